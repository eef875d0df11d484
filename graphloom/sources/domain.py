"""The driver's tables as symbols and relations. Definitions are SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2002-01-01"

DEFINITIONS = {
    "methods": """SELECT concat('Part', CAST(l_partkey AS STRING)) AS owner, concat('op_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS name,
        l_orderkey, l_suppkey, CAST(l_linenumber AS INT) AS branches, CAST(l_quantity AS INT) % 5 AS loops, CAST(l_quantity AS INT) % 3 AS conditionals, CAST(l_quantity AS INT) AS body_lines,
        CASE l_returnflag WHEN 'R' THEN 'private' WHEN 'A' THEN 'protected' ELSE 'public' END AS visibility, CASE l_linestatus WHEN 'F' THEN 'class' ELSE 'instance' END AS scope,
        round(l_discount * 1000, 2) AS test_coverage, round(l_tax * 1000, 2) AS doc_coverage, CAST(l_shipdate AS DATE) AS changed, l_extendedprice AS price
        FROM {lineitem}""",
    "classes": """SELECT concat('Part', CAST(p_partkey AS STRING)) AS name, concat(p_brand, '::Part', CAST(p_partkey AS STRING)) AS fqname, p_brand AS namespace,
        CASE WHEN p_partkey > 0 THEN concat('Part', CAST(CAST(floor(p_partkey / 2.0) AS BIGINT) AS STRING)) END AS superclass, p_partkey, CAST(p_size AS INT) AS size,
        p_type AS type, concat(lower(replace(p_type, ' ', '_')), '/part_', CAST(p_partkey AS STRING), '.rb') AS file, p_retailprice AS price
        FROM {part}""",
    "tree": """SELECT r_name AS fqname, CAST(NULL AS STRING) AS superclass, 'module' AS type FROM {region}
        UNION ALL SELECT concat(r_name, '::', n_name), r_name, 'class' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL SELECT concat(r_name, '::', n_name, '::', s_name), concat(r_name, '::', n_name), 'class' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL SELECT concat(r_name, '::', n_name, '::', c_name), concat(r_name, '::', n_name), 'class' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "inherits": """SELECT concat('Part', CAST(p_partkey AS STRING)) AS src, concat('Part', CAST(CAST(floor(p_partkey / 2.0) AS BIGINT) AS STRING)) AS dst FROM {part} WHERE p_partkey > 0""",
    "depends": """SELECT concat('Part', CAST(l_partkey AS STRING)) AS src, concat('Supplier', CAST(l_suppkey AS STRING)) AS dst, count(*) AS weight FROM {lineitem} GROUP BY 1, 2""",
    "calls": """SELECT src, dst, count(*) AS weight FROM (
        SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events}) x WHERE dst IS NOT NULL GROUP BY 1, 2""",
    "speaks": """SELECT concat(role, CAST(turn AS STRING)) AS src, lead(concat(role, CAST(turn AS STRING))) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM {conversations}""",
    "orders": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'static' WHEN '2-HIGH' THEN 'runtime' WHEN '3-MEDIUM' THEN 'rbs' WHEN '5-LOW' THEN 'yard' ELSE 'inferred' END AS source FROM {orders}""",
    "texts": "SELECT doc_id, text, lang, source FROM {documents}",
    "labels": "SELECT doc_id, quality, toxic FROM {labels}",
    "symbols": "SELECT item_id, text AS name FROM {benchmark}",
    "suppliers": "SELECT concat('Supplier', CAST(s_suppkey AS STRING)) AS name, CAST(s_nationkey AS INT) AS nation, s_acctbal AS balance FROM {supplier}",
    "items": "SELECT * FROM {lineitem}",
    "pages": "SELECT page_id, url, html FROM {pages}",
    "customers": "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM {customer}",
    "placed": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM {orders}",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", DEFINITIONS[name]))


def with_tables(sql: str) -> str:
    """DuckDB SQL with the definitions that it mentions as @name put in front."""
    used = list(dict.fromkeys(re.findall(r"@(\w+)", sql)))
    ctes = [f"d_{n} AS ({re.sub(r'\{(\w+)\}', lambda m: m[1], DEFINITIONS[n])})" for n in used]
    body = re.sub(r"@(\w+)", lambda m: f"d_{m[1]}", sql).strip()
    if not ctes:
        return body
    if re.match(r"(?i)with recursive\s", body):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[14:].lstrip()
    if re.match(r"(?i)with\s", body):
        return "WITH " + ", ".join(ctes) + ", " + body[4:].lstrip()
    return "WITH " + ", ".join(ctes) + " " + body
