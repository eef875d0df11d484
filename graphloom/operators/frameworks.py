"""Models and controllers of a web framework, from the declarations in class bodies (path, name, namespace, target, options)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N

ASSOCIATIONS = ["belongs_to", "has_one", "has_many", "has_and_belongs_to_many"]
VALIDATIONS = ["validates", "validate", "validates_presence_of", "validates_uniqueness_of"]
CALLBACKS = [f"{w}_{e}" for w in ("before", "after", "around") for e in ("save", "create", "update", "destroy", "validation", "commit")] + ["after_initialize"]
SCOPES = ["scope", "default_scope"]
FILTERS = ["before_action", "after_action", "around_action", "skip_before_action"]
#: action: (verb, path behind the resource)
REST = {"index": ("GET", ""), "show": ("GET", "/:id"), "new": ("GET", "/new"), "create": ("POST", ""), "edit": ("GET", "/:id/edit"), "update": ("PATCH", "/:id"), "destroy": ("DELETE", "/:id")}


def _n(names: list[str]) -> Column:
    return F.count_if(F.col("name").isin(names))


def model_info(patterns: DataFrame, classes: DataFrame) -> DataFrame:
    """(fqname, table, associations, validations, callbacks, scopes, complexity, issues) of classes that descend directly from a model base."""
    p = patterns.groupBy(F.col("namespace").alias("fqname")).agg(
        _n(ASSOCIATIONS).alias("associations"), _n(VALIDATIONS).alias("validations"), _n(CALLBACKS).alias("callbacks"), _n(SCOPES).alias("scopes"),
        F.count_if(F.startswith("name", F.lit("around_"))).alias("around"), F.count_if(F.col("name") == "default_scope").alias("default_scopes"),
        F.count_if(F.coalesce(F.contains("options", F.lit("through")), F.lit(False))).alias("through"),
    )
    counts = ["associations", "validations", "callbacks", "scopes", "around", "default_scopes", "through"]
    m = classes.where(N.rails_type("superclass") == "model").select("fqname").join(p, "fqname", "left").fillna(0, counts)
    cx = F.least(F.expr("2 * associations + validations + 3 * callbacks + scopes + 5 * around + 3 * through + 2 * default_scopes"), F.lit(100)).cast("int")
    signs = [
        (F.col("associations") > 5, "many_associations"), (F.col("callbacks") > 10, "many_callbacks"), (F.col("default_scopes") > 0, "default_scope"),
        (F.col("validations") == 0, "no_validations"),
    ]
    issues = F.filter(F.array(*[F.when(hit, F.lit(k)) for hit, k in signs]), lambda x: x.isNotNull())
    return m.select("fqname", N.table_name("fqname").alias("table"), "associations", "validations", "callbacks", "scopes", cx.alias("complexity"), issues.alias("issues"))


def associations(patterns: DataFrame) -> DataFrame:
    """(fqname, kind, name, class_name): the class is the name in singular, in camel case."""
    plural = F.col("name").isin("has_many", "has_and_belongs_to_many")
    one = F.when(plural, singular(F.col("target"))).otherwise(F.col("target"))
    return patterns.where(F.col("name").isin(ASSOCIATIONS)).select(F.col("namespace").alias("fqname"), F.col("name").alias("kind"), F.col("target").alias("name"), camelize(one).alias("class_name"))


def singular(word: Column) -> Column:
    return (
        F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


def camelize(word: Column) -> Column:
    return F.array_join(F.transform(F.split(word, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2), F.length(w)))), "")


def routes(spark) -> DataFrame:
    return spark.createDataFrame([(a, v, p) for a, (v, p) in REST.items()], "action string, verb string, suffix string")


def controller_info(classes: DataFrame, methods: DataFrame, patterns: DataFrame) -> DataFrame:
    """(fqname, actions, rest_actions, filters, rescues, compliance, complexity, issues) of classes that descend directly from a controller base; actions are public instance methods."""
    c = classes.where(N.rails_type("superclass") == "controller").select("fqname")
    rest = F.col("name").isin(list(REST))
    a = methods.where("visibility = 'public' and receiver_type = 'instance'").groupBy(F.col("owner").alias("fqname")).agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(rest).alias("rest_actions"), F.sum("complexity").alias("cx"), F.max("complexity").alias("worst"),
        F.count_if(F.col("name").isin("create", "update")).alias("writes"),
    )
    strong = methods.groupBy(F.col("owner").alias("fqname")).agg(F.count_if(F.endswith("name", F.lit("_params"))).alias("strong"))
    p = patterns.groupBy(F.col("namespace").alias("fqname")).agg(
        _n(FILTERS).alias("filters"), F.count_if(F.col("name") == "rescue_from").alias("rescues"), F.count_if((F.col("name") == "before_action") & F.col("target").rlike("auth|login|sign")).alias("auth"),
    )
    counts = ["actions", "rest_actions", "cx", "worst", "writes", "strong", "filters", "rescues", "auth"]
    j = c.join(a, "fqname", "left").join(strong, "fqname", "left").join(p, "fqname", "left").fillna(0, counts)
    compliance = F.round(0.6 * F.col("rest_actions") / 7 + 0.4 * F.coalesce(F.try_divide(F.col("rest_actions"), F.col("actions")), F.lit(0.0)), 2)
    j = j.withColumn("compliance", compliance)
    cx = F.least(F.expr("2 * actions + 3 * filters + cx + 2 * (actions - rest_actions)"), F.lit(100)).cast("int")
    signs = [
        (F.col("worst") > 10, "complex_action"), ((F.col("writes") > 0) & (F.col("strong") == 0), "no_strong_params"), ((F.col("auth") == 0) & ~F.col("fqname").rlike("Public|Session"), "no_authentication"),
        (F.col("compliance") < 0.5, "not_restful"), ((F.col("actions") > 3) & (F.col("rescues") == 0), "no_rescue"),
    ]
    issues = F.filter(F.array(*[F.when(hit, F.lit(k)) for hit, k in signs]), lambda x: x.isNotNull())
    return j.select("fqname", "actions", "rest_actions", "filters", "rescues", "compliance", cx.alias("complexity"), issues.alias("issues"))


def action_routes(controllers: DataFrame, methods: DataFrame) -> DataFrame:
    """(fqname, action, verb, path): the conventional route of each REST action."""
    r = routes(controllers.sparkSession)
    m = methods.where("visibility = 'public'").select(F.col("owner").alias("fqname"), F.col("name").alias("action"))
    j = controllers.select("fqname").join(m, "fqname").join(F.broadcast(r), "action")  # seven rows, whatever the data
    return j.select("fqname", "action", "verb", F.concat(F.lit("/"), N.resource_name("fqname"), "suffix").alias("path"))
