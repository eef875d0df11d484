from graphloom.llm.urls import RULES, decide, malformed, rules_table


def brute(url, rules):
    if not url:
        return ("none", None)
    rest = url.strip(" ").split("#")[0]
    if "://" in rest and rest.split("://")[0].replace("+", "").replace("-", "").replace(".", "").isalnum():
        rest = rest.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?" if c in rest], default=len(rest))
    host, full = rest[:cut].lower(), rest[cut:] if rest[cut:].startswith("/") else "/" + rest[cut:]
    host = host.split("@")[-1]
    head, _, port = host.rpartition(":")
    host = (head if head and (port.isdigit() or not port) else host).rstrip(".")
    path, best = full.split("?")[0], None
    for rule, action, e in rules:
        if e is None or action is None:
            continue
        h, p = e.split("/", 1)
        p = "/" + p
        if (host == h or host.endswith("." + h)) and (p in (full, path) or (p.endswith("/") and path.startswith(p))):
            key = (len(h), len(e), action == "allow", -rule)
            if best is None or key > best[0]:
                best = (key, action, rule)
    return (best[1], best[2]) if best else ("none", None)


URLS = [
    None, "", "   ", "http://", "https://free-bets.example.com/", "https://FREE-BETS.example.com./en/x?y#z", "free-bets.example.com", "http://u:p@m.free-bets.example.com:8080/a",
    "https://www.example.net/es/a", "https://example.net/es", "https://example.net/es/", "https://badexample.net/es/", "https://a.b.c.d.example.org/de/x/y/z", "https://ththnd.example.net/en/?page=1",
    "https://ththnd.example.net/en/?page=2", "ftp://blog.example.com/ads/tracking/" + "x/" * 3000, "https://blog.tionsh.example.net/fr/1", "https://free-bets.example.com/?q=1", "//x", "https://free-bets.example.com/en",
]


def test_matches_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS)] + [(99, URLS[4], "extra"), (99, URLS[4], "extra"), (None, URLS[4], None)], "page_id bigint, url string, rule string")
    got = decide(pages, rules_table(spark)).collect()
    assert len(got) == len(URLS) + 3
    assert [(r.url, r.action, r.rule) for r in got if (r.action, r.rule) != brute(r.url, RULES)] == []


def test_rules_with_nulls_and_none(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x/")], "page_id bigint, url string")
    some = spark.createDataFrame([(1, None, "a.example/"), (2, "block", None), (3, "block", "example/"), (4, "allow", "example/")], "rule int, action string, expression string")
    assert decide(pages, some).select("action", "rule").collect()[0] == ("allow", 4)
    assert decide(pages, some.limit(0)).select("action", "rule").collect()[0] == ("none", None)
    assert decide(pages.limit(0), some).count() == 0


def test_rules_are_normalized_and_malformed_ones_reported(spark):
    rules = spark.createDataFrame([(1, "block", "Bad.Example.com/"), (2, "block", "other.example.com"), (3, "block", "/path/"), (4, "deny", "x.example/"), (5, "block", "http://Third.Example./a/"), (6, "block", "3.4/")], "rule int, action string, expression string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.bad.example.com/x", "https://OTHER.example.com", "http://third.example/a/b", "http://x.example/", "http://1.2.3.4/", "http://a.3.4/"])], "__ur int, url string")
    got = {r["__ur"]: (r.action, r.rule) for r in decide(pages, rules).collect()}
    assert got == {0: ("block", 1), 1: ("block", 2), 2: ("block", 5), 3: ("none", None), 4: ("none", None), 5: ("block", 6)}
    assert sorted(r.rule for r in malformed(rules).collect()) == [3, 4]
    names = spark.createDataFrame([(1, "http://a.bad.example.com/", "b", 2, "c")], "u int, url string, action string, k int, `short` string")
    assert decide(names, rules).collect()[0].asDict() == {"u": 1, "url": "http://a.bad.example.com/", "k": 2, "short": "c", "action": "block", "rule": 1}
