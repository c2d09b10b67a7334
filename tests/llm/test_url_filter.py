from pyspark.sql import functions as F

from tests.helpers import same
from tracewell.llm import queries, url_filter


def test_sql(spark):
    same(queries.op6_url_filter(spark, "/root/testdata/sf0.001"), queries.OP6_SQL)


def test_sql_over_more_rows(spark):
    same(queries.op6_url_filter(spark, "/root/testdata/sf0.01"), queries.OP6_SQL, "/root/testdata/sf0.01")


def run(spark, urls, labels=(), **more):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    found = url_filter.judged(pages, spark.createDataFrame(list(labels), "page_id long, bad boolean"), **more).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in found]


def test_urls_and_rules(spark):
    urls = ["HTTP://A.Example.ORG/es/x?q#f", "x://example.org/en/12", "x://example.org/en/2", "x://notexample.org/es/", "x://É.com/de/?a", "x://a.com/fr/b#c", "x://com/de", "no scheme", None, "a://b://c/d", "x://h", "x:///p", "x://org"]
    assert run(spark, urls) == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("notexample.org", "/es/", "org/", "allow"),
        ("É.com", "/de/", "com/de/", "block"), ("a.com", "/fr/b", "com/fr/", "allow"), ("com", "/de", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("h", "", None, "allow"), ("", "/p", None, "allow"), ("org", "", None, "allow"),
    ]


def test_reputation(spark):
    urls = [f"x://bad.net/{i}" for i in range(60)] + [f"x://good.net/{i}" for i in range(60)] + [f"x://new{i}.net/" for i in range(3)] + ["x://sub.bad.net/"]
    labels = [(i, i < 60) for i in range(120)] + [(0, True), (500, True), (1, None)]
    got = run(spark, urls, labels)
    assert {g[3] for g in got[:60]} == {"block"} and {g[3] for g in got[60:123]} == {"allow"} and got[123][3] == "block"


def test_lone_bad_hosts_among_clean_ones(spark):
    """20 of 20, 36 of 40 and 80 of 100 bad pages condemn a host among 60 clean ones; 3 of 20 and 40 of 100 don't."""
    hosts = {"a": (20, 20), "b": (36, 40), "c": (80, 100), "d": (3, 20), "e": (40, 100)} | {f"clean{i}": (i % 3, 30) for i in range(60)}
    urls, labels = [], []
    for h, (bad, n) in hosts.items():
        for i in range(n):
            labels.append((len(urls), i < bad))
            urls.append(f"x://{h}.net/{i}")
    verdicts = {}
    for host, _, _, v in run(spark, urls, labels):
        verdicts[host.split(".")[0]] = v
    assert {h for h, v in verdicts.items() if v == "block"} == {"a", "b", "c"}


def plain_roll_up(host, rules):
    p = host.split(".")
    best = (0, 1)
    for i in range(len(p)):
        t = ".".join(p[i:])
        if "!" + t in rules:
            best = max(best, (1, len(p) - i - 1))
        if t in rules or (i + 1 < len(p) and "*." + ".".join(p[i + 1 :]) in rules):
            best = max(best, (0, len(p) - i))
    return ".".join(p[-best[1] :]), ".".join(p[-best[1] - 1 :])


def test_suffix_rules(spark):
    rules = ["com", "co.uk", "*.ck", "!www.ck", "*.b.c.d", "c.d"]
    hosts = ["a.com", "com", "x.y.co.uk", "co.uk", "a.b.ck", "b.ck", "ck", "www.ck", "q.www.ck", "1.2.b.c.d", "b.c.d", "z.c.d", "odd.zz", "", "a..com"]
    table = spark.createDataFrame([(r,) for r in rules], "suffix_rule string")
    for given in (rules, table):
        got = {r.host: (r.suffix, r.domain) for r in url_filter.rolled_up(spark.createDataFrame([(h, 1) for h in hosts], "host string, n int"), given).collect()}
        assert got == {h: plain_roll_up(h, rules) for h in hosts}


def test_shrinkage(spark):
    """One bad page out of one doesn't condemn a host; the same share of many does."""
    urls = ["x://a.one.net/"] + [f"x://b.two.net/{i}" for i in range(200)] + [f"x://c{i // 10}.net/" for i in range(1000)]
    got = run(spark, urls, [(i, i < 201 or i % 10 == 0) for i in range(1201)])
    assert got[0][3] == "allow" and got[5][3] == "block"


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, ["x://a.b/"], rules=spark.createDataFrame([], "rule_host string, rule_path string, verdict string"))[0][3] == "allow"


def test_sites(spark):
    """User, port and final dots don't part a site's outcomes; addresses with a common end aren't pooled."""
    rows = spark.createDataFrame([(h,) for h in ("me@a.example.com:8080", "a.example.com.", "10.0.0.1:80", "8.9.0.1", "[2001:db8::1]:443", "example.co.uk.:1", "")], "host string").withColumn("host", url_filter.site_of(F.col("host")))
    got = {(r.host, r.suffix, r.domain) for r in url_filter.rolled_up(rows).collect()}
    assert got == {("a.example.com", "com", "example.com"), ("10.0.0.1",) * 3, ("8.9.0.1",) * 3, ("[2001:db8::1]",) * 3, ("example.co.uk", "co.uk", "example.co.uk"), ("", "", "")}
    urls = [f"x://10.0.0.1:{i}/" for i in range(40)] + [f"x://8.9.0.1/{i}" for i in range(5)] + [f"x://u{i}@good.net./" for i in range(40)]
    found = run(spark, urls, [(i, i < 40) for i in range(85)])
    assert {f[3] for f in found[:40]} == {"block"} and {f[3] for f in found[40:]} == {"allow"} and found[3][0] == "10.0.0.1:3"


def test_sql_with_ports_and_addresses(spark, tmp_path):
    hosts = [("u@bad.net:81", 1), ("bad.net.", 1), ("bad.net", 1), ("10.1.2.3:8", 1), ("9.9.2.3", 0), ("ok.co.uk", 0), ("[::1]:9", 0)]
    pages = [(i, f"http://{h}/p{i}", "") for i, (h, _) in enumerate(hosts * 12)]
    labels = [(i, 1, b) for i, (_, b) in enumerate(hosts * 12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    same(queries.op6_url_filter(spark, str(tmp_path)), queries.OP6_SQL, str(tmp_path))
