"""Operator 6, URL filters with empirical-Bayes host reputation. Built-in functions throughout.

Every page has a host; hosts belong to registered domains and these to public suffixes. Labelled outcomes (bad or not)
are counted by host and rolled up. A level's counts are shrunk towards its parent's mean: posterior = Beta(s m + bad,
s (1 - m) + good) with m the parent's posterior mean and s the prior strength: that of the level, estimated by moments
from the spread of all its groups around their parents, weakened by the parent's own uncertainty. A host is blocked if its bad rate exceeds ``limit`` even at the lower
posterior bound (mean - z sd) of 0.5, that is, if its pages are surely more likely bad than good; so a host without labels, or with few, is blocked only on its domain's record.

Rules come first. A rule (host, path) fits its host and all subdomains, for paths that start with its path; of those
that fit, the longest decides. Rules are looked up for distinct hosts, by equality on the host's suffixes; only a
host's own few rules go to its pages, with its verdict, in one join that adaptive execution may split.

Reputation is kept by site: hosts that differ in user, port or final dots only are one, and an address (10.0.0.1) belongs to
no domain. Rules look at the host as it stands in the url.

Edge cases. Null url or none with "://": host and path empty, no rule unless one has an empty host, verdict by the
overall record. Ties between rules of one length: the one that sorts last. Repeated rows give one row each; a page id
with several labels counts each. Null labels don't count. Extra columns are ignored. Empty tables give empty results;
without labels nothing is blocked by reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import Scratch, broadcast_if_small

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Rules for public suffixes where the caller gives no table of them: some of two labels; all others have one.
SUFFIXES = ["ac.uk", "co.jp", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk"]
#: A host goes when its page is more likely bad than not, even at the lower bound.
LIMIT, Z, PRIOR = 0.5, 2.0, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


#: Numbers and dots, or brackets, as addresses have them.
ADDRESS = "^([0-9]{1,3}([.][0-9]{1,3}){3}|\\[.*\\])$"


def site_of(host: Column) -> Column:
    """What a host's reputation is kept under: without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def rolled_up(hosts: DataFrame, suffixes: list[str] | DataFrame = SUFFIXES) -> DataFrame:
    """``hosts`` (host and any columns) with suffix and domain, by rules for public suffixes.

    A rule is a suffix (``co.uk``), a wildcard for one more label (``*.ck``) or an exception to one (``!www.ck``, whose
    suffix is ck). The exception wins, else the longest; without a rule the suffix is the last label. The domain has one
    label more, or is the host where that has none more. An address is its own suffix and domain.
    """
    spark = hosts.sparkSession
    rules = suffixes if isinstance(suffixes, DataFrame) else spark.createDataFrame([(x,) for x in suffixes], "suffix_rule string")
    rules = rules.select("suffix_rule").distinct()
    parts = F.split("host", "\\.")
    tail = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    # of each tail of labels the three forms a rule for it may have, with the labels of the suffix that it gives
    forms = lambda i: F.array(
        F.struct(tail(i).alias("r"), (F.size(parts) - i + 1).alias("labels"), F.lit(0).alias("strong")), F.struct(F.concat(F.lit("*."), tail(i + 1)).alias("r"), (F.size(parts) - i + 1).alias("labels"), F.lit(0).alias("strong")),
        F.struct(F.concat(F.lit("!"), tail(i)).alias("r"), (F.size(parts) - i).alias("labels"), F.lit(1).alias("strong")),
    )
    asked = hosts.select("host").distinct().select("host", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), forms))).alias("f"))
    size = rules.agg(F.sum(F.length("suffix_rule") + 32)).first()[0] or 0
    fit = asked.join(broadcast_if_small(rules, size), F.col("f.r") == F.col("suffix_rule")).groupBy("host").agg(F.max(F.struct("f.strong", "f.labels")).alias("best"))
    labels = F.coalesce(F.col("best.labels"), F.lit(1))
    out = hosts.join(fit, "host", "left")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    address = F.col("host").rlike(ADDRESS)
    return out.withColumn("suffix", F.when(address, F.col("host")).otherwise(last(labels))).withColumn("domain", F.when(address, F.col("host")).otherwise(last(labels + 1))).drop("best")


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` (n, bad, m, k) with the posterior's a and b.

    The level has one strength; a group's prior is no stronger than what its parent's posterior, worth k outcomes, knows.
    """
    spread = "coalesce(sum(pow(bad - n * m, 2) / n / greatest(m * (1 - m), 1e-9)), 0D)"
    rho = F.expr(f"CASE WHEN sum(n) > count(*) THEN least(greatest(({spread} - count(*)) / (sum(n) - count(*)), 1e-4), 0.99) ELSE 1e-4 END")
    level = groups.where("n > 0").agg(rho.alias("rho"))
    return groups.join(F.broadcast(level)).withColumn("s", F.expr("1 / (rho / (1 - rho) + 1 / k)")).withColumn("a", F.expr("s * m + bad")).withColumn("b", F.expr("s * (1 - m) + n - bad")).drop("rho", "s", "m", "k")  # one row


def reputations(hosts: DataFrame, scratch: Scratch, suffixes: list[str] | DataFrame = SUFFIXES) -> DataFrame:
    """(host, n, bad, a, b) from (host, n, bad): Beta posteriors of the bad rate."""
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    rolled = scratch.table(rolled_up(hosts, suffixes))
    domains = scratch.table(rolled.groupBy("domain", "suffix").agg(*sums))
    top = domains.agg(*sums).select(((F.coalesce("bad", F.lit(0)) + PRIOR * 0.5) / (F.coalesce("n", F.lit(0)) + PRIOR)).alias("m"), (F.coalesce("n", F.lit(0)) + F.lit(PRIOR)).alias("k"))
    suffixes = _shrunk(domains.groupBy("suffix").agg(*sums).join(F.broadcast(top)))  # one row
    of_suffix = suffixes.select("suffix", F.expr("a / (a + b)").alias("m"), F.expr("a + b").alias("k"))
    of_domain = scratch.table(_shrunk(domains.join(of_suffix, "suffix")).select("domain", F.expr("a / (a + b)").alias("m"), F.expr("a + b").alias("k")))
    return _shrunk(rolled.join(of_domain, "domain")).select("host", "n", "bad", "a", "b")


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, limit: float = LIMIT, z: float = Z, id_col: str = "page_id", suffixes: list[str] | DataFrame = SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate, lower_bound.

    ``labels``: page_id, bad (boolean). ``suffixes``: rules for public suffixes, a list or a table (suffix_rule).
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "url-filter")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    outcomes = labels.select("page_id", F.col("bad").cast("long").alias("bad")).where("bad IS NOT NULL")
    counts = urls.select("page_id", site_of(F.col("host")).alias("site")).join(outcomes, "page_id").groupBy("site").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = scratch.table(urls.select("host").distinct().withColumn("site", site_of(F.col("host"))))
    sites = scratch.table(hosts.select("site").distinct().join(counts, "site", "left").fillna(0, ["n", "bad"]).withColumnRenamed("site", "host"))

    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    parts = F.split("host", "\\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rule_host"))
    rule = F.struct((F.length("rule_host") + F.length("rule_path")).alias("len"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("prefix"), "verdict")
    fitting = above.join(rules.dropDuplicates(), "rule_host").groupBy("host").agg(F.collect_list(rule).alias("rules"))

    rate, sd = F.expr("a / (a + b)"), F.expr("sqrt(a * b / (pow(a + b, 2) * (a + b + 1)))")
    known = hosts.join(reputations(sites, scratch, suffixes).withColumnRenamed("host", "site"), "site").select("host", rate.alias("bad_rate"), (rate - z * sd).alias("lower_bound")).join(fitting, "host", "left")
    known = scratch.table(known)
    size = known.agg(F.sum(F.length("host") + 32 + 128 * F.size(F.coalesce("rules", F.array())))).first()[0] or 0
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r.prefix)))
    out = urls.join(broadcast_if_small(known, size), "host").withColumn("best", best)
    verdict = F.coalesce("best.verdict", F.when(F.col("lower_bound") > limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "lower_bound")
