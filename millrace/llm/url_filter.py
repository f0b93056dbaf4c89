"""Operator 2: URL filters, by rules and by trust and distrust that flow along links between hosts.

Trust is a personalised PageRank from hosts whose pages the rules allow; distrust is one on the reversed links from
hosts whose pages they block. A page that no rule fits gets its host's verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import sized_broadcast, table, written

#: Fixed values: (host, path, verdict) of the rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Ranks are iterated until they change by less than TOLERANCE of all mass, some 130 rounds; MOST_ROUNDS end in an error.
DAMPING, TOLERANCE, MOST_ROUNDS, ROUNDS_A_LOOK = 0.85, 1e-9, 500, 8
#: A host is blocked if its distrust is more than so many times its trust.
RATIO = 1.0


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule (host and path as one string) that fits; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Each host meets the rules of its
    suffixes by equality, once; its pages then choose among these. Of rules equally long, the smaller string, then block.
    """
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    rule = F.concat("rule_host", "rule_path")
    order = F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("kind"), "verdict", "rule_path")
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    fitting = written(hosts.join(sized_broadcast(rules), "rule_host").groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("fitting")), "host_rules")
    found = urls.join(sized_broadcast(fitting), "host", "left")
    best = F.try_element_at(F.filter("fitting", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(1))
    return found.withColumns({"rule": best["rule"], "rule_verdict": best["verdict"]}).select(*urls.columns, "rule", "rule_verdict")


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, with the number of times they occur on the pages."""
    targets = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#>\s]+)"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).withColumn("dst", F.lower("dst"))
    return links.filter("src != dst and src != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def personalised_pagerank(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, rank) for links (src, dst, weight) and seeds (node, mass > 0). Ranks sum to 1, or there are none without seeds.

    What a node without links holds goes back to the seeds. Nodes that no walk reaches are left out. Iterated until the
    ranks change by less than the tolerance in all; if most_rounds do not suffice, that is an error.
    """
    total = seeds.agg(F.sum("mass")).first()[0]
    if not total:
        return seeds.select("node", F.lit(0.0).alias("rank")).limit(0)
    seeds = written(seeds.groupBy("node").agg((F.sum("mass") / F.lit(total)).alias("seed")), "seeds")
    out = links.groupBy("src").agg(F.sum("weight").alias("out"))
    steps = written(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "links")
    ranks = seeds.select("node", F.col("seed").alias("rank"))
    if steps.isEmpty():
        return ranks
    for k in range(1, most_rounds + 1):
        moved = ranks.join(steps, ranks.node == steps.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("moved"))
        joined = moved.join(seeds, moved.dst == seeds.node, "full_outer")
        joined = joined.select(F.coalesce("dst", "node").alias("node"), F.coalesce("moved", F.lit(0.0)).alias("moved"), F.coalesce("seed", F.lit(0.0)).alias("seed"))
        # written each round: plans stay short, and a lost executor costs one round
        joined = written(joined.select("node", "seed", (damping * F.col("moved") + (1 - damping) * F.col("seed")).alias("rank")), "ranks")
        lost = 1.0 - joined.agg(F.sum("rank")).first()[0]
        last, ranks = ranks, joined.select("node", (F.col("rank") + lost * F.col("seed")).alias("rank"))
        if k % ROUNDS_A_LOOK == 0:
            change = ranks.join(last.withColumnRenamed("rank", "before"), "node", "full_outer").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))))).first()[0]
            if change < tolerance:
                return ranks
    raise RuntimeError(f"ranks did not settle in {most_rounds} rounds")


def host_verdicts(judged: DataFrame, links: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust, verdict) for every host of the judged pages (host, rule_verdict).

    Seeds are hosts by the share of their rule-judged pages that are allowed, or blocked. Trust and distrust are
    ranks times the number of hosts that have any, so that 1 is the mean. Hosts with neither are allowed.
    """
    share = lambda what: F.try_divide(F.count(F.when(F.col("rule_verdict") == what, 1)), F.count("rule_verdict")).alias(what)
    hosts = written(judged.groupBy("host").agg(share("allow"), share("block")), "hosts")
    seeds = lambda what: hosts.filter((F.col(what) > 0) & (F.col("host") != "")).select(F.col("host").alias("node"), F.col(what).alias("mass"))
    trust = personalised_pagerank(links, seeds("allow"))
    distrust = personalised_pagerank(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), seeds("block"))
    scaled = lambda ranks, name: ranks.select(F.col("node").alias("host"), (F.col("rank") * F.lit(float(ranks.count()))).alias(name))
    found = hosts.select("host").join(scaled(trust, "trust"), "host", "left").join(scaled(distrust, "distrust"), "host", "left").na.fill(0.0, ["trust", "distrust"])
    return found.withColumn("verdict", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages (without html) and host, path, rule, verdict, host_verdict, trust, distrust; such columns are replaced.

    A null or odd url has an empty host, fits no rule and is allowed. Repeated rows give repeated results. Of rules
    that fit equally long, the smaller string counts, then block.
    """
    added = ["host", "path", "rule", "rule_verdict", "verdict", "host_verdict", "trust", "distrust", "fitting"]
    pages = with_host_path(pages.drop(*[c for c in added if c not in (url, html)]), url)
    judged = written(match_rules(pages.drop(html), rules), "judged")
    links = written(host_links(pages.select("host", html), html), "host_links")
    hosts = host_verdicts(judged, links).withColumnRenamed("verdict", "host_verdict")
    return judged.join(sized_broadcast(written(hosts, "verdicts")), "host", "left").withColumn("verdict", F.coalesce("rule_verdict", "host_verdict")).drop("rule_verdict")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE_SQL: dict[str, str] = {}
