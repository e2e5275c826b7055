"""URL filters by rules and, where no rule fits, by link-graph propagation, in DataFrame functions only.

A rule names a host with all its subdomains and the begin of a path; the longest that fits decides. Hosts of pages that
rules allow are trusted, hosts of pages that rules block are distrusted, each by the share of such pages. Trust flows
along links (personalised PageRank from the trusted hosts), distrust flows against them, to hosts that link to blocked
ones: each gets the mean distrust of the hosts that it links to, so it counts what share of its links leads there and not how
many others link there too. A page without a rule is blocked if its host's distrust, less its trust, reaches the threshold:
half of what a wholly blocked host has before any flow.

Links are the hosts in href attributes of the pages, and those between a host and the host one label up, if both have
pages. Hosts that only links name take part. A null or malformed url has an empty host, no rule and is allowed; null
html has no links. Repeated rows are pages of their own, an empty table gives no row, other columns play no part. The number of rounds is fixed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from manyfold.llm.common import hot_keys, lookup, spread_join
from manyfold.sources.settled import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/\"'?#\s>]+)"
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit(""))
    rest = F.substring(after, F.length(host) + 1, F.length(url))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, n_ and the rules whose host it lies under, longest first, for the hosts that have any."""
    rules = rules.withColumn("at", F.instr("rule", "/")).select(
        "rule", "verdict", F.expr("substr(rule, 1, at - 1)").alias("end"), F.expr("substr(rule, at)").alias("start")
    )
    # Only so many last labels of a host can meet a rule.
    depth = rules.agg(F.max(F.size(F.split("end", r"\.")))).first()[0] or 1
    labels = F.split(F.substring_index("host", ".", -depth), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = hosts.select("host", "n_", F.explode(ends).alias("end")).join(rules, "end")
    order = F.struct((-F.length("rule")).alias("length"), "rule", "start", "verdict")
    return own.groupBy("host").agg(F.min("n_").alias("n_"), F.sort_array(F.collect_list(order)).alias("rules"))


def parent(host: Column) -> Column:
    return F.substring(host, F.locate(".", host) + 1, F.length(host))


def link_graph(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst: each pair of different hosts once. Pages have columns host and html."""
    named = F.transform(F.regexp_extract_all("html", F.lit(HREF), 1), lambda h: F.translate(h, UPPER, LOWER))
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(named)).alias("dst"))
    names = hosts.select("host")
    up = names.filter(F.instr("host", ".") > 0).select(F.col("host").alias("src"), parent(F.col("host")).alias("dst"))
    up = up.join(names, F.col("dst") == F.col("host"), "left_semi")
    pairs = linked.union(up).union(up.select("dst", "src"))
    return pairs.filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust after so many rounds, from seeds (host, trust, distrust)."""
    edges = settle(edges, "host-links")
    out = settle(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_")), "links-out")
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_"))
    hot_out, hot_in = hot_keys(out, ["src"], "n_"), hot_keys(into, ["dst"], "n_")
    edges = settle(spread_join(edges, out, ["src"], "dst", hot_out), "host-links")
    none = F.lit(0.0)
    share = F.lit(damping) / F.col("n_")
    given = seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    given = settle(given, "seeds")
    scores = given
    for _ in range(rounds):
        trust, doubt = (scores.select(F.col("host").alias(end), F.col(c).alias("sent")) for end, c in (("src", "trust"), ("dst", "distrust")))
        forward = spread_join(edges, trust, ["src"], "dst", hot_out).select(F.col("dst").alias("host"), (share * F.col("sent")).alias("sent"), none)
        back = spread_join(edges, doubt, ["dst"], "src", hot_in).select(F.col("src").alias("host"), none, (share * F.col("sent")).alias("sent"))
        heard = given.union(forward).union(back).groupBy("host")
        scores = settle(heard.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "scores")
    return scores


def filter_urls(pages: DataFrame, rules: DataFrame, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page. Rules have columns rule and verdict."""
    host, path = host_and_path(F.col("url"))
    thin = settle(pages.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url").alias("spread")), "pages")
    hosts = settle(thin.groupBy("host").agg(F.count(F.lit(1)).alias("n_")), "hosts")
    ruled = lookup(thin, host_rules(hosts, rules), ["host"], ["rules"], "n_", "spread")
    fits = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    ruled = ruled.withColumn("fit", fits).select("page_id", "host", "path", "spread", "fit.rule", "fit.verdict")

    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    seeds = ruled.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    linked = pages.select(host.alias("host"), "html")
    scores = propagate(seeds, link_graph(linked, hosts), damping, rounds)
    bad = F.col("distrust") - F.col("trust") >= threshold * (1 - damping)
    judged = scores.join(hosts, "host").select("host", "n_", F.when(bad & (F.col("host") != ""), "block").otherwise("allow").alias("by_host"))
    both = lookup(ruled, judged, ["host"], ["by_host"], "n_", "spread")
    return both.select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_host").alias("verdict"))
