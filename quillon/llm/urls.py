"""URL filters: rules first, then trust and distrust spread over the graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, guarded, materialise

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links of a page: href values, quoted or bare.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
DAMPING, ROUNDS = 0.85, 10
#: Ranks have converged when a round adds less than this to their sum, which nears at most 1.
TOLERANCE = 1e-9
#: A host is blocked if its distrust is more than this many times its trust.
BALANCE = 1.0


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. All rules are one CASE."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """Edges (src, dst, n) between different hosts, from pages (host, html).

    Relative links stay on their host and say nothing about another, so they are not edges.
    Each page's hosts are made distinct before the shuffle, and counts are summed map-side.
    """
    absolute = F.filter(F.regexp_extract_all("html", F.lit(HREF), 1), lambda u: u.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    dst = F.array_distinct(F.transform(absolute, lambda u: F.translate(F.regexp_extract(u, r"//([^/?#]*)", 1), UPPER, LOWER)))
    return (pages.select(F.col("host").alias("src"), F.explode(dst).alias("dst"))
            .where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: edges (src, dst, n), seeds (host, weight summing to 1) -> (host, rank).

    rank = (1 - damping) * seed + damping * what arrives over the edges, for at least so many
    rounds and until one reaches no new host and adds less than tolerance to the sum of ranks
    (ranks only grow, so that sum is the whole change; what is still to come is at most
    damping / (1 - damping) times it). A host without links out passes nothing on. Each round is
    one join on the source and one partially aggregated sum, written to the shared folder, and
    one counted aggregate.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("_all"))
    e = materialise(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("_all")).alias("p")))
    start = seeds.select("host", (F.col("weight") * (1 - damping)).alias("rank"))
    rank = start = materialise(start)
    if e.isEmpty() or start.isEmpty():
        return start
    measure = lambda r: r.agg(F.count("*"), F.sum("rank")).first()
    done, (hosts, total) = 0, measure(rank)
    while True:
        moved = e.join(rank, e["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.col("p") * F.col("rank") * damping).alias("rank"))
        before, rank = rank, materialise(start.unionByName(moved).groupBy("host").agg(F.sum("rank").alias("rank")))
        if before is not start:
            discard(before)
        last_hosts, last_total = hosts, total
        done, (hosts, total) = done + 1, measure(rank)
        if done >= rounds and hosts == last_hosts and total - last_total < tolerance:
            discard(e, start)
            return rank


def host_scores(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) from judged pages (host, html, verdict): seeds, links, propagation.

    Seeds are the hosts of pages that rules allow (trusted) or block, weighted by their share of
    such pages. Trust follows links; distrust goes against them, to hosts that link to blocked ones.
    """
    seeds = materialise(pages.where("host <> ''").groupBy("host").agg(
        F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("b")))
    totals = seeds.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    edges = materialise(host_links(pages))

    def spread(col: str, e: DataFrame) -> DataFrame:
        total = float(totals[col] or 0) or 1.0
        return personalised_rank(e, seeds.where(f"{col} > 0").select("host", (F.col(col) / total).alias("weight")))

    trust = spread("a", edges).withColumnRenamed("rank", "trust")
    distrust = spread("b", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).withColumnRenamed("rank", "distrust")
    return trust.join(distrust, "host", "full").na.fill(0.0)


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, balance: float = BALANCE) -> DataFrame:
    """Judge each page (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A url that a rule fits gets its verdict; any other is blocked iff its host's distrust exceeds
    balance times its trust, so a host without either is allowed. Null urls, and urls without
    ://, have an empty host and path, no rule, and are allowed. Null html has no links. Repeated
    rows are judged alike, each on its own row, and weigh in the seeds and links by their number.
    Empty tables give empty results; other columns are not read.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("_m", match_rule(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "host", "path", "html", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("verdict"))
    scores = guarded(materialise(host_scores(judged)))
    blocked = F.coalesce(F.col("distrust") > F.col("trust") * balance, F.lit(False))
    return (judged.drop("html").join(scores, "host", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))


def op9(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, with its host's trust and distrust.

    Null urls, empty ones and those without :// have an empty host and path, fit no rule and are allowed; null html has no
    links. Repeated rows are judged alike, each for itself. Texts of any length are searched for links to their end. Extra
    columns are not read, whatever their names. Empty in, empty out.
    """
    return filter_urls(pages)
