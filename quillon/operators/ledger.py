"""Accounts of calls: costs, windows of time, latency, drift, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_ledger(usage: DataFrame, prices: DataFrame, groups: tuple[str, ...] = ("phase", "model")) -> DataFrame:
    """Calls, tokens and cost by groups with subtotals and the grand total (rollup; nulls are totals)."""
    priced = usage.join(prices, "model", "left")
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return priced.withColumn("cost", cost).rollup(*groups).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))


def measured_means(usage: DataFrame, least: int = 5) -> DataFrame:
    return usage.groupBy("model").agg(F.avg("tokens_in").alias("mean_in"), F.avg("tokens_out").alias("mean_out"), F.count("*").alias("n")).where(F.col("n") >= least)


def run_windows(calls: DataFrame, phase: str = "phase", at: str = "at") -> DataFrame:
    """First and last call and how many, by phase."""
    return calls.groupBy(phase).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("calls"))


def drift(calls: DataFrame, group: str, value: str) -> DataFrame:
    """Groups in which a value that should be constant is not."""
    return calls.groupBy(group).agg(F.count_distinct(value).alias("values")).where("values > 1")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (name_a, name_b) of intervals (name, lo, hi) that overlap; for the few intervals of a run."""
    x, y = [d.select(F.col("name").alias(f"name_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for d, s in ((a, "a"), (b, "b"))]
    return x.join(y, (F.col("lo_a") <= F.col("hi_b")) & (F.col("hi_a") >= F.col("lo_b")))


def exact_quantiles(rows: DataFrame, group: tuple[str, ...], value: str, shares: tuple[float, ...], bins: int = 4096) -> DataFrame:
    """(group, q): exact quantiles with linear interpolation, an array in the order of shares; null values are left out.

    Two passes, so that a group's distinct values never meet in one state. The first counts a group's values in bins of equal
    width between its least and greatest; the counts say in which bins the wanted places lie. The second counts the
    distinct values of those bins alone and finds the places among them. Values are finite; a group without any has no row.
    """
    v = rows.select(*group, F.col(value).cast("double").alias("v")).where("v is not null")
    ends = v.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    binned = v.join(ends, list(group)).withColumn("bin", F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)), F.lit(0)).cast("int"))
    along = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(*group, "bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(along)).select(*group, "bin", (F.col("upto") - F.col("c")).alias("before"), "upto")
    wanted = F.posexplode(F.array(*map(F.lit, shares))).alias("i", "share")
    places = ends.select(*group, "n", wanted).withColumn("at", F.col("share") * (F.col("n") - 1))
    places = places.select(*group, "i", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("k"))
    held = places.join(counts, list(group)).where("before <= k and k < upto").select(*group, "i", "at", "k", "bin", "before")
    inside = binned.join(held.select(*group, "bin", "before").distinct(), [*group, "bin"]).groupBy(*group, "bin", "before", "v").agg(F.count("*").alias("c"))
    within = Window.partitionBy(*group, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("upto", F.col("before") + F.sum("c").over(within)).select(*group, "bin", "v", (F.col("upto") - F.col("c")).alias("first"), "upto")
    found = held.drop("before").join(ranked, [*group, "bin"]).where("first <= k and k < upto")
    # of the two neighbours each weighs by how near the place is to it
    share = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1 - F.abs(F.col("at") - F.col("k")))
    each = found.groupBy(*group, "i").agg(F.sum(F.col("v") * share).alias("q"))
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


def latency(calls: DataFrame, group: str, seconds: str) -> DataFrame:
    """Calls, mean, and the median and two upper quantiles of each group."""
    q = exact_quantiles(calls, (group,), seconds, (0.5, 0.9, 0.99))
    facts = calls.groupBy(group).agg(F.count("*").alias("calls"), F.avg(seconds).alias("mean"))
    return facts.join(q, group, "left").select(group, "calls", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


def error_groups(calls: DataFrame, keys: tuple[Column, ...], top: int = 10) -> DataFrame:
    n = calls.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), *[c for c in n.columns if c != "n"]).limit(top)


def string_relation(asked: Column, returned: Column) -> Column:
    """equal, subset, superset, overlap or disjoint: the parts of a requested and a returned model name."""
    parts = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda x: x != ""))
    a, b = parts(asked), parts(returned)
    only_a, only_b, both = F.size(F.array_except(a, b)), F.size(F.array_except(b, a)), F.size(F.array_intersect(a, b))
    return F.when((only_a == 0) & (only_b == 0), "equal").when(only_a == 0, "subset").when(only_b == 0, "superset").when(both > 0, "overlap").otherwise("disjoint")


def superseded(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records whose parameters are not those now wanted for their model."""
    return records.join(wanted.select("model", F.col("params").alias("_want")), "model").where(~F.col("params").eqNullSafe(F.col("_want"))).drop("_want")


def compare_stored(now: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose values differ by more than tolerance, or that only one side has."""
    s = stored.select(*keys, F.col(value).alias("_stored"))
    out = now.select(*keys, value).join(s, keys, "full")
    same = (F.abs(F.col(value) - F.col("_stored")) <= tolerance) | (F.col(value).isNull() & F.col("_stored").isNull())
    return out.where(~F.coalesce(same, F.lit(False))).withColumnRenamed("_stored", "stored")
