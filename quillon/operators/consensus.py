"""Several raters' labels merged by majority, and agreement among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.sets import set_f1


def majority_value(labels: DataFrame, item: str, value: str, least: int = 2) -> DataFrame:
    """(item, consensus): the value that at least least raters gave; null without one."""
    votes = labels.groupBy(item, value).agg(F.count("*").alias("n"))
    return votes.groupBy(item).agg(F.max(F.when(F.col("n") >= least, F.struct("n", value)))[value].alias("consensus"))


def majority_names(named: DataFrame, item: str = "key", least: int = 2) -> DataFrame:
    """(item, consensus, consensus_order): names listed by at least least raters, as a set and by
    (mean place, smallest place, name) over the raters that list them."""
    votes = named.groupBy(item, "name").agg(F.count("*").alias("n"), F.avg("place").alias("mean"), F.min("place").alias("low")).where(F.col("n") >= least)
    packed = votes.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("mean", "low", "name"))).alias("_v"))
    order = F.transform("_v", lambda x: x["name"])
    return packed.select(item, F.array_sort(order).alias("consensus"), order.alias("consensus_order"))


def rater_sets(named: DataFrame, items: DataFrame, raters: tuple[str, ...], item: str = "key") -> DataFrame:
    """One row an item with a set for each rater, empty if they list nothing."""
    empty = F.array().cast("array<string>")
    wide = named.groupBy(item).agg(*[F.array_sort(F.collect_list(F.when(F.col("rater") == r, F.col("name")))).alias(r) for r in raters])
    return items.select(item).join(wide, item, "left").select(item, *[F.coalesce(r, empty).alias(r) for r in raters])


def pair_f1(sets: DataFrame, raters: tuple[str, ...]) -> DataFrame:
    """(pair, f1): mean F1 of each two raters over all items."""
    pairs = [(a, b) for i, a in enumerate(raters) for b in raters[i + 1:]]
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), set_f1(F.col(a), F.col(b)).alias("f1")) for a, b in pairs])).alias("x")
    return sets.select(each).groupBy("x.pair").agg(F.avg("x.f1").alias("f1"))


def leave_one_out(sets: DataFrame, raters: tuple[str, ...]) -> DataFrame:
    """(rater, strict_f1, lenient_f1): each rater against what both, or either, of the others list."""
    rows = []
    for r in raters:
        a, b = [x for x in raters if x != r]
        rows.append(F.struct(F.lit(r).alias("rater"), set_f1(F.col(r), F.array_intersect(a, b)).alias("s"), set_f1(F.col(r), F.array_union(F.col(a), F.col(b))).alias("l")))
    return sets.select(F.explode(F.array(*rows)).alias("x")).groupBy("x.rater").agg(F.avg("x.s").alias("strict_f1"), F.avg("x.l").alias("lenient_f1"))


def conservative(score: Column, reference: Column) -> Column:
    """A missing answer scores 0, unless there was nothing to find."""
    return F.coalesce(score, F.when(F.size(reference) == 0, 1.0).otherwise(0.0))


def krippendorff(labels: DataFrame, item: str, value: str) -> DataFrame:
    """One row alpha for nominal labels (item, value), items of two labels or more; null if all are one value.

    The coincidences of an item need only its counts by value: values v and w of an item meet
    n_v * n_w (less n_v for v = w) times, weighted 1 / (m - 1).
    """
    by = labels.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").cast("double").alias("n"))
    m = F.sum("n").over(Window.partitionBy(item))
    by = by.withColumn("m", m).where("m > 1")
    facts = by.agg(F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("off"), F.sum("n").alias("total"))
    square = by.groupBy(value).agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    all_ = F.col("total")
    expected = (all_ * all_ - F.col("sq")) / (all_ * (all_ - 1))
    return facts.join(square).select(F.when(expected > 0, 1 - F.col("off") / all_ / expected).alias("alpha"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 columns, percent agreement beside it; null if chance agreement is 1."""
    po, pa, pb = F.avg((F.col(a) == F.col(b)).cast("double")), F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    out = pairs.agg(po.alias("agreement"), (pa * pb + (1 - pa) * (1 - pb)).alias("chance"))
    return out.select("agreement", F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))
