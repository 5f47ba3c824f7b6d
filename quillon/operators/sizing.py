"""How large a study must be: variance of a two-answer design, detectable effects and power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.sets import jaccard
from quillon.operators.resample import spread
from quillon.operators.study import hash32

#: Normal quantiles for a two-sided 5 % test, for 80 % power, and for 5 % over the family's 18 tests.
Z95, Z80, Z_HOLM = 1.959963984540054, 0.8416212335729143, 2.9155
#: Coefficients of a rational approximation of the normal distribution, good to 7.5e-8.
NORMAL_T, NORMAL_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function as an expression."""
    x = F.abs(z)
    t = 1 / (1 + NORMAL_T * x)
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * sum((b * F.pow(t, F.lit(k + 1)) for k, b in enumerate(NORMAL_B)), F.lit(0.0))
    return F.when(z < 0, tail).otherwise(1 - tail)


def two_draws(rows: DataFrame, draws: int, cell: tuple[str, ...] = ("model", "query", "arm")) -> DataFrame:
    """(cell, t, x, y): for each cell and draw two different answers as structs of the columns that are not the cell's.

    rows: (cell, rep, ...) with rep from 1 to the cell's size. The pair follows from hashes of the cell and the draw; a draw
    takes two rows by number, so the work is that of cells and draws, whatever the cells hold. Cells of one answer have none.
    """
    n = spread(rows.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1"))
    t = n.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    name = [F.col(c) for c in (*cell, "t")]
    picked = t.withColumn("i", hash32("first", *name) % F.col("n")).withColumn("j", hash32("second", *name) % (F.col("n") - 1))
    picked = picked.withColumn("j", F.col("j") + F.when(F.col("j") >= F.col("i"), 1).otherwise(0))
    kept = [c for c in rows.columns if c not in (*cell, "rep")]
    side = lambda c, s: picked.select(*cell, "t", (F.col(c) + 1).cast("int").alias("rep")).join(rows, [*cell, "rep"]).select(*cell, "t", F.struct(*kept).alias(s))
    return side("i", "x").join(side("j", "y"), [*cell, "t"])


def pair_share(x: str = "x", y: str = "y") -> Column:
    """Mean of the defined shares of two answers."""
    a, b = F.col(f"{x}.share"), F.col(f"{y}.share")
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def pair_excess() -> Column:
    """Excess divergence of two draws (xa, ya) and (xb, yb) by their name sets."""
    j = lambda p, q: jaccard(F.col(f"{p}.names"), F.col(f"{q}.names"))
    between = (j("xa", "xb") + j("xa", "yb") + j("ya", "xb") + j("ya", "yb")) / 4
    return (1 - between) - ((1 - j("xa", "ya")) + (1 - j("xb", "yb"))) / 2


def components(values: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group, mean, variance, n_query) of values (group, query, v), one a draw.

    The variance of one query's statistic: between queries that of their means over draws, within them the mean of
    their variances over draws. Fewer than two queries of at least two draws: no row.
    """
    per = values.where("v is not null").groupBy(*group, "query").agg(F.avg("v").alias("m"), F.var_samp("v").alias("w"), F.count("*").alias("n")).where("n > 1")
    out = per.groupBy(*group).agg(F.avg("m").alias("mean"), (F.var_samp("m") + F.avg("w")).alias("variance"), F.count("*").alias("n_query"))
    return out.where("n_query > 1")


def sizes(parts: DataFrame, queries: tuple[int, ...] = (30, 40, 50, 60, 80)) -> DataFrame:
    """parts (…, mean, variance) for each number of queries: se, mde, mde_holm, power at the observed mean."""
    each = parts.withColumn("queries", F.explode(F.array(*map(F.lit, queries)))).withColumn("se", F.sqrt(F.col("variance") / F.col("queries")))
    return (each.withColumn("mde", (Z95 + Z80) * F.col("se")).withColumn("mde_holm", (Z_HOLM + Z80) * F.col("se"))
            .withColumn("power", normal_cdf(F.try_divide(F.abs("mean"), "se") - Z_HOLM)))
