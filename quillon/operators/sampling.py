"""Seeded sampling and assignment: the same rows whatever the partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.study import hash32


def shuffle_key(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def plan(*dimensions: DataFrame) -> DataFrame:
    """Cross product of small dimension tables (a design, not data)."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out


def per_stratum(rows: DataFrame, stratum: tuple[str, ...], k: int, seed: str, key: str = "key") -> DataFrame:
    """k rows of each stratum by hash order, all if fewer; shortfall says how many are missing."""
    order = Window.partitionBy(*stratum).orderBy(shuffle_key(seed, F.col(key)), key)
    # each task keeps its first k of a stratum before the shuffle; sizes are counted apart, map-side
    kept = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    sizes = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in stratum]).agg(F.greatest(F.lit(0), k - F.count("*")).alias("shortfall"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in stratum])
    return kept.join(sizes, same).drop(*[f"_{c}" for c in stratum])


def round_robin(rows: DataFrame, bucket: tuple[str, ...], n: int, seed: str, key: str = "key") -> DataFrame:
    """n rows taken from the buckets in turn."""
    order = Window.partitionBy(*bucket).orderBy(shuffle_key(seed, F.col(key)), key)
    return rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n).orderBy("turn", *bucket).limit(n)


def largest_remainder(strata: DataFrame, total: int, seed: str, name: str = "stratum", size: str = "n", at_least: int = 0) -> DataFrame:
    """strata with quota: total shared in proportion to size, remainders by size and then a seeded hash.

    With at_least each stratum first gets that many (no more than it has). One row a stratum: small.
    """
    every = Window.partitionBy(F.lit(0))
    base = strata.withColumn("_base", F.least(F.lit(at_least), F.col(size)))
    base = base.withColumn("_rest", total - F.sum("_base").over(every)).withColumn("_room", F.col(size) - F.col("_base"))
    # whole-number arithmetic: floor and remainder of rest * room / all room
    base = base.withColumn("_all", F.sum("_room").over(every))
    base = base.withColumn("_q", F.expr("_rest * _room div _all")).withColumn("_m", F.expr("_rest * _room % _all"))
    left = F.col("_rest") - F.sum("_q").over(every)
    rank = F.row_number().over(every.orderBy(F.desc("_m"), shuffle_key(seed, F.col(name))))
    return base.withColumn("quota", F.col("_base") + F.col("_q") + F.when(rank <= left, 1).otherwise(0)).select(*strata.columns, "quota")


def capped_remainder(strata: DataFrame, total: DataFrame, seed: str, name: str = "stratum", size: str = "n") -> DataFrame:
    """strata with quota: one each, the rest in proportion to size by largest remainders, none above its size.

    total: one row (total), at least as many as there are strata. What the caps leave over goes, one by one, to the stratum
    that has most room, ties by name, until it is spent or no room is left. That fixed point is found at once: a stratum with
    room r would take its turns at levels r, r - 1, ...; of all strata's levels the highest are served. One row a stratum.
    """
    every = Window.partitionBy(F.lit(0))
    base = strata.join(F.broadcast(total)).withColumn("_rest", F.col("total") - F.count("*").over(every)).withColumn("_all", F.sum(size).over(every))
    base = base.withColumn("_q", F.expr(f"_rest * {size} div _all")).withColumn("_m", F.expr(f"_rest * {size} % _all"))
    rank = F.row_number().over(every.orderBy(F.desc("_m"), shuffle_key(seed, F.col(name))))
    given = base.withColumn("_a", F.least(F.col(size), 1 + F.col("_q") + F.when(rank <= F.col("_rest") - F.sum("_q").over(every), 1).otherwise(0)))
    short = given.withColumn("_short", F.col("total") - F.sum("_a").over(every)).withColumn("_room", F.col(size) - F.col("_a"))
    turns = short.where("_short > 0 and _room > 0").select(name, "_short", F.explode(F.expr("sequence(_room, greatest(1, _room - _short + 1), -1)")).alias("_level"))
    served = turns.withColumn("_turn", F.row_number().over(every.orderBy(F.desc("_level"), name))).where("_turn <= _short").groupBy(name).agg(F.count("*").alias("_more"))
    return short.join(served, name, "left").select(*strata.columns, (F.col("_a") + F.coalesce("_more", F.lit(0))).cast("long").alias("quota"))


def opaque_ids(rows: DataFrame, seed: str, key: str = "key") -> DataFrame:
    """rows with pid, a seeded name that hides the key."""
    return rows.withColumn("pid", F.concat(F.lit("p"), F.substring(shuffle_key(seed, F.col(key)), 1, 12)))


def smallest(rows: DataFrame, one_in: int, seed: str, name: str, key: str = "key") -> DataFrame:
    """rows with a flag on exactly ceil(n / one_in) of them: those of the smallest seeded hashes.

    An order statistic without a sort of all rows: hashes are counted by their first 16 bits, the counts say in
    which of those 65,536 bins the limit lies, and only that bin's rows are put in order.
    """
    hashed = rows.withColumn("_h", shuffle_key(seed, F.col(key))).withColumn("_bin", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    bins = hashed.groupBy("_bin").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(F.lit(0))
    upto = F.sum("_n").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    cut = bins.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(whole)).withColumn("_limit", F.expr(f"(_all + {one_in - 1}) div {one_in}")).where("_upto >= _limit and _upto - _n < _limit").select(F.col("_bin").alias("_cut"), (F.col("_limit") - F.col("_upto") + F.col("_n")).alias("_left"))
    marked = hashed.join(F.broadcast(cut))  # one row, or none without rows
    order = Window.partitionBy("_bin").orderBy("_h", key)
    inside = marked.where("_bin = _cut").withColumn(name, F.row_number().over(order) <= F.col("_left"))
    outside = marked.where("_bin <> _cut").withColumn(name, F.col("_bin") < F.col("_cut"))
    return outside.unionByName(inside).select(*rows.columns, name)


def balanced_pairs(items: DataFrame, raters: tuple[str, ...], seed: str, group: tuple[str, ...] = ("query", "arm"), cell: str = "model", key: str = "key") -> DataFrame:
    """items with rater: in each group the pairs of raters, each twice, are dealt to its cells in a seeded order.

    The i-th cell of a group gets the i-th pair, and its items, in a seeded order, the pair's raters in turn; so no rater has
    two items of a cell of two, and with as many cells as pairs all raters have equally many. Windows stand over a
    group's cells and a cell's items, both few by the draw before.
    """
    pairs = [(a, b) for i, a in enumerate(raters) for b in raters[i + 1:]] * 2
    slots = F.array_sort(F.array(*[F.struct(shuffle_key(seed, *map(F.col, group), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(len(pairs))]))
    cells = items.select(*group, cell).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(cell)))
    names = F.array(*[F.array(*map(F.lit, p)) for p in pairs])
    dealt = cells.withColumn("_pair", F.get(names, F.get(slots, (F.col("_i") - 1) % len(pairs))["s"])).drop("_i")
    turn = F.row_number().over(Window.partitionBy(*group, cell).orderBy(shuffle_key(seed, F.col(key)), key))
    return items.withColumn("_j", turn).join(dealt, [*group, cell]).withColumn("rater", F.get("_pair", (F.col("_j") - 1) % 2)).drop("_j", "_pair")
