"""Draws, layers and row predicates of repeated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ("model", "query", "arm", "rep")


def final_draws(draws: DataFrame, slot: tuple[str, ...] = SLOT) -> DataFrame:
    """The last draw of each slot, with whether its first draw was degenerate. One shuffle, no sort of groups."""
    rest = [c for c in draws.columns if c not in slot]
    packed = draws.groupBy(*slot).agg(F.max_by(F.struct(*rest), "draw").alias("_last"), F.min_by(F.col("outcome") == "degenerate", "draw").alias("first_degenerate"), F.count("*").alias("n_draws"))
    return packed.select(*slot, "_last.*", "first_degenerate", "n_draws")


def redraw_plan(draws: DataFrame, slot: tuple[str, ...] = SLOT, most: int = 3) -> DataFrame:
    """(slot, next_draw, status): done if any draw is usable, plan while fewer than most were made, else short."""
    g = draws.groupBy(*slot).agg(F.bool_or(F.col("outcome") != "degenerate").alias("ok"), F.max("draw").alias("last"))
    status = F.when(F.col("ok"), "done").when(F.col("last") < most, "plan").otherwise("short")
    return g.select(*slot, F.when(status == "plan", F.col("last") + 1).alias("next_draw"), status.alias("status"))




def predicates() -> dict[str, Column]:
    return {
        "primary": F.col("outcome") != "degenerate",
        "valid_only": F.col("outcome") == "valid",
        "no_truncated": ~F.col("truncated"),
        "non_refused": ~F.col("outcome").isin("refusal", "degenerate"),
    }


def with_flag(rows: DataFrame, keys: DataFrame, name: str, key: str = "key") -> DataFrame:
    """rows with a flag for keys that are in a list (a semi-join as a column)."""
    marked = keys.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def unpivot_arms(table: DataFrame, arms: dict[str, str], key: str) -> DataFrame:
    """One row a key and arm from columns of texts; blank texts have no row."""
    named = table.select(key, *[F.col(c).alias(a) for a, c in arms.items()])
    return named.unpivot([key], list(arms), "arm", "text").where("trim(coalesce(text, '')) <> ''")


def row_share(rows: DataFrame, row: str, value: str = "n") -> DataFrame:
    return rows.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(row)))


def ranked(rows: DataFrame, value: str, name: str, group: tuple[str, ...] = ()) -> DataFrame:
    """rank by value descending, ties by name. Without a group all rows meet in one task: for small aggregates."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(group or (F.lit(0),))).orderBy(F.desc(value), name)))
