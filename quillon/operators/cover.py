"""A small set of answers that covers many features: greedy gains over classes of equal answers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.sampling import shuffle_key

DDL = "place int, key long, model string, tags string, gain double, added string"


def classes(tagged: DataFrame, size: int, seed: str, key: str = "key") -> DataFrame:
    """(model, tags, keys): answers alike in model and tags, and the first of them in a seeded order, size at most.

    No more than size of a class can be chosen, so the rest need not be known. Tags are few, so classes are.
    """
    order = Window.partitionBy("model", "tags").orderBy("h", key)
    ranked = tagged.select(F.col(key).alias(key), "model", F.array_sort(F.array_distinct("tags")).alias("tags"), shuffle_key(seed, F.col(key)).alias("h"))
    first = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    return first.groupBy("model", "tags").agg(F.array_sort(F.collect_list(F.struct("h", key))).alias("keys"))


def choose(known: list[tuple[str, tuple[str, ...], list[tuple[str, int]]]], worth: dict[str, float], size: int, often: int, floor: int, floor_gain: float) -> list[tuple]:
    """(place, key, model, tags, gain, added) of the answers chosen from classes (model, tags, [(hash, key)]).

    A tag that c chosen answers have adds worth / (1 + c), nothing from often on; a model below its floor adds
    floor_gain. The greatest gain goes first, ties to the smaller hash. Afterwards each model short of its floor
    gets its best answers, each in place of the least gainful one of a model above the floor, if there is one.
    """
    left = {(m, t): sorted(keys) for m, t, keys in known}
    covered, have, chosen = Counter(), Counter(), []

    def gain(c: tuple[str, tuple[str, ...]]) -> float:
        return sum(worth[t] / (1 + covered[t]) for t in c[1] if t in worth and covered[t] < often) + (floor_gain if have[c[0]] < floor else 0)

    def best(of) -> tuple | None:
        open_ = [(-gain(c), keys[0], c) for c, keys in left.items() if keys and of(c)]
        return min(open_) if open_ else None

    def take(found: tuple, how: str) -> None:
        value, (h, key), c = found
        left[c].pop(0)
        chosen.append((key, c, -value, how, h))
        have[c[0]] += 1

    while len(chosen) < size and (found := best(lambda c: True)):
        take(found, "gain")
        covered.update(found[2][1])
    for model in sorted({m for m, _, _ in known}):
        while have[model] < floor and (found := best(lambda c: c[0] == model)):
            over = [x for x in chosen if have[x[1][0]] > floor]
            if over:
                drop = min(over, key=lambda x: gain(x[1]))
                chosen.remove(drop)
                have[drop[1][0]] -= 1
                left[drop[1]] = sorted([*left[drop[1]], (drop[4], drop[0])])
            take(found, "floor")
    return [(i + 1, key, c[0], ",".join(c[1]), float(g), how) for i, (key, c, g, how, _) in enumerate(chosen)]


def practice_set(tagged: DataFrame, worth: dict[str, float], size: int = 15, often: int = 3, floor: int = 2, floor_gain: float = 6, seed: str = "practice") -> DataFrame:
    """The chosen answers of tagged (key, model, tags): Spark forms the classes, the driver sees a few keys of each."""
    rows = [(r["model"], tuple(r["tags"]), [(x["h"], x["key"]) for x in r["keys"]]) for r in classes(tagged, size + 1, seed).collect()]
    return tagged.sparkSession.createDataFrame(choose(rows, worth, size, often, floor, floor_gain), DDL)
