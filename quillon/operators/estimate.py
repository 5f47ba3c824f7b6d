"""Shares, paired contrasts and excess divergence, with the query as the unit of analysis."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.sets import jaccard
from quillon.functions.subsets import SMALL, guest_sums, shared_sums

CELL = ("model", "query", "arm")


def mention_counts(answers: DataFrame, mentions: DataFrame, classes: DataFrame, ambiguous: str | None = None) -> DataFrame:
    """answers with n_local, n_global, n_ambiguous, n_unknown over distinct mentions.

    ambiguous='local' or 'global' counts ambiguous names there; names in no class are n_unknown.
    """
    classed = mentions.join(classes, "name", "left")
    cls = F.coalesce("class", F.lit("unknown"))
    cls = F.when(cls == "ambiguous", ambiguous).otherwise(cls) if ambiguous else cls
    counts = classed.groupBy("key").agg(*[F.count_if(cls == c).alias(f"n_{c}") for c in ("local", "global", "ambiguous", "unknown")])
    return answers.join(counts, "key", "left").na.fill(0, [f"n_{c}" for c in ("local", "global", "ambiguous", "unknown")])


def local_share() -> Column:
    """local / (local + global); null if nothing is classified."""
    n = F.col("n_local") + F.col("n_global")
    return F.when(n > 0, F.col("n_local") / n)


def cell_means(rows: DataFrame, value: Column, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Mean of the defined values of each cell; a cell without any has no row."""
    return rows.select(*cell, value.alias("v")).where("v is not null and not isnan(v)").groupBy(*cell).agg(F.avg("v").alias("v"))


def query_means(cells: DataFrame) -> DataFrame:
    """Mean over queries for each model and arm, and how many queries are defined."""
    return cells.groupBy("model", "arm").agg(F.avg("v").alias("share"), F.count("*").alias("n_queries"))


def pooled(rows: DataFrame, y: Column, n: Column) -> DataFrame:
    return rows.groupBy("model", "arm").agg((F.sum(y) / F.sum(n)).alias("pooled"))


def paired(cells: DataFrame, contrasts: tuple[tuple[str, str], ...], unit: tuple[str, ...] = ("model", "query")) -> DataFrame:
    """Differences a - b of each unit defined in both arms: one scan, arms as columns."""
    arms = sorted({x for c in contrasts for x in c})
    wide = cells.groupBy(*unit).agg(*[F.max(F.when(F.col("arm") == a, F.col("v"))).alias(f"v_{a}") for a in arms])
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(f"v_{a}") - F.col(f"v_{b}")).alias("d")) for a, b in contrasts])).alias("p")
    return wide.select(*unit, pairs).select(*unit, "p.contrast", "p.d").where("d is not null")


def contrast_means(differences: DataFrame) -> DataFrame:
    return differences.groupBy("model", "contrast").agg(F.avg("d").alias("estimate"), F.count("*").alias("n"))


def all_models_mean(estimates: DataFrame, models: int) -> DataFrame:
    """Equal-weight mean over models; null unless all of them are defined."""
    return estimates.groupBy("contrast").agg(F.when(F.count("estimate") == models, F.avg("estimate")).alias("estimate"))


def set_counts(lists: DataFrame, field: str = "names", cell: tuple[str, ...] = CELL) -> DataFrame:
    """Distinct sets of each cell and how many answers have them: pairs are formed of these, not of answers."""
    return lists.groupBy(*cell, F.col(field).alias("s")).agg(F.count("*").cast("double").alias("c"))


#: Names that sets are written over as bits, 63 a column; with more names sets stay lists.
MOST_NAMES, WORD = 1008, 63
#: Groups among which a unit's subsets are divided.
PARTS = 4


def encoded(sets: DataFrame, names: DataFrame) -> tuple[DataFrame, int]:
    """sets with their members as bits b0, b1, ... over names (name), and how many such columns: 0 beyond MOST_NAMES.

    A pair then costs a bit count of an and, not a search through lists.
    """
    known = sorted(r[0] for r in names.select("name").distinct().limit(MOST_NAMES + 1).collect())
    if len(known) > MOST_NAMES:
        return sets, 0
    words = -(-max(1, len(known)) // WORD)
    for k in range(words):
        mine = known[k * WORD:(k + 1) * WORD]
        places = F.array(*map(F.lit, mine)) if mine else F.array().cast("array<string>")
        bit = lambda acc, x: F.when(F.array_position(places, x) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(places, x) - 1).cast("int")))).otherwise(acc)  # noqa: B023, E731
        sets = sets.withColumn(f"b{k}", F.aggregate("s", F.lit(0).cast("long"), bit))
    return sets, words


def _sides(sets: DataFrame, words: int) -> tuple[list[Column], list[Column], Column]:
    """A set's columns as the left and the right side of a pair, and the pair's Jaccard similarity."""
    if not words:
        left, right = ([F.col("s").alias(f"s{x}"), F.col("c").alias(f"c{x}")] for x in "xy")
        return left, right, jaccard(F.col("sx"), F.col("sy"))
    left, right = ([*[F.col(f"b{k}").alias(f"b{k}{x}") for k in range(words)], F.size("s").alias(f"n{x}"), F.col("c").alias(f"c{x}")] for x in "xy")
    both = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"b{k}x").bitwiseAND(F.col(f"b{k}y"))) for k in range(words)])
    total = F.col("nx") + F.col("ny") - both
    return left, right, F.when(total > 0, both / total).otherwise(1.0)


def _paired_sums(sets: DataFrame, words: int, unit: list[str], side: str) -> DataFrame:
    """(unit, x, y, t): similarities of a unit's sets summed pair by pair, in both orders; y is null where t counts the answers of x."""
    left, right, sim = _sides(sets, words)
    pairs = sets.select(*unit, F.col(side).alias("x"), *left).join(sets.select(*unit, F.col(side).alias("y"), *right), unit)
    counted = sets.groupBy(*unit, F.col(side).alias("x"), F.lit(None).cast("string").alias("y")).agg(F.sum("c").alias("t"))
    return pairs.groupBy(*unit, "x", "y").agg(F.sum(F.col("cx") * F.col("cy") * sim).alias("t")).unionByName(counted)


def _subset_sums(sets: DataFrame, known: list[str], unit: list[str], side: str) -> DataFrame:
    """The same by the subsets that sets share, without forming their pairs.

    A subset is counted where its first name belongs, in one of PARTS groups of a unit, to which a set goes once for
    each of its names there. Each set also has one of PARTS homes; the few of more than SMALL names visit all of
    them and meet the sets there one by one. A group holds a part of a unit's distinct sets.
    """
    size, home = F.size("s"), F.pmod(F.xxhash64("s"), F.lit(PARTS)).cast("int")
    places = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    firsts = F.filter(F.transform("s", lambda x: F.array_position(places, x).cast("int") - 1), lambda i: i >= 0)
    go = lambda part, first, kind: F.struct(part.cast("int").alias("part"), first.cast("int").alias("first"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<part:int,first:int,kind:string>>")
    stops = F.concat(F.array(go(PARTS + home, F.lit(0), "own")), F.when(size <= SMALL, F.transform(firsts, lambda i: go(i % PARTS, i, "first"))).otherwise(none),
                     F.when(size > SMALL, F.array(*[go(F.lit(PARTS + k), F.lit(0), "guest") for k in range(PARTS)])).otherwise(none))
    rows = sets.select(*unit, F.col(side).alias("side"), F.col("b0").alias("mask"), size.alias("size"), "c", F.explode(stops).alias("to")).select(*unit, "side", "mask", "size", "c", "to.*")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.select(*unit).schema.fields)

    def run(key: tuple, data: pa.Table) -> pa.Table:
        at, of = {n: data.column(n).to_numpy() for n in ("mask", "size", "c", "first")}, data.column("side").combine_chunks().dictionary_encode()
        names, of, kind = of.dictionary.to_pylist(), of.indices.to_numpy(), data.column("kind").to_numpy()
        mask, size, c, n, out = at["mask"], at["size"], at["c"], len(names), []
        if key[-1].as_py() < PARTS:
            t = shared_sums(mask, size, c, of, n, at["first"])
        else:
            own, none = kind == "own", np.bincount(of, c * (size == 0), n)
            t = guest_sums(mask, size, c, of, n, ~own) + np.outer(none, none)  # equal sets have one home
            out = [(*key[:-1], x, None, many) for x, many in zip(names, np.bincount(of[own], c[own], n))]
        out += [(*key[:-1], x, y, t[i, j]) for i, x in enumerate(names) for j, y in enumerate(names)]
        unit_ = [pa.array([v.as_py() for v in col]) for col in list(zip(*out))[:len(unit)]]
        x, y, t = list(zip(*out))[len(unit):]
        return pa.table([*unit_, pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(t, pa.float64())], names=[*unit, "x", "y", "t"])

    # by number: adaptive execution would put many groups, whose rows are few but whose subsets are many, into one task
    tasks = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *unit, "part").groupBy(*unit, "part").applyInArrow(run, f"{kinds}, x string, y string, t double")


def similarity_sums(sets: DataFrame, names: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    """(unit, x, y, nx, ny, t): answers of each two cells of a unit, and their Jaccard similarities summed over all ordered pairs.

    The last column of cell is the side, the others the unit. Equal sets count by multiplicity. Up to WORD names, work is
    linear in the sets, 2 ** size each; beyond, and for sets of over SMALL names, they meet pair by pair.
    """
    *unit, side = cell
    sets, words = encoded(sets.where(F.col(side).isNotNull()), names)
    parts = _subset_sums(sets, sorted(r[0] for r in names.select("name").distinct().collect()), unit, side) if words == 1 else _paired_sums(sets, words, unit, side)
    total = parts.groupBy(*unit, "x", "y").agg(F.sum("t").alias("t"))
    packed = total.groupBy(*unit).agg(F.collect_list(F.struct("x", "y", "t")).alias("l"))
    many = F.filter("l", lambda e: e["y"].isNull())
    t = lambda x, y: F.coalesce(F.get(F.filter("l", lambda e: (e["x"] == x) & (e["y"] == y)), F.lit(0))["t"], F.lit(0.0))
    pairs = F.flatten(F.transform(many, lambda a: F.transform(many, lambda b: F.struct(a["x"].alias("x"), b["x"].alias("y"), a["t"].alias("nx"), b["t"].alias("ny"), t(a["x"], b["x"]).alias("t")))))
    return packed.select(*unit, F.explode(pairs).alias("p")).select(*unit, "p.*")


def _within() -> Column:
    """Mean similarity over pairs of different answers: null below two."""
    return F.when(F.col("nx") > 1, (F.col("t") - F.col("nx")) / (F.col("nx") * (F.col("nx") - 1)))


def _all_pairs() -> Column:
    return F.col("t") / (F.col("nx") * F.col("ny"))


def within_similarity(sets: DataFrame, names: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    """(cell, n, t, within): mean Jaccard similarity over pairs of answers i < j of a cell; null below two answers.

    t is the sum over all ordered pairs. Equal sets count by multiplicity, so t less the n answers
    with themselves leaves the pairs.
    """
    same = similarity_sums(sets, names, cell).where("x = y")
    return same.select(*cell[:-1], F.col("x").alias(cell[-1]), F.col("nx").alias("n"), "t", _within().alias("within"))


def _contrasted(sums: DataFrame, contrasts: tuple[tuple[str, str], ...], same: Column, result: Column, name: str) -> DataFrame:
    """(model, query, contrast, result) of a (first arm with itself), b (second with itself) and ab; undefined ones have no row."""
    value = F.when(F.col("x") == F.col("y"), same).otherwise(_all_pairs())
    wide = sums.groupBy("model", "query").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "x", "y").alias("k"), value.alias("v")))).alias("m"))
    at = lambda a, b: F.col("m")[f"{a}-{b}"]
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), at(a, a).alias("a"), at(b, b).alias("b"), at(a, b).alias("ab")) for a, b in contrasts])).alias("w")
    return wide.select("model", "query", each).select("model", "query", "w.*").select("model", "query", "contrast", result.alias(name)).where(F.col(name).isNotNull())


def excess_divergence(sets: DataFrame, contrasts: tuple[tuple[str, str], ...], names: DataFrame) -> DataFrame:
    """(model, query, contrast, d): divergence between two arms less the mean divergence within them.

    Units with an arm of fewer than two answers are undefined and have no row.
    """
    return _contrasted(similarity_sums(sets, names), contrasts, _within(), (1 - F.col("ab")) - ((1 - F.col("a")) + (1 - F.col("b"))) / 2, "d")


def kernel_distance(sets: DataFrame, contrasts: tuple[tuple[str, str], ...], names: DataFrame) -> DataFrame:
    """Squared maximum mean discrepancy of two arms' sets under a Jaccard kernel, draws with replacement."""
    return _contrasted(similarity_sums(sets, names), contrasts, _all_pairs(), F.col("a") + F.col("b") - 2 * F.col("ab"), "mmd2")


def crosstab(rows: DataFrame, row: str, col: str, values: tuple[str, ...]) -> DataFrame:
    """Counts by row and column with row shares, in one aggregation."""
    n = [F.count_if(F.col(col) == v) for v in values]
    return rows.groupBy(row).agg(*[c.alias(f"n_{v}") for c, v in zip(n, values)], F.count("*").alias("n"), *[(c / F.count("*")).alias(f"share_{v}") for c, v in zip(n, values)])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
