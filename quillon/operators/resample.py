"""Cluster bootstrap with counts that any engine derives alike, and tests built on it."""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.study import hash32


def spread(rows: DataFrame) -> DataFrame:
    """rows over all shuffle partitions, before each is multiplied: adaptive execution would leave so few rows in one task."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def weights(units: DataFrame, draws: int, seed: int = 7, stratum: str | None = None) -> DataFrame:
    """(b, unit, w): how often each unit is drawn in each resample of as many units.

    units: one row (unit[, stratum]). Draw j of resample b takes the unit numbered
    hash(seed, b, stratum, j) modulo the stratum's size; every unit keeps its row, also with w = 0.
    The units are clusters, few by design; answers never meet the draws.
    """
    s = F.col(stratum) if stratum else F.lit("all")
    numbered = units.select("unit", s.alias("s")).withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("unit")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("s")))
    numbered = spread(numbered)
    drawn = numbered.select("s", "n", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).select(
        "s", "b", (hash32(str(seed), F.col("b"), F.col("s"), F.col("j")) % F.col("n")).alias("i"))
    counts = drawn.groupBy("b", "s", "i").agg(F.count("*").alias("w"))
    grid = numbered.select("unit", "s", "i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    return grid.join(counts, ["b", "s", "i"], "left").select("b", "unit", F.coalesce("w", F.lit(0)).alias("w"))


def replicates(values: DataFrame, drawn: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group, b, rep) of weighted means of values (group, unit, v); a resample without weight is dropped."""
    met = values.join(drawn, "unit")
    return met.groupBy(*group, "b").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("rep")).where("rep is not null")


def ratio_replicates(values: DataFrame, drawn: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """As replicates, of sum(y) / sum(n) of values (group, unit, y, n)."""
    met = values.join(drawn, "unit")
    return met.groupBy(*group, "b").agg((F.sum(F.col("w") * F.col("y")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("rep")).where("rep is not null")


def percentile_interval(reps: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """2.5 and 97.5 % percentiles (linear), and how many resamples were defined."""
    p = F.percentile("rep", F.array(F.lit(0.025), F.lit(0.975)))
    return reps.groupBy(*group).agg(p.alias("p"), F.count("*").alias("used")).select(*group, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"), "used")


def frame_intervals(values: DataFrame, drawn: DataFrame, group: tuple[str, ...], member: str, least: int = 2) -> DataFrame:
    """(member, group, estimate, n_units, lo, hi, used) over a frame of units that was fixed before any was found eligible.

    values: (member, group, unit, v) of eligible units; drawn covers the whole frame and is shared
    by all members, so a resample can lack every eligible unit and is then undefined. Member "all" is the members' mean with
    equal weights, defined where all of them are. Below least units (of any member) there is no interval.
    """
    point = values.groupBy(member, *group).agg(F.avg("v").alias("estimate"), F.count("*").alias("n_units"))
    reps = replicates(values, drawn, (member, *group))
    members = values.select(member).distinct().agg(F.count("*").alias("members"))
    whole = point.groupBy(*group).agg(F.avg("estimate").alias("estimate"), F.min("n_units").alias("n_units"), F.count("*").alias("met")).join(F.broadcast(members)).where("met = members")
    joint = reps.groupBy(*group, "b").agg(F.avg("rep").alias("rep"), F.count("*").alias("met")).join(F.broadcast(members)).where("met = members")
    name = F.lit("all").alias(member)
    points = point.unionByName(whole.select(name, *group, "estimate", "n_units"))
    limits = percentile_interval(reps.unionByName(joint.select(name, *group, "b", "rep")), (member, *group))
    enough = lambda c: F.when(F.col("n_units") >= least, F.col(c)).alias(c)
    return points.join(limits, [member, *group], "left").select(member, *group, "estimate", "n_units", enough("lo"), enough("hi"), F.coalesce("used", F.lit(0)).alias("used"))


def kappa_replicates(cells: DataFrame, drawn: DataFrame) -> DataFrame:
    """(b, rep) of Cohen's kappa of two binary labels; cells: (unit, n, a, b2, same), counts of rows, of each label and of agreement."""
    t = cells.join(drawn, "unit").groupBy("b").agg(*[F.sum(F.col("w") * F.col(c)).cast("double").alias(c) for c in ("n", "a", "b2", "same")])
    pa, pb = F.col("a") / F.nullif(F.col("n"), F.lit(0.0)), F.col("b2") / F.nullif(F.col("n"), F.lit(0.0))
    chance = pa * pb + (1 - pa) * (1 - pb)
    return t.select("b", ((F.col("same") / F.nullif(F.col("n"), F.lit(0.0)) - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("rep")).where("rep is not null")


def mean_effect(values: DataFrame, drawn: DataFrame, group: tuple[str, ...], draws: int, least: int = 10) -> DataFrame:
    """Studentised bootstrap test of a zero mean: (group, n, mean, t, p).

    No test (p null) below least units; P = 1 if the values do not vary. A resample whose variance
    is zero or undefined counts against the null being rejected.
    """
    base = values.groupBy(*group).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    base = base.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))))
    met = values.join(base.select(*group, "mean", "t"), list(group)).join(drawn, "unit")
    e = F.col("v") - F.col("mean")
    sums = met.groupBy(*group, "b", "t").agg(F.sum("w").cast("double").alias("N"), F.sum(F.col("w") * e).alias("S"), F.sum(F.col("w") * e * e).alias("Q"))
    var = F.when(F.col("N") > 1, (F.col("Q") - F.col("S") * F.col("S") / F.col("N")) / (F.col("N") * (F.col("N") - 1)))
    star = F.when(var > 1e-18, F.abs(F.col("S") / F.col("N") / F.sqrt(var)))
    hits = sums.withColumn("star", star).groupBy(*group).agg(F.count_if(F.col("star").isNull() | (F.col("star") >= F.abs("t"))).alias("hits"))
    p = F.when(F.col("n") < least, F.lit(None)).when(F.col("t").isNull(), 1.0).otherwise((1 + F.col("hits")) / (draws + 1))
    return base.join(hits, list(group)).select(*group, "n", "mean", "t", p.cast("double").alias("p"))


def holm(tests: DataFrame, family: tuple[str, ...], p: str = "p", tie: str = "contrast") -> DataFrame:
    """tests with p_holm: running maximum of (m - i + 1) * p over sorted p, at most 1; null p counts as 1."""
    w = Window.partitionBy(*family)
    ordered = w.orderBy("_p", tie)
    return (tests.withColumn("_p", F.coalesce(p, F.lit(1.0))).withColumn("_m", F.count("*").over(w)).withColumn("_i", F.row_number().over(ordered))
            .withColumn("p_holm", F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_i") + 1) * F.col("_p")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))).drop("_p", "_m", "_i"))


def benjamini_yekutieli(tests: DataFrame, family: tuple[str, ...], q: float = 0.05, p: str = "p", tie: str = "contrast") -> DataFrame:
    """tests with rejected: all up to the largest i with p_(i) <= i / m * q / H_m."""
    w = Window.partitionBy(*family)
    ordered = w.orderBy("_p", tie)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    t = tests.withColumn("_p", F.coalesce(p, F.lit(1.0))).withColumn("_m", F.count("*").over(w)).withColumn("_i", F.row_number().over(ordered))
    last = F.max(F.when(F.col("_p") <= F.col("_i") / F.col("_m") * q / harmonic, F.col("_i")).otherwise(0)).over(w)
    return t.withColumn("rejected", F.col("_i") <= last).drop("_p", "_m", "_i")


@lru_cache(maxsize=4)
def draw_matrix(strata: tuple[str, ...], draws: int, seed: int = 7) -> np.ndarray:
    """The weights of `weights` as one array (draws, units); strata: each unit's, units in order of name."""
    out = np.zeros((draws, len(strata)), np.int16)
    for s in dict.fromkeys(strata):
        own = np.array([i for i, x in enumerate(strata) if x == s])
        for b in range(draws):
            head = md5(f"{seed}|{b}|{s}|".encode())
            for j in range(len(own)):
                h = head.copy()
                h.update(str(j).encode())
                out[b, own[int.from_bytes(h.digest()[:4]) % len(own)]] += 1
    return out


def vector_means(values: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Weighted means (draws, columns) of values (units, columns) over their defined units: sums over units of whole arrays."""
    known = ~np.isnan(values)
    total, n = drawn @ np.where(known, values, 0.0), drawn @ known.astype(float)
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def _frame(frame: DataFrame) -> tuple[list[str], tuple[str, ...]]:
    """Names of the units, sorted, and their strata ("all" without any): clusters, few by design."""
    stratum = F.col("stratum") if "stratum" in frame.columns else F.lit("all")
    rows = sorted(map(tuple, frame.select("unit", stratum).distinct().collect()))
    return [r[0] for r in rows], tuple(r[1] for r in rows)


def intervals(values: DataFrame, frame: DataFrame, group: tuple[str, ...], draws: int, seed: int = 7) -> DataFrame:
    """(group, lo, hi, used): percentile limits of the means over units of values (group, unit, v)."""
    one = values.select(*group, "unit", "v", F.lit("mean").alias("measure"), F.lit("one").alias("who"))
    return cluster_statistics(one, frame, group, "who", draws, seed, least=1).where("who = 'one'").select(*group, "lo", "hi", "used")


def mean_effects(values: DataFrame, frame: DataFrame, group: tuple[str, ...], draws: int, least: int = 10, seed: int = 7) -> DataFrame:
    """As mean_effect, (group, n, mean, t, p), with the draws as one matrix: a group's resamples are three products with it."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.select(*group).schema.fields)
    units, strata = _frame(frame)

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        v = data.set_index("unit")["v"].reindex(units).to_numpy(float)
        known = ~np.isnan(v)
        n, mean = int(known.sum()), float(v[known].mean())
        sd = float(v[known].std(ddof=1)) if n > 1 else 0.0
        t = mean / (sd / np.sqrt(n)) if sd > 0 else None
        p = None if n < least else 1.0
        if t is not None and n >= least:
            e, w = np.where(known, v - mean, 0.0), draw_matrix(strata, draws, seed)
            many, total, square = w @ known.astype(float), w @ e, w @ (e * e)
            with np.errstate(divide="ignore", invalid="ignore"):
                var = np.where(many > 1, (square - total * total / many) / (many * (many - 1)), np.nan)
                star = np.where(var > 1e-18, np.abs(total / many / np.sqrt(var)), np.inf)
            p = (1 + int((star >= abs(t)).sum())) / (draws + 1)
        return pd.DataFrame([(*key, n, mean, t, p)], columns=[*group, "n", "mean", "t", "p"])

    return values.where("v is not null").groupBy(*group).applyInPandas(run, f"{kinds}, n long, mean double, t double, p double")


def cluster_statistics(values: DataFrame, frame: DataFrame, group: tuple[str, ...], member: str, draws: int, seed: int = 7, least: int = 2) -> DataFrame:
    """(group, member, measure, estimate, n_units, lo, hi, used) of many statistics that share one draw of clusters.

    values: (group, member, unit, measure, v), v the statistic's value in a unit; its estimate is the mean over units. frame:
    (unit[, stratum]) of all units that are drawn, within strata if there are any, eligible or not: clusters, few by design, whose names the driver hands to the tasks. Member
    "all" is the members' mean, defined where all members of the measure are. Percentile limits over the defined resamples, none
    below least units. A group holds its members' units; the draws are one matrix that each task derives from hashes,
    and a group's replicates are its product with the values, so no resample is ever a row.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.select(*group).schema.fields)
    units, strata = _frame(frame)

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        wide = data.set_index(["unit", "measure", member])["v"].unstack(["measure", member]).reindex(units)
        x = wide.to_numpy(float)
        reps, n = vector_means(x, draw_matrix(strata, draws, seed)), (~np.isnan(x)).sum(0)
        point, out, columns = np.nansum(x, 0) / np.maximum(n, 1), [], list(wide.columns)
        for measure in sorted({c[0] for c in columns}):
            at = [i for i, c in enumerate(columns) if c[0] == measure]
            parts = [(columns[i][1], point[i], n[i], reps[:, i]) for i in at if n[i]]
            if len(parts) == len(at):
                parts.append(("all", point[at].mean(), n[at].min(), reps[:, at].mean(1)))
            for who, estimate, many, r in parts:
                r = r[~np.isnan(r)]
                lo, hi = np.percentile(r, [2.5, 97.5]) if many >= least and len(r) else (None, None)
                out.append((*key, who, measure, float(estimate), int(many), lo, hi, len(r)))
        return pd.DataFrame(out, columns=[*group, member, "measure", "estimate", "n_units", "lo", "hi", "used"])

    return values.groupBy(*group).applyInPandas(run, f"{kinds}, {member} string, measure string, estimate double, n_units long, lo double, hi double, used long")


def cluster_ratios(cells: DataFrame, frame: DataFrame, group: tuple[str, ...], sums: tuple[str, ...], statistics: dict, draws: int, seed: int = 7) -> DataFrame:
    """(group, statistic, estimate, lo, hi, used): statistics of sums over clusters, which are drawn together.

    cells: (group, unit, sums); statistics: name -> function of the sums by name, arrays over resamples. Drawn as in
    cluster_statistics; a resample of which a statistic is undefined is dropped.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*group).schema.fields)
    units, strata = _frame(frame)

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        x = data.set_index("unit")[list(sums)].reindex(units).fillna(0).to_numpy(float)
        drawn = draw_matrix(strata, draws, seed) @ x
        out = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for name, f in statistics.items():
                point, reps = f(dict(zip(sums, x.sum(0)[:, None]))), f(dict(zip(sums, drawn.T)))
                reps = reps[np.isfinite(reps)]
                lo, hi = np.percentile(reps, [2.5, 97.5]) if len(reps) else (None, None)
                out.append((*key, name, float(point[0]) if np.isfinite(point[0]) else None, lo, hi, len(reps)))
        return pd.DataFrame(out, columns=[*group, "statistic", "estimate", "lo", "hi", "used"])

    return cells.groupBy(*group).applyInPandas(run, f"{kinds}, statistic string, estimate double, lo double, hi double, used long")
