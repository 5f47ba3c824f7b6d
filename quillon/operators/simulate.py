"""Monte-Carlo calibration and power, fanned out over data sets; each is seeded by its own number."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.stats import acceptance_count, crossing, holm, isotonic, sign_flip, signed_rank, upper_limit, wilson

CALIBRATION_DDL = "scenario string, dataset long, model string, contrast string, p_rank double, p_flip double, reject_holm boolean"


def permuted_within(sides: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Scenario i: answers of a query change arms freely."""
    return rng.permutation(sides)


def permuted_blocks(sides: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Scenario ii: the whole arms of a query change places."""
    return sides if rng.random() < 0.5 else np.where(sides == "a", "b", "a")


SCENARIOS = {"within": permuted_within, "blocks": permuted_blocks}


def calibrate(spark: SparkSession, cells: pd.DataFrame, scenario: str, datasets: DataFrame, seed: int = 5) -> DataFrame:
    """Tests on null data sets made of one observed study: a row a data set, model and contrast.

    cells: model, contrast, query, side, v: the study's per-answer values, a bounded design of some
    thousand rows that every task gets. datasets: (dataset); leave out what a log already has.
    """
    keyed = [(k, g.sort_values(["query", "side", "v"])) for k, g in cells.groupby(["model", "contrast"])]
    shuffle = SCENARIOS[scenario]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for b in f["dataset"]:
                found = []
                for j, ((model, contrast), g) in enumerate(keyed):
                    rng = np.random.default_rng([seed, int(b), j])
                    d = []
                    for _, q in g.groupby("query"):
                        side, v = shuffle(q["side"].to_numpy(), rng), q["v"].to_numpy(float)
                        a, c = v[side == "a"], v[side == "b"]
                        if np.isfinite(a).any() and np.isfinite(c).any():
                            d.append(float(np.nanmean(a) - np.nanmean(c)))
                    got = signed_rank(d)
                    found.append((model, contrast, got[1] if got else None, sign_flip(d, 200, int(b))))
                adjusted = holm([x[2] for x in found])
                rows += [(scenario, int(b), *x, q < 0.05) for x, q in zip(found, adjusted)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALIBRATION_DDL.split(", ")])

    return datasets.select("dataset").mapInPandas(run, CALIBRATION_DDL)


def calibration_summary(log: DataFrame) -> DataFrame:
    """Rejection rates of each test and the family-wise rate, with Wilson limits, by scenario."""
    by = log.groupBy("scenario", "dataset").agg(F.avg((F.col("p_rank") < 0.05).cast("double")).alias("rank"), F.avg((F.col("p_flip") < 0.05).cast("double")).alias("flip"), F.bool_or("reject_holm").alias("any"))
    out = by.groupBy("scenario").agg(F.count("*").alias("datasets"), F.avg("rank").alias("rank_rate"), F.avg("flip").alias("flip_rate"), F.count_if("any").alias("family"))
    lo, hi = wilson(F.col("family"), F.col("datasets"))
    return out.select("scenario", "datasets", "rank_rate", "flip_rate", (F.col("family") / F.col("datasets")).alias("fwer"), lo.alias("lo"), hi.alias("hi"))


def verdict(rejections: int, datasets: int) -> str:
    """pass if no more data sets reject than the nominal level can explain."""
    return "pass" if rejections <= acceptance_count(datasets) else "fail"


def dispersion(counts: DataFrame) -> DataFrame:
    """(arm, rho): moment estimate of within-answer correlation of (arm, x of n), clipped to [0, 0.95]."""
    p = counts.groupBy("arm").agg((F.sum("x") / F.sum("n")).alias("p"))
    both = counts.join(p, "arm").where("n >= 2 and p > 0 and p < 1")
    v = F.col("p") * (1 - F.col("p"))
    num = F.sum((F.col("x") - F.col("n") * F.col("p")) * (F.col("x") - F.col("n") * F.col("p")) - F.col("n") * v)
    return both.groupBy("arm").agg(F.greatest(F.lit(0.0), F.least(F.lit(0.95), num / F.sum(F.col("n") * (F.col("n") - 1) * v))).alias("rho"))


def beta_binomial(rng: np.random.Generator, n: np.ndarray, p: float, rho: float) -> np.ndarray:
    if rho <= 0 or p in (0.0, 1.0):
        return rng.binomial(n, p)
    k = (1 - rho) / rho
    return rng.binomial(n, rng.beta(p * k, (1 - p) * k, len(n)))


def power(spark: SparkSession, effects: list[float], datasets: int, queries: int = 25, reps: int = 5, units: int = 4, base: float = 0.3, rho: float = 0.1, spread: float = 0.5, seed: int = 9) -> DataFrame:
    """(effect, dataset, p): signed-rank tests of simulated studies with a planted shift on the logit scale."""
    grid = spark.createDataFrame([(i, float(e)) for i, e in enumerate(effects)], "i int, effect double").crossJoin(F.broadcast(spark.range(datasets).withColumnRenamed("id", "dataset")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, e, b in zip(f["i"], f["effect"], f["dataset"]):
                rng = np.random.default_rng([seed, int(i), int(b)])
                logit = math.log(base / (1 - base)) + spread * rng.normal(size=queries)
                d = []
                for q in range(queries):
                    a, c = (beta_binomial(rng, np.full(reps, units), 1 / (1 + math.exp(-x)), rho) / units for x in (logit[q] + e, logit[q]))
                    d.append(float(a.mean() - c.mean()))
                got = signed_rank(d)
                out.append((float(e), int(b), got[1] if got else 1.0))
            yield pd.DataFrame(out, columns=["effect", "dataset", "p"])

    return grid.repartition(max(1, len(effects))).mapInPandas(run, "effect double, dataset long, p double")


def power_summary(results: DataFrame, level: float = 0.8) -> tuple[pd.DataFrame, float | None]:
    """Power by effect with its monotone fit, and the effect detected with the given power."""
    t = results.groupBy("effect").agg(F.avg((F.col("p") < 0.05).cast("double")).alias("power"), F.count("*").alias("n")).orderBy("effect").toPandas()
    t["fit"] = isotonic(t["power"].tolist())
    return t, crossing(t["effect"].tolist(), t["power"].tolist(), level)


def refusal_bound(refused: int, queries: int, contrast_with: int | None = None) -> float:
    """Upper limit of the share of queries with a refusal; of two arms, the larger 97.5 % limit."""
    if contrast_with is None:
        return upper_limit(refused, queries)
    return max(upper_limit(refused, queries, 0.975), upper_limit(contrast_with, queries, 0.975))
