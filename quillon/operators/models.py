"""Mixed models and per-family tests, one group a job, on counts that Spark has already summed."""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.optimise import simplex, trust_region
from quillon.functions.stats import by_rejects, normal_cdf, sign_flip, signed_rank, t_cdf
from quillon.functions.subsets import Similarities, deal
from quillon.operators.estimate import cell_means, contrast_means, paired

GLMM_DDL = "job string, status string, contrast string, estimate double, se double, z double, p double, sd_query double, sd_cell double, singular boolean, optimizer string, tried string"
#: Bounds of the logarithm of a random effect's standard deviation; below SINGULAR it counts as none.
LOW_SD, HIGH_SD, SINGULAR = -9.0, 5.0, 1e-3
#: A fit has converged where its gradient, scaled by the curvature, is below this.
SETTLED = 2e-3


def binomial_counts(rows: DataFrame, y, job: str = "model") -> DataFrame:
    """(job, query, arm, s, n): successes and trials; all that the models see of the answers."""
    return rows.groupBy(F.col(job).alias("job"), "query", "arm").agg(F.sum(y.cast("int")).alias("s"), F.count(y).alias("n"))


def laplace(par: np.ndarray, x: np.ndarray, z: np.ndarray, s: np.ndarray, n: np.ndarray, k: int, modes: np.ndarray) -> float:
    """-2 log likelihood by the Laplace approximation.

    Arrays are by query: x (q, r, k) fixed effects of its r rows, z (q, r, d) random ones, whose
    standard deviations are exp of par past the first k. modes (q, d) is the warm start, updated.
    """
    beta, sd = par[:k], np.exp(np.clip(par[k:], -12, 5))
    zs = z * np.concatenate([sd[:1], np.repeat(sd[1:], z.shape[2] - 1)])
    fixed = x @ beta
    for _ in range(60):
        eta = np.clip(fixed + np.einsum("qrd,qd->qr", zs, modes), -30, 30)
        mu = 1 / (1 + np.exp(-eta))
        grad = np.einsum("qrd,qr->qd", zs, s - n * mu) - modes
        info = np.einsum("qrd,qr,qre->qde", zs, n * mu * (1 - mu), zs) + np.eye(zs.shape[2])
        step = np.linalg.solve(info, grad[..., None])[..., 0]
        size = np.abs(step).max()
        modes += step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-9:
            break
    eta = np.clip(fixed + np.einsum("qrd,qd->qr", zs, modes), -30, 30)
    mu = 1 / (1 + np.exp(-eta))
    info = np.einsum("qrd,qr,qre->qde", zs, n * mu * (1 - mu), zs) + np.eye(zs.shape[2])
    ll = (s * eta - n * np.log1p(np.exp(eta))).sum() - 0.5 * (modes ** 2).sum() - 0.5 * np.linalg.slogdet(info)[1].sum()
    return -2 * ll


def _gradient(f, par: np.ndarray, h: float = 1e-4) -> np.ndarray:
    return np.array([(f(par + h * e) - f(par - h * e)) / (2 * h) for e in np.eye(len(par))])


def _hessian(f, par: np.ndarray, h: float = 1e-3) -> np.ndarray:
    e = np.eye(len(par)) * h
    return np.array([[(f(par + a + b) - f(par + a - b) - f(par - a + b) + f(par - a - b)) / (4 * h * h) for b in e] for a in e])


def minimise(f, par: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, bool]:
    """Quasi-Newton descent with a backtracking line search."""
    inv, value, grad = np.eye(len(par)) * 0.1, f(par), _gradient(f, par)
    for _ in range(rounds):
        if np.abs(grad).max() < 1e-6 * (1 + abs(value)):
            return par, True
        step = -inv @ grad
        if step @ grad >= 0:
            inv, step = np.eye(len(par)) * 0.1, -0.1 * grad
        t = 1.0
        while t > 1e-8 and not f(par + t * step) < value + 1e-4 * t * (step @ grad):
            t /= 2
        if t <= 1e-8:
            return par, bool(np.abs(grad).max() < 1e-2 * (1 + abs(value)))
        new = par + t * step
        g = _gradient(f, new)
        ds, dg = new - par, g - grad
        if (c := ds @ dg) > 1e-12:
            a = np.eye(len(par)) - np.outer(ds, dg) / c
            inv = a @ inv @ a.T + np.outer(ds, ds) / c
        par, value, grad = new, f(new), g
    return par, False


def _settled(f, par: np.ndarray, k: int) -> tuple[bool, np.ndarray]:
    """Whether par is a minimum by its scaled gradient and curvature, and half the curvature: the information.

    A standard deviation at its bound has no curvature to use and is left out.
    """
    live = np.r_[np.ones(k, bool), np.exp(par[k:]) >= SINGULAR]
    grad, info = _gradient(f, par)[live], (_hessian(f, par) / 2)[np.ix_(live, live)]
    try:
        scaled = np.linalg.solve(np.linalg.cholesky(info), grad / 2)
    except np.linalg.LinAlgError:
        return False, info
    return bool(min(np.abs(scaled).max(), np.abs(grad).max()) < SETTLED), info


def _separated(s: np.ndarray, n: np.ndarray) -> bool:
    """Whether an arm has no rows, or all 0, or all 1, so that the model is not identified."""
    return bool(((s == 0) | (s == n)).any())


def _by_query(data: pd.DataFrame) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Arms, queries, and successes and trials by query and arm of rows (query, arm, s, n)."""
    arms, queries = sorted(data["arm"].unique()), sorted(data["query"].unique())
    s, n = np.zeros((len(queries), len(arms))), np.zeros((len(queries), len(arms)))
    at = (data["query"].map({q: i for i, q in enumerate(queries)}).to_numpy(), data["arm"].map({a: i for i, a in enumerate(arms)}).to_numpy())
    np.add.at(s, at, data["s"].to_numpy(float))
    np.add.at(n, at, data["n"].to_numpy(float))
    return arms, queries, s, n


def fit_glmm(data: pd.DataFrame, contrasts: tuple[tuple[str, str], ...], cell: bool = False) -> list[tuple]:
    """Logistic model y ~ arm + (1 | query) [+ (1 | query:arm)] of one job: rows without the job's name.

    Three minimisers are tried in order until one ends where the function's derivatives say that it is a
    minimum: a trust region, a simplex, quasi-Newton steps. status separation: an arm without rows, or all
    0, or all 1, and nothing is tried; failed: no minimiser converged. A singular fit, of which a random
    effect is 0, counts. Contrasts are Wald, with the joint curvature at the optimum.
    """
    arms, queries, s, n = _by_query(data)
    wanted = {a for c in contrasts for a in c}
    none = [f"{a}-{b}" for a, b in contrasts]
    if not wanted <= set(arms) or _separated(s.sum(0), n.sum(0)):
        return [("separation", c, *[None] * 9) for c in none]
    k = len(arms)
    x = np.broadcast_to(np.eye(k), (len(queries), k, k))
    z = np.ones((len(queries), k, 1))
    if cell:
        z = np.concatenate([z, x], 2)
    modes = np.zeros((len(queries), z.shape[2]))
    f = lambda par: laplace(par, x, z, s, n, k, modes)
    share = (s.sum(0) + 0.5) / (n.sum(0) + 1)
    start = np.r_[np.log(share / (1 - share)), [-0.7] * (2 if cell else 1)]
    bounds = np.r_[[-30.0] * k, [LOW_SD] * (len(start) - k)], np.r_[[30.0] * k, [HIGH_SD] * (len(start) - k)]

    def by_trust_region(par: np.ndarray) -> tuple[np.ndarray, bool]:
        best, _, reached = trust_region(lambda rows, _: np.array([f(p) for p in rows]), par[None], *bounds)
        return best[0], bool(reached[0])

    tried = []
    for name, method in (("trust region", by_trust_region), ("simplex", lambda par: simplex(f, par)), ("quasi-newton", lambda par: minimise(f, par))):
        par, reached = method(start)
        good, info = _settled(f, par, k)
        tried.append(f"{name}: {'ok' if good else 'not at a minimum' if reached else 'no end'}")
        if good:
            break
    else:
        return [("failed", c, *[None] * 8, "; ".join(tried)) for c in none]
    sd = np.exp(par[k:])
    singular, v = bool((sd < SINGULAR).any()), np.linalg.inv(info)[:k, :k]
    out = []
    for a, b in contrasts:
        w = np.zeros(k)
        w[arms.index(a)], w[arms.index(b)] = 1, -1
        est, var = float(w @ par[:k]), float(w @ v @ w)
        se = math.sqrt(var) if var > 0 else None
        zz = est / se if se else None
        out.append(("ok", f"{a}-{b}", est, se, zz, 2 * normal_cdf(-abs(zz)) if zz is not None else None, float(sd[0]), float(sd[1]) if cell else None, singular, name, "; ".join(tried)))
    return out


def glmm(counts: DataFrame, contrasts: tuple[tuple[str, str], ...], cell: bool = False) -> DataFrame:
    """Fit every job of (job, query, arm, s, n): a group holds queries times arms rows."""

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(str(key[0]), *r) for r in fit_glmm(data, contrasts, cell)], columns=[c.split()[0] for c in GLMM_DDL.split(", ")])

    return counts.groupBy("job").applyInPandas(run, GLMM_DDL)


def deviances(par: np.ndarray, s: np.ndarray, n: np.ndarray, w: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """-2 log likelihoods (B) by the Laplace approximation of y ~ arm + (1 | query), one for each row of weights w (B, q).

    par (B, k + 1): effects of the k arms, and the standard deviation, of either sign. s, n (q, k). A query
    of weight 2 counts as two clusters alike, which share their mode. modes (B, q) are updated.
    """
    fixed, sd = par[:, None, :-1], par[:, -1:]
    for _ in range(60):
        mu = 1 / (1 + np.exp(-np.clip(fixed + (sd * modes)[..., None], -30, 30)))
        info = sd**2 * (n * mu * (1 - mu)).sum(2) + 1
        step = (sd * (s - n * mu).sum(2) - modes) / info
        modes += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    eta = np.clip(fixed + (sd * modes)[..., None], -30, 30)
    mu = 1 / (1 + np.exp(-eta))
    info = sd**2 * (n * mu * (1 - mu)).sum(2) + 1
    return -2 * (w * ((s * eta - n * np.logaddexp(0, eta)).sum(2) - 0.5 * modes**2 - 0.5 * np.log(info))).sum(1)


def refit(s: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Effects (B, k) of the model refitted under each row of weights w (B, q), and which of them were fitted.

    All refits are one array program that starts from the fit of all queries. Separated ones are dropped.
    """
    total = np.stack([w @ s, w @ n])
    ok = ~((total[0] == 0) | (total[0] == total[1])).any(1)
    k = s.shape[1]
    low, high = np.r_[[-30.0] * k, 0.0], np.r_[[30.0] * k, np.exp(HIGH_SD)]

    def fit(weights: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        modes = np.zeros(weights.shape)

        def f(par: np.ndarray, rows: np.ndarray) -> np.ndarray:
            own = modes[rows]
            out = deviances(par, s, n, weights[rows], own)
            modes[rows] = own
            return out

        par, value, _ = trust_region(f, start, low, high)
        return par, np.isfinite(value) & np.isfinite(par).all(1)

    share = (s.sum(0) + 0.5) / (n.sum(0) + 1)
    whole, _ = fit(np.ones((1, len(s))), np.r_[np.log(share / (1 - share)), 0.5][None])
    whole[:, -1] = np.maximum(whole[:, -1], 0.1)  # from a deviation of 0 no slope leads away
    out = np.full((len(w), k), np.nan)
    if ok.any():
        par, finite = fit(w[ok].astype(float), np.repeat(whole, ok.sum(), 0))
        out[ok] = np.where(finite[:, None], par[:, :-1], np.nan)
    return out, np.isfinite(out).all(1)


def glmm_bootstrap(counts: DataFrame, weights: DataFrame, contrasts: tuple[tuple[str, str], ...], block: int = 250) -> DataFrame:
    """(job, b, contrast, estimate): refits on resampled queries; estimate is null where the resample is separated.

    weights: (b, unit, w), a query drawn w times counts as w clusters. One task a job and block of
    resamples: it holds queries times arms rows, each query with its weights of the block as an array.
    """
    packed = weights.withColumn("block", F.floor(F.col("b") / block)).groupBy("block", F.col("unit").alias("query")).agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("drawn"))
    rows = counts.join(packed, "query").select("job", "block", "query", "arm", "s", "n", "drawn")

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        arms, queries, s, n = _by_query(data)
        drawn = data.drop_duplicates("query").set_index("query")["drawn"]
        b = [x["b"] for x in drawn[queries[0]]]
        par, _ = refit(s, n, np.array([[x["w"] for x in drawn[q]] for q in queries]).T)
        each = [(f"{x}-{y}", par[:, arms.index(x)] - par[:, arms.index(y)] if x in arms and y in arms else np.full(len(b), np.nan)) for x, y in contrasts]
        out = pd.concat([pd.DataFrame({"job": str(key[0]), "b": b, "contrast": name, "estimate": est}) for name, est in each])
        return out.astype({"b": "int64"}).assign(estimate=pd.array(out["estimate"].where(out["estimate"].notna(), None), "Float64"))

    return rows.groupBy("job", "block").applyInPandas(run, "job string, b long, contrast string, estimate double")


LMM_DDL = "job string, contrast string, estimate double, se double, z double, p double, ratio double"


def fit_lmm(data: pd.DataFrame, contrasts: tuple[tuple[str, str], ...]) -> list[tuple]:
    """Linear model y ~ arm + (1 | query) by REML, from counts, sums and sums of squares by query and arm."""
    arms = sorted(data["arm"].unique())
    groups = [(g.set_index("arm").reindex(arms).fillna(0.0)) for _, g in data.groupby("query")]
    n, t = np.array([g["n"] for g in groups], float), np.array([g["t"] for g in groups], float)
    yy, total, k = float(data["tt"].sum()), n.sum(), len(arms)

    def parts(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        m = n.sum(1)
        shrink = ratio / (1 + ratio * m)
        xvx = np.diag(n.sum(0)) - np.einsum("q,qa,qb->ab", shrink, n, n)
        xvy = t.sum(0) - np.einsum("q,qa,q->a", shrink, n, t.sum(1))
        beta = np.linalg.solve(xvx, xvy)
        rss = yy - (shrink * t.sum(1) ** 2).sum() - beta @ xvy
        var = rss / (total - k)
        crit = np.log1p(ratio * m).sum() + np.linalg.slogdet(xvx)[1] + (total - k) * math.log(max(var, 1e-300))
        return crit, beta, np.linalg.inv(xvx) * var, var

    grid = np.r_[0.0, np.exp(np.linspace(-10, 6, 60))]
    best = min(grid, key=lambda r: parts(r)[0])
    lo, hi = best / 1.5, best * 1.5
    for _ in range(60):  # golden section around the best of the grid
        a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if parts(a)[0] < parts(b)[0] else (a, hi)
    ratio = (lo + hi) / 2
    _, beta, v, _ = parts(ratio)
    out = []
    for a, b in contrasts:
        w = np.zeros(k)
        w[arms.index(a)], w[arms.index(b)] = 1, -1
        est, se = float(w @ beta), math.sqrt(float(w @ v @ w))
        out.append((f"{a}-{b}", est, se, est / se, 2 * normal_cdf(-abs(est / se)), float(ratio)))
    return out


def lmm(rows: DataFrame, y, contrasts: tuple[tuple[str, str], ...], job: str = "model") -> DataFrame:
    """Fit every job on sufficient statistics by query and arm."""
    stats = rows.groupBy(F.col(job).alias("job"), "query", "arm").agg(F.count(y).cast("double").alias("n"), F.sum(y).alias("t"), F.sum(y * y).alias("tt"))

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(str(key[0]), *r) for r in fit_lmm(data, contrasts)], columns=[c.split()[0] for c in LMM_DDL.split(", ")])

    return stats.groupBy("job").applyInPandas(run, LMM_DDL)


def paired_tests(differences: DataFrame, group: tuple[str, ...] = ("model", "contrast"), draws: int = 2000) -> DataFrame:
    """Signed-rank and sign-flip tests of per-query differences (group, query, d)."""
    ddl = ", ".join(f"{g} string" for g in group) + ", n int, w double, p_rank double, p_flip double"

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        d = data.sort_values("query")["d"].tolist()
        got = signed_rank(d) or (None, 1.0 if d else None, 0)  # differences that are all zero speak for no effect
        return pd.DataFrame([(*map(str, key), got[2], got[0], got[1], sign_flip(d, draws))], columns=[c.split()[0] for c in ddl.split(", ")])

    return differences.groupBy(*group).applyInPandas(run, ddl)


def _null_test(per_query: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group, n_queries, observed, p) from queries' statistics (group, observed, stars), stars one value a draw.

    The test's statistic is the mean over queries, its null distribution the mean of the draws of one
    number; a query's undefined draw is left out, and so is a draw that no query defines. Two-sided,
    with the observed assignment counted among the draws.
    """
    # one pass: a second use of per_query would run its draws again
    draws = per_query.select(*group, "observed", F.posexplode("stars").alias("draw", "star")).groupBy(*group, "draw").agg(
        F.count("*").cast("int").alias("n_queries"), F.avg("observed").alias("observed"), F.avg(F.nanvl("star", F.lit(None))).alias("star"))
    every = Window.partitionBy(*group)
    draws = draws.select(*group, "star", *[F.max(F.when(F.col("draw") == 0, F.col(x))).over(every).alias(x) for x in ("n_queries", "observed")])
    tail = lambda c: (F.count_if(c) + 1) / (F.count("star") + 1)
    p = F.least(F.lit(1.0), 2 * F.least(tail(F.col("star") >= F.col("observed") - 1e-12), tail(F.col("star") <= F.col("observed") + 1e-12)))
    return draws.groupBy(*group, "n_queries", "observed").agg(F.when(F.count("star") > 0, p).alias("p"))


def _spread(rows: DataFrame, *key: str) -> DataFrame:
    """rows by key in a fixed number of partitions: adaptive execution would join groups, whose work is in their draws, to a few tasks by their bytes."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *key)


def randomisation(values: DataFrame, group: tuple[str, ...] = ("model", "contrast"), draws: int = 2000, seed: int = 11) -> DataFrame:
    """Two-sided randomisation test of the mean difference of two arms, re-assigning answers within queries.

    values: (group, query, side 'a' or 'b', v), null v undefined. Each draw permutes the sides of
    every query's answers; markers of undefined values move with the answers. Queries with an
    undefined side in the data take no part. Equal values are exchangeable, so Spark counts them
    first, a query is a group of its distinct values, and a draw is how many of each go to side a.
    """
    ddl = ", ".join(f"{g} string" for g in group) + ", observed double, stars array<double>"
    counted = values.groupBy(*group, "query", "side", "v").agg(F.count("*").alias("c"))

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        table = data.pivot_table(index=data["v"].astype(float).fillna(np.inf), columns="side", values="c", aggfunc="sum", fill_value=0)
        worth = table.index.to_numpy(float)
        side = {x: table[x].to_numpy(np.int64) if x in table else np.zeros(len(worth), np.int64) for x in "ab"}
        ok = np.isfinite(worth)
        mean = lambda m: np.where(m[:, ok].sum(1) > 0, m[:, ok] @ worth[ok] / np.maximum(m[:, ok].sum(1), 1), np.nan)
        t = (mean(side["a"][None]) - mean(side["b"][None]))[0]
        if np.isnan(t):
            return pd.DataFrame(columns=[*group, "observed", "stars"])
        rng = np.random.default_rng([seed, *str(tuple(map(str, (key[:-1], key[-1])))).encode()])
        each, stars = side["a"] + side["b"], []
        step = max(1, 1_000_000 // len(worth))
        for k in range(0, draws, step):
            a = rng.multivariate_hypergeometric(each, int(side["a"].sum()), min(step, draws - k), method="marginals")
            stars.append(mean(a) - mean(each - a))
        return pd.DataFrame([(*map(str, key[:-1]), t, np.concatenate(stars))], columns=[*group, "observed", "stars"])

    return _null_test(_spread(counted, *group, "query").groupBy(*group, "query").applyInPandas(run, ddl), group)


def set_excess(a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Excess divergence of rows of counts of distinct sets of two arms, given the sets' similarities."""
    na, nb = a.sum(1), b.sum(1)
    to_a = a @ alike
    within = lambda m, to, n: ((to * m).sum(1) - n) / (n * (n - 1))
    between = (to_a * b).sum(1) / (na * nb)
    return (1 - between) - ((1 - within(a, to_a, na)) + (1 - within(b, b @ alike, nb))) / 2


def set_excess_of(similar: Similarities, each: np.ndarray):
    """A function from rows of counts of the first arm to excess divergences, the second having the rest of each; no similarity matrix is held."""
    to_all, top = similar.product(each.astype(float)), similar.most(each)
    total = each @ to_all

    def of(a: np.ndarray) -> np.ndarray:
        na = a.sum(1, dtype=float)
        nb, aa, ae = each.sum() - na, similar.squares(a, top), a @ to_all
        within = lambda t, n: (t - n) / (n * (n - 1))
        return (1 - (ae - aa) / (na * nb)) - ((1 - within(aa, na)) + (1 - within(total - 2 * ae + aa, nb))) / 2

    return of


#: Distinct sets of a query up to which their similarities are held as a matrix.
MOST_HELD = 3000
#: Draws scored together where they are not.
DRAWS_AT_ONCE = 250


def set_randomisation(lists: DataFrame, contrasts: tuple[tuple[str, str], ...], field: str = "names", draws: int = 2000, seed: int = 12) -> DataFrame:
    """Randomisation test of excess divergence: the pooled answers' name sets re-assigned to two arms within each query.

    (model, contrast, n_queries, observed, p). Queries with an arm of fewer than two answers take no
    part. Spark counts equal sets first. Up to MOST_HELD distinct sets of a query their similarities are a
    matrix; beyond, a draw goes by the subsets that sets share, so memory and work grow as the sets do. If
    there are no more assignments than draws, draws pick from all of them with equal chance.
    """
    arms = sorted({x for c in contrasts for x in c})
    counted = lists.select("model", "query", "arm", F.array_sort(F.array_distinct(field)).alias("s")).groupBy("model", "query", "s").agg(*[F.count_if(F.col("arm") == x).alias(x) for x in arms])
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in contrasts])).alias("w")
    counted = counted.select("model", "query", "s", pairs).select("model", "w.contrast", "query", "s", "w.a", "w.b").where("a + b > 0")

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        table = data.assign(s=[tuple(x) for x in data["s"]]).set_index("s").sort_index()
        a, b = (table[x].to_numpy(np.int64) for x in "ab")
        if a.sum() < 2 or b.sum() < 2:
            return pd.DataFrame(columns=["model", "contrast", "observed", "stars"])
        names = {x: k for k, x in enumerate(sorted({x for s in table.index for x in s}))}
        member = np.zeros((len(table), max(1, len(names))), np.int8)
        member[np.repeat(np.arange(len(table)), [len(s) for s in table.index]), [names[x] for s in table.index for x in s]] = 1
        held_whole = len(table) <= MOST_HELD
        if held_whole:
            held = member.astype(float)
            both, size = held @ held.T, held.sum(1)
            union = size[:, None] + size[None] - both
            alike = np.where(union > 0, both / np.maximum(union, 1), 1.0)
            excess = lambda x: set_excess(x, a + b - x, alike)
        else:
            excess = set_excess_of(Similarities(member), a + b)
        rng, each = np.random.default_rng([seed, *str(key).encode()]), a + b
        if math.comb(int(each.sum()), int(a.sum())) <= draws:
            of = np.repeat(np.arange(len(each)), each)
            every = np.array([np.bincount(of[list(x)], minlength=len(each)) for x in combinations(range(len(of)), int(a.sum()))])
            stars = excess(every)[rng.integers(0, len(every), draws)]
        else:
            some = partial(rng.multivariate_hypergeometric, method="marginals") if held_whole else partial(deal, rng)
            step, parts = max(1, 4_000_000 // len(each)) if held_whole else DRAWS_AT_ONCE, []
            for k in range(0, draws, step):
                parts.append(excess(some(each, int(a.sum()), min(step, draws - k))))
            stars = np.concatenate(parts)
        return pd.DataFrame([(str(key[0]), str(key[1]), float(excess(a[None])[0]), stars)], columns=["model", "contrast", "observed", "stars"])

    per = _spread(counted, "model", "contrast", "query").groupBy("model", "contrast", "query").applyInPandas(run, "model string, contrast string, observed double, stars array<double>")
    return _null_test(per, ("model", "contrast"))


def registered_tests(differences: DataFrame, counts: DataFrame | None, contrasts: tuple[tuple[str, str], ...]) -> DataFrame:
    """(model, contrast, estimate, n, method, p): the registered test of each contrast of one family.

    estimate is the mean over queries of the paired differences (model, query, contrast, d). P is the mixed model's on
    counts (job, query, arm, s, n), where there are counts and it fits, else that of the signed-rank test.
    """
    ranks = paired_tests(differences, draws=200).select("model", "contrast", "p_rank")
    found = contrast_means(differences).join(ranks, ["model", "contrast"], "left")
    if counts is None:
        return found.select("model", "contrast", "estimate", "n", F.lit("signed rank").alias("method"), F.col("p_rank").alias("p"))
    fit = glmm(counts, contrasts).where("status = 'ok' and p is not null and not isnan(p)").select(F.col("job").alias("model"), "contrast", F.col("p").alias("p_fit"))
    return found.join(fit, ["model", "contrast"], "left").select(
        "model", "contrast", "estimate", "n", F.when(F.col("p_fit").isNotNull(), "glmm").otherwise("signed rank").alias("method"), F.coalesce("p_fit", "p_rank").alias("p"))


def outcome_tests(rows: DataFrame, y, contrasts: tuple[tuple[str, str], ...]) -> DataFrame:
    """The registered test of a yes-or-no outcome of answers. y: 0 or 1, null undefined."""
    return registered_tests(paired(cell_means(rows, y.cast("double")), contrasts), binomial_counts(rows.where(y.isNotNull()), y), contrasts)


def alternative_annotator(scores: DataFrame, margin: float = 0.15, q: float = 0.05, least: int = 30) -> DataFrame:
    """Could a machine replace a rater? scores: (rater, item, machine, human), each a similarity to the other raters.

    For each rater: the share of items on which it is at least as good as the machine less the
    machine's share, tested below the margin (one-sided t); rejections by Benjamini-Yekutieli.
    Raters with fewer than least items take no part: no p, no rejection, no place in the winning
    rate. The moments are summed by Spark; a handful of rows is left for the t distribution.
    """
    wf, wh = (F.col("machine") >= F.col("human")).cast("double"), (F.col("human") >= F.col("machine")).cast("double")
    d = wh - wf
    m = scores.groupBy("rater").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.avg(wf).alias("advantage"))

    def run(_: tuple, data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("rater")
        p = []
        for n, mean, sd in zip(data["n"], data["mean"], data["sd"]):
            if n < least:
                p.append(None)
            elif not sd > 0:
                p.append(float(mean >= margin))
            else:
                p.append(t_cdf((mean - margin) / (sd / math.sqrt(n)), n - 1))
        tested = [x for x in p if x is not None]
        won = iter(by_rejects(tested, q))
        rejected = [x is not None and bool(next(won)) for x in p]
        return data.assign(p=pd.array(p, "Float64"), rejected=rejected, winning_rate=sum(rejected) / len(tested) if tested else None)[["rater", "n", "mean", "advantage", "p", "rejected", "winning_rate"]]

    return m.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "rater string, n long, mean double, advantage double, p double, rejected boolean, winning_rate double")
