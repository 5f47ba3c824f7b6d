"""Optimisers, refits, draws, practice sets, sizes, term scans and conclusions against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import optimise
from quillon.operators import cover, ledger, models, resample, resolve, sampling, scan, sizing
from quillon.plans import families

PAIRS = (("bn", "en"), ("bl", "en"), ("bn", "bl"))


def study(seed=1, queries=12, low=2, high=9, base=-1.2):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(queries):
        u = rng.normal(0, 0.6)
        for arm, b in (("en", base), ("bn", base + 0.5), ("bl", base + 1)):
            n = int(rng.integers(low, high))
            rows.append((f"q{q:02d}", arm, int(rng.binomial(n, 1 / (1 + math.exp(-b - u)))), n))
    return pd.DataFrame(rows, columns=["query", "arm", "s", "n"])


def valley(x):
    return (1 - x[..., 0]) ** 2 + 100 * (x[..., 1] - x[..., 0] ** 2) ** 2


def test_minimisers_find_the_end_of_a_valley():
    low, high = np.full(2, -5.0), np.full(2, 5.0)
    x, value, reached = optimise.trust_region(lambda x, _: valley(x), np.array([[-1.2, 1.0], [0.0, 3.0], [2.0, -1.0]]), low, high, 300)
    assert np.allclose(x, 1, atol=1e-3) and reached.all() and (value < 1e-6).all()
    found, ended = optimise.simplex(lambda x: float(valley(x)), np.array([-1.2, 1.0]))
    assert ended and np.allclose(found, 1, atol=1e-3)
    edge, _, _ = optimise.trust_region(lambda x, _: ((x - 9) ** 2).sum(1), np.zeros((1, 2)), low, high)
    assert np.allclose(edge, 5)


def test_refits_equal_fits_of_copied_clusters():
    data = study()
    arms, queries, s, n = models._by_query(data)
    w = resample.draw_matrix(("all",) * len(queries), 12)
    par, ok = models.refit(s, n, w)
    for b in range(12):
        copied = pd.concat([data[data["query"] == q].assign(query=f"{q}#{k}") for i, q in enumerate(queries) for k in range(w[b, i])])
        fits = models.fit_glmm(copied, PAIRS)
        assert ok[b] == (fits[0][0] == "ok")
        for (x, y), fit in zip(PAIRS, fits):
            if ok[b]:
                assert par[b, arms.index(x)] - par[b, arms.index(y)] == pytest.approx(fit[2], abs=2e-3)


def test_separated_resamples_are_dropped(spark):
    data = study(3, queries=4, base=-3.5)
    counts = spark.createDataFrame(data.assign(job="m"))
    drawn = resample.weights(spark.createDataFrame([(q,) for q in sorted(set(data["query"]))], "unit string"), 40)
    got = models.glmm_bootstrap(counts, drawn, PAIRS, block=15).toPandas()
    assert len(got) == 120 and sorted(set(got["b"])) == list(range(40))
    wide = drawn.toPandas().pivot(index="b", columns="unit", values="w")
    for b, rows in got.groupby("b"):
        total = data.assign(w=data["query"].map(wide.loc[b])).assign(s=lambda d: d.s * d.w, n=lambda d: d.n * d.w).groupby("arm")[["s", "n"]].sum()
        assert rows["estimate"].isna().all() == bool(((total.s == 0) | (total.s == total.n)).any())


def test_protocol_goes_on_to_the_next_minimiser(monkeypatch):
    want = models.fit_glmm(study(), PAIRS)[0]
    assert want[9:] == ("trust region", "trust region: ok")
    monkeypatch.setattr(models, "trust_region", lambda f, x, low, high: (x, None, np.array([False])))
    got = models.fit_glmm(study(), PAIRS)[0]
    assert got[9:] == ("simplex", "trust region: no end; simplex: ok") and got[2:6] == pytest.approx(want[2:6], abs=1e-3)
    monkeypatch.setattr(models, "simplex", lambda f, x: (x + 1, True))
    got = models.fit_glmm(study(), PAIRS)[0]
    assert got[9:] == ("quasi-newton", "trust region: no end; simplex: not at a minimum; quasi-newton: ok") and got[2] == pytest.approx(want[2], abs=1e-3)
    monkeypatch.setattr(models, "minimise", lambda f, x: (x, False))
    assert [r[0] for r in models.fit_glmm(study(), PAIRS)] == ["failed"] * 3


def test_shared_draws_equal_weights_and_replicates(spark):
    units = [f"u{i}" for i in range(7)]
    frame = spark.createDataFrame([(u, "ab"[i % 2]) for i, u in enumerate(units)], "unit string, s string")
    for stratum in (None, "s"):
        drawn = resample.weights(frame, 30, stratum=stratum).toPandas().pivot(index="b", columns="unit", values="w").to_numpy()
        assert (drawn == resample.draw_matrix(tuple("ab"[i % 2] if stratum else "all" for i in range(7)), 30)).all()
    rng = random.Random(2)
    rows = [("g", m, u, k, rng.random()) for m in "pq" for u in units for k in ("x", "y") if rng.random() < 0.7] + [("h", "p", "u1", "x", 1.0)]
    values = spark.createDataFrame(rows, "g string, m string, unit string, measure string, v double")
    got = {(r.g, r.m, r.measure): r for r in resample.cluster_statistics(values, frame, ("g",), "m", 300).collect()}
    reps = resample.replicates(values.select("g", "m", "measure", "unit", "v"), resample.weights(frame, 300), ("g", "m", "measure"))
    for r in resample.percentile_interval(reps, ("g", "m", "measure")).collect():
        mine = got[r.g, r.m, r.measure]
        assert mine.used == r.used
        assert (mine.lo, mine.hi) == ((None, None) if mine.n_units < 2 else pytest.approx((r.lo, r.hi)))
    assert got["g", "all", "x"].estimate == pytest.approx((got["g", "p", "x"].estimate + got["g", "q", "x"].estimate) / 2)


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 237])
def test_smallest_flags_exactly_a_tenth_rounded_up(spark, n):
    rows = spark.createDataFrame([(i, "x") for i in range(n)], "key long, other string").repartition(3)
    got = sampling.smallest(rows, 10, "s", "mine").collect()
    assert len(got) == n and sum(r.mine for r in got) == -(-n // 10)
    order = {r.key: r.h for r in rows.select("key", sampling.shuffle_key("s", F.col("key")).alias("h")).collect()}
    assert {r.key for r in got if r.mine} == set(sorted(order, key=order.get)[:-(-n // 10)])


def test_balanced_pairs(spark):
    rows = [(100 * q + 10 * m + k, f"q{q}", "en", f"m{m}") for q in range(5) for m in range(6) for k in range(2) if (q, m, k) != (4, 5, 1)]
    got = sampling.balanced_pairs(spark.createDataFrame(rows, "key long, query string, arm string, model string"), ("R1", "R2", "R3"), "s").collect()
    assert len(got) == len(rows)
    by, cells = defaultdict(Counter), defaultdict(list)
    for r in got:
        by[r.query][r.rater] += 1
        cells[r.query, r.model].append(r.rater)
    assert all(len(set(c)) == len(c) for c in cells.values())
    assert all(sorted(by[f"q{q}"].values()) == [4, 4, 4] for q in range(4))
    assert len({tuple(sorted(c)) for c in cells.values()}) >= 3


def greedy(rows, worth, size, often, floor, extra, order):
    """The study's rule over single answers."""
    left, chosen, covered, have = set(rows), [], Counter(), Counter()

    def gain(k):
        m, tags = rows[k]
        return sum(worth[t] / (1 + covered[t]) for t in tags if t in worth and covered[t] < often) + (extra if have[m] < floor else 0)

    while len(chosen) < size and left:
        best = min(left, key=lambda k: (-gain(k), order[k]))
        chosen.append(best)
        left.discard(best)
        covered.update(rows[best][1])
        have[rows[best][0]] += 1
    for m in sorted({m for m, _ in rows.values()}):
        while have[m] < floor and (mine := [k for k in left if rows[k][0] == m]):
            over = [k for k in chosen if have[rows[k][0]] > floor]
            add = min(mine, key=lambda k: (-gain(k), order[k]))
            if over:
                drop = min(over, key=gain)
                chosen.remove(drop)
                left.add(drop)
                have[rows[drop][0]] -= 1
            chosen.append(add)
            left.discard(add)
            have[m] += 1
    return chosen


@pytest.mark.parametrize("seed,extra", [(1, 6), (2, 0), (3, 0.5), (4, 0)])
def test_practice_set_equals_the_greedy_choice_over_answers(spark, seed, extra):
    rng = random.Random(seed)
    worth = {"a": 5, "b": 3, "c": 2, "d": 1, "e": 1}
    rows = {i: (rng.choice("xxxxxyz"), tuple(sorted({rng.choice("abcdef") for _ in range(rng.randint(0, 4))}))) for i in range(150)}
    frame = spark.createDataFrame([(k, m, list(t)) for k, (m, t) in rows.items()], "key long, model string, tags array<string>").repartition(3)
    order = {r.key: r.h for r in frame.select("key", sampling.shuffle_key("practice", F.col("key")).alias("h")).collect()}
    got = cover.practice_set(frame, worth, size=15, floor=3, floor_gain=extra).orderBy("place").collect()
    assert [r.key for r in got] == greedy(rows, worth, 15, 3, 3, extra, order)
    assert Counter(r.model for r in got)["z"] >= 3


def test_practice_set_of_few_answers(spark):
    frame = spark.createDataFrame([(1, "x", ["a"]), (2, "x", [])], "key long, model string, tags array<string>")
    assert [r.key for r in cover.practice_set(frame, {"a": 1}).orderBy("place").collect()] == [1, 2]
    assert cover.practice_set(frame.where("key < 0"), {"a": 1}).collect() == []


def test_two_draws_are_different_answers(spark):
    rows = spark.createDataFrame([("m", f"q{q}", "en", r + 1, float(r)) for q in range(3) for r in range((1, 2, 5)[q])], "model string, query string, arm string, rep int, share double")
    got = sizing.two_draws(rows, 200).select("query", "t", F.col("x.share").alias("x"), F.col("y.share").alias("y")).collect()
    assert {r["query"] for r in got} == {"q1", "q2"} and len(got) == 400
    assert all(r.x != r.y for r in got)
    seen = Counter((r.x, r.y) for r in got if r["query"] == "q2")
    assert len(seen) == 20 and max(seen.values()) < 30


def test_normal_distribution(spark):
    z = [-8.0, -2.5, -1.0, -1e-9, 0.0, 0.3, 1.96, 4.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", sizing.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * (1 + math.erf(r.z / math.sqrt(2))), abs=1e-7) for r in got)


def test_term_scan_equals_a_pattern_a_term(spark, monkeypatch):
    rng = random.Random(7)
    terms = [("note", "word"), ("note", "suffix"), ("note", "substring"), ("One Plus", "word"), ("x", "suffix"), ("ডেল", "suffix"), ("ডেল", "word"), ("রবি", "substring"), ("a-b", "word"), ("", "word"), (None, "word"), ("o", "substring"), ("plus", "suffix")]
    bits = ["note", "Note", "noter", "notes", "notegulo", "keynote", "one plus", "ONE PLUS", "x", "xte", "1x", "ডেল", "ডেলের", "ডেলিভারি", "ডেলে", "রবির", "কডেল", "a-b", "a-b2", "plusta", ".", "\n", "foo"]
    texts = [None, "", "note"] + ["".join(rng.choice(bits) + rng.choice([" ", "", ",", "  "]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    monkeypatch.setattr(scan, "MOST_TERMS", 5)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.term, r.kind): r.first for r in scan.term_hits(frame, spark.createDataFrame(terms, "term string, kind string")).collect()}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = {}
    for i, t in enumerate(texts):
        for term, kind in terms:
            if term and (m := re.search(scan.pattern(term.translate(low), kind), (t or "").translate(low))):
                want[i, term.translate(low), kind] = m.start()
    assert got == want and len({k[1:] for k in got}) >= 10


def test_word_join(spark):
    frame = spark.createDataFrame([(1, "Note one, note"), (2, None), (3, "notes")], "doc_id long, text string")
    assert [tuple(r) for r in scan.word_hits(frame, spark.createDataFrame([("note",), ("NOTE",)], "term string")).collect()] == [(1, "note")]


def test_conclusions(spark):
    rows = [("a", True, True, True, {"a": True, "b": True}, 0.2), ("b", True, True, True, {"a": True, "b": False}, 0.2), ("c", True, True, True, {}, -0.2),
            ("d", True, None, True, {}, 0.0), ("e", False, False, False, {"c": False}, None), ("f", True, True, True, {"a": None}, 1.0)]
    df = spark.createDataFrame(rows, "k string, registered boolean, mean_effect boolean, randomisation boolean, gates map<string,boolean>, estimate double")
    got = {r.k: (r.conclusion, r.direction, r.disagreement) for r in families.conclude(df).collect()}
    assert got == {"a": (True, "+", False), "b": (False, "+", True), "c": (True, "-", False), "d": (False, "0", True), "e": (False, None, False), "f": (False, "+", True)}


@pytest.mark.parametrize("up,down", [(0, 0), (5, 0), (0, 7), (3, 3), (12, 4), (40, 60)])
def test_sign_test(spark, up, down):
    got = spark.range(1).select(families.sign_test(F.lit(up), F.lit(down)).alias("p")).first().p
    n = up + down
    assert got == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(min(up, down) + 1)) / 2**n))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    shares = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    groups = {"even": rng.random(500), "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 40, "hot": np.r_[np.zeros(300), 1e9, rng.random(50)], "tied": rng.integers(0, 4, 99)}
    rows = [(g, i % 2, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("none", 0, None), ("two", 1, None)]
    frame = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    for bins in (4096, 3):
        got = {r.g: r.q for r in ledger.exact_quantiles(frame, ("g",), "x", shares, bins).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert got[g] == pytest.approx(np.quantile(np.array(xs, float), shares).tolist(), abs=1e-9)
    both = {(r.g, r.h): r.q[0] for r in ledger.exact_quantiles(frame, ("g", "h"), "x", (0.5,)).collect()}
    assert both["even", 0] == pytest.approx(np.median(groups["even"][::2]))


def naive_allocation(sizes, total, order):
    rest, whole = total - len(sizes), sum(sizes.values())
    add = {s: n * rest // whole for s, n in sizes.items()}
    left = rest - sum(add.values())
    for s in sorted(sizes, key=lambda s: (-(sizes[s] * rest % whole), order[s]))[:left]:
        add[s] += 1
    quota = {s: min(1 + add[s], n) for s, n in sizes.items()}
    short = total - sum(quota.values())
    while short > 0 and (room := [s for s in sizes if quota[s] < sizes[s]]):
        quota[min(room, key=lambda s: (-(sizes[s] - quota[s]), s))] += 1
        short -= 1
    return quota


@pytest.mark.parametrize("seed", range(5))
def test_capped_allocation_equals_giving_one_by_one(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([1, 1, 1, 2, 3, 40]) for i in range(14)}
    total = rng.choice([len(sizes), sum(sizes.values()) * 4 // 5, sum(sizes.values())])
    total = max(total, len(sizes))
    frame = spark.createDataFrame(list(sizes.items()), "stratum string, n long")
    order = {r.stratum: r.h for r in frame.select("stratum", sampling.shuffle_key("k", F.col("stratum")).alias("h")).collect()}
    got = {r.stratum: r.quota for r in sampling.capped_remainder(frame, spark.createDataFrame([(total,)], "total long"), "k").collect()}
    assert got == naive_allocation(sizes, total, order) and sum(got.values()) == total


def test_extension_of_a_name_table(spark):
    names = spark.createDataFrame([("a", "Alpha", "alef|first", "local", 1, 1, "old"), ("b", "Beta", "", "global", 2, 1, "old")], "id string, display string, aliases string, class string, ordinal long, round int, provenance string")
    fine = [("brand", "c", "Gamma", "local", "gamma", "d"), ("brand", "c", "Gamma", "local", "Gamma Co", "d"), ("both", "e", "Shop", "global", "shop", "d"), ("alias", "a", None, None, "Alfa", "d"), ("alias", "a", None, None, "ALEF", "d"), ("exclude", None, None, None, "thing", "d"), ("unidentified", None, None, None, "alpha", "d")]
    ddl = "kind string, id string, display string, class string, form string, how string"
    decisions = spark.createDataFrame([r for r in fine if r[4] != "ALEF"], ddl)
    new = resolve.extend_round(names, decisions, 2, "round two")
    rows = {r.id: r for r in new.collect()}
    assert rows["a"].aliases == "alef|first|Alfa" and rows["a"].provenance == "old; aliases extended, round two" and rows["a"].round == 1
    assert rows["c"].aliases == "Gamma Co" and rows["c"].round == 2 and rows["e"].provenance == "round two (d); brand and retailer" and rows["b"].provenance == "old"
    assert resolve.extension_problems(names, decisions, new).collect() == []
    again = resolve.extend_round(names, spark.createDataFrame(fine, ddl), 2, "round two")
    assert {r.id: r.aliases for r in again.collect()}["a"] == "alef|first|Alfa"  # a form that it has already, folded
    bad = spark.createDataFrame([("brand", "b", "Beta Two", "local", "first", "d"), ("alias", "zz", None, None, "lost", "d")], ddl)
    moved = new.withColumn("aliases", F.when(F.col("id") == "a", "alef|Alfa|odd").when(F.col("id") == "b", "first").otherwise(F.col("aliases"))).where("id <> 'e'")
    got = {(r.problem, r.surface, r.old_id, r.new_id) for r in resolve.extension_problems(names, bad, moved).collect()}
    assert {("resolved", "first", "a", "b"), ("id taken", None, "b", "b"), ("no target", None, None, "zz"), ("moved", "first", "a", "b"), ("unexplained", "odd", None, "a")} <= got
    lost = resolve.extension_problems(names, decisions, new.where("id <> 'b'")).collect()
    assert [tuple(r) for r in lost] == [("lost", "beta", "b", None)]


def test_ratios_of_shared_draws(spark):
    rng = random.Random(3)
    units = [f"u{i}" for i in range(6)]
    cells = {(g, u): (rng.randint(1, 9), rng.randint(0, 5)) for g in "pq" for u in units[:5]}
    frame = spark.createDataFrame([(u,) for u in units], "unit string")
    rows = spark.createDataFrame([(g, u, *x) for (g, u), x in cells.items()], "g string, unit string, n long, y long")
    got = {r.g: r for r in resample.cluster_ratios(rows, frame, ("g",), ("n", "y"), {"share": lambda t: t["y"] / t["n"]}, 200).collect()}
    w = resample.draw_matrix(("all",) * 6, 200)
    for g in "pq":
        n, y = ([sum(w[b, i] * cells.get((g, u), (0, 0))[k] for i, u in enumerate(units)) for b in range(200)] for k in (0, 1))
        reps = [b / a for a, b in zip(n, y) if a]
        assert got[g].used == len(reps) and (got[g].lo, got[g].hi) == pytest.approx(tuple(np.percentile(reps, [2.5, 97.5])))
        assert got[g].estimate == pytest.approx(sum(x[1] for k, x in cells.items() if k[0] == g) / sum(x[0] for k, x in cells.items() if k[0] == g))
