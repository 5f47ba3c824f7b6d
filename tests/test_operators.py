"""Operators on small tables with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import consensus, estimate, layers, ledger, models, resample, resolve, sampling, simulate

PAIR = (("bn", "en"),)


def NAMES(spark, names="xy"):
    return spark.createDataFrame([(c,) for c in names], "name string")


def sets_of(spark, en, bn):
    rows = [("m", "q", arm, r, list(s)) for arm, xs in (("en", en), ("bn", bn)) for r, s in enumerate(xs)]
    return estimate.set_counts(spark.createDataFrame(rows, "model string, query string, arm string, rep int, names array<string>"))


@pytest.mark.parametrize("en,bn,want", [(["x", "x"], ["y", "y"], 1.0), (["x", "y"], ["x", "y"], -0.5), (["x"], ["y", "y"], None)])
def test_excess_divergence(spark, en, bn, want):
    got = [r.d for r in estimate.excess_divergence(sets_of(spark, en, bn), PAIR, NAMES(spark)).collect()]
    assert got == ([] if want is None else [want])


def test_local_share(spark):
    answers = spark.createDataFrame([(1,), (2,)], "key long")
    mentions = spark.createDataFrame([(1, n) for n in "lgau"] + [(2, "u")], "key long, name string")
    classes = spark.createDataFrame([("l", "local"), ("g", "global"), ("a", "ambiguous")], "name string, class string")
    got = {r.key: r.s for r in estimate.mention_counts(answers, mentions, classes).select("key", estimate.local_share().alias("s")).collect()}
    assert got == {1: 0.5, 2: None}
    got = estimate.mention_counts(answers, mentions, classes, "local").where("key = 1").select(estimate.local_share()).first()[0]
    assert got == pytest.approx(2 / 3)


def test_paired_drops_undefined(spark):
    rows = [("m", "q1", "bn", 0.2), ("m", "q1", "bn", None), ("m", "q1", "bn", 0.4), ("m", "q1", "en", 0.1), ("m", "q2", "bn", float("nan")), ("m", "q2", "en", 1.0), ("m", "q3", "bn", 1.0), ("m", "q3", "en", 0.0), ("m", "q3", "en", 1.0)]
    cells = estimate.cell_means(spark.createDataFrame(rows, "model string, query string, arm string, x double"), F.col("x"))
    r = estimate.contrast_means(estimate.paired(cells, PAIR)).first()
    assert r.estimate == pytest.approx(0.35) and r.n == 2


def test_majority(spark):
    votes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "item int, v string")
    assert {r.item: r.consensus for r in consensus.majority_value(votes, "item", "v").collect()} == {1: "a", 2: None}
    named = spark.createDataFrame([(1, "R1", "x", 1), (1, "R1", "y", 2), (1, "R2", "y", 1), (1, "R2", "x", 2), (1, "R3", "z", 1), (1, "R3", "y", 2)], "key int, rater string, name string, place int")
    r = consensus.majority_names(named).first()
    assert r.consensus == ["x", "y"] and r.consensus_order == ["x", "y"]


@pytest.mark.parametrize("labels,check", [([("u", "a")] * 3 + [("w", "b")] * 3, lambda a: a == pytest.approx(1.0)), ([("u", "a")] * 3, lambda a: a is None), ([(f"u{i}", v) for i in range(20) for v in ("a", "b")], lambda a: a < 0.2)])
def test_krippendorff(spark, labels, check):
    assert check(consensus.krippendorff(spark.createDataFrame(labels, "item string, v string"), "item", "v").first().alpha)


def test_final_draws_and_plan(spark):
    rows = [("m", "q", "en", 0, 1, "degenerate"), ("m", "q", "en", 0, 2, "valid"), ("m", "q", "en", 1, 1, "degenerate"), ("m", "q", "en", 2, 3, "degenerate"), ("m", "q", "en", 2, 1, "degenerate")]
    draws = spark.createDataFrame(rows, "model string, query string, arm string, rep int, draw int, outcome string")
    got = {r.rep: (r.draw, r.outcome, r.first_degenerate) for r in layers.final_draws(draws).collect()}
    assert got == {0: (2, "valid", True), 1: (1, "degenerate", True), 2: (3, "degenerate", True)}
    assert {r.rep: (r.next_draw, r.status) for r in layers.redraw_plan(draws).collect()} == {0: (None, "done"), 1: (2, "plan"), 2: (None, "short")}


def test_resolve_prefers_whole_then_longer_prefix(spark):
    names = spark.createDataFrame([("a", "Alpha", "alpha one|shared", 1), ("b", "Beta", "shared", 2), ("c", "Alpha One Two", "", 3)], "id string, display string, aliases string, ordinal int")
    out = spark.createDataFrame([("junk",)], "surface string")
    keys = resolve.key_map(names, out)
    said = spark.createDataFrame([("ALPHA  one (x)",), ("alpha one two three",), ("alpha one nine",), ("Alpha zzz",), ("shared",), ("junk",), ("nope",)], "surface string")
    got = {r.surface: r.id for r in resolve.resolve(said, keys).collect()}
    assert list(got.values()) and got == {"ALPHA  one (x)": "a", "alpha one two three": "c", "alpha one nine": "a", "Alpha zzz": "a", "shared": "b", "junk": resolve.EXCLUDED, "nope": None}
    assert [r.surface for r in resolve.collisions(names).collect()] == ["shared"]
    more = resolve.extend(names, spark.createDataFrame([("gamma", "new", "g"), ("alf", "alias", "a"), ("x", "exclude", None)], "folded string, action string, id string"))
    assert {r.surface: r.id for r in resolve.key_map(more).collect()} | {"gamma": "g", "alf": "a"} == {r.surface: r.id for r in resolve.key_map(more).collect()}


def test_bootstrap_is_independent_of_partitions(spark):
    units = spark.createDataFrame([(f"u{i}", f"s{i % 2}") for i in range(10)], "unit string, s string")
    a, b = ({(r.b, r.unit): r.w for r in resample.weights(u, 30, stratum="s").collect()} for u in (units, units.repartition(7)))
    assert a == b
    w = pd.Series(a)
    assert (w.groupby(level=0).sum() == 10).all()


def test_mean_effect_edges(spark):
    units = spark.createDataFrame([(f"u{i}",) for i in range(12)], "unit string")
    rows = [("few", f"u{i}", float(i)) for i in range(5)] + [("flat", f"u{i}", 1.0) for i in range(12)] + [("big", f"u{i}", 5.0 + (i % 3) * 0.1) for i in range(12)]
    got = {r.g: r.p for r in resample.mean_effect(spark.createDataFrame(rows, "g string, unit string, v double"), resample.weights(units, 200), ("g",), 200).collect()}
    assert got["few"] is None and got["flat"] == 1.0 and got["big"] < 0.05


def test_sampling(spark):
    rows = spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 3).alias("s"))
    a, b = ({(r.key, r.s) for r in sampling.per_stratum(x, ("s",), 5, "k").collect()} for x in (rows, rows.repartition(9)))
    assert a == b and len(a) == 15
    strata = spark.createDataFrame([("a", 70), ("b", 25), ("c", 5)], "stratum string, n int")
    assert {r.stratum: r.quota for r in sampling.largest_remainder(strata, 10, "k").collect()} in ({"a": 7, "b": 3, "c": 0}, {"a": 7, "b": 2, "c": 1})
    assert sum(r.quota for r in sampling.largest_remainder(strata, 10, "k", at_least=1).collect()) == 10
    assert [r.turn for r in sampling.round_robin(rows, ("s",), 6, "k").collect()] == [1, 1, 1, 2, 2, 2]


def test_string_relation(spark):
    rows = [("a-1", "A 1"), ("a", "a-b"), ("a-b", "b"), ("a-b", "b-c"), ("x", "y")]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(ledger.string_relation(F.col("x"), F.col("y"))).collect()]
    assert got == ["equal", "subset", "superset", "overlap", "disjoint"]


def test_compare_stored(spark):
    now = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    old = spark.createDataFrame([("a", 1.0), ("b", 2.1), ("c", None), ("d", 1.0)], "k string, v double")
    assert {r.k for r in ledger.compare_stored(now, old, ["k"], "v").collect()} == {"b", "d"}


def study(effect, n_q=60, n=12, sd=0.6, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(n_q):
        u = sd * rng.normal()
        for arm, e in (("en", 0.0), ("bn", effect)):
            rows.append((f"q{q}", arm, int(rng.binomial(n, 1 / (1 + math.exp(-(-0.5 + u + e))))), n))
    return pd.DataFrame(rows, columns=["query", "arm", "s", "n"])


@pytest.mark.parametrize("cell", [False, True])
def test_glmm_recovers_an_effect(cell):
    status, contrast, est, se, z, p, sd, sd_cell, singular, optimizer, tried = models.fit_glmm(study(1.0), PAIR, cell)[0]
    assert status == "ok" and contrast == "bn-en" and abs(est - 1.0) < 3 * se and 0.05 < se < 0.3 and p < 1e-6 and 0.3 < sd < 1.0


def test_glmm_laplace_matches_quadrature():
    data = study(0.5, n_q=15, seed=3)
    x = np.broadcast_to(np.eye(2), (15, 2, 2))
    wide = data.pivot(index="query", columns="arm", values="s")[["bn", "en"]].to_numpy(float)
    s, n = wide, np.full((15, 2), 12.0)
    par = np.array([0.1, -0.4, math.log(0.5)])
    got = models.laplace(par, x, np.ones((15, 2, 1)), s, n, 2, np.zeros((15, 1)))
    nodes, weights = np.polynomial.hermite_e.hermegauss(60)
    eta = par[:2][None, None] + 0.5 * nodes[:, None, None]
    ll = (s[None] * eta - n[None] * np.log1p(np.exp(eta))).sum(2)
    want = -2 * np.log((np.exp(ll) * (weights / weights.sum())[:, None]).sum(0)).sum()
    assert got == pytest.approx(want, rel=2e-3)


def test_glmm_separation():
    data = study(0.0)
    data.loc[data["arm"] == "bn", "s"] = 0
    assert models.fit_glmm(data, PAIR)[0][0] == "separation"


def test_lmm(spark):
    rng = np.random.default_rng(1)
    rows = [("m", f"q{q}", arm, float(3 + u + e + 0.3 * rng.normal())) for q in range(40) for u in [0.5 * rng.normal()] for arm, e in (("en", 0.0), ("bn", 0.4)) for _ in range(5)]
    r = models.lmm(spark.createDataFrame(rows, "model string, query string, arm string, y double"), F.col("y"), PAIR).first()
    assert abs(r.estimate - 0.4) < 3 * r.se and r.se == pytest.approx(0.3 * math.sqrt(2 / 200), rel=0.2)


def test_randomisation(spark):
    rows = [("m", "c", f"q{q}", s, float(v)) for q in range(8) for s, vs in (("a", (3, 4, 5)), ("b", (0, 1, 2))) for v in vs] + [("m", "c", "q9", "a", None), ("m", "c", "q9", "b", 1.0)]
    values = spark.createDataFrame(rows, "model string, contrast string, query string, side string, v double")
    r = models.randomisation(values, draws=500).first()
    assert r.n_queries == 8 and r.observed == pytest.approx(3.0) and r.p < 0.02
    same = models.randomisation(values.repartition(5), draws=500).first()
    assert same == r


def test_randomisation_query_draws_ten_thousand(spark, monkeypatch):
    """The query's draws are the reference's, and the P value of few answers is that of all their assignments."""
    from itertools import combinations

    from quillon.plans import catalogue
    from quillon.plans import models as registered

    asked = []
    monkeypatch.setattr(registered.models, "randomisation", lambda values, draws, real=models.randomisation: asked.append(draws) or real(values, draws=draws))
    catalogue.QUERIES["h2_h3_randomisation"](spark, "/root/testdata/sf0.001")
    assert asked == [10_000]
    a, b = [5.0, 5.0, 2.0, 4.0], [1.0, 2.0, 2.0, 0.0]
    values = spark.createDataFrame([("m", "c", "q", s, v) for s, vs in (("a", a), ("b", b)) for v in vs], "model string, contrast string, query string, side string, v double")
    every = [sum((a + b)[i] for i in c) for c in combinations(range(8), 4)]
    want = 2 * sum(x >= sum(a) for x in every) / len(every)
    assert models.randomisation(values, draws=10_000).first().p == pytest.approx(want, abs=0.012)


def test_alternative_annotator(spark):
    rows = [(r, i, 0.9 if i % 2 else 0.8, 0.85) for r in ("R1", "R2", "R3") for i in range(60)] + [("R9", i, 0.9, 0.1) for i in range(5)]
    got = {r.rater: r for r in models.alternative_annotator(spark.createDataFrame(rows, "rater string, item int, machine double, human double")).collect()}
    assert got["R1"].advantage == 0.5 and got["R9"].p is None and got["R1"].p == got["R2"].p


def test_calibration_and_power(spark):
    rng = np.random.default_rng(3)
    cells = pd.DataFrame([("m", "c", f"q{q}", s, rng.random()) for q in range(12) for s in "ab" for _ in range(3)], columns=["model", "contrast", "query", "side", "v"])
    a, b = (sorted(map(tuple, simulate.calibrate(spark, cells, "within", spark.range(0, 40, 1, k).withColumnRenamed("id", "dataset")).collect())) for k in (1, 4))
    assert a == b and len(a) == 40
    s = simulate.calibration_summary(spark.createDataFrame(a, simulate.CALIBRATION_DDL)).first()
    assert s.fwer < 0.25 and s.lo <= s.fwer <= s.hi
    t, effect = simulate.power_summary(simulate.power(spark, [0.0, 1.0, 2.0], 25))
    assert t["fit"].is_monotonic_increasing and t["power"].iloc[0] < 0.3 and t["power"].iloc[-1] > 0.9 and 0 < effect <= 2.0
    assert simulate.refusal_bound(0, 250) == pytest.approx(1 - 0.05 ** (1 / 250))
    assert simulate.verdict(0, 100) == "pass" and simulate.verdict(60, 100) == "fail"


def test_similarity_over_bits_is_that_of_lists(spark, monkeypatch):
    """150 names fill three columns of bits; empty sets are alike. Beyond the limit sets stay lists."""
    rng = np.random.default_rng(4)
    names = [f"n{i}" for i in range(150)]
    rows = [("m", f"q{i % 3}", ("en", "bn")[i % 2], i, [str(x) for x in rng.choice(names, rng.integers(0, 30), replace=False)]) for i in range(60)]
    s = estimate.set_counts(spark.createDataFrame(rows, "model string, query string, arm string, rep int, names array<string>"))
    got = []
    for most in (1008, 100):
        monkeypatch.setattr(estimate, "MOST_NAMES", most)
        got.append({r.query: round(r.d, 9) for r in estimate.excess_divergence(s, PAIR, NAMES(spark, names)).collect()})
    assert got[0] == got[1] and len(got[0]) == 3


def test_annotators_with_few_items_take_no_part(spark):
    rows = [(r, i, 0.9, 0.1) for r, n in (("R1", 40), ("R2", 40), ("R3", 29)) for i in range(n)]
    got = {r.rater: r for r in models.alternative_annotator(spark.createDataFrame(rows, "rater string, item int, machine double, human double")).collect()}
    assert got["R3"].p is None and not got["R3"].rejected and all(r.winning_rate == 1.0 for r in got.values())


def test_no_differences_speak_for_no_effect(spark):
    d = spark.createDataFrame([("m", "bn-en", f"q{i}", 0.0) for i in range(8)], "model string, contrast string, query string, d double")
    assert [(r.n, r.p_rank) for r in models.paired_tests(d).collect()] == [(0, 1.0)]


def test_set_randomisation_against_all_assignments(spark):
    """One query of 3 and 3 answers: 20 assignments, whose tail is known exactly; two queries average."""
    from itertools import combinations

    said = {("q", "bn"): [["x"], ["x", "y"], ["x"]], ("q", "en"): [["y"], ["y", "z"], ["z"]], ("r", "bn"): [["x"], ["y"]], ("r", "en"): [["y"], ["z"]], ("s", "bn"): [["x"]], ("s", "en"): [["y"], ["y"]]}
    rows = [("m", q, arm, r, names) for (q, arm), sets in said.items() for r, names in enumerate(sets)]
    lists = spark.createDataFrame(rows, "model string, query string, arm string, rep int, names array<string>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    far = lambda xs, ys: 1 - np.mean([jac(x, y) for x in xs for y in ys])
    own = lambda xs: 1 - np.mean([jac(x, y) for x, y in combinations(xs, 2)])
    excess = lambda xs, ys: far(xs, ys) - (own(xs) + own(ys)) / 2
    pool = said["q", "bn"] + said["q", "en"]
    every = [excess([pool[i] for i in k], [pool[i] for i in range(6) if i not in k]) for k in combinations(range(6), 3)]
    t = excess(said["q", "bn"], said["q", "en"])
    want = min(1, 2 * min(np.mean([e >= t - 1e-12 for e in every]), np.mean([e <= t + 1e-12 for e in every])))
    for draws, slack in ((4000, 0.03), (19, 0.4)):  # all assignments, or drawn ones
        got = models.set_randomisation(lists.where("query = 'q'"), PAIR, draws=draws).first()
        assert (got.n_queries, got.observed) == (1, pytest.approx(t)) and got.p == pytest.approx(want, abs=slack)
    two = models.set_randomisation(lists, PAIR, draws=500).first()
    assert two.n_queries == 2 and two.observed == pytest.approx((t + excess(said["r", "bn"], said["r", "en"])) / 2)
    assert models.set_randomisation(lists.repartition(5), PAIR, draws=500).first() == two


def test_outcome_tests_name_their_method(spark):
    rng = np.random.default_rng(8)
    rows = [("m", f"q{q}", arm, int(rng.random() < (0.6 if arm == "bn" else 0.2))) for q in range(15) for arm in ("en", "bn") for _ in range(20)]
    rows += [("never", f"q{q}", arm, 0) for q in range(15) for arm in ("en", "bn") for _ in range(5)]
    got = {r.model: r for r in models.outcome_tests(spark.createDataFrame(rows, "model string, query string, arm string, y int"), F.col("y"), PAIR).collect()}
    assert got["m"].method == "glmm" and got["m"].p < 1e-6 and got["m"].estimate > 0.2
    assert got["never"].method == "signed rank" and got["never"].p == 1.0 and got["never"].estimate == 0
