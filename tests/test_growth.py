"""Operators whose work or memory must grow no faster than the input."""

import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quillon.functions import subsets
from quillon.operators import estimate, models, study


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_similarities_are_summed_without_pairs(spark):
    """Empty, small and large sets, repeated ones too, against all pairs; no join forms the pairs of a cell."""
    rng = np.random.default_rng(5)
    names = [f"n{i:02}" for i in range(25)]
    rows = [("m", f"q{i % 2}", ("en", "bn")[i // 2 % 2], i, sorted(str(x) for x in rng.choice(names, k, replace=False))) for i, k in enumerate([*rng.integers(0, 9, 150), *rng.integers(subsets.SMALL, 20, 12)] * 2)]
    rows += [(*r[:3], 1000 + r[3], r[4]) for r in rows[::7]]
    sets = estimate.set_counts(spark.createDataFrame(rows, "model string, query string, arm string, rep int, names array<string>"))
    sums = estimate.similarity_sums(sets, spark.createDataFrame([(n,) for n in names], "name string"))
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    of = lambda q, arm: [r[4] for r in rows if r[1] == q and r[2] == arm]
    got = {(r.query, r.x, r.y): (r.nx, r.ny, r.t) for r in sums.collect()}
    assert len(got) == 8
    for (q, x, y), (nx, ny, t) in got.items():
        assert (nx, ny) == (len(of(q, x)), len(of(q, y))) and t == pytest.approx(sum(jac(a, b) for a in of(q, x) for b in of(q, y)), rel=1e-12)
    assert "Join" not in _plan(sums)


def test_near_pairs_compare_classes_of_equal_words(spark, tmp_path):
    """600 rows of three texts give all their pairs, but no row meets another before classes have met."""
    from quillon.plans import catalogue

    names = ["red ring", "red ring old", "blue bolt"]
    rows = [(i, names[i % 3], "B", "LARGE", 60 if i == 0 else 5) for i in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = catalogue.QUERIES["j16_near_pairs"](spark, str(tmp_path))
    n0, n1, n2 = 199, 200, 200
    assert df.count() == df.distinct().count() == (n0 + n1) * (n0 + n1 - 1) // 2 + n2 * (n2 - 1) // 2
    assert df.where("a >= b or a = 0 or b = 0").count() == 0
    assert "Deduplicate [a#" not in _plan(df)


@pytest.mark.parametrize("names,most", [(25, 8), (25, 20), (80, 8)])
def test_similarities_without_their_matrix(names, most):
    """Draws of a query's sets, empty and large ones among them, score as with the matrix; over 63 names in blocks."""
    rng = np.random.default_rng(6)
    member = np.unique([rng.permutation(names) < rng.integers(0, most) for _ in range(300)], axis=0).astype(np.int8)
    both, size = member.astype(float) @ member.T, member.sum(1)
    union = size[:, None] + size[None] - both
    alike = np.where(union > 0, both / np.maximum(union, 1), 1.0)
    each = rng.integers(1, 4, len(member))
    x = rng.multivariate_hypergeometric(each, int(each.sum()) // 3, 5, method="marginals")
    similar = subsets.Similarities(member, most=5000)
    assert similar.product(each.astype(float)) == pytest.approx(alike @ each, rel=1e-12)
    assert models.set_excess_of(similar, each)(x) == pytest.approx(models.set_excess(x, each - x, alike), abs=1e-12)


def test_randomisation_of_many_sets_holds_no_square():
    """12,000 distinct sets, whose similarities alone would take 1,152 MB."""
    rng = np.random.default_rng(7)
    member = np.unique(rng.random((16_000, 25)) < 0.16, axis=0).astype(np.int8)[:12_000]
    each = np.ones(len(member), np.int64)
    tracemalloc.start()
    got = models.set_excess_of(subsets.Similarities(member), each)(rng.multivariate_hypergeometric(each, 5000, 3, method="marginals"))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(member) > 9000 and np.isfinite(got).all() and peak < 300


@pytest.mark.parametrize("name", ["u4_set_equality", "j9_label_branches", "j13_a41_common_support", "g2_g11_price_agreement"])
def test_keys_go_to_as_many_tasks_as_lines_ask_for(spark, monkeypatch, name):
    from quillon.plans import catalogue, designs, records  # noqa: F401

    rows, plans = [], []
    for most in (250_000, 100):
        monkeypatch.setattr(study, "LINES_A_TASK", most)
        df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        rows.append(sorted(map(str, df.collect())))
        plans.append(_plan(df))
    assert rows[0] == rows[1] and "REPARTITION_BY_NUM" in plans[1] and "REPARTITION_BY_NUM" not in plans[0]


@pytest.mark.parametrize("most", [1, 9, 400, 70_000, 10**10])
def test_draws_are_scored_together(monkeypatch, most):
    """Draws in several tables, of counts that take each of the types, and subsets of so many sets that sums have stages."""
    monkeypatch.setattr(subsets, "WORK", 1)
    rng = np.random.default_rng(8)
    member = np.unique([rng.permutation(12) < rng.integers(0, 9) for _ in range(900)], axis=0).astype(np.int8)
    both, size = member.astype(float) @ member.T, member.sum(1)
    union = size[:, None] + size[None] - both
    alike = np.where(union > 0, both / np.maximum(union, 1), 1.0)
    x = rng.integers(0, most + 1, (45, len(member)))
    assert subsets.Similarities(member).squares(x) == pytest.approx(np.einsum("dx,xy,dy->d", x.astype(float), alike, x.astype(float)), rel=1e-12)


@pytest.mark.parametrize("k", [1, 3, 6])
def test_dealt_draws_have_the_law_of_draws_without_replacement(k):
    each, rng = np.array([2, 1, 0, 3, 1]), np.random.default_rng(9)
    got = subsets.deal(rng, each, k, 40_000)
    assert (got.sum(1) == k).all() and (got <= each).all() and (got >= 0).all()
    members = np.repeat(np.arange(len(each)), each)
    want = Counter(tuple(np.bincount(c, minlength=len(each)).tolist()) for c in map(list, combinations(members, k)))
    seen = Counter(map(tuple, got.tolist()))
    assert set(seen) <= set(want)
    for x, n in want.items():
        p = n / want.total()
        assert abs(seen[x] / 40_000 - p) < 5 * (p * (1 - p) / 40_000) ** 0.5 + 1e-12


def test_randomisation_draws_once(spark):
    """The statistic and its draws come from one pass, whose groups adaptive execution does not join to a few tasks."""
    rows = [("m", f"q{i % 3}", ("en", "bn")[i // 3 % 2], [f"n{i % 5}", f"n{i % 7}"]) for i in range(60)]
    lists = spark.createDataFrame(rows, "model string, query string, arm string, names array<string>")
    values = spark.createDataFrame([("m", "c", f"q{i % 3}", "ab"[i // 3 % 2], i % 4 / 4) for i in range(60)], "model string, contrast string, query string, side string, v double")
    for df in (models.set_randomisation(lists, (("bn", "en"),), draws=50), models.randomisation(values, draws=50)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("FlatMapGroupsInPandas") == 1 and "REPARTITION_BY_NUM" in plan
        r = df.collect()
        assert len(r) == 1 and r[0].n_queries == 3 and 0 < r[0].p <= 1


def test_randomisation_beyond_the_matrix(spark, monkeypatch):
    """Queries of many sets, scored by dealt draws, have the matrix's observed value and about its P."""
    rng = np.random.default_rng(10)
    rows = [("m", f"q{i % 2}", ("en", "bn")[i // 2 % 2], sorted({f"n{x}" for x in rng.integers(0, 9 + i // 2 % 2, 3)})) for i in range(400)]
    lists = spark.createDataFrame(rows, "model string, query string, arm string, names array<string>")
    held = models.set_randomisation(lists, (("bn", "en"),)).first()
    monkeypatch.setattr(models, "MOST_HELD", 10)
    dealt = models.set_randomisation(lists, (("bn", "en"),)).first()
    assert dealt.n_queries == held.n_queries == 2 and dealt.observed == pytest.approx(held.observed, abs=1e-12)
    assert dealt.p == pytest.approx(held.p, abs=0.1)
