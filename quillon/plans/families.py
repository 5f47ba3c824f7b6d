"""Families of registered tests: fits, intervals, corrections, and the table that draws conclusions from all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import estimate, layers, models, resample, study
from quillon.operators.study import CONTRASTS
from quillon.plans.catalogue import COUNTED, DRAWS, PAIRED, View, _EFFECT, _PLAIN, cells_sql, query, rounded

#: Resamples of the mixed models' intervals, as in the study.
BOOT = 1000
#: Re-assignments of a randomisation test, and refits of a mixed model, within the combined table: fewer than in h2_h3 and l3, which it repeats.
TABLE_DRAWS, TABLE_BOOT = 500, 250
REVERSION = (("bn", "bl"),)


@dataclass
class Family:
    """One outcome: values of answers (model, query, arm, v), trials (model, query, arm, s, n) of its mixed model, contrasts."""

    values: DataFrame | None
    trials: DataFrame | None
    contrasts: tuple[tuple[str, str], ...]
    lists: DataFrame | None = None

    def differences(self, v: View) -> DataFrame:
        if self.values is None:
            return estimate.excess_divergence(estimate.set_counts(v.lists), self.contrasts, v.names)
        return estimate.paired(estimate.cell_means(self.values, F.col("v")), self.contrasts)

    def counts(self) -> DataFrame | None:
        return None if self.trials is None else self.trials.groupBy(F.col("model").alias("job"), "query", "arm").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")


def families(v: View) -> dict[str, Family]:
    """Excess divergence, local share, share of BDT prices, price mention, reversion and refusal."""
    cell = ["model", "query", "arm"]
    a = v.answers
    ratio = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n)).alias("v")
    shares = v.counted().select(*cell, F.col("n_local").alias("s"), (F.col("n_local") + F.col("n_global")).alias("n"))
    prices = study.by_key(v.prices, "key", v.prices)
    entries = a.join(prices.groupBy("key").agg(F.count_if(F.col("currency") == "BDT").alias("s"), F.count("*").alias("n")), "key").select(*cell, "s", "n")
    yes = lambda rows, y: rows.select(*cell, y.cast("long").alias("s"), F.lit(1).cast("long").alias("n"))
    primary = a.where(layers.predicates()["primary"])
    priced = yes(layers.with_flag(primary, prices.where("currency = 'BDT'"), "priced"), F.col("priced"))
    turned = yes(a.where(layers.predicates()["non_refused"] & F.col("arm").isin("bn", "bl")), F.col("outcome") == "reversion")
    refused = yes(primary, F.col("outcome") == "refusal")
    of = lambda rows, contrasts=CONTRASTS: Family(rows.select(*cell, ratio("s", "n")), rows, contrasts)
    return {"divergence": Family(None, None, CONTRASTS, v.lists), "share": of(shares), "bdt": of(entries), "price": of(priced), "reversion": of(turned, REVERSION), "refusal": of(refused)}


def _named(family: str, df: DataFrame) -> DataFrame:
    return df.withColumn("family", F.lit(family))


def _differences(v: View) -> DataFrame:
    return estimate.union_all([_named(name, f.differences(v)) for name, f in families(v).items()])


_FAMILY_SQL = f"""{COUNTED}, units as (select a.*, s, n from answers a join (select key, count(*) filter (where currency = 'BDT') as s, count(*) as n from prices group by all) using (key)),
fam as (select 'share' as family, model, query, arm, n_local as s, n_local + n_global as n from counted union all select 'bdt', model, query, arm, s, n from units
  union all select 'price', model, query, arm, (key in (select key from prices where currency = 'BDT'))::int, 1 from answers where outcome <> 'degenerate'
  union all select 'reversion', model, query, arm, (outcome = 'reversion')::int, 1 from answers where outcome in ('valid', 'reversion') and arm in ('bn', 'bl')
  union all select 'refusal', model, query, arm, (outcome = 'refusal')::int, 1 from answers where outcome <> 'degenerate')"""


def _trials(v: View) -> DataFrame:
    return estimate.union_all([_named(name, f.trials) for name, f in families(v).items() if f.trials is not None])


def _fits(v: View, cell: bool = False) -> DataFrame:
    """The mixed models of all families that have one, a job a family and model."""
    of = lambda names: _trials(v).where(F.col("family").isin(*names)).groupBy(F.concat_ws("|", "family", "model").alias("job"), "query", "arm").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    fits = models.glmm(of(("share", "bdt", "price", "refusal")), CONTRASTS, cell).unionByName(models.glmm(of(("reversion",)), REVERSION, cell))
    part = F.split("job", "[|]", 2)
    return fits.select(part[0].alias("family"), part[1].alias("model"), *[c for c in fits.columns if c != "job"])


@query("l1_glmm")
def glmm(v: View) -> DataFrame:
    """Contrasts of every family's mixed model, with the minimiser that found it and what became of those before it."""
    return rounded(_fits(v), "estimate", "se", "z", "p", "sd_query")


@query("l2_glmm_query_and_cell")
def glmm_cell(v: View) -> DataFrame:
    """The same with a random effect of each query and arm beside that of the query."""
    return rounded(_fits(v, cell=True), "estimate", "se", "z", "p", "sd_query", "sd_cell")


def _boot(v: View, draws: int = BOOT) -> DataFrame:
    """(family, model, contrast, lo, hi, fitted): percentile limits of the mixed models' contrasts over resampled queries."""
    units = v.table("nation").select(F.col("n_name").alias("unit"))
    drawn = resample.weights(units, draws)
    reps = []
    for name, f in families(v).items():
        if f.trials is not None:
            reps.append(_named(name, models.glmm_bootstrap(f.counts(), drawn, f.contrasts)))
    r = estimate.union_all(reps).select("family", F.col("job").alias("model"), "contrast", F.col("estimate").alias("rep"))
    return resample.percentile_interval(r.where("rep is not null"), ("family", "model", "contrast")).withColumnRenamed("used", "fitted")


@query("l3_glmm_bootstrap")
def glmm_bootstrap(v: View) -> DataFrame:
    """Interval of each mixed model's contrast over a thousand resamples of queries; separated ones are dropped and counted."""
    return rounded(_boot(v).withColumn("dropped", BOOT - F.col("fitted")), "lo", "hi")


@query("a38_fit_table", f"""with {_FAMILY_SQL}, by_arm as (select family, model, arm, sum(s)::bigint as y1, sum(n)::bigint as n from fam group by all having sum(n) > 0),
q as (select family, model, count(distinct query) as n_query from fam where n > 0 group by all),
t as (select family, model, sum(n)::bigint as n, string_agg(arm || ' ' || y1 || '/' || n, ', ' order by arm) as events, bool_or(y1 = 0 or y1 = n) or count(*) < any_value(case family when 'reversion' then 2 else 3 end) as bad from by_arm group by all)
select family, model, case when bad then 'separation' else 'ok' end as status, case when bad then '(1 | query) planned' else '(1 | query)' end as random_effects, n, n_query, events, bad as fallback, case when bad then 'separation' end as fallback_reason,
case family when 'share' then 'classified mentions' when 'bdt' then 'price entries' else 'answers' end as unit from t join q using (family, model)""")
def fit_table(v: View) -> DataFrame:
    """What became of each planned mixed model, on how many units and events, and whether its fallback applies; l1 has optimisers and errors."""
    trials = _trials(v).where("n > 0")
    arms = trials.groupBy("family", "model", "arm").agg(F.sum("s").alias("y1"), F.sum("n").alias("n"))
    line = F.concat(F.col("arm"), F.lit(" "), "y1", F.lit("/"), "n")
    facts = arms.groupBy("family", "model").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), ", ").alias("events"))
    queries = trials.groupBy("family", "model").agg(F.count_distinct("query").alias("n_query"))
    status = _fits(v).groupBy("family", "model").agg(F.max("status").alias("status"))
    ok = F.col("status") == "ok"
    unit = F.when(F.col("family") == "share", "classified mentions").when(F.col("family") == "bdt", "price entries").otherwise("answers")
    effects = F.when(ok, "(1 | query)").when(F.col("status") == "failed", "(1 | query), not converged").otherwise("(1 | query) planned")
    return facts.join(queries, ["family", "model"]).join(status, ["family", "model"]).select(
        "family", "model", "status", effects.alias("random_effects"), "n", "n_query", "events", (~ok).alias("fallback"), F.when(~ok, F.col("status")).alias("fallback_reason"), unit.alias("unit"))


def _registered(v: View) -> DataFrame:
    """(family, model, contrast, estimate, n, method, p, p_holm, rejected): each family corrected within itself."""
    parts = [_named(name, models.registered_tests(f.differences(v), f.counts(), f.contrasts)) for name, f in families(v).items()]
    tests = estimate.union_all(parts).withColumn("tie", F.concat("model", "contrast"))
    return resample.holm(tests, ("family",), tie="tie").withColumn("rejected", F.col("p_holm") <= 0.05).drop("tie")


@query("l7_registered_families")
def registered_families(v: View) -> DataFrame:
    """Every family of registered tests, corrected within itself: mixed models where they fit, else signed ranks of the paired differences."""
    return rounded(_registered(v), "estimate", "p", "p_holm")


@query("p8_p9_family_contrasts", f"""with {_FAMILY_SQL}, per as (select family, model, query, arm, s / n as x from fam where n > 0), cells as (select family, model, query, arm, avg(x) as v from per group by all),
wide as (select family, model, query, max(v) filter (where arm = 'en') as en, max(v) filter (where arm = 'bn') as bn, max(v) filter (where arm = 'bl') as bl from cells group by all),
d as (select * from (select family, model, query, unnest(['bn-en', 'bl-en', 'bn-bl']) as contrast, unnest([bn - en, bl - en, bn - bl]) as d from wide) where d is not null)
select family, model, contrast, round(avg(d), 6) as estimate, count(*) as n from d group by all""")
def family_contrasts(v: View) -> DataFrame:
    """Mean paired difference of every outcome that answers have by themselves: shares, price entries, mentions, reversion, refusal."""
    parts = [_named(name, estimate.contrast_means(f.differences(v))) for name, f in families(v).items() if f.values is not None]
    return rounded(estimate.union_all(parts), "estimate")


# ------------------------------------------------------------------------------- verdicts
_SIGNS = """sg as (select model, contrast, count(*) filter (where d > 0) as up, count(*) filter (where d < 0) as down from paired group by all),
ck as (select model, contrast, sign(up::int - down::int) as lean, up + down as m, unnest(range(0, least(up, down) + 1)) as i from sg),
cb as (select model, contrast, any_value(lean) as lean, least(1.0, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))) as p_b from ck group by all)"""
_VERDICTS = f"""{_EFFECT}, {_SIGNS},
ho as (select model, contrast, mean, p, max((m - i + 1) * p) over (order by i rows unbounded preceding) as ph from (select *, row_number() over (order by p, model || contrast) as i, count(*) over () as m from tests)),
hb as (select model, contrast, lean, p_b, max((m - i + 1) * p_b) over (order by i rows unbounded preceding) as pbh from (select *, row_number() over (order by p_b, model || contrast) as i, count(*) over () as m from cb)),
bo as (select model, contrast, quantile_cont(rep, 0.025) as lo, quantile_cont(rep, 0.975) as hi from (select model, contrast, b, sum(w * d) / nullif(sum(w), 0) as rep from paired join wt on unit = query group by all) where rep is not null group by all),
vd as (select model, contrast, ho.p < 0.05 as nominal, ph <= 0.05 as rejected, p_b < 0.05 and lean * mean > 0 as agrees, pbh <= 0.05 as check_rejects, (lo > 0 and mean > 0) or (hi < 0 and mean < 0) as excludes
  from ho join hb using (model, contrast) join bo using (model, contrast)),
tx as (select *, case when rejected then case when agrees then 'supp.' else 'NOT supp.' end else '' end as first_part,
  case when check_rejects = rejected then 'Holm: same' when check_rejects then 'Holm: would reject' else 'Holm: no rejection' end as second_part from vd)"""


def _verdicts(v: View) -> DataFrame:
    """(model, contrast, nominal, rejected, agrees, check_rejects, excludes) of local share.

    The test of the mean effect, corrected by Holm, against two checks: a sign test over queries, corrected alike,
    and the bootstrap interval.
    """
    d = estimate.paired(v.share_cells(), CONTRASTS)
    unit = v.table("nation").select(F.col("n_name").alias("unit"))
    values = d.select("model", "contrast", F.col("query").alias("unit"), F.col("d").alias("v"))
    family, tie = F.lit("share").alias("family"), F.concat("model", "contrast").alias("tie")
    tests = resample.holm(resample.mean_effects(values, unit, ("model", "contrast"), DRAWS).select("*", family, tie), ("family",), tie="tie")
    signs = d.groupBy("model", "contrast").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    check = resample.holm(signs.select("*", sign_test(F.col("up"), F.col("down")).alias("p"), family, tie), ("family",), tie="tie").select(
        "model", "contrast", F.signum((F.col("up") - F.col("down")).cast("double")).alias("lean"), F.col("p").alias("p_b"), F.col("p_holm").alias("b_holm"))
    limits = resample.intervals(values, unit, ("model", "contrast"), DRAWS)
    m = F.col("mean")
    return tests.join(check, ["model", "contrast"]).join(limits, ["model", "contrast"]).select(
        "model", "contrast", (F.col("p") < 0.05).alias("nominal"), (F.col("p_holm") <= 0.05).alias("rejected"), ((F.col("p_b") < 0.05) & (F.col("lean") * m > 0)).alias("agrees"),
        (F.col("b_holm") <= 0.05).alias("check_rejects"), (((F.col("lo") > 0) & (m > 0)) | ((F.col("hi") < 0) & (m < 0))).alias("excludes"))


def sign_test(up: Column, down: Column) -> Column:
    """Two-sided P of the sign test, by the binomial's terms in turn: exact to rounding, at most 1."""
    n = up + down
    start = F.struct(F.lit(0.0).alias("sum"), (-n * F.log(F.lit(2.0))).alias("term"))
    step = lambda a, i: F.struct((a["sum"] + F.exp(a["term"])).alias("sum"), (a["term"] + F.log((n - i) / (i + 1))).alias("term"))
    # the last step would take the logarithm of nothing if all signs agreed, so it adds the term only
    last = F.aggregate(F.sequence(F.lit(0), F.least(up, down).cast("int")), start, lambda a, i: F.when(i < n, step(a, i)).otherwise(F.struct((a["sum"] + F.exp(a["term"])).alias("sum"), a["term"].alias("term"))))
    return F.least(F.lit(1.0), 2 * last["sum"])


@query("a30_verdicts", f"{_VERDICTS} select model, contrast, first_part || case when first_part = '' then '' else '; ' end || second_part as check_b, case when excludes then 'supported' else 'not' end as check_a from tx")
def verdict_strings(v: View) -> DataFrame:
    """Each contrast's verdicts: does the check support a rejection, and would it, corrected, have rejected itself?"""
    word = F.when(~F.col("rejected"), "").when(F.col("agrees"), "supp.; ").otherwise("NOT supp.; ")
    holm = F.when(F.col("check_rejects") == F.col("rejected"), "Holm: same").when(F.col("check_rejects"), "Holm: would reject").otherwise("Holm: no rejection")
    return _verdicts(v).select("model", "contrast", F.concat(word, holm).alias("check_b"), F.when(F.col("excludes"), "supported").otherwise("not").alias("check_a"))


@query("a29_rejection_counts", f"""{_VERDICTS} select contrast, count(*) as tests, count(*) filter (where nominal) as nominal, count(*) filter (where rejected) as rejected, count(*) filter (where rejected and agrees) as supported,
count(*) filter (where rejected and not agrees) as not_supported, count(*) filter (where rejected and agrees and excludes) as by_both from vd group by all""")
def rejection_counts(v: View) -> DataFrame:
    """How many tests of a contrast are below 0.05, how many Holm rejects, and how many rejections the checks support."""
    r = F.col("rejected")
    return _verdicts(v).groupBy("contrast").agg(F.count("*").alias("tests"), F.count_if("nominal").alias("nominal"), F.count_if(r).alias("rejected"), F.count_if(r & F.col("agrees")).alias("supported"),
                                                F.count_if(r & ~F.col("agrees")).alias("not_supported"), F.count_if(r & F.col("agrees") & F.col("excludes")).alias("by_both"))


# ------------------------------------------------------------------------------- the combined table
def conclude(items: DataFrame) -> DataFrame:
    """items with gates_ok, conclusion, direction and disagreement.

    items: registered, mean_effect and randomisation (rejections), gates (map of a check's name to whether it supports, empty
    where none applies), estimate. An effect is concluded if all three tests reject it and every gate supports it.
    """
    gates = F.coalesce(F.forall(F.map_values("gates"), lambda g: F.coalesce(g, F.lit(False))), F.lit(True))
    three = [F.coalesce(c, F.lit(False)) for c in ("registered", "mean_effect", "randomisation")]
    all_ = three[0] & three[1] & three[2]
    return (items.withColumn("gates_ok", gates).withColumn("conclusion", all_ & gates)
            .withColumn("direction", F.when(F.col("estimate") > 0, "+").when(F.col("estimate") < 0, "-").when(F.col("estimate") == 0, "0"))
            .withColumn("disagreement", ~((three[0] == three[1]) & (three[1] == three[2])) | (all_ & ~gates)))


def item_table(v: View) -> DataFrame:
    """Every family and contrast with its estimate, three tests, checks and the conclusion that they allow."""
    by = ["family", "model", "contrast"]
    fams, units = families(v), v.table("nation").select(F.col("n_name").alias("unit"))
    d = _differences(v).persist()  # read by four tests; a row a family, contrast, model and query
    values = d.select(*by, F.col("query").alias("unit"), F.col("d").alias("v"))
    tie = F.concat("model", "contrast").alias("tie")
    corrected = lambda t, name: resample.holm(t.select(*by, "p", tie), ("family",), tie="tie").select(*by, F.col("p").alias(f"p_{name}"), (F.col("p_holm") <= 0.05).alias(name))
    effect = corrected(resample.mean_effects(values, units, tuple(by), DRAWS), "mean_effect")
    answers = estimate.union_all([_named(name, f.values) for name, f in fams.items() if f.values is not None])
    sides = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.when(F.col("arm") == a, "a").when(F.col("arm") == b, "b").alias("side")) for a, b in CONTRASTS])).alias("s")
    dealt = answers.select("family", "model", "query", "v", sides).select("family", "model", "query", "v", "s.*").where("side is not null")
    dealt = dealt.where((F.col("family") != "reversion") | (F.col("contrast") == "bn-bl"))
    scalar = models.randomisation(dealt, tuple(by), draws=TABLE_DRAWS).select(*by, "p")
    of_sets = _named("divergence", models.set_randomisation(v.lists, CONTRASTS, draws=TABLE_DRAWS)).select(*by, "p")
    random = corrected(scalar.unionByName(of_sets), "randomisation")
    flips = models.paired_tests(d, tuple(by), draws=TABLE_DRAWS).select(*by, F.col("p_flip"))
    registered = _registered(v).select(*by, "estimate", "n", "method", F.col("p").alias("p_registered"), F.col("rejected").alias("registered"))
    limits = resample.intervals(values, units, tuple(by), DRAWS).select(*by, "lo", "hi")
    fits = _boot(v, TABLE_BOOT).select(*by, F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    joined = registered
    for part in (effect, random, flips, limits, fits):
        joined = joined.join(part, by, "left")
    same = lambda lo, hi: ((F.col(lo) > 0) & (F.col("estimate") > 0)) | ((F.col(hi) < 0) & (F.col("estimate") < 0))
    flip = F.col("p_flip") < 0.05
    gates = (F.when(F.col("family") == "divergence", F.create_map(F.lit("c"), flip)).when(F.col("method") == "glmm", F.create_map(F.lit("a"), same("a_lo", "a_hi"), F.lit("b"), flip))
             .otherwise(F.create_map().cast("map<string,boolean>")))
    out = conclude(joined.withColumn("gates", gates))
    return rounded(out.select(*by, "estimate", "n", "method", "p_registered", "registered", "p_mean_effect", "mean_effect", "p_randomisation", "randomisation", "lo", "hi",
                              F.to_json("gates").alias("gates"), "gates_ok", "conclusion", "direction", "disagreement"), "estimate", "p_registered", "p_mean_effect", "p_randomisation", "lo", "hi")
