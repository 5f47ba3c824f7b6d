"""Queries over the design of a study: draws, raters, practice sets, sizes, gates and term scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import cover, estimate, layers, resample, resolve, sampling, scan, sizing, study
from quillon.operators.study import hash32
from quillon.plans.catalogue import CONTRASTS, COUNTED, DRAWS, F1, JAC, _PLAIN, View, h, query, rounded

# ------------------------------------------------------------------------------- a labelling round: draw, pairs of raters, overlap
_SIX = 6  # subjects of the round: the design needs as many as there are pairs of raters, twice
_ROUND = f"""rnd as (select key, query, arm, 'm' || ({h("'subject|' || key")} % {_SIX}) as model from answers),
drawn2 as (select *, {h("'reuse|' || key")} % 50 = 0 as reused from rnd qualify row_number() over (partition by query, arm, model order by md5('round|' || key), key) <= 2),
rated as (select *, (dense_rank() over (partition by query, arm order by model) - 1) % 6 as i, (row_number() over (partition by query, arm, model order by md5('pairs|' || key), key) - 1) % 2 + 1 as j from drawn2 where not reused),
slots as (select query, arm, s, row_number() over (partition by query, arm order by md5('pairs|' || query || '|' || arm || '|' || s), s) - 1 as i from (select distinct query, arm from rated), (select unnest(range(6)) as s)),
paired2 as (select r.key, r.query, r.arm, r.model, [['R1', 'R2'], ['R1', 'R3'], ['R2', 'R3'], ['R1', 'R2'], ['R1', 'R3'], ['R2', 'R3']][s + 1][j] as rater,
  row_number() over (order by md5('overlap|' || key), key) <= (count(*) over () + 9) // 10 as overlap from rated r join slots using (query, arm, i))"""


def _round(v: View) -> DataFrame:
    """Two answers of each query, arm and subject; a fiftieth has a label already and is not rated again."""
    rows = v.answers.select("key", "query", "arm", F.concat(F.lit("m"), hash32("subject", F.col("key")) % _SIX).alias("model"))
    drawn = sampling.per_stratum(rows, ("query", "arm", "model"), 2, "round").drop("shortfall")
    return drawn.withColumn("reused", hash32("reuse", F.col("key")) % 50 == 0)


def _rated(v: View) -> DataFrame:
    return sampling.smallest(sampling.balanced_pairs(_round(v).where("not reused").drop("reused"), study.RATERS, "pairs"), 10, "overlap", "overlap")


@query("r6_assign_raters", f"with {_ROUND} select * from paired2")
def assign_raters(v: View) -> DataFrame:
    """Who rates what: pairs of raters balanced within query and arm, and a tenth, rounded up, that all rate."""
    return _rated(v).select("key", "query", "arm", "model", "rater", "overlap")


@query("r5_two_of_each_cell", f"""with {_ROUND}, n as (select query, arm, model, count(*) as n from rnd group by all) select key, query, arm, model, greatest(0, 2 - n) as shortfall from drawn2 join n using (query, arm, model)""")
def two_of_each_cell(v: View) -> DataFrame:
    rows = v.answers.select("key", "query", "arm", F.concat(F.lit("m"), hash32("subject", F.col("key")) % _SIX).alias("model"))
    return sampling.per_stratum(rows, ("query", "arm", "model"), 2, "round")


@query("r8_design_check", f"""with {_ROUND}, single as (select * from paired2 where not overlap), cells as (select query, arm, model, count(*) as n, count(distinct rater) as d from single group by all),
g as (select query, arm, count(*) as n, list_sort(list(c)) as split from (select query, arm, rater, count(*) as c from single group by all) group by all),
full_ as (select query, arm, list_sum(split) as n, split from g)
select (select count(*) from drawn2 where reused) as reused, (select count(*) from paired2 where overlap) as overlap, (select count(*) from single) as single, (select count(*) from cells) as single_cells,
(select count(*) from cells where n <> d) as one_rater_twice, (select count(*) from full_ where n = 12) as full_groups, (select count(*) from full_ where n = 12 and split = [4, 4, 4]) as balanced_groups""")
def design_check(v: View) -> DataFrame:
    """The assignment against its rules: no rater has both answers of a cell to themself; full groups of twelve are split 4, 4, 4."""
    rated, single = _rated(v), _rated(v).where("not overlap")
    cells = single.groupBy("query", "arm", "model").agg(F.count("*").alias("n"), F.count_distinct("rater").alias("d")).agg(F.count("*").alias("single_cells"), F.count_if(F.expr("n <> d")).alias("one_rater_twice"))
    split = single.groupBy("query", "arm").agg(F.count("*").alias("n"), *[F.count_if(F.col("rater") == r).alias(r) for r in study.RATERS]).where("n = 12")
    even = split.agg(F.count("*").alias("full_groups"), F.count_if(F.expr("R1 = 4 and R2 = 4 and R3 = 4")).alias("balanced_groups"))
    counts = rated.agg(F.count_if("overlap").alias("overlap"), F.count_if(~F.col("overlap")).alias("single"))
    reused = _round(v).agg(F.count_if("reused").alias("reused"))
    return reused.join(counts).join(cells).join(even)  # one row each


# ------------------------------------------------------------------------------- a practice set that covers features
#: What a feature is worth while no chosen answer has it.
_WORTH = {"arm:bl": 2, "arm:bn": 1, "arm:en": 1, "lang:mixed": 5, "lang:banglish": 3, "lang:bn": 1, "lang:en": 1, "hedged": 4, "price_bdt": 3, "price_usd": 4, "retailers": 2, "many_brands": 1, "no_commercial": 2}


def tagged(v: View) -> DataFrame:
    """(key, model, tags): the features of each answer."""
    p = v.prices.groupBy("key").agg(F.bool_or(F.col("currency") == "BDT").alias("bdt"), F.bool_or(F.col("currency") == "USD").alias("usd"), F.count("*").alias("n_prices"))
    r = v.retailers.groupBy("key").agg(F.count("*").alias("n_retailers"))
    rows = v.answers.select("key", "model", "arm", "outcome").join(p, "key", "left").join(r, "key", "left").join(v.lists.select("key", F.size("names").alias("n_names")), "key", "left")
    said = F.coalesce("n_names", F.lit(0)) + F.coalesce("n_prices", F.lit(0)) + F.coalesce("n_retailers", F.lit(0))
    language = F.element_at(F.array(*[F.lit(f"lang:{x}") for x in ("en", "bn", "banglish", "mixed")]), (hash32("language", F.col("key")) % 4 + 1).cast("int"))
    marks = {"price_bdt": F.col("bdt"), "price_usd": F.col("usd"), "retailers": F.col("n_retailers") > 0, "many_brands": F.col("n_names") >= 4, "no_commercial": said == 0,
             "hedged": (F.col("outcome") == "refusal") & (said > 0)}
    return rows.select("key", "model", F.array_compact(F.array(F.concat(F.lit("arm:"), F.col("arm")), language, *[F.when(on, tag) for tag, on in marks.items()])).alias("tags"))


@query("r7_feature_cover")
def feature_cover(v: View) -> DataFrame:
    """Fifteen answers chosen one by one for the features that they add, each model twice at least."""
    return cover.practice_set(tagged(v), _WORTH)


# ------------------------------------------------------------------------------- sizes of a study
_SIZE_DRAWS = 400
_PICK = f"""reps as (select model, query, arm, rep, names, case when n_local + n_global > 0 then n_local / (n_local + n_global) end as share from counted join (select key, names from lists) using (key)),
nn as (select model, query, arm, count(*) as n from reps group by all having n > 1),
tt as (select *, {h("'first|' || model || '|' || query || '|' || arm || '|' || t")} % n as i, {h("'second|' || model || '|' || query || '|' || arm || '|' || t")} % (n - 1) as j0 from nn, (select unnest(range({_SIZE_DRAWS})) as t)),
pk as (select *, case when j0 >= i then j0 + 1 else j0 end as j from tt),
two as (select k.model, k.query, k.arm, k.t, x.names as xn, y.names as yn, case when x.share is not null and y.share is not null then (x.share + y.share) / 2 else coalesce(x.share, y.share) end as share
  from pk k join reps x on x.model = k.model and x.query = k.query and x.arm = k.arm and x.rep = k.i + 1 join reps y on y.model = k.model and y.query = k.query and y.arm = k.arm and y.rep = k.j + 1),
cn as (select unnest(['bn-en', 'bl-en', 'bn-bl']) as contrast, unnest(['bn', 'bl', 'bn']) as a, unnest(['en', 'en', 'bl']) as b),
both2 as (select x.model, x.query, contrast, x.share - y.share as d, (1 - ({JAC.format(a='x.xn', b='y.xn')} + {JAC.format(a='x.xn', b='y.yn')} + {JAC.format(a='x.yn', b='y.xn')} + {JAC.format(a='x.yn', b='y.yn')}) / 4)
  - ((1 - {JAC.format(a='x.xn', b='x.yn')}) + (1 - {JAC.format(a='y.xn', b='y.yn')})) / 2 as e from cn join two x on x.arm = a join two y on y.arm = b and y.model = x.model and y.query = x.query and y.t = x.t),
vals as (select 'share contrast' as statistic, model, contrast as part, query, d as v from both2 union all select 'excess divergence', model, contrast, query, e from both2 union all select 'arm share', model, arm, query, share from two),
pq as (select statistic, model, part, query, avg(v) as m, var_samp(v) as w from vals where v is not null group by all having count(v) > 1),
cp as (select statistic, model, part, avg(m) as mean, var_samp(m) + avg(w) as variance, count(*) as n_query from pq group by all having count(*) > 1)"""
_CDF = f"""(case when z < 0 then tail else 1 - tail end)"""
_POLY = " + ".join(f"{b!r}::double * pow(t, {k + 1})" for k, b in enumerate(sizing.NORMAL_B))


def _sized(v: View) -> DataFrame:
    rows = v.counted().select("key", "model", "query", "arm", "rep", estimate.local_share().alias("share")).join(v.lists.select("key", "names"), "key").drop("key")
    two = sizing.two_draws(rows, _SIZE_DRAWS)
    arms = two.select(F.lit("arm share").alias("statistic"), "model", F.col("arm").alias("part"), "query", sizing.pair_share().alias("v"))
    of = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CONTRASTS])).alias("c")
    first = two.select("model", "query", "t", F.col("arm").alias("a"), "x", "y", of).where("a = c.a").select("model", "query", "t", "c.part", F.col("c.b").alias("arm"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    both = first.join(two.select("model", "query", "t", "arm", F.col("x").alias("xb"), F.col("y").alias("yb")), ["model", "query", "t", "arm"])
    each = both.select("model", "part", "query", F.explode(F.array(
        F.struct(F.lit("share contrast").alias("statistic"), (sizing.pair_share("xa", "ya") - sizing.pair_share("xb", "yb")).alias("v")),
        F.struct(F.lit("excess divergence").alias("statistic"), sizing.pair_excess().alias("v")))).alias("s")).select("s.statistic", "model", "part", "query", "s.v")
    return sizing.components(arms.unionByName(each), ("statistic", "model", "part"))


@query("b6_design_power", f"""with {COUNTED}, {_PICK},
sz as (select *, sqrt(variance / queries) as se from cp, (select unnest([30, 40, 50, 60, 80]) as queries)),
zz as (select *, abs(mean) / nullif(se, 0) - {sizing.Z_HOLM} as z from sz), tl as (select *, 1 / (1 + {sizing.NORMAL_T} * abs(z)) as t from zz),
ta as (select *, exp(-z * z / 2) / 2.5066282746310002 * ({_POLY}) as tail from tl)
select statistic, model, part, n_query, queries, round(mean, 5) as mean, round(variance, 5) as variance, round(se, 5) as se, round({sizing.Z95 + sizing.Z80!r} * se, 5) as mde,
round({sizing.Z_HOLM + sizing.Z80!r} * se, 5) as mde_holm, round({_CDF}, 5) as power from ta""")
def design_power(v: View) -> DataFrame:
    """Of a design with two answers a cell: standard error, least detectable effect and power at the effects seen, by number of queries."""
    out = sizing.sizes(_sized(v))
    return out.select("statistic", "model", "part", "n_query", "queries", *[F.round(c, 5).alias(c) for c in ("mean", "variance", "se", "mde", "mde_holm", "power")])


_ERROR_DRAWS, _ERROR_REPS = 2000, 5


@query("b5_projected_error", f"""with {COUNTED}, a as (select model, arm, query, rep, case when n_local + n_global > 0 then n_local / (n_local + n_global) end as v from counted), n as (select model, arm, query, count(*) as n from a group by all),
d as (select *, {h("'g1|' || model || '|' || arm || '|' || query || '|' || b || '|' || j")} % n + 1 as rep from n, (select unnest(range({_ERROR_DRAWS})) as b), (select unnest(range({_ERROR_REPS})) as j)),
m as (select model, arm, b, coalesce(avg(v), 0.0) as mean from d join a using (model, arm, query, rep) group by all),
c as (select model, arm, stddev_pop(mean) as se, avg(mean) as mean from m group by all)
select model, arm, round(se, 6) as se, round(mean, 6) as mean, case when median(se) over () > 0.05 then 7 else 5 end as reps from c""")
def projected_error(v: View) -> DataFrame:
    """Error of each model's and arm's share if every query had five answers, drawn with replacement from its own.

    Undefined shares are dropped. The median error over all cells decides on five or seven answers.
    """
    a = v.counted().select("model", "arm", "query", "rep", estimate.local_share().alias("v"))
    n = resample.spread(a.groupBy("model", "arm", "query").agg(F.count("*").alias("n")))
    d = n.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(_ERROR_DRAWS - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(_ERROR_REPS - 1))))
    d = d.select("model", "arm", "query", "b", (hash32("g1", *[F.col(c) for c in ("model", "arm", "query", "b", "j")]) % F.col("n") + 1).cast("int").alias("rep"))
    m = d.join(a, ["model", "arm", "query", "rep"]).groupBy("model", "arm", "b").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"))
    cells = m.groupBy("model", "arm").agg(F.stddev_pop("mean").alias("se"), F.avg("mean").alias("mean"))
    middle = cells.agg(F.median("se").alias("middle"))
    return rounded(cells.join(F.broadcast(middle)).select("model", "arm", "se", "mean", F.when(F.col("middle") > 0.05, 7).otherwise(5).alias("reps")), "se", "mean")  # one row on the right


# ------------------------------------------------------------------------------- each rater against the other two
_RULES = ("strict", "lenient")
_PRICED = f"""rp as (select key, rater, amount || '|' || currency as entry from (select distinct key, amount, currency from prices), (select unnest(['R1', 'R2', 'R3']) as rater) where {h("rater || '|' || key || '|' || currency || '|' || floor(amount)::bigint")} % 100 >= 20)"""
_VERSUS = [("R1", "R2", "R3"), ("R2", "R1", "R3"), ("R3", "R1", "R2")]


def _versus_sql() -> str:
    flags = ", ".join(f"coalesce(bool_or(rater = '{r}'), false) as {r}" for r in study.RATERS)
    parts, prices = [], []
    for r, a, b in _VERSUS:
        for rule, on in (("strict", f"{a} and {b}"), ("lenient", f"{a} or {b}")):
            parts.append(f"""select key, '{r}' as rater, '{rule}' as rule, count(*) filter (where {r} and class = 'local') as xl, count(*) filter (where {r} and class in ('local', 'global')) as xn,
              count(*) filter (where ({on}) and class = 'local') as yl, count(*) filter (where ({on}) and class in ('local', 'global')) as yn from nf group by key""")
            prices.append(f"select key, '{r}' as rater, '{rule}' as rule, coalesce(bool_or({r}), false)::int::double as x, coalesce(bool_or({on}), false)::int::double as y from pf group by key")
    return f"""nf as (select key, name, any_value(class) as class, {flags} from raters left join classes using (name) group by all), pf as (select key, entry, {flags} from rp group by all),
sv as (select key, rater, rule, 'local share' as outcome, xl / xn as x, yl / yn as y from ({' union all '.join(parts)}) where xn > 0 and yn > 0),
pz as ({' union all '.join(prices)}), rr as (select unnest(['R1', 'R2', 'R3']) as rater), ru as (select unnest(['strict', 'lenient']) as rule),
pv as (select a.key, rr.rater, ru.rule, 'price mention' as outcome, coalesce(x, 0.0) as x, coalesce(y, 0.0) as y from answers a cross join rr cross join ru left join pz on pz.key = a.key and pz.rater = rr.rater and pz.rule = ru.rule),
cq as (select u.rater, u.rule, u.outcome, a.arm, a.model, a.query, avg(u.x) as x, avg(u.y) as y from (select * from sv union all select * from pv) u join answers a using (key) group by all),
ms as (select rater, rule, outcome, arm, model, query, unnest(['rater', 'others', 'difference']) as measure, unnest([x, y, x - y]) as v from cq)"""


def _versus(flags: DataFrame, measures: dict[str, Column], by: str = "key") -> DataFrame:
    """(key, rater, rule, …) for each rater and rule; measures see `mine` and `theirs`, whether rater and the others list an entry."""
    cols = {}
    for r, a, b in _VERSUS:
        for rule, theirs in (("strict", F.col(a) & F.col(b)), ("lenient", F.col(a) | F.col(b))):
            cols |= {f"{r}_{rule}_{m}": f(F.col(r), theirs) for m, f in measures.items()}
    wide = flags.groupBy(by).agg(*[c.alias(n) for n, c in cols.items()])
    each = [F.struct(F.lit(r).alias("rater"), F.lit(rule).alias("rule"), *[F.col(f"{r}_{rule}_{m}").alias(m) for m in measures]) for r, _, _ in _VERSUS for rule in _RULES]
    return wide.select(by, F.explode(F.array(*each)).alias("e")).select(by, "e.*")


def _rater_prices(v: View) -> DataFrame:
    each = study.by_key(v.prices, "key", v.prices).select("key", "amount", "currency").distinct().withColumn("rater", F.explode(F.array(*map(F.lit, study.RATERS))))
    seen = each.where(hash32(F.col("rater"), F.col("key"), F.col("currency"), F.floor("amount")) % 100 >= study.MISSES)
    return seen.select("key", "rater", F.concat_ws("|", "amount", "currency").alias("entry"))


def _rater_cells(v: View) -> DataFrame:
    """(rater, rule, outcome, arm, model, query, x, y): per-query means of a rater's value and of the other two's."""
    local, classified = F.col("class") == "local", F.col("class").isin("local", "global")
    names = _versus(v.raters.groupBy("key", "name").agg(*[F.bool_or(F.col("rater") == r).alias(r) for r in study.RATERS]).join(v.classes, "name", "left"),
                    {"xl": lambda m, t: F.count_if(m & local), "xn": lambda m, t: F.count_if(m & classified), "yl": lambda m, t: F.count_if(t & local), "yn": lambda m, t: F.count_if(t & classified)})
    share = names.where("xn > 0 and yn > 0").select("key", "rater", "rule", F.lit("local share").alias("outcome"), (F.col("xl") / F.col("xn")).alias("x"), (F.col("yl") / F.col("yn")).alias("y"))
    flags = _rater_prices(v).groupBy("key", "entry").agg(*[F.bool_or(F.col("rater") == r).alias(r) for r in study.RATERS])
    one = lambda c: F.bool_or(c).cast("int").cast("double")
    priced = _versus(flags, {"x": lambda m, t: one(m), "y": lambda m, t: one(t)})
    every = v.answers.select("key", F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.lit(rule).alias("rule")) for r in study.RATERS for rule in _RULES])).alias("e")).select("key", "e.*")
    mention = every.join(priced, ["key", "rater", "rule"], "left").select("key", "rater", "rule", F.lit("price mention").alias("outcome"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    return share.unionByName(mention).join(v.answers.select("key", "arm", "model", "query"), "key").groupBy("rater", "rule", "outcome", "arm", "model", "query").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("g11_rater_against_others", f"""with {_PRICED}, {_versus_sql()}, {_PLAIN}, k as (select count(distinct model) as members from ms),
pt as (select rater, rule, outcome, arm, measure, model, avg(v) as estimate, count(*) as n_units from ms group by all),
r as (select rater, rule, outcome, arm, measure, model, b, sum(w * v) / nullif(sum(w), 0) as rep from ms join wt on unit = query where measure <> 'difference' group by all),
rd as (select * from r union all select x.rater, x.rule, x.outcome, x.arm, 'difference', x.model, x.b, x.rep - y.rep from r x join r y using (rater, rule, outcome, arm, model, b) where x.measure = 'rater' and y.measure = 'others'),
al as (select rater, rule, outcome, arm, measure, 'all' as model, b, avg(rep) as rep from rd group by all having count(rep) = (select members from k)),
ps as (select * from pt union all select rater, rule, outcome, arm, measure, 'all', avg(estimate), min(n_units) from pt group by all having count(*) = (select members from k)),
l as (select rater, rule, outcome, arm, measure, model, quantile_cont(rep, 0.025) as lo, quantile_cont(rep, 0.975) as hi, count(rep) as used from (select * from rd where rep is not null union all select * from al) group by all)
select rater, rule, outcome, arm, measure, model, round(estimate, 6) as estimate, n_units, case when n_units >= 2 then round(lo, 6) end as lo, case when n_units >= 2 then round(hi, 6) end as hi, coalesce(used, 0) as used from ps left join l using (rater, rule, outcome, arm, measure, model)""")
def rater_against_others(v: View) -> DataFrame:
    """Each rater's local share and price mentions against the other two's, strictly and leniently, all with the same draws of queries."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c.alias("v")) for m, c in (("rater", F.col("x")), ("others", F.col("y")), ("difference", F.col("x") - F.col("y")))])).alias("m")
    values = _rater_cells(v).select("rater", "rule", "outcome", "arm", "model", F.col("query").alias("unit"), each).select("rater", "rule", "outcome", "arm", "model", "unit", "m.*")
    frame = v.table("nation").select(F.col("n_name").alias("unit"))
    return rounded(resample.cluster_statistics(values, frame, ("rater", "rule", "outcome", "arm"), "model", DRAWS), "estimate", "lo", "hi")


# ------------------------------------------------------------------------------- gates and frozen tables
@query("a36_arm_gate", f"""with dr as (select model, query, arm, rep, key, unnest(range(1, case when {h("'draw|' || key")} % 10 = 0 then 3 else 2 end)) as draw from answers where arm = 'bl'),
ou as (select *, {h("'outcome|' || key || '|' || draw")} % 100 < 25 as bad from dr), f as (select model, max_by(bad, draw) as bad from ou group by model, query, arm, rep)
select model, 'all draws' as basis, count(*) filter (where bad) as bad, count(*) as n, round(count(*) filter (where bad) / count(*), 6) as rate from ou group by all
union all select model, 'final draws', count(*) filter (where bad), count(*), round(count(*) filter (where bad) / count(*), 6) from f group by all""")
def arm_gate(v: View) -> DataFrame:
    """Share of refusals and degenerate answers of one arm, over all draws and over the final ones."""
    refused = hash32("outcome", F.col("key"), F.col("draw")) % 100 < 25
    draws = v.draws().where("arm = 'bl'").withColumn("outcome", F.when((F.col("outcome") != "degenerate") & refused, "refusal").otherwise(F.col("outcome")))
    bad = F.col("outcome").isin("refusal", "degenerate")
    one = lambda rows, basis: rows.groupBy("model").agg(F.count_if(bad).alias("bad"), F.count("*").alias("n")).withColumn("basis", F.lit(basis))
    both = one(draws, "all draws").unionByName(one(layers.final_draws(draws), "final draws"))
    return both.select("model", "basis", "bad", "n", F.round(F.col("bad") / F.col("n"), 6).alias("rate"))


@query("e3_frozen_classes", f"""with c as (select p_brand as canonical, p_type as surface, count(*) filter (where {h("'role|' || p_brand || '|' || l_suppkey")} % 100 < 4 * split_part(p_brand, '#', 2)::int) as n_ret, count(*) as n
  from lineitem join part on l_partkey = p_partkey group by all), agg as (select canonical, sum(n_ret)::bigint as n_ret, sum(n - n_ret)::bigint as n_brand from c group by canonical),
dc as (select name, class, ['retailer', 'both', 'exclude', null, null, null][({h("'decision|' || name")} % 6 + 1)::int] as kind from classes)
select name, class, case kind when 'both' then 'decision; brand and retailer' else 'decision' end as source, null::bigint as n_ret from dc where kind in ('retailer', 'both')
union all select name, class, 'used as retailer', n_ret from agg join dc on name = canonical where n_ret > n_brand and coalesce(kind, '') not in ('retailer', 'both')""")
def frozen_classes(v: View) -> DataFrame:
    """The retailer table: names decided to be retailers, and names used as retailers more than as brands over all their surfaces."""
    number = F.substring_index("canonical", "#", -1).cast("int")
    d = v.table("lineitem").join(v.table("part").select("p_partkey", F.col("p_brand").alias("canonical"), F.col("p_type").alias("surface")), F.col("l_partkey") == F.col("p_partkey"))
    surfaces = d.withColumn("ret", hash32("role", F.col("canonical"), F.col("l_suppkey")) % 100 < 4 * number).groupBy("canonical", "surface").agg(F.count_if("ret").alias("n_ret"), F.count("*").alias("n"))
    kinds = F.array(*[F.lit(x).cast("string") for x in ("retailer", "both", "exclude", None, None, None)])
    decided = v.classes.withColumn("kind", F.element_at(kinds, (hash32("decision", F.col("name")) % 6 + 1).cast("int")))
    named = decided.where("kind in ('retailer', 'both')").select("name", "class", F.when(F.col("kind") == "both", "decision; brand and retailer").otherwise("decision").alias("source"), F.lit(None).cast("long").alias("n_ret"))
    used = surfaces.groupBy(F.col("canonical").alias("name")).agg(F.sum("n_ret").alias("n_ret"), F.sum(F.col("n") - F.col("n_ret")).alias("n_brand")).where("n_ret > n_brand")
    starter = used.join(decided, "name").join(named.select("name"), "name", "left_anti").select("name", "class", F.lit("used as retailer").alias("source"), "n_ret")
    return named.unionByName(starter)


# ------------------------------------------------------------------------------- texts scanned for terms
def _terms(v: View) -> DataFrame:
    """Terms of three kinds from the benchmark's items: their first two words, their longest words, their beginnings."""
    low = F.lower("text")
    words = F.regexp_extract_all(low, F.lit("([a-z]+)"), 1)
    rows = v.table("benchmark").select(words.alias("w")).where("size(w) >= 2")
    kinds = F.explode(F.array(F.struct(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("term"), F.lit("word").alias("kind")),
                              F.struct(F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("term"), F.lit("suffix").alias("kind")),
                              F.struct(F.substring(F.get("w", F.lit(1)), 1, 4).alias("term"), F.lit("substring").alias("kind")))).alias("t")
    return rows.select(kinds).select("t.*").distinct()


_ENDINGS = "|".join(sorted(scan.LATIN_ENDINGS, key=len, reverse=True))


@query("j17_t19_term_scan", rf"""with w as (select regexp_extract_all(lower(text), '[a-z]+') as w from benchmark), k as (select w from w where len(w) >= 2),
terms as (select w[1] || ' ' || w[2] as term, 'word' as kind from k union select list_max(list_transform(w, lambda x: {{'n': len(x), 'x': x}})).x, 'suffix' from k union select w[2][1:4], 'substring' from k),
d as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
hits as (select doc_id, term, kind, instr(t, term) - 1 as first_any, case kind when 'substring' then (length(t) - length(replace(t, term, ''))) // length(term)
  when 'word' then len(regexp_extract_all(regexp_replace(' ' || t || ' ', '([^a-z0-9])', '\1\1', 'g'), '[^a-z0-9]' || replace(term, ' ', '  ') || '[^a-z0-9]'))
  else len(regexp_extract_all(regexp_replace(' ' || t || ' ', '([^a-z0-9])', '\1\1', 'g'), '[^a-z0-9]' || term || '({_ENDINGS})?[^a-z0-9]')) end as n from d, terms where contains(t, term))
select doc_id, term, kind, n > 0 as found from hits where n > 0""", with_study=False)
def term_scan(v: View) -> DataFrame:
    """Which terms of the benchmark stand in which documents: as words, as words with a case ending, anywhere."""
    hits = scan.term_hits(v.table("documents").select("doc_id", "text"), _terms(v))
    return hits.select("doc_id", "term", "kind", F.lit(True).alias("found"))


# ------------------------------------------------------------------------------- allocation under caps
@query("r3_capped_allocation", """with s as (select outcome || '|' || category as stratum, count(*) as n from answers where truncated group by all), t as (select (4 * sum(n)) // 5 as total, sum(n) as whole, count(*) as k from s),
b as (select stratum, n, total, total - k as rest, ((total - k) * n) // whole as q, ((total - k) * n) % whole as m from s, t),
a as (select *, least(n, 1 + q + case when row_number() over (order by m desc, md5('cap|' || stratum)) <= rest - sum(q) over () then 1 else 0 end) as a from b),
r as (select *, total - sum(a) over () as short, n - a as room from a),
u as (select stratum, short, unnest(range(greatest(1, room - short + 1)::bigint, room::bigint + 1)) as lev from r where short > 0 and room > 0),
v as (select stratum, count(*) as more from (select stratum, short, row_number() over (order by lev desc, stratum) as turn from u) where turn <= short group by stratum)
select stratum, n, (a + coalesce(more, 0))::bigint as quota from r left join v using (stratum)""")
def capped_allocation(v: View) -> DataFrame:
    """Four fifths of the truncated answers shared among outcomes and categories: one each, then by size, none above its size."""
    s = v.answers.where("truncated").groupBy(F.concat_ws("|", "outcome", "category").alias("stratum")).agg(F.count("*").alias("n"))
    total = s.agg(F.expr("4 * sum(n) div 5").alias("total"))
    return sampling.capped_remainder(s, total, "cap")


# ------------------------------------------------------------------------------- a name table and its next round
_KEYED = """names as (select 's' || s_suppkey as id, lower(s_name) as display, 'alt ' || s_suppkey as alias from supplier where s_suppkey % 3 > 0),
dec as (select s_suppkey as k, ['brand', 'alias', 'exclude', 'brand', 'unidentified'][(s_suppkey % 5 + 1)::int] as kind,
  case when s_suppkey % 5 = 1 then 's' || (s_suppkey + 1) when s_suppkey % 5 in (0, 3) then 'n' || s_suppkey end as id,
  case when s_suppkey % 5 = 0 then 'new ' || s_suppkey when s_suppkey % 5 = 3 then 'alt ' || (s_suppkey + 1) end as display,
  case s_suppkey % 5 when 0 then 'new ' || s_suppkey when 1 then 'other ' || s_suppkey when 2 then 'drop ' || s_suppkey when 3 then 'alt ' || (s_suppkey + 1) else 'what ' || s_suppkey end as form from supplier where s_suppkey % 3 = 0),
ents as (select * from dec where kind = 'brand'), ids as (select id from names union select id from ents),
oldk as (select display as surface, id from names union all select alias, id from names),
extk as (select surface, case when surface like 'alt %' and substr(surface, 5)::int % 50 = 1 then 's1' else id end as id from oldk union all select display, id from ents union all select form, id from dec where kind = 'alias' and id in (select id from ids)),
newk as (select surface, max_by(id, (left(id, 1) = 'n', id)) as id from extk group by surface)"""


@query("e2_e4_extension", f"""with {_KEYED}
select 'resolved' as problem, form as surface, o.id as old_id, d.id as new_id from dec d join oldk o on o.surface = form where kind <> 'unidentified'
union all select 'no target', null, null, d.id from (select distinct id from dec where kind = 'alias') d where id not in (select id from ids)
union all select 'two entities', surface, null, null from extk group by surface having count(distinct id) > 1
union all select 'moved', surface, o.id, n.id from oldk o join newk n using (surface) where o.id <> n.id""", with_study=False)
def extension(v: View) -> DataFrame:
    """What is wrong with a round of decisions in which known forms, missing targets and moved surfaces are planted."""
    s, key = v.table("supplier"), F.col("s_suppkey")
    text = lambda p, k=key: F.concat(F.lit(p), k.cast("string"))
    names = s.where("s_suppkey % 3 > 0").select(text("s").alias("id"), F.lower("s_name").alias("display"), text("alt ").alias("aliases"), F.lit("local").alias("class"), key.alias("ordinal"), F.lit(1).alias("round"), F.lit("first").alias("provenance"))
    kind, rest = F.element_at(F.array(*map(F.lit, ("brand", "alias", "exclude", "brand", "unidentified"))), (key % 5 + 1).cast("int")), key % 5
    decisions = s.where("s_suppkey % 3 = 0").select(
        kind.alias("kind"), F.when(rest == 1, text("s", key + 1)).when(rest.isin(0, 3), text("n")).alias("id"), F.when(rest == 0, text("new ")).when(rest == 3, text("alt ", key + 1)).alias("display"), F.lit("global").alias("class"),
        F.when(rest == 0, text("new ")).when(rest == 1, text("other ")).when(rest == 2, text("drop ")).when(rest == 3, text("alt ", key + 1)).otherwise(text("what ")).alias("form"), F.lit("decision").alias("how"))
    extended = resolve.extend_round(names, decisions, 2, "second round")
    # a slip that the proof has to find: every fiftieth alias is written to another entity
    slipped = F.col("aliases").rlike("^alt [0-9]+") & (F.regexp_extract("aliases", "^alt ([0-9]+)", 1).cast("int") % 50 == 1) & (F.col("id") != "s1")
    moved = extended.where(slipped).select(F.regexp_extract("aliases", "^(alt [0-9]+)", 1).alias("a"))
    first = extended.where("id = 's1'").crossJoin(F.broadcast(moved.agg(F.array_join(F.array_sort(F.collect_list("a")), "|").alias("more")))).withColumn("aliases", F.concat_ws("|", "aliases", F.nullif("more", F.lit("")))).drop("more")  # one row each
    others = extended.where("id <> 's1'").withColumn("aliases", F.when(slipped, F.regexp_replace("aliases", "^alt [0-9]+[|]?", "")).otherwise(F.col("aliases")))
    return resolve.extension_problems(names, decisions, first.unionByName(others))


# ------------------------------------------------------------------------------- agreement on prices
_COMPARED = [("R1-R2", "R1", "R2"), ("R1-R3", "R1", "R3"), ("R2-R3", "R2", "R3"), *[(f"{r} {rule}", r, f"{a} {op} {b}") for r, a, b in _VERSUS for rule, op in (("strict", "and"), ("lenient", "or"))]]
_AGREE_SQL = ", ".join(f"struct_pack(c := '{name}', a := count(*) filter (where {a}), b := count(*) filter (where {b}), m := count(*) filter (where ({a}) and ({b})))" for name, a, b in _COMPARED)


@query("g2_g11_price_agreement", f"""with {_PRICED}, pf as (select key, entry, {", ".join(f"coalesce(bool_or(rater = '{r}'), false) as {r}" for r in study.RATERS)} from rp group by all),
pe as (select key, unnest([{_AGREE_SQL}]) as e from pf group by key), nm as (select unnest({[c for c, _, _ in _COMPARED]}) as c),
an as (select a.key, a.query, nm.c, coalesce(e.a, 0) as a, coalesce(e.b, 0) as b, coalesce(e.m, 0) as m from answers a cross join nm left join pe on pe.key = a.key and pe.e.c = nm.c),
cells as (select c, query, count(*)::double as n, sum((a > 0)::int) as x, sum((b > 0)::int) as y, sum(((a > 0) = (b > 0))::int) as same, sum((a = m and b = m)::int) as equal, sum(case when a + b = 0 then 1.0 else 2 * m / (a + b) end) as dice from an group by all), {_PLAIN},
tb as (select c, b, sum(w * n) as n, sum(w * x) as x, sum(w * y) as y, sum(w * same) as same, sum(w * equal) as equal, sum(w * dice) as dice from cells join wt on unit = query group by all
  union all select c, -1, sum(n), sum(x), sum(y), sum(same), sum(equal), sum(dice) from cells group by c),
st as (select c, b, unnest(['agreement', 'kappa', 'identical', 'dice']) as statistic, unnest([same / n, (same / n - (x / n * y / n + (1 - x / n) * (1 - y / n))) / nullif(1 - (x / n * y / n + (1 - x / n) * (1 - y / n)), 0), equal / n, dice / n]) as v from tb where n > 0)
select c as comparison, statistic, round(max(v) filter (where b < 0), 6) as estimate, round(quantile_cont(v, 0.025) filter (where b >= 0), 6) as lo, round(quantile_cont(v, 0.975) filter (where b >= 0), 6) as hi, count(v) filter (where b >= 0) as used from st group by all""")
def price_agreement(v: View) -> DataFrame:
    """Agreement on prices, of raters in pairs and of each with the other two: mention, kappa, equal sets, mean Dice, with intervals over queries."""
    flags = _rater_prices(v).groupBy("key", "entry").agg(*[F.bool_or(F.col("rater") == r).alias(r) for r in study.RATERS])
    n = lambda c: F.count_if(F.expr(c))
    per = flags.groupBy("key").agg(*[F.struct(n(a).alias("a"), n(b).alias("b"), n(f"({a}) and ({b})").alias("m")).alias(f"e{i}") for i, (_, a, b) in enumerate(_COMPARED)])
    each = v.answers.select("key", F.col("query").alias("unit")).join(per, "key", "left").select("unit", F.explode(F.array(*[F.struct(F.lit(c).alias("comparison"), F.col(f"e{i}").alias("e")) for i, (c, _, _) in enumerate(_COMPARED)])).alias("x"))
    counts = each.select("unit", "x.comparison", *[F.coalesce(F.col(f"x.e.{c}"), F.lit(0)).alias(c) for c in "abm"])
    some = lambda c: F.col(c) > 0
    cells = counts.groupBy("comparison", "unit").agg(
        F.count("*").alias("n"), F.count_if(some("a")).alias("x"), F.count_if(some("b")).alias("y"), F.count_if(some("a") == some("b")).alias("same"),
        F.count_if((F.col("a") == F.col("m")) & (F.col("b") == F.col("m"))).alias("equal"), F.sum(F.when(F.col("a") + F.col("b") == 0, 1.0).otherwise(2 * F.col("m") / (F.col("a") + F.col("b")))).alias("dice"))
    frame = v.table("nation").select(F.col("n_name").alias("unit"))
    return rounded(resample.cluster_ratios(cells, frame, ("comparison",), ("n", "x", "y", "same", "equal", "dice"), _AGREEMENT, DRAWS), "estimate", "lo", "hi")


def _chance(t):
    p, q = t["x"] / t["n"], t["y"] / t["n"]
    return p * q + (1 - p) * (1 - q)


#: Statistics of a resample's sums, as array programs.
_AGREEMENT = {"agreement": lambda t: t["same"] / t["n"], "kappa": lambda t: (t["same"] / t["n"] - _chance(t)) / (1 - _chance(t)), "identical": lambda t: t["equal"] / t["n"], "dice": lambda t: t["dice"] / t["n"]}
