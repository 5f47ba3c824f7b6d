"""The registered queries: operators applied to the study view, each beside its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import jsonx, sets, text
from quillon.functions.stats import wilson
from quillon.operators import consensus, estimate, layers, ledger, resample, resolve, sampling, study
from quillon.operators.study import CONTRASTS, STUDY_SQL, hash32

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DRAWS = 10_000


class View:
    """The study view's frames, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return study.table(self.spark, self.dir, name)

    @property
    def answers(self) -> DataFrame:
        return study.answers(self.spark, self.dir)

    @property
    def mentions(self) -> DataFrame:
        return study.mentions(self.spark, self.dir)

    @property
    def names(self) -> DataFrame:
        """Every name that an answer can mention: the brands of the part table."""
        return self.table("part").select(F.col("p_brand").alias("name")).distinct()

    @property
    def classes(self) -> DataFrame:
        return study.name_classes(self.spark, self.dir)

    @property
    def lists(self) -> DataFrame:
        return study.name_lists(self.answers, self.mentions)

    @property
    def prices(self) -> DataFrame:
        return study.price_entries(self.spark, self.dir)

    @property
    def retailers(self) -> DataFrame:
        return study.retailer_entries(self.spark, self.dir)

    @property
    def raters(self) -> DataFrame:
        return study.rater_names(self.mentions)

    def counted(self, ambiguous: str | None = None) -> DataFrame:
        return estimate.mention_counts(self.answers, self.mentions, self.classes, ambiguous)

    def share_cells(self, ambiguous: str | None = None, where: Column | None = None) -> DataFrame:
        rows = self.counted(ambiguous)
        return estimate.cell_means(rows if where is None else rows.where(where), estimate.local_share())

    def draws(self) -> DataFrame:
        """Every answer's draws: one in ten has a second."""
        n = F.when(hash32("draw", F.col("key")) % 10 == 0, 2).otherwise(1)
        each = self.answers.withColumn("draw", F.explode(F.sequence(F.lit(1), n)))
        h = hash32("outcome", F.col("key"), F.col("draw")) % 100
        return each.withColumn("outcome", F.when(h < 20, "degenerate").otherwise("valid")).select(*layers.SLOT, "key", "draw", "outcome")


def query(name: str, sql: str | None = None, with_study: bool = True) -> Callable[[Callable[[View], DataFrame]], Callable[[View], DataFrame]]:
    def add(f: Callable[[View], DataFrame]) -> Callable[[View], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(View(spark, sf_dir))
        if sql:
            body = sql.strip()
            SQL[name] = (f"with {STUDY_SQL.strip()}" + ((",\n" + body[5:]) if body.startswith("with ") else "\n" + body)) if with_study else body
        return f
    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def h(sql: str) -> str:
    return f"('0x' || substr(md5({sql}), 1, 8))::ubigint"


COUNTED = """counted as (
  select a.*, coalesce(n_local, 0) as n_local, coalesce(n_global, 0) as n_global, coalesce(n_ambiguous, 0) as n_ambiguous, coalesce(n_unknown, 0) as n_unknown
  from answers a left join (select key, count(*) filter (where class = 'local') as n_local, count(*) filter (where class = 'global') as n_global,
    count(*) filter (where class = 'ambiguous') as n_ambiguous, count(*) filter (where class is null) as n_unknown
    from mentions left join classes using (name) group by key) using (key))"""


def cells_sql(value: str = "n_local / (n_local + n_global)", where: str = "n_local + n_global > 0", rows: str = "counted", name: str = "cells") -> str:
    return f"{name} as (select model, query, arm, avg({value}) as v from {rows} where {where} group by all)"


PAIRED = """wide as (select model, query, max(v) filter (where arm = 'en') as en, max(v) filter (where arm = 'bn') as bn, max(v) filter (where arm = 'bl') as bl from cells group by all),
paired as (select * from (select model, query, unnest(['bn-en', 'bl-en', 'bn-bl']) as contrast, unnest([bn - en, bl - en, bn - bl]) as d from wide) where d is not null)"""
SHARE = f"with {COUNTED}, {cells_sql()}, {PAIRED}"


@query("a4_paired_local_share", f"{SHARE} select model, contrast, round(avg(d), 6) as estimate, count(*) as n from paired group by all")
def paired_local_share(v: View) -> DataFrame:
    return rounded(estimate.contrast_means(estimate.paired(v.share_cells(), CONTRASTS)), "estimate")


@query("a3_shares_two_level_and_pooled", f"""with {COUNTED}, {cells_sql()},
q as (select model, arm, avg(v) as share, count(*) as n_queries from cells group by all),
p as (select model, arm, sum(n_local) / sum(n_local + n_global) as pooled from counted group by all)
select model, arm, round(share, 6) as share, n_queries, round(pooled, 6) as pooled from q join p using (model, arm)""")
def shares(v: View) -> DataFrame:
    rows = v.counted()
    return rounded(estimate.query_means(v.share_cells()).join(estimate.pooled(rows, F.col("n_local"), F.col("n_local") + F.col("n_global")), ["model", "arm"]), "share", "pooled")


@query("a5_mention_counts", f"with {COUNTED} select key, n_local, n_global, n_ambiguous, n_unknown from counted")
def mention_counts(v: View) -> DataFrame:
    return v.counted().select("key", "n_local", "n_global", "n_ambiguous", "n_unknown")


@query("a6_ambiguous_unknown_rates", f"""with {COUNTED} select model, arm, round(sum(n_ambiguous) / sum(n_local + n_global + n_ambiguous + n_unknown), 6) as ambiguous_rate,
round(sum(n_unknown) / sum(n_local + n_global + n_ambiguous + n_unknown), 6) as unknown_rate from counted group by all""")
def ambiguous_rates(v: View) -> DataFrame:
    n = F.sum(F.col("n_local") + F.col("n_global") + F.col("n_ambiguous") + F.col("n_unknown"))
    return rounded(v.counted().groupBy("model", "arm").agg((F.sum("n_ambiguous") / n).alias("ambiguous_rate"), (F.sum("n_unknown") / n).alias("unknown_rate")), "ambiguous_rate", "unknown_rate")


for _side in ("local", "global"):
    @query(f"p5_ambiguous_as_{_side}", f"""with {COUNTED}, {cells_sql(f"(n_local{' + n_ambiguous' if _side == 'local' else ''}) / (n_local + n_global + n_ambiguous)", "n_local + n_global + n_ambiguous > 0")}, {PAIRED}
select model, contrast, round(avg(d), 6) as estimate, count(*) as n from paired group by all""")
    def ambiguous_as(v: View, side: str = _side) -> DataFrame:
        return rounded(estimate.contrast_means(estimate.paired(v.share_cells(side), CONTRASTS)), "estimate")


_PREDICATES = {"primary": "outcome <> 'degenerate'", "valid_only": "outcome = 'valid'", "no_truncated": "not truncated", "non_refused": "outcome not in ('refusal', 'degenerate')"}
for _name, _where in _PREDICATES.items():
    @query(f"p5_sensitivity_{_name}", f"""with {COUNTED}, {cells_sql(where=f"n_local + n_global > 0 and {_where}")}, {PAIRED}
select model, contrast, round(avg(d), 6) as estimate, count(*) as n from paired group by all""")
    def sensitivity(v: View, name: str = _name) -> DataFrame:
        return rounded(estimate.contrast_means(estimate.paired(v.share_cells(where=layers.predicates()[name]), CONTRASTS)), "estimate")


@query("a11_all_models_mean", f"""{SHARE}, e as (select model, contrast, avg(d) as estimate from paired group by all)
select contrast, round(case when count(estimate) = 5 then avg(estimate) end, 6) as estimate from e group by all""")
def all_models(v: View) -> DataFrame:
    return rounded(estimate.all_models_mean(estimate.contrast_means(estimate.paired(v.share_cells(), CONTRASTS)), 5), "estimate")


@query("a10_model_groups", f"""with {COUNTED}, {cells_sql()}, g as (select case when model in ('1-URGENT', '2-HIGH') then 'urgent' else 'other' end as team, query, arm, avg(v) as v from cells group by all),
w as (select team, query, max(v) filter (where arm = 'bn') - max(v) filter (where arm = 'en') as d from g group by all)
select team, round(avg(d), 6) as estimate, count(d) as n from w group by all""")
def model_groups(v: View) -> DataFrame:
    g = v.share_cells().withColumn("team", F.when(F.col("model").isin("1-URGENT", "2-HIGH"), "urgent").otherwise("other")).groupBy("team", "query", "arm").agg(F.avg("v").alias("v"))
    d = estimate.paired(g, (("bn", "en"),), unit=("team", "query"))
    return rounded(d.groupBy("team").agg(F.avg("d").alias("estimate"), F.count("*").alias("n")), "estimate")


@query("a40_share_by_category", f"""with {COUNTED}, {cells_sql()}, c as (select distinct query, category from answers)
select category, model, arm, round(avg(v), 6) as share, count(*) as n from cells join c using (query) group by all""")
def share_by_category(v: View) -> DataFrame:
    places = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("query"), F.col("r_name").alias("category"))
    return rounded(v.share_cells().join(places, "query").groupBy("category", "model", "arm").agg(F.avg("v").alias("share"), F.count("*").alias("n")), "share")


@query("a7_outcome_frequencies", "select model, arm, outcome, count(*) as n from answers group by all")
def frequencies(v: View) -> DataFrame:
    return v.answers.groupBy("model", "arm", "outcome").agg(F.count("*").alias("n"))


@query("a8_crosstab", """select arm, count(*) filter (where outcome = 'valid') as n_valid, count(*) filter (where outcome = 'refusal') as n_refusal, count(*) as n,
round(count(*) filter (where outcome = 'valid') / count(*), 6) as share_valid, round(count(*) filter (where outcome = 'refusal') / count(*), 6) as share_refusal from answers group by all""")
def crosstab(v: View) -> DataFrame:
    return rounded(estimate.crosstab(v.answers, "arm", "outcome", ("valid", "refusal")), "share_valid", "share_refusal")


@query("a9_reversion_breakdown", """select model, arm, round(count(*) filter (where outcome = 'reversion') / count(*), 6) as rate, count(*) as n
from answers where outcome not in ('refusal', 'degenerate') group by all""")
def reversion(v: View) -> DataFrame:
    return rounded(v.answers.where(layers.predicates()["non_refused"]).groupBy("model", "arm").agg((F.count_if(F.col("outcome") == "reversion") / F.count("*")).alias("rate"), F.count("*").alias("n")), "rate")


_LEDGER_SQL = f"""with usage as (select key, model, case when year(asked_at) < 1998 then 'early' else 'late' end as phase, {h("'in|' || key")} % 2000 as tokens_in, {h("'out|' || key")} % 4000 as tokens_out from answers),
priced as (select distinct model, {h("'price|' || model")} % 10 + 1 as price_in, {h("'price_out|' || model")} % 30 + 1 as price_out from answers)"""


def _usage(v: View) -> tuple[DataFrame, DataFrame]:
    a = v.answers
    u = a.select("key", "model", "asked_at", F.when(F.year("asked_at") < 1998, "early").otherwise("late").alias("phase"), (hash32("in", F.col("key")) % 2000).alias("tokens_in"), (hash32("out", F.col("key")) % 4000).alias("tokens_out"))
    p = a.select("model").distinct().withColumns({"price_in": hash32("price", F.col("model")) % 10 + 1, "price_out": hash32("price_out", F.col("model")) % 30 + 1})
    return u, p


@query("a12_cost_ledger", f"""{_LEDGER_SQL} select phase, model, count(*) as calls, sum(tokens_in)::bigint as tokens_in, sum(tokens_out)::bigint as tokens_out,
round(sum((tokens_in * price_in + tokens_out * price_out) / 1e6), 6) as cost from usage join priced using (model) group by rollup (phase, model)""")
def cost_ledger(v: View) -> DataFrame:
    return rounded(ledger.cost_ledger(*_usage(v)), "cost")


@query("a13_measured_means", f"{_LEDGER_SQL} select model, round(avg(tokens_in), 6) as mean_in, round(avg(tokens_out), 6) as mean_out, count(*) as n from usage group by all having count(*) >= 5")
def measured_means(v: View) -> DataFrame:
    return rounded(ledger.measured_means(_usage(v)[0]), "mean_in", "mean_out")


@query("a15_run_windows", f"{_LEDGER_SQL}, t as (select phase, asked_at from usage join answers using (key)) select phase, min(asked_at)::varchar as first_seen, max(asked_at)::varchar as last_seen, count(*) as calls from t group by all")
def run_windows(v: View) -> DataFrame:
    w = ledger.run_windows(_usage(v)[0], "phase", "asked_at")
    return w.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query("a15_drift", "select query, count(distinct outcome) as \"values\" from answers group by all having count(distinct outcome) > 1")
def drift(v: View) -> DataFrame:
    return ledger.drift(v.answers, "query", "outcome")


_RETURNED = "case s_suppkey % 5 when 0 then upper(s_name) when 1 then concat(s_name, '-preview') when 2 then 'supplier' when 3 then concat('Supplier-', s_suppkey, '-x') else 'gpt-x' end"


@query("a16_string_relation", f"""with n as (select s_suppkey, list_distinct(list_filter(regexp_split_to_array(lower(s_name), '[^a-z0-9]+'), lambda x: x <> '')) as a,
  list_distinct(list_filter(regexp_split_to_array(lower({_RETURNED}), '[^a-z0-9]+'), lambda x: x <> '')) as b from supplier), c as (select *, len(list_intersect(a, b)) as k from n)
select s_suppkey, case when k = len(a) and k = len(b) then 'equal' when k = len(a) then 'subset' when k = len(b) then 'superset' when k > 0 then 'overlap' else 'disjoint' end as relation from c""", with_study=False)
def string_relation(v: View) -> DataFrame:
    """A model name as asked and as returned, by their parts; the returned ones are made from the key."""
    return v.table("supplier").select("s_suppkey", ledger.string_relation(F.col("s_name"), F.expr(_RETURNED)).alias("relation"))


@query("a17_latency_quantiles", """select event_type, count(*) as calls, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99
from events group by all""", with_study=False)
def latency(v: View) -> DataFrame:
    return rounded(ledger.latency(v.table("events"), "event_type", "value"), "mean", "p50", "p90", "p99")


@query("a18_error_groups", """select strftime(ts, '%Y-%m-%d') as "day", event_type, count(*) as n from events where event_type = 'error' group by all order by n desc, "day", event_type limit 10""", with_study=False)
def error_groups(v: View) -> DataFrame:
    return ledger.error_groups(v.table("events").where("event_type = 'error'"), (F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type")))


_VOTES = f"votes as (select key, rater, case when {h("rater || '|outcome|' || key")} % 10 < 8 then outcome else 'valid' end as vote from answers, (select unnest(['R1', 'R2', 'R3']) as rater))"


def _votes(v: View) -> DataFrame:
    each = v.answers.withColumn("rater", F.explode(F.array(*map(F.lit, study.RATERS))))
    return each.select("key", "rater", F.when(hash32(F.col("rater"), F.lit("outcome"), F.col("key")) % 10 < 8, F.col("outcome")).otherwise("valid").alias("vote"))


@query("a19_majority_value", f"with {_VOTES}, c as (select key, vote, count(*) as n from votes group by all) select key, max(vote) filter (where n >= 2) as consensus from c group by all")
def majority_value(v: View) -> DataFrame:
    return consensus.majority_value(_votes(v), "key", "vote")


_MAJOR = """major as (select key, list_sort(list(name)) as consensus, list(name order by mean, low, name) as consensus_order from (
  select key, name, avg(place) as mean, min(place) as low from raters group by all having count(*) >= 2) group by key)"""


@query("a20_a21_majority_names", f"with {_MAJOR} select key, array_to_string(consensus, ',') as consensus, array_to_string(consensus_order, ',') as consensus_order from major")
def majority_names(v: View) -> DataFrame:
    m = consensus.majority_names(v.raters)
    return m.select("key", F.array_join("consensus", ",").alias("consensus"), F.array_join("consensus_order", ",").alias("consensus_order"))


_SETS = """rs as (select a.key, coalesce(list_sort(list(name) filter (where rater = 'R1')), []) as r1, coalesce(list_sort(list(name) filter (where rater = 'R2')), []) as r2,
  coalesce(list_sort(list(name) filter (where rater = 'R3')), []) as r3 from answers a left join raters using (key) group by a.key)"""
F1 = "(case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end)"
JAC = "(case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end)"


@query("m8_pair_f1", f"with {_SETS} select pair, round(avg(f1), 6) as f1 from (select unnest(['R1-R2', 'R1-R3', 'R2-R3']) as pair, unnest([{F1.format(a='r1', b='r2')}, {F1.format(a='r1', b='r3')}, {F1.format(a='r2', b='r3')}]) as f1 from rs) group by all")
def pair_f1(v: View) -> DataFrame:
    return rounded(consensus.pair_f1(consensus.rater_sets(v.raters, v.answers, study.RATERS), study.RATERS), "f1")


def _loo_sql(r: str, a: str, b: str) -> str:
    return f"""select '{r.upper()}' as rater, round(avg({F1.format(a=r, b=f'list_intersect({a}, {b})')}), 6) as strict_f1, round(avg({F1.format(a=r, b=f'list_distinct(list_concat({a}, {b}))')}), 6) as lenient_f1 from rs"""


@query("a22_leave_one_out", f"with {_SETS} {_loo_sql('r1', 'r2', 'r3')} union all {_loo_sql('r2', 'r1', 'r3')} union all {_loo_sql('r3', 'r1', 'r2')}")
def leave_one_out(v: View) -> DataFrame:
    return rounded(consensus.leave_one_out(consensus.rater_sets(v.raters, v.answers, study.RATERS), study.RATERS), "strict_f1", "lenient_f1")


@query("a23_conservative_score", f"""with {_SETS}, {_MAJOR}, s as (select rs.key, coalesce(consensus, []) as ref, case when {h("'miss|' || rs.key")} % 10 > 0 then {F1.format(a='r1', b='coalesce(consensus, [])')} end as f1 from rs left join major using (key))
select round(avg(f1), 6) as scored, round(avg(coalesce(f1, case when len(ref) = 0 then 1.0 else 0.0 end)), 6) as conservative, count(f1) as n_scored, count(*) as n from s""")
def conservative(v: View) -> DataFrame:
    s = consensus.rater_sets(v.raters, v.answers, study.RATERS).join(consensus.majority_names(v.raters), "key", "left")
    ref = F.coalesce("consensus", F.array().cast("array<string>"))
    s = s.select(ref.alias("ref"), F.when(hash32("miss", F.col("key")) % 10 > 0, sets.set_f1(F.col("R1"), ref)).alias("f1"))
    return rounded(s.agg(F.avg("f1").alias("scored"), F.avg(consensus.conservative(F.col("f1"), F.col("ref"))).alias("conservative"), F.count("f1").alias("n_scored"), F.count("*").alias("n")), "scored", "conservative")


@query("a26_denominators", "select arm, currency, count(*) as n, count(distinct key) as n_answers from answers join prices using (key) group by all")
def denominators(v: View) -> DataFrame:
    return v.answers.join(v.prices.select("key", "currency"), "key").groupBy("arm", "currency").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_answers"))


@query("a27_top_retailers", """select retailer, n, row_number() over (order by n desc, retailer) as "rank" from (select retailer, count(*) as n from retailers group by all) qualify "rank" <= 10""")
def top_retailers(v: View) -> DataFrame:
    n = v.retailers.groupBy("retailer").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "retailer").limit(10).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "retailer")))


@query("a32_distinct_keys", "select distinct model, query from answers")
def distinct_keys(v: View) -> DataFrame:
    return v.answers.select("model", "query").distinct()


@query("a33_cube", "select model, arm, category, count(*) as n from answers group by cube (model, arm, category)")
def cube(v: View) -> DataFrame:
    return v.answers.cube("model", "arm", "category").agg(F.count("*").alias("n"))


@query("a35_outcome_table", """select model, arm, round(count(*) filter (where outcome in ('refusal', 'degenerate')) / count(*), 6) as gate_share, round(count(*) filter (where truncated) / count(*), 6) as truncated_share,
round(quantile_cont(amount, 0.5), 6) as median_amount from answers group by all""")
def outcome_table(v: View) -> DataFrame:
    shares = v.answers.groupBy("model", "arm").agg((F.count_if(F.col("outcome").isin("refusal", "degenerate")) / F.count("*")).alias("gate_share"), (F.count_if("truncated") / F.count("*")).alias("truncated_share"))
    middle = ledger.exact_quantiles(v.answers, ("model", "arm"), "amount", (0.5,)).select("model", "arm", F.col("q")[0].alias("median_amount"))
    return rounded(shares.join(middle, ["model", "arm"], "left"), "gate_share", "truncated_share", "median_amount")


@query("p13_price_predicates", """select key, count(*) filter (where amount > 0) > 0 as has_price, count(*) filter (where currency = 'BDT') as n_bdt, count(*) as n, count(*) filter (where currency <> 'unstated') as n_stated from prices group by all""")
def price_predicates(v: View) -> DataFrame:
    return v.prices.groupBy("key").agg((F.count_if(F.col("amount") > 0) > 0).alias("has_price"), F.count_if(F.col("currency") == "BDT").alias("n_bdt"), F.count("*").alias("n"), F.count_if(F.col("currency") != "unstated").alias("n_stated"))


@query("p9_bdt_share_contrasts", f"""with units as (select a.*, s, n from answers a join (select key, count(*) filter (where currency = 'BDT') as s, count(*) as n from prices group by all) using (key)), {cells_sql('s / n', 'n > 0', 'units')}, {PAIRED}
select model, contrast, round(avg(d), 6) as estimate, count(*) as n from paired group by all""")
def bdt_share(v: View) -> DataFrame:
    units = v.answers.join(v.prices.groupBy("key").agg(F.count_if(F.col("currency") == "BDT").alias("s"), F.count("*").alias("n")), "key")
    return rounded(estimate.contrast_means(estimate.paired(estimate.cell_means(units, F.col("s") / F.col("n")), CONTRASTS)), "estimate")


@query("p8_answer_binary_contrasts", f"""with {cells_sql("(outcome = 'refusal')::int", "outcome <> 'degenerate'", 'answers')}, {PAIRED} select model, contrast, round(avg(d), 6) as estimate, count(*) as n from paired group by all""")
def answer_binary(v: View) -> DataFrame:
    rows = v.answers.where(layers.predicates()["primary"])
    return rounded(estimate.contrast_means(estimate.paired(estimate.cell_means(rows, (F.col("outcome") == "refusal").cast("double")), CONTRASTS)), "estimate")


@query("p16_unpivot", "with u as (unpivot (select c_custkey, c_name as en, case when c_custkey % 3 > 0 then c_mktsegment else ' ' end as bn from customer) on en, bn into name arm value text) select c_custkey, arm, text from u where trim(text) <> ''")
def unpivot(v: View) -> DataFrame:
    c = v.table("customer").withColumn("_b", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise(" "))
    return layers.unpivot_arms(c, {"en": "c_name", "bn": "_b"}, "c_custkey")


@query("p17_canonical_sets", "select key, array_to_string(names, ',') as names, array_to_string(names_order, ',') as names_order from lists")
def canonical_sets(v: View) -> DataFrame:
    return v.lists.select("key", F.array_join("names", ",").alias("names"), F.array_join("names_order", ",").alias("names_order"))


@query("p22_language_or_outcome", """select arm, case when outcome in ('refusal', 'degenerate') then outcome when truncated then 'unresolved' else arm end as label, count(*) as n from answers group by all""")
def language_label(v: View) -> DataFrame:
    label = F.when(F.col("outcome").isin("refusal", "degenerate"), F.col("outcome")).otherwise(F.coalesce(F.when(~F.col("truncated"), F.col("arm")), F.lit("unresolved")))
    return v.answers.groupBy("arm", label.alias("label")).agg(F.count("*").alias("n"))


@query("j2_inner_and_missing", """select (select count(*) from answers join (select distinct key from mentions) using (key)) as matched, (select count(*) from answers a anti join mentions m on a.key = m.key) as missing""")
def matched_and_missing(v: View) -> DataFrame:
    flagged = layers.with_flag(v.answers, v.mentions, "has")
    return flagged.agg(F.count_if("has").alias("matched"), F.count_if(~F.col("has")).alias("missing"))


@query("j5_existence_flag", "select a.key, exists (select 1 from prices p where p.key = a.key and p.currency = 'USD') as in_usd from answers a")
def existence(v: View) -> DataFrame:
    return layers.with_flag(v.answers, v.prices.where("currency = 'USD'"), "in_usd").select("key", "in_usd")


def _name_table(v: View) -> DataFrame:
    n = F.substring_index("name", "#", -1)
    brands = v.table("part").select(F.col("p_brand").alias("name")).distinct()
    return brands.select(F.concat(F.lit("b"), n).alias("id"), F.col("name").alias("display"), F.concat(F.lit("maker "), n, F.lit("|brand no "), n).alias("aliases"), n.cast("int").alias("ordinal"))


def _surfaces(v: View) -> DataFrame:
    m = v.mentions
    n, k = F.substring_index("name", "#", -1), hash32("form", F.col("key"), F.col("name")) % 6
    form = (F.when(k == 0, F.upper("name")).when(k == 1, F.concat(F.lit("Maker "), n)).when(k == 2, F.concat(F.lit("brand no "), n, F.lit(" pro max (new)")))
            .when(k == 3, F.concat("name", F.lit(" classic"))).when(k == 4, F.concat(F.lit("Other "), n)).otherwise(F.col("name")))
    return m.select("key", "name", form.alias("surface"))


_SURFACES = f"""forms as (select key, name, split_part(name, '#', 2) as n, {h("'form|' || key || '|' || name")} % 6 as k from mentions),
surfaces as (select key, name, case k when 0 then upper(name) when 1 then 'Maker ' || n when 2 then 'brand no ' || n || ' pro max (new)' when 3 then name || ' classic' when 4 then 'Other ' || n else name end as surface from forms),
folded as (select *, trim(regexp_replace(regexp_replace(lower(surface), '\\s*\\([^()]*\\)\\s*$', ''), '\\s+', ' ', 'g')) as s from surfaces),
keymap as (select distinct unnest(['brand#' || n, 'maker ' || n, 'brand no ' || n]) as surface, 'b' || n as id from (select distinct split_part(p_brand, '#', 2) as n from part)),
tried as (select f.*, string_split(s, ' ') as w from folded f),
resolved as (select t.*, coalesce(k0.id, k3.id, k2.id, k1.id) as id from tried t left join keymap k0 on k0.surface = s
  left join keymap k3 on len(w) > 3 and k3.surface = array_to_string(w[1:3], ' ') left join keymap k2 on len(w) > 2 and k2.surface = array_to_string(w[1:2], ' ') left join keymap k1 on len(w) > 1 and k1.surface = w[1])"""


@query("j6_resolve_names", f"with {_SURFACES} select key, surface, id from resolved")
def resolve_names(v: View) -> DataFrame:
    return resolve.resolve(_surfaces(v), resolve.key_map(_name_table(v))).select("key", "surface", "id")


@query("e1_candidates", f"""with {_SURFACES} select s as folded, count(*) as n, count(distinct surface) as n_forms, count(distinct a.query) as n_groups, min(surface) as form from resolved join answers a using (key) where id is null group by all""")
def candidates(v: View) -> DataFrame:
    m = _surfaces(v).join(v.answers.select("key", "query"), "key")
    return resolve.candidates(m, resolve.key_map(_name_table(v)))


@query("e2_collisions", """select surface, count(distinct id) as n_ids from (select 's' || (s_suppkey % 7) as id, unnest([lower(s_name), 'nation ' || s_nationkey]) as surface from supplier) group by all having count(distinct id) > 1""", with_study=False)
def collisions(v: View) -> DataFrame:
    names = v.table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 7).alias("id"), F.col("s_name").alias("display"), F.concat(F.lit("Nation "), "s_nationkey").alias("aliases"))
    return resolve.collisions(names)


@query("e6_frequent_mentions", "select name, count(*) as n from mentions group by all having count(*) >= 100")
def frequent_mentions(v: View) -> DataFrame:
    return v.mentions.groupBy("name").agg(F.count("*").alias("n")).where("n >= 100")


@query("e7_merge_back", f"""select a.key, coalesce(d.o, a.outcome) as outcome, d.o is not null and d.o <> a.outcome as conflict from answers a left join (select key, case when {h("'decide|' || key")} % 2 = 0 then 'valid' else outcome end as o from answers where {h("'decided|' || key")} % 20 = 0) d using (key)""")
def merge_back(v: View) -> DataFrame:
    a = v.answers.select("key", "outcome")
    decided = a.where(hash32("decided", F.col("key")) % 20 == 0).withColumn("outcome", F.when(hash32("decide", F.col("key")) % 2 == 0, "valid").otherwise(F.col("outcome")))
    return resolve.merge_back(a, decided, "key", "outcome")


_SETCOUNT = "sc as (select model, query, arm, names as s, count(*)::double as c from lists group by all)"
_WITHIN = f"""wi as (select a.model, a.query, a.arm, n, case when n > 1 then (sum(a.c * b.c * {JAC.format(a='a.s', b='b.s')}) - n) / (n * (n - 1)) end as within
  from sc a join sc b using (model, query, arm) join (select model, query, arm, sum(c) as n from sc group by all) using (model, query, arm) group by a.model, a.query, a.arm, n)"""
_BETWEEN = f"""be as (select a.model, a.query, a.arm || '-' || b.arm as contrast, a.arm as aa, b.arm as ab, sum(a.c * b.c * {JAC.format(a='a.s', b='b.s')}) / sum(a.c * b.c) as between_
  from sc a join sc b on a.model = b.model and a.query = b.query and a.arm || '-' || b.arm in ('bn-en', 'bl-en', 'bn-bl') group by all)"""


@query("m1_within_jaccard", f"with {_SETCOUNT}, {_WITHIN} select model, query, arm, n, round(within, 6) as within from wi")
def within(v: View) -> DataFrame:
    return rounded(estimate.within_similarity(estimate.set_counts(v.lists), v.names).drop("t"), "within")


@query("m6_excess_divergence", f"""with {_SETCOUNT}, {_WITHIN}, {_BETWEEN}, ex as (select be.model, be.query, contrast, (1 - between_) - ((1 - x.within) + (1 - y.within)) / 2 as d from be
join wi x on be.model = x.model and be.query = x.query and aa = x.arm and x.within is not null join wi y on be.model = y.model and be.query = y.query and ab = y.arm and y.within is not null)
select model, contrast, round(avg(d), 6) as estimate, count(*) as n from ex group by all""")
def excess(v: View) -> DataFrame:
    return rounded(estimate.contrast_means(estimate.excess_divergence(estimate.set_counts(v.lists), CONTRASTS, v.names)), "estimate")


@query("m7_kernel_distance", f"""with {_SETCOUNT}, {_BETWEEN}, k as (select a.model, a.query, a.arm, sum(a.c * b.c * {JAC.format(a='a.s', b='b.s')}) / sum(a.c * b.c) as k from sc a join sc b using (model, query, arm) group by all)
select be.model, be.query, contrast, round(x.k + y.k - 2 * between_, 6) as mmd2 from be join k x on be.model = x.model and be.query = x.query and aa = x.arm join k y on be.model = y.model and be.query = y.query and ab = y.arm""")
def kernel(v: View) -> DataFrame:
    return rounded(estimate.kernel_distance(estimate.set_counts(v.lists), CONTRASTS, v.names), "mmd2")


@query("m2_m4_consensus_scores", f"""with {_SETS}, {_MAJOR} select rs.key, round({F1.format(a='r1', b='coalesce(consensus, [])')}, 6) as f1, round({JAC.format(a='r1', b='coalesce(consensus, [])')}, 6) as jaccard, r1 = coalesce(consensus, []) as exact from rs left join major using (key)""")
def consensus_scores(v: View) -> DataFrame:
    s = consensus.rater_sets(v.raters, v.answers, study.RATERS).join(consensus.majority_names(v.raters), "key", "left")
    ref = F.coalesce("consensus", F.array().cast("array<string>"))
    return rounded(s.select("key", sets.set_f1(F.col("R1"), ref).alias("f1"), sets.jaccard(F.col("R1"), ref).alias("jaccard"), sets.exact_match(F.col("R1"), ref).alias("exact")), "f1", "jaccard")


@query("m5_rank_overlap", """with o as (select a.key, coalesce(list(name order by place) filter (where rater = 'R1'), []) as x, coalesce(list(name order by place) filter (where rater = 'R2'), []) as y from answers a left join raters using (key) group by a.key),
z as (select key, case when len(x) <= len(y) then x else y end as s, case when len(x) <= len(y) then y else x end as l from o),
d as (select key, s, l, unnest(range(1, len(l) + 1)) as d from z where len(s) > 0),
t as (select key, any_value(len(s)) as ns, any_value(len(l)) as nl, any_value(len(list_intersect(s, l))) as xl, any_value(len(list_intersect(s, l[1:len(s)]))) as xs,
  sum(len(list_intersect(s[1:least(d, len(s))], l[1:d])) / d * 0.9::double ** d + case when d > len(s) then len(list_intersect(s, l[1:len(s)])) * (d - len(s)) / (len(s) * d) * 0.9::double ** d else 0 end) as terms from d group by key)
select z.key, round(case when len(s) = 0 and len(l) = 0 then 1.0 when len(s) = 0 then 0.0 else (0.1::double / 0.9::double) * terms + ((xl - xs) / nl + xs / ns) * 0.9::double ** nl end, 6) as rbo from z left join t using (key)""")
def rank_overlap(v: View) -> DataFrame:
    ordered = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("rater") == r, F.struct("place", "name")))), lambda x: x["name"])
    wide = v.raters.groupBy("key").agg(ordered("R1").alias("x"), ordered("R2").alias("y"))
    empty = F.array().cast("array<string>")
    both = v.answers.select("key").join(wide, "key", "left")
    return rounded(both.select("key", sets.rank_overlap(F.coalesce("x", empty), F.coalesce("y", empty)).alias("rbo")), "rbo")


@query("g1_krippendorff", f"""with {_VOTES}, c as (select key, vote, count(*)::double as n from votes group by all), m as (select *, sum(n) over (partition by key) as m from c),
f as (select sum(n * (m - n) / (m - 1)) as off, sum(n) as total from m where m > 1), s as (select sum(c * c) as sq from (select vote, sum(n) as c from m where m > 1 group by all))
select round(1 - off / total / ((total * total - sq) / (total * (total - 1))), 6) as alpha from f, s""")
def krippendorff(v: View) -> DataFrame:
    return rounded(consensus.krippendorff(_votes(v), "key", "vote"), "alpha")


@query("g2_g3_kappa", f"""with {_VOTES}, p as (select key, max((vote = 'valid')::int) filter (where rater = 'R1') as a, max((vote = 'valid')::int) filter (where rater = 'R2') as b from votes group by all),
o as (select avg((a = b)::int) as po, avg(a) as pa, avg(b) as pb from p) select round(po, 6) as agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) as kappa from o""")
def kappa(v: View) -> DataFrame:
    valid = (F.col("vote") == "valid").cast("int")
    p = _votes(v).groupBy("key").agg(F.max(F.when(F.col("rater") == "R1", valid)).alias("a"), F.max(F.when(F.col("rater") == "R2", valid)).alias("b"))
    return rounded(consensus.kappa(p, "a", "b"), "agreement", "kappa")


@query("g4_wilson", """with c as (select model, arm, count(*) filter (where outcome = 'refusal') as k, count(*)::double as n from answers group by all), w as (select *, k / n as p, 1.959963984540054::double as z from c)
select model, arm, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as lo, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as hi from w""")
def wilson_limits(v: View) -> DataFrame:
    c = v.answers.groupBy("model", "arm").agg(F.count_if(F.col("outcome") == "refusal").alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rounded(c.select("model", "arm", lo.alias("lo"), hi.alias("hi")), "lo", "hi")


@query("w1_w2_final_draws", f"""with dr as (select model, query, arm, rep, key, unnest(range(1, case when {h("'draw|' || key")} % 10 = 0 then 3 else 2 end)) as draw from answers),
ou as (select *, case when {h("'outcome|' || key || '|' || draw")} % 100 < 20 then 'degenerate' else 'valid' end as outcome from dr)
select model, query, arm, rep, key, max(draw) as draw, max_by(outcome, draw) as outcome, min_by(outcome, draw) = 'degenerate' as first_degenerate, count(*) as n_draws from ou group by all""")
def final_draws(v: View) -> DataFrame:
    return layers.final_draws(v.draws())


@query("w3_redraw_plan", f"""with dr as (select model, query, arm, rep, key, unnest(range(1, case when {h("'draw|' || key")} % 10 = 0 then 3 else 2 end)) as draw from answers),
ou as (select *, {h("'outcome|' || key || '|' || draw")} % 100 < 20 as bad from dr), g as (select model, query, arm, rep, bool_or(not bad) as ok, max(draw) as last from ou group by all)
select model, query, arm, rep, case when not ok and last < 3 then last + 1 else 0 end as next_draw, case when ok then 'done' when last < 3 then 'plan' else 'short' end as status from g""")
def redraw_plan(v: View) -> DataFrame:
    return layers.redraw_plan(v.draws()).na.fill(0, ["next_draw"])


@query("w4_w5_ranked_shares", """with c as (select arm, name, count(*) as n from answers join mentions using (key) group by all) select arm, name, n, round(n / sum(n) over (partition by arm), 6) as share, row_number() over (partition by arm order by n desc, name) as "rank" from c""")
def ranked_shares(v: View) -> DataFrame:
    c = v.answers.select("key", "arm").join(v.mentions, "key").groupBy("arm", "name").agg(F.count("*").alias("n"))
    return rounded(layers.ranked(layers.row_share(c, "arm"), "n", "name", ("arm",)), "share")


@query("w6_first_mention", "select name, min(place) as best, round(avg(place), 6) as mean_place from mentions group by all")
def first_mention(v: View) -> DataFrame:
    return rounded(v.mentions.groupBy("name").agg(F.min("place").alias("best"), F.avg("place").alias("mean_place")), "mean_place")


@query("o4_top3_overlap", """with c as (select arm, category, count(*) as n from answers group by all), t as (select arm, list(category order by n desc, category)[1:3] as top from c group by arm)
select a.arm as arm_a, b.arm as arm_b, len(list_intersect(a.top, b.top)) as shared from t a join t b on a.arm < b.arm""")
def top3(v: View) -> DataFrame:
    c = layers.ranked(v.answers.groupBy("arm", "category").agg(F.count("*").alias("n")), "n", "category", ("arm",)).where("rank <= 3")
    t = c.groupBy("arm").agg(F.collect_list("category").alias("top"))
    a, b = t.select(F.col("arm").alias("arm_a"), F.col("top").alias("ta")), t.select(F.col("arm").alias("arm_b"), F.col("top").alias("tb"))
    return a.join(b, F.col("arm_a") < F.col("arm_b")).select("arm_a", "arm_b", F.size(F.array_intersect("ta", "tb")).alias("shared"))


@query("o5_opaque_ids", "select key, 'p' || substr(md5('round1|' || key), 1, 12) as pid from answers")
def opaque(v: View) -> DataFrame:
    return sampling.opaque_ids(v.answers.select("key"), "round1")


@query("o8_nearest_rank", """with s as (select model, list(amount order by amount) as l from answers group by all) select model, round(l[1 + round_even(0.9::double * (len(l) - 1), 0)::int], 6) as p90 from s""")
def nearest_rank(v: View) -> DataFrame:
    """The value at the place nearest to 0.9 (n - 1) from 0, halves to even; distinct values are counted first, then added up."""
    counts = v.answers.groupBy("model", "amount").agg(F.count("*").alias("c"))
    w = Window.partitionBy("model")
    r = counts.withColumn("upto", F.sum("c").over(w.orderBy("amount"))).withColumn("n", F.sum("c").over(w))
    place = F.bround(0.9 * (F.col("n") - 1), 0)
    return rounded(r.where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select("model", F.col("amount").alias("p90")), "p90")


@query("u2_u3_supports", """select (select count(*) from (select model, query from answers where arm = 'en' intersect select model, query from answers where arm = 'bn')) as both, (select count(*) from (select name from classes except select name from mentions)) as unused,
(select count(*) from (select name from mentions except select name from classes)) as unclassed""")
def supports(v: View) -> DataFrame:
    a = v.answers
    both = a.where("arm = 'en'").select("model", "query").intersect(a.where("arm = 'bn'").select("model", "query")).agg(F.count("*").alias("both"))
    names, known = v.mentions.select("name"), v.classes.select("name")
    return both.join(known.subtract(names).agg(F.count("*").alias("unused"))).join(names.subtract(known).agg(F.count("*").alias("unclassed")))


_WEIGHTS = f"""units as (select query as unit, category as s, row_number() over (partition by {{part}} order by query) - 1 as i, count(*) over (partition by {{part}}) as n from (select distinct query, category from answers)),
drawn as (select {{part}} as s2, b, {h("'7|' || b || '|' || {part} || '|' || i")} % n as i2 from units, (select unnest(range({DRAWS})) as b)),
wt as (select g.b, u.unit, count(d.b) as w from units u cross join (select unnest(range({DRAWS})) as b) g left join drawn d on d.b = g.b and d.s2 = {{part}} and d.i2 = u.i group by all)"""
_PLAIN, _STRATA = _WEIGHTS.format(part="'all'"), _WEIGHTS.format(part="s").replace("partition by s order", "partition by category order").replace("over (partition by s)", "over (partition by category)")


def _units(v: View) -> DataFrame:
    return v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("unit"), F.col("r_name").alias("category"))


@query("b1_b2_bootstrap", f"""{SHARE}, {_PLAIN}, r as (select model, contrast, b, sum(w * d) / nullif(sum(w), 0) as rep from paired join wt on unit = query group by all)
select model, contrast, round(quantile_cont(rep, 0.025), 6) as lo, round(quantile_cont(rep, 0.975), 6) as hi, count(rep) as used from r where rep is not null group by all""")
def bootstrap(v: View) -> DataFrame:
    d = estimate.paired(v.share_cells(), CONTRASTS).select("model", "contrast", F.col("query").alias("unit"), F.col("d").alias("v"))
    return rounded(resample.intervals(d, _units(v), ("model", "contrast"), DRAWS), "lo", "hi")


@query("b3_stratified_bootstrap", f"""{SHARE}, {_STRATA}, r as (select model, contrast, b, sum(w * d) / nullif(sum(w), 0) as rep from paired join wt on unit = query group by all)
select model, contrast, round(quantile_cont(rep, 0.025), 6) as lo, round(quantile_cont(rep, 0.975), 6) as hi, count(rep) as used from r where rep is not null group by all""")
def stratified_bootstrap(v: View) -> DataFrame:
    d = estimate.paired(v.share_cells(), CONTRASTS).select("model", "contrast", F.col("query").alias("unit"), F.col("d").alias("v"))
    return rounded(resample.intervals(d, _units(v).withColumnRenamed("category", "stratum"), ("model", "contrast"), DRAWS), "lo", "hi")


@query("b1_ratio_bootstrap", f"""with {COUNTED}, t as (select model, arm, query, sum(n_local) as y, sum(n_local + n_global) as n from counted group by all), {_PLAIN},
r as (select model, arm, b, sum(w * y) / nullif(sum(w * n), 0) as rep from t join wt on unit = query group by all)
select model, arm, round(quantile_cont(rep, 0.025), 6) as lo, round(quantile_cont(rep, 0.975), 6) as hi, count(rep) as used from r where rep is not null group by all""")
def ratio_bootstrap(v: View) -> DataFrame:
    t = v.counted().groupBy("model", "arm", F.col("query").alias("unit")).agg(F.sum("n_local").alias("y"), F.sum(F.col("n_local") + F.col("n_global")).alias("n"))
    return rounded(resample.percentile_interval(resample.ratio_replicates(t, resample.weights(_units(v), DRAWS), ("model", "arm")), ("model", "arm")), "lo", "hi")


@query("b4_frame_bootstrap", f"""{SHARE}, {_PLAIN}, c as (select distinct query, category from answers), e as (select p.*, category from paired p join c using (query)),
pt as (select model, contrast, category, avg(d) as estimate, count(*) as n_units from e group by all), m as (select count(distinct model) as members from e),
r as (select model, contrast, category, b, sum(w * d) / nullif(sum(w), 0) as rep from e join wt on unit = query group by all),
j as (select 'all' as model, contrast, category, b, avg(rep) as rep from r group by contrast, category, b having count(rep) = (select members from m)),
pts as (select * from pt union all select 'all', contrast, category, avg(estimate), min(n_units) from pt group by contrast, category having count(*) = (select members from m)),
l as (select model, contrast, category, quantile_cont(rep, 0.025) as lo, quantile_cont(rep, 0.975) as hi, count(*) as used from (select * from r where rep is not null union all select * from j) group by all)
select model, contrast, category, round(estimate, 6) as estimate, n_units, case when n_units >= 2 then round(lo, 6) end as lo, case when n_units >= 2 then round(hi, 6) end as hi, coalesce(used, 0) as used
from pts left join l using (model, contrast, category)""")
def frame_bootstrap(v: View) -> DataFrame:
    """Contrasts within a category, resampled over the frame of all queries; the models' mean shares the draws."""
    categories = v.answers.select("query", "category").distinct()
    d = estimate.paired(v.share_cells(), CONTRASTS).join(categories, "query").select("model", "contrast", "category", F.col("query").alias("unit"), F.col("d").alias("v"))
    return rounded(resample.frame_intervals(d, resample.weights(_units(v), DRAWS), ("contrast", "category"), "model"), "estimate", "lo", "hi")


@query("g2_g3_cluster_interval", f"""with {_VOTES}, p as (select key, max((vote = 'valid')::int) filter (where rater = 'R1') as x, max((vote = 'valid')::int) filter (where rater = 'R2') as y from votes group by all),
cells as (select query, count(*) as c, sum(x) as x, sum(y) as y, sum((x = y)::int) as same from p join answers using (key) group by query), {_PLAIN},
t as (select b, sum(w * c)::double as c, sum(w * x) as x, sum(w * y) as y, sum(w * same) as same from cells join wt on unit = query group by b),
q as (select same / c as po, x / c * (y / c) + (1 - x / c) * (1 - y / c) as pe from t where c > 0), r as (select (po - pe) / nullif(1 - pe, 0) as rep from q)
select round(quantile_cont(rep, 0.025), 6) as lo, round(quantile_cont(rep, 0.975), 6) as hi, count(rep) as used from r where rep is not null""")
def kappa_interval(v: View) -> DataFrame:
    """Kappa of two raters with all answers of a query resampled together."""
    valid = (F.col("vote") == "valid").cast("int")
    p = _votes(v).groupBy("key").agg(F.max(F.when(F.col("rater") == "R1", valid)).alias("x"), F.max(F.when(F.col("rater") == "R2", valid)).alias("y"))
    cells = p.join(v.answers.select("key", F.col("query").alias("unit")), "key").groupBy("unit").agg(
        F.count("*").alias("n"), F.sum("x").alias("a"), F.sum("y").alias("b2"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    return rounded(resample.percentile_interval(resample.kappa_replicates(cells, resample.weights(_units(v), DRAWS)), ()), "lo", "hi")


_EFFECT = f"""{SHARE}, {_PLAIN}, base as (select model, contrast, count(*) as n, avg(d) as mean, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t from paired group by all),
sums as (select model, contrast, b, any_value(t) as t, sum(w)::double as nn, sum(w * (d - mean)) as s, sum(w * (d - mean) * (d - mean)) as q from paired join base using (model, contrast) join wt on unit = query group by all),
va as (select *, case when nn > 1 then (q - s * s / nn) / (nn * (nn - 1)) end as v from sums),
hits as (select model, contrast, count(*) filter (where v is null or v <= 1e-18 or abs(s / nn / sqrt(v)) >= abs(t)) as hits from va group by all),
tests as (select model, contrast, n, mean, t, (1 + hits) / ({DRAWS} + 1) as p from base join hits using (model, contrast))"""


def _tests(v: View) -> DataFrame:
    d = estimate.paired(v.share_cells(), CONTRASTS).select("model", "contrast", F.col("query").alias("unit"), F.col("d").alias("v"))
    return resample.mean_effects(d, _units(v), ("model", "contrast"), DRAWS)


@query("h4_mean_effect", f"{_EFFECT} select model, contrast, n, round(mean, 6) as mean, round(t, 6) as t, round(p, 6) as p from tests")
def mean_effect(v: View) -> DataFrame:
    return rounded(_tests(v), "mean", "t", "p")


@query("h6_holm", f"""{_EFFECT}, o as (select *, row_number() over (order by p, model || contrast) as i, count(*) over () as m from tests)
select model, contrast, round(p, 6) as p, round(least(1.0, max((m - i + 1) * p) over (order by i rows unbounded preceding)), 6) as p_holm from o""")
def holm(v: View) -> DataFrame:
    t = _tests(v).withColumn("family", F.lit("share")).withColumn("tie", F.concat("model", "contrast"))
    return rounded(resample.holm(t, ("family",), tie="tie").select("model", "contrast", "p", "p_holm"), "p", "p_holm")


@query("h7_benjamini_yekutieli", f"""{_EFFECT}, o as (select *, row_number() over (order by p, model || contrast) as i, count(*) over () as m from tests), hm as (select sum(1.0::double / k) as hsum from (select unnest(range(1, 16)) as k)),
l as (select o.*, max(case when p <= i / m * 0.05::double / hsum then i else 0 end) over () as last from o, hm) select model, contrast, i <= last as rejected from l""")
def benjamini_yekutieli(v: View) -> DataFrame:
    t = _tests(v).withColumn("family", F.lit("share")).withColumn("tie", F.concat("model", "contrast"))
    return resample.benjamini_yekutieli(t, ("family",), tie="tie").select("model", "contrast", "rejected")


@query("r1_plan", "select n_name as query, arm, rep from nation, (select unnest(['en', 'bn', 'bl']) as arm), (select unnest(range(1, 6)) as rep)", with_study=False)
def design(v: View) -> DataFrame:
    arms = v.spark.createDataFrame([("en",), ("bn",), ("bl",)], "arm string")
    return sampling.plan(v.table("nation").select(F.col("n_name").alias("query")), arms, v.spark.range(1, 6).select(F.col("id").alias("rep")))


@query("r5_per_stratum", """select key, category, arm, greatest(0, 20 - n) as shortfall from (select key, category, arm, row_number() over (partition by category, arm order by md5('s5|' || key), key) as r, count(*) over (partition by category, arm) as n from answers) where r <= 20""")
def per_stratum(v: View) -> DataFrame:
    return sampling.per_stratum(v.answers.select("key", "category", "arm"), ("category", "arm"), 20, "s5")


@query("r2_round_robin", """select key, model, arm, turn from (select key, model, arm, row_number() over (partition by model, arm order by md5('rr|' || key), key) as turn from answers) order by turn, model, arm limit 200""")
def round_robin(v: View) -> DataFrame:
    return sampling.round_robin(v.answers.select("key", "model", "arm"), ("model", "arm"), 200, "rr")


@query("r4_largest_remainder", """with s as (select outcome as stratum, count(*) as n from answers group by all), q as (select *, (200 * n) // sum(n) over () as q, (200 * n) % sum(n) over () as m from s)
select stratum, n, (q + case when row_number() over (order by m desc, md5('lr|' || stratum)) <= 200 - sum(q) over () then 1 else 0 end)::bigint as quota from q""")
def largest_remainder(v: View) -> DataFrame:
    return sampling.largest_remainder(v.answers.groupBy(F.col("outcome").alias("stratum")).agg(F.count("*").alias("n")), 200, "lr").withColumn("quota", F.col("quota").cast("long"))


@query("r3_guarantee_one", """with s as (select model || arm || outcome as stratum, count(*) as n from answers group by all), b as (select *, least(1, n) as b from s), r as (select *, 300 - sum(b) over () as rest, n - b as room from b),
q as (select *, (rest * room) // sum(room) over () as q, (rest * room) % sum(room) over () as m from r)
select stratum, n, (b + q + case when row_number() over (order by m desc, md5('g1|' || stratum)) <= rest - sum(q) over () then 1 else 0 end)::bigint as quota from q""")
def guarantee_one(v: View) -> DataFrame:
    s = v.answers.groupBy(F.concat("model", "arm", "outcome").alias("stratum")).agg(F.count("*").alias("n"))
    return sampling.largest_remainder(s, 300, "g1", at_least=1).withColumn("quota", F.col("quota").cast("long"))


_BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_LETTERS = "len(regexp_extract_all({t}, '[À-ÿ]')) as {a}, len(regexp_extract_all({t}, '[A-Za-z]')) as {b}"


@query("t3_t6_script_ratio", rf"""with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: regexp_matches(x, '[À-ÿA-Za-z]')) as words,
  list_filter(regexp_split_to_array(regexp_replace(text, '\([^)]*\)|\[[^\]]*\]|（[^）]*）', ' ', 'g'), '{_BLANK}+'), lambda x: x <> '' and not regexp_matches(x, '\p{{Nd}}')
    and not (not regexp_matches(x, '[À-ÿ]') and regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '^["''“‘(«\[*–—•·-]*\p{{Lu}}'))) as kept from documents),
c as (select doc_id, {_LETTERS.format(t='text', a='a', b='b')}, len(words) as nw, len(list_filter(words, lambda x: len(regexp_extract_all(x, '[À-ÿ]')) >= len(regexp_extract_all(x, '[A-Za-z]')))) as mine,
  {_LETTERS.format(t="array_to_string(kept, ' ')", a='pa', b='pb')} from w),
r as (select doc_id, case when a + b > 0 then a / (a + b) else 0.0 end as ratio, case when nw > 0 then mine / nw else 0.0 end as ratio_words, case when pa + pb > 0 then pa / (pa + pb) when a + b > 0 then a / (a + b) else 0.0 end as prose from c)
select doc_id, round(ratio, 6) as ratio, round(ratio_words, 6) as ratio_words, round(prose, 6) as prose, case when prose >= 0.6 then 'bn' when prose <= 0.2 then 'latin' else 'mixed' end as script from r""", with_study=False)
def script_ratio(v: View) -> DataFrame:
    """T3 to T6; accented letters stand in for the script, which these tables lack."""
    t, script = F.col("text"), "À-ÿ"
    each = F.struct(text.script_ratio(t, script).alias("ratio"), text.script_ratio_words(t, script).alias("ratio_words"), text.prose_ratio(t, script).alias("prose"))
    r = v.table("documents").select("doc_id", F.explode(F.array(each)).alias("r")).select("doc_id", "r.*")  # computed once, then used
    return rounded(r.withColumn("script", text.script_class(F.col("prose"))), "ratio", "ratio_words", "prose")


@query("t16_t20_lines_and_tokens", """select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: x <> '')) as n_lines, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) as n_tokens from documents""", with_study=False)
def lines_tokens(v: View) -> DataFrame:
    return v.table("documents").select("doc_id", F.size(text.lines(F.col("text"))).alias("n_lines"), F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query("t8_t11_first_rule", """select doc_id, case when regexp_matches(text, '(?i)copyright|licen[sc]e') then 'license' when regexp_matches(text, '[0-9]{12,}') then 'number' when regexp_matches(text, '[|]') then 'table' end as rule from documents""", with_study=False)
def first_rule(v: View) -> DataFrame:
    rules = [("license", "(?i)copyright|licen[sc]e"), ("number", "[0-9]{12,}"), ("table", "[|]")]
    return v.table("documents").select("doc_id", text.first_rule(F.col("text"), rules).alias("rule"))


_UNITS = ("Tk", "usd", "euro", "", "?", "Taka", "$", "unstated")


@query("t12_t14_prices", """with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice)::bigint as a, l_partkey % 8 as u from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when u in (0, 1, 2, 5, 7) then a::double end as amount, case when u in (0, 5) then 'BDT' when u = 1 then 'USD' when u = 2 then 'other' when u = 7 then 'unstated' end as currency from p""", with_study=False)
def price_lines(v: View) -> DataFrame:
    """Lines without a currency word, or with one that is not letters, are no prices."""
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("l_partkey") % 8 + 1).cast("int"))
    line = F.concat(F.round("l_extendedprice").cast("long").cast("string"), F.lit(" "), unit)
    p = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.price(line).alias("p"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.amount", "p.currency")


@query("t17_digit_runs", """select doc_id, len(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+')) as n_numbers from documents""", with_study=False)
def digit_runs(v: View) -> DataFrame:
    return v.table("documents").select("doc_id", F.size(text.digit_runs(F.col("text"))).alias("n_numbers"))


@query("t22_slug", "select s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from supplier", with_study=False)
def slug(v: View) -> DataFrame:
    return v.table("supplier").select("s_suppkey", text.slug(F.col("s_name")).alias("slug"))


_CODED = f"""x as (select key, arm, ['bn', 'latin', 'mixed'][({h("'script|' || key")} % 3 + 1)::int] as script, [null, 'en', 'bn', 'banglish', 'mixed', 'other'][({h("'lang|' || key")} % 6 + 1)::int] as ext,
  [null, true, false, false][({h("'rule|' || key")} % 4 + 1)::int] as fires, {h("'content|' || key")} % 3 > 0 as content, outcome = 'degenerate' as bad,
  case arm when 'bl' then 'banglish' else arm end as wanted from answers),
y as (select *, case when script = 'bn' then 'bn' end as language0, not (script = 'bn' or (script = 'latin' and arm = 'bn')) as pending,
  case when script = 'bn' then arm = 'bn' when script = 'latin' and arm = 'bn' then false end as conforming0,
  case when script = 'bn' then 'bn' when script = 'latin' then case when ext = 'bn' then 'latin_unresolved' else ext end else coalesce(ext, 'mixed') end as language1,
  case when script = 'bn' then wanted = 'bn' when script = 'latin' and arm = 'bn' then false when script = 'latin' and ext = 'bn' then null else ext = wanted end as conforming1,
  case when script = 'bn' and ext <> 'bn' then 'script=bn but extractor=' || ext when script = 'latin' and ext = 'bn' then 'script=latin but extractor=bn' end as reason1 from x)"""


def _coded(v: View) -> DataFrame:
    """Answers with what coding and extraction know of them, derived from md5 of the key."""
    pick = lambda name, xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), (hash32(name, F.col("key")) % len(xs) + 1).cast("int"))
    return v.answers.select("key", "model", "arm", (F.col("outcome") == "degenerate").alias("bad"), pick("script", ("bn", "latin", "mixed"), "string").alias("script"),
                            pick("lang", (None, "en", "bn", "banglish", "mixed", "other"), "string").alias("ext"), pick("rule", (None, True, False, False), "boolean").alias("fires"),
                            (hash32("content", F.col("key")) % 3 > 0).alias("content"))


@query("t9_t10_conformity", f"with {_CODED} select key, language0, pending, conforming0, language1, conforming1, reason1 from y")
def conformity(v: View) -> DataFrame:
    c, r = text.conformity(F.col("arm"), F.col("script")), text.resolve_language(F.col("arm"), F.col("script"), F.col("ext"))
    return _coded(v).select("key", c["language"].alias("language0"), c["pending"].alias("pending"), c["conforming"].alias("conforming0"),
                            r["language"].alias("language1"), r["conforming"].alias("conforming1"), r["reason"].alias("reason1"))


_OUTCOME = """case when bad then 'degenerate' when fires is null then 'pending_refusal_rules' when {ext} is null and (fires or pending) then 'pending_extractor'
  when fires and not content then 'refusal' when conforming1 is null then 'pending_adjudication' when conforming1 then 'valid' else 'language_reversion' end"""


def _outcome(ext: Column) -> Column:
    pending = text.conformity(F.col("arm"), F.col("script"))["pending"]
    return text.outcome(F.col("bad"), F.col("fires"), ext.isNotNull(), F.col("content"), pending, F.col("arm"), F.col("script"), ext)


@query("p15_j1_final_outcome", f"""with {_CODED}, o as (select *, {_OUTCOME.format(ext='ext')} as outcome from y)
select key, outcome, coalesce(fires and outcome in ('pending_adjudication', 'valid', 'language_reversion'), false) as hedged from o""")
def final_outcome(v: View) -> DataFrame:
    """The final code of each answer: a refusal is content-free, one that names something is hedged."""
    o = _outcome(F.col("ext"))
    return _coded(v).select("key", o["outcome"].alias("outcome"), o["hedged"].alias("hedged"))


@query("a8_g7_refolded_agreement", f"""with {_CODED}, o as (select *, {_OUTCOME.format(ext='ext')} as a from y),
x2 as (select * replace (case when {h("'second|' || key")} % 5 = 0 then 'mixed' else ext end as ext) from x),
y2 as (select *, not (script = 'bn' or (script = 'latin' and arm = 'bn')) as pending, case when script = 'bn' then wanted = 'bn' when script = 'latin' and arm = 'bn' then false when script = 'latin' and ext = 'bn' then null else ext = wanted end as conforming1 from x2),
p as (select key, {_OUTCOME.format(ext='ext')} as b from y2)
select arm, count(*) as n, round(avg((a = b)::int), 6) as agreement from o join p using (key) where a <> 'pending_extractor' group by all""")
def refolded_agreement(v: View) -> DataFrame:
    """Two extractors on the answers that the first has coded: how often the final code is the same."""
    second = F.when(hash32("second", F.col("key")) % 5 == 0, "mixed").otherwise(F.col("ext"))
    both = _coded(v).select("arm", _outcome(F.col("ext"))["outcome"].alias("a"), _outcome(second)["outcome"].alias("b")).where("a <> 'pending_extractor'")
    return rounded(both.groupBy("arm").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement")), "agreement")


@query("n5_json_fields", "select event_id, (props->>'$.k')::bigint as k from events", with_study=False)
def json_fields(v: View) -> DataFrame:
    return v.table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("n3_canonical_key", """select s_suppkey, substr(sha256('{"name":"' || s_name || '","nation":' || s_nationkey || '}'), 1, 32) as id from supplier""", with_study=False)
def canonical_key(v: View) -> DataFrame:
    return v.table("supplier").select("s_suppkey", jsonx.canonical_key({"nation": F.col("s_nationkey"), "name": F.col("s_name")}).alias("id"))


@query("n1_tolerant_json", """select event_id, case when event_id % 6 <> 3 and event_id % 6 <> 5 then (props->>'$.k')::bigint end as k from events""", with_study=False)
def tolerant_json(v: View) -> DataFrame:
    """Whole, fenced, wrapped in prose, after other braces, with braces left open, and spaced: the fourth and the last but one have none."""
    i, p, lit = F.col("event_id") % 6, F.col("props"), F.lit
    wrapped = (F.when(i == 0, p).when(i == 1, F.concat(lit("```json\n"), p, lit("\n```"))).when(i == 2, F.concat(lit("Here it is: "), p, lit(" as asked")))
               .when(i == 3, F.concat(lit("So {this} "), p)).when(i == 4, F.concat(lit("  "), p, lit(" \n"))).otherwise(F.concat(lit("{ open "), p)))
    return v.table("events").select("event_id", F.from_json(jsonx.tolerant_json(wrapped), "k bigint")["k"].alias("k"))


@query("t1_fold")
def fold(v: View) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


_TAILS = "case doc_id % 5 when 0 then text || repeat(substr(text, 1, (doc_id % 61)::int), 25) when 1 then ' ' || chr(10) when 2 then repeat(chr(7), 9) || left(text, 40) when 3 then left(text, 30) || repeat('ab  ' || chr(9), 7) else text end"


@query("t7_degenerate", rf"""with b as (select doc_id, regexp_replace(coalesce({_TAILS}, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g') as s from documents),
t as (select doc_id, s, trim(regexp_replace(s, '{_BLANK}+', ' ', 'g')) as f, len(regexp_extract_all(s, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{{FFFD}}]')) as bad from b),
l as (select *, list_filter(range(1, 61), lambda p: length(f) >= p * greatest(5, ceil(20 / p)::int) and trim(right(f, p)) <> '' and right(f, p * greatest(5, ceil(20 / p)::int)) = repeat(right(f, p), greatest(5, ceil(20 / p)::int)))[1] as p from t)
select doc_id, case when s = '' then 'empty' when bad > 0.1 * length(s) then 'unreadable_chars' when p is not null then 'loop:period' || p || 'x' || greatest(5, ceil(20 / p)::int) end as reason from l""", with_study=False)
def degenerate(v: View) -> DataFrame:
    """Texts with repeated tails, blanks and control characters put to them, so that each reason occurs."""
    return v.table("documents").select("doc_id", text.degenerate(F.expr(_TAILS)).alias("reason"))


#: Rows of equal words that travel together, about.
PACK = 256


@query("j16_near_pairs", """with t as (select p_partkey as id, p_brand as category, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}]+')) as w from part where p_size <= 50)
select a.id as a, b.id as b from t a join t b on a.category = b.category and a.id < b.id where len(list_intersect(a.w, b.w)) > 0 and len(list_intersect(a.w, b.w)) >= 0.6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""", with_study=False)
def near_pairs(v: View) -> DataFrame:
    """Pairs of a category that share most of their words.

    Rows with the same words are one class of their category, and classes are compared. Words are ordered rarest first within
    the category; two sets that share so many have one in common among the first n - ceil(0.6 n) + 1 of each, so only those meet, and a
    pair of classes counts where it meets first. Its rows are paired last, in packs of PACK a class, and not shuffled again.
    """
    t = v.table("part").where("p_size <= 50").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.array_sort(text.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("w"))
    packs = t.where("category is not null and size(w) > 0").withColumn("pack", F.pmod(F.xxhash64("id"), F.ceil(F.count("*").over(Window.partitionBy("category", "w")) / PACK))).groupBy("category", "w", "pack").agg(F.collect_list("id").alias("ids"))
    classes = packs.select("category", "w").distinct()
    e = classes.select("category", "w", F.explode("w").alias("word"))
    df = e.groupBy("category", "word").agg(F.count("*").alias("f"))
    ordered = e.join(df, ["category", "word"]).groupBy("category", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "word"))), lambda x: x["word"]).alias("o"))
    n = F.size("w")
    first = ordered.withColumn("o", F.slice("o", F.lit(1), n - F.ceil(0.6 * n).cast("int") + 1)).withColumn("word", F.explode("o"))
    a, b = [first.select("category", "word", F.col("w").alias(f"w{s}"), F.col("o").alias(f"o{s}")) for s in ("a", "b")]
    length = F.least(F.size("wa"), F.size("wb")) >= 0.6 * F.greatest(F.size("wa"), F.size("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    met = a.join(b, ["category", "word"]).where(length).where(F.get(F.array_intersect("oa", "ob"), F.lit(0)) == F.col("word"))
    alike = met.where(both >= 0.6 * (F.size("wa") + F.size("wb") - both)).select("category", "wa", "wb")
    side = lambda s: packs.select("category", F.col("w").alias(f"w{s}"), F.col("ids").alias(f"ids{s}"))
    rows = alike.join(side("a"), ["category", "wa"]).join(side("b"), ["category", "wb"])
    return rows.select(F.explode("idsa").alias("a"), "idsb").select("a", F.explode("idsb").alias("b")).where("a < b")


@query("j17_term_join", """with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from documents), n as (select distinct lower(p_type) as word, 'type' as kind from part union select unnest(['the', 'von', 'que', 'les']), 'function')
select doc_id, word, kind from t join n using (word)""", with_study=False)
def term_join(v: View) -> DataFrame:
    words = v.table("documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("word"))
    terms = v.table("part").select(F.lower("p_type").alias("word"), F.lit("type").alias("kind")).union(
        v.spark.createDataFrame([(w, "function") for w in ("the", "von", "que", "les")], "word string, kind string")).distinct()
    return words.join(terms, "word").select("doc_id", "word", "kind")


@query("j21_interval_overlap", """with i as (select model as name, min(asked_at) as lo, max(asked_at) as hi from answers group by all), p as (select year(asked_at)::varchar as name, min(asked_at) as lo, max(asked_at) as hi from answers group by all)
select i.name as name_a, p.name as name_b from i join p on i.lo <= p.hi and i.hi >= p.lo""")
def interval_overlap(v: View) -> DataFrame:
    spans = lambda rows, name: rows.groupBy(name.alias("name")).agg(F.min("asked_at").alias("lo"), F.max("asked_at").alias("hi"))
    a = v.answers
    return ledger.overlaps(spans(a, F.col("model")), spans(a, F.year("asked_at").cast("string"))).select("name_a", "name_b")


@query("c10_compare_stored", f"""{SHARE}, e as (select model, contrast, avg(d) as estimate from paired group by all),
{cells_sql(name='cells2', where='n_local + n_global > 0 and not truncated')}, w2 as (select model, query, max(v) filter (where arm = 'en') as en, max(v) filter (where arm = 'bn') as bn from cells2 group by all),
o as (select model, 'bn-en' as contrast, avg(bn - en) as estimate from w2 where bn - en is not null group by model)
select coalesce(e.model, o.model) as model, coalesce(e.contrast, o.contrast) as contrast from e full join o on e.model = o.model and e.contrast = o.contrast where coalesce(abs(e.estimate - o.estimate) > 0.0005, true)""")
def compare_stored(v: View) -> DataFrame:
    """Estimates now against a stored run that left truncated answers out and knew one contrast only."""
    now = estimate.contrast_means(estimate.paired(v.share_cells(), CONTRASTS)).select("model", "contrast", "estimate")
    stored = estimate.contrast_means(estimate.paired(v.share_cells(where=~F.col("truncated")), CONTRASTS[:1])).select("model", "contrast", "estimate")
    return ledger.compare_stored(now, stored, ["model", "contrast"], "estimate", 0.0005).select("model", "contrast")


@query("k10_superseded", f"""with r as (select key, model, 'v' || ({h("'params|' || key")} % 3) as params from answers), w as (select distinct model, 'v' || ({h("'want|' || model")} % 3) as want from answers) select key, r.model, params from r join w using (model) where params <> want""")
def superseded(v: View) -> DataFrame:
    r = v.answers.select("key", "model", F.concat(F.lit("v"), hash32("params", F.col("key")) % 3).alias("params"))
    w = v.answers.select("model").distinct().withColumn("params", F.concat(F.lit("v"), hash32("want", F.col("model")) % 3))
    return ledger.superseded(r, w).select("key", "model", "params")
