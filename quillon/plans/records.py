"""Queries over records of answers: layers, typed labels, checks, ledgers and tables of decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import consensus, estimate, layers, study
from quillon.operators.study import hash32
from quillon.plans.catalogue import COUNTED, View, h, query, rounded
from quillon.sources import readers, sinks


def _among(name: str, values: tuple, key: str = "key", kind: str = "string") -> Column:
    """One of values by md5 of the key: what the tables lack."""
    return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), (hash32(name, F.col(key)) % len(values) + 1).cast("int"))


def _among_sql(name: str, values: tuple, key: str = "key") -> str:
    listed = ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in values)
    return f"[{listed}][({h(f''''{name}|' || {key}''')} % {len(values)} + 1)::int]"


# ------------------------------------------------------------------------------------------------ layers
_LANGUAGES = ("en", "bn", "banglish", "mixed", None)
_TARGET = "case arm when 'bl' then 'banglish' else arm end"


@query("p1_j3_human_layer", f"""with labelled as (select key, {_among_sql('language', _LANGUAGES)} as language, {h("'in_primary|' || key")} % 5 > 0 as primary_set from answers where {h("'human|' || key")} % 4 = 0),
coded as (select key, outcome = 'refusal' as refused, truncated from answers where {h("'coded|' || key")} % 10 > 0), marked as (select key from answers where {h("'persona|' || key")} % 20 = 0)
select l.key, model, query, arm, rep, primary_set, coalesce(c.refused, false) as refused, coalesce(language = {_TARGET}, false) as valid, coalesce(language = 'mixed', false) as mixed,
coalesce(c.truncated, false) as truncated, m.key is not null as persona, array_to_string(names, ',') as names, array_to_string(names_order, ',') as names_order
from labelled l join lists using (key) left join coded c using (key) left join marked m using (key)""")
def human_layer(v: View) -> DataFrame:
    """Labelled answers with what coding knows of them; an answer without a coded row has defaults."""
    a = v.answers
    labelled = a.where(hash32("human", F.col("key")) % 4 == 0).select("key", _among("language", _LANGUAGES).alias("language"), (hash32("in_primary", F.col("key")) % 5 > 0).alias("primary_set"))
    coded = a.where(hash32("coded", F.col("key")) % 10 > 0).select("key", (F.col("outcome") == "refusal").alias("refused"), "truncated")
    marked = a.where(hash32("persona", F.col("key")) % 20 == 0).select("key")
    rows = layers.with_flag(labelled.join(v.lists.drop("outcome", "truncated"), "key").join(coded, "key", "left"), marked, "persona")
    no = F.lit(False)
    return rows.select("key", "model", "query", "arm", "rep", "primary_set", F.coalesce("refused", no).alias("refused"), F.coalesce(F.col("language") == text.target(F.col("arm")), no).alias("valid"),
                       F.coalesce(F.col("language") == "mixed", no).alias("mixed"), F.coalesce("truncated", no).alias("truncated"), "persona", F.array_join("names", ",").alias("names"), F.array_join("names_order", ",").alias("names_order"))


@query("p2_j4_corpus_layer", f"""with dr as (select model, query, arm, rep, key, truncated, unnest(range(1, case when {h("'draw|' || key")} % 10 = 0 then 3 else 2 end)) as draw from answers),
ou as (select *, case when {h("'outcome|' || key || '|' || draw")} % 100 < 20 then 'degenerate' when {h("'outcome|' || key || '|' || draw")} % 100 < 25 then 'pending_extractor' else 'valid' end as outcome from dr),
f as (select model, query, arm, rep, max_by((key, outcome, truncated), draw) as l, min_by(outcome, draw) = 'degenerate' as degenerate_first from ou group by all),
u as (select key, case when {h("'tokens|' || key")} % 7 = 0 then null else {h("'tokens|' || key")} % 900 end as tokens from answers where {h("'used|' || key")} % 12 > 0)
select l[1] as key, model, query, arm, rep, l[2] as outcome, l[3] as truncated, degenerate_first, tokens::double as completion_tokens from f left join u on u.key = l[1] where l[2] <> 'pending_extractor'""")
def corpus_layer(v: View) -> DataFrame:
    """The final draw of each slot, terminally pending ones out, with its usage where there is a record."""
    n = F.when(hash32("draw", F.col("key")) % 10 == 0, 2).otherwise(1)
    hh = hash32("outcome", F.col("key"), F.col("draw")) % 100
    draws = v.answers.select(*layers.SLOT, "key", "truncated", F.explode(F.sequence(F.lit(1), n)).alias("draw")).withColumn(
        "outcome", F.when(hh < 20, "degenerate").when(hh < 25, "pending_extractor").otherwise("valid"))
    final = layers.final_draws(draws).where("outcome <> 'pending_extractor'")
    t = hash32("tokens", F.col("key"))
    usage = v.answers.where(hash32("used", F.col("key")) % 12 > 0).select("key", F.when(t % 7 != 0, t % 900).cast("double").alias("completion_tokens"))
    return final.join(usage, "key", "left").select("key", *layers.SLOT, "outcome", "truncated", F.col("first_degenerate").alias("degenerate_first"), "completion_tokens")


_EXCLUDED = "n % 9 = 0"


@query("p3_machine_layer", f"""with ok as (select key from answers where {h("'extraction|' || key")} % 15 > 0),
m as (select key, list(name order by place) filter (where split_part(name, '#', 2)::int % 9 > 0) as o, list(name order by place) as x from mentions group by key)
select a.key, model, query, arm, outcome in ('valid', 'reversion') as primary_set, outcome = 'refusal' as refused, outcome = 'valid' as valid, array_to_string(list_sort(coalesce(o, [])), ',') as names,
array_to_string(coalesce(o, []), ',') as names_order, array_to_string(list_sort(coalesce(x, [])), ',') as names_x from answers a join ok using (key) left join m using (key) where outcome in ('valid', 'reversion', 'refusal')""")
def machine_layer(v: View) -> DataFrame:
    """Answers with a valid extraction; excluded names leave the list and stay in names_x."""
    ok = v.answers.where(hash32("extraction", F.col("key")) % 15 > 0).where(F.col("outcome").isin("valid", "reversion", "refusal")).select("key")
    keep = F.substring_index("name", "#", -1).cast("int") % 9 > 0
    packed = v.mentions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "name", keep.alias("keep")))).alias("l"))
    lists = packed.select("key", F.transform("l", lambda x: x["name"]).alias("x"), F.transform(F.filter("l", lambda x: x["keep"]), lambda x: x["name"]).alias("o"))
    empty = F.array().cast("array<string>")
    rows = v.answers.join(ok, "key", "left_semi").join(lists, "key", "left").withColumns({"o": F.coalesce("o", empty), "x": F.coalesce("x", empty)})
    return rows.select("key", "model", "query", "arm", F.col("outcome").isin("valid", "reversion").alias("primary_set"), (F.col("outcome") == "refusal").alias("refused"), (F.col("outcome") == "valid").alias("valid"),
                       F.array_join(F.array_sort("o"), ",").alias("names"), F.array_join("o", ",").alias("names_order"), F.array_join(F.array_sort("x"), ",").alias("names_x"))


_FAMILIES = {"human": "outcome <> 'degenerate' and not truncated", "reversion": "arm in ('bn', 'bl') and outcome not in ('refusal', 'degenerate')", "coded": "outcome <> 'degenerate'"}


@query("p7_family_rows", " union all ".join(f"select '{f}' as family, model, count(*) as n from answers where {w} group by all" for f, w in _FAMILIES.items()))
def family_rows(v: View) -> DataFrame:
    """Rows that each family of tests analyses: one scan, a row goes to every family whose filter it passes."""
    a = v.answers
    fits = F.array_compact(F.array(*[F.when(F.expr(w), f) for f, w in _FAMILIES.items()]))
    return a.select("model", F.explode(fits).alias("family")).groupBy("family", "model").agg(F.count("*").alias("n"))


@query("p10_query_subsets", """with q as (select case when c_custkey % 11 = 0 then 'X' else 'Q' end || lpad(c_custkey::varchar, 3, '0') as id, case when c_custkey % 4 = 0 then ' yes ' when c_custkey % 4 = 1 then 'YES' when c_custkey % 4 = 2 then '' end as smoke from customer)
select id, coalesce(upper(trim(smoke)), '') = 'YES' as smoke from q where regexp_full_match(id, 'Q[0-9]{3}')""", with_study=False)
def query_subsets(v: View) -> DataFrame:
    """Final rows by the form of their id, and flags that are YES in any case and spacing."""
    k = F.col("c_custkey")
    q = v.table("customer").select(F.concat(F.when(k % 11 == 0, "X").otherwise("Q"), F.when(F.length(k.cast("string")) < 3, F.lpad(k.cast("string"), 3, "0")).otherwise(F.substring(k.cast("string"), 1, 3))).alias("id"),
                                   F.when(k % 4 == 0, " yes ").when(k % 4 == 1, "YES").when(k % 4 == 2, "").alias("smoke"))
    return q.where(F.col("id").rlike("^Q[0-9]{3}$")).select("id", (F.coalesce(F.upper(F.trim("smoke")), F.lit("")) == "YES").alias("smoke"))


@query("p11_p12_item_classes", """with r as (select s_name as name, case when s_suppkey % 3 = 0 then 'local' when s_suppkey % 3 = 1 then 'global' end as class from supplier where s_suppkey % 5 > 0),
b as (select s_name as name, 'ambiguous' as class from supplier where s_suppkey % 5 <> 1)
select key, retailer, r.class as strict_class, case when r.name is not null then r.class else b.class end as class from retailers left join r on r.name = retailer left join b on b.name = retailer""")
def item_classes(v: View) -> DataFrame:
    """Retailers with their class, of the retailer table where they stand in it, else of the brand table; strictly, of the former only."""
    k, s = F.col("s_suppkey"), v.table("supplier")
    r = s.where(k % 5 > 0).select(F.col("s_name").alias("retailer"), F.lit(True).alias("known"), F.when(k % 3 == 0, "local").when(k % 3 == 1, "global").alias("strict_class"))
    b = s.where(k % 5 != 1).select(F.col("s_name").alias("retailer"), F.lit("ambiguous").alias("brand_class"))
    return v.retailers.join(r, "retailer", "left").join(b, "retailer", "left").select("key", "retailer", "strict_class", F.when(F.col("known"), F.col("strict_class")).otherwise(F.col("brand_class")).alias("class"))


@query("p12_excluded_as_class", """with x as (select key, count(*) filter (where class = 'local') as l, count(*) filter (where class = 'global') as g, count(*) filter (where class is null) as e from mentions left join classes using (name) group by key)
select key, l + e as n_local_more, g + e as n_global_more from x""")
def excluded_as_class(v: View) -> DataFrame:
    """Names of no class counted once as local and once as global: the bounds of the shares."""
    c = v.mentions.join(v.classes, "name", "left")
    n = lambda cls: F.count_if(F.coalesce("class", F.lit(cls)) == cls)
    return c.groupBy("key").agg(n("local").alias("n_local_more"), n("global").alias("n_global_more"))


@query("p14_with_outcome", f"""select key, case when {h("'flip|' || key")} % 6 = 0 then case when outcome = 'valid' then 'refusal' else 'valid' end else outcome end as outcome, truncated from answers""")
def with_outcome(v: View) -> DataFrame:
    """The analysed outcome replaced where a simulation says so, all else kept."""
    flip = hash32("flip", F.col("key")) % 6 == 0
    return v.answers.withColumn("outcome", F.when(flip, F.when(F.col("outcome") == "valid", "refusal").otherwise("valid")).otherwise(F.col("outcome"))).select("key", "outcome", "truncated")


_LABEL = "brands array<string>, prices array<string>, refused string"


@query("p19_p21_p23_typed_labels", """with p as (select l_orderkey as key, list(round(l_extendedprice)::bigint * (l_partkey % 6 > 0)::int) as amounts, count(*) filter (where l_partkey % 6 = 0) as zeros, count(*) as n, sum(round(l_extendedprice)::bigint * (l_partkey % 6 > 0)::int)::double as total from lineitem group by all)
select key, n, zeros as zero_price_entries, total, key % 3 = 0 as refused from p""")
def typed_labels(v: View) -> DataFrame:
    """Labels as raters export them (strings in JSON), read back as typed rows: prices as pairs, flags as booleans."""
    line = F.concat((F.round("l_extendedprice").cast("long") * (F.col("l_partkey") % 6 > 0).cast("int")).cast("string"), F.lit(" BDT"))
    packed = v.table("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(line).alias("prices"))
    raw = packed.select("key", F.to_json(F.struct("prices", F.when(F.col("key") % 3 == 0, "true").otherwise("false").alias("refused"))).alias("raw"))
    row = raw.select("key", F.from_json("raw", _LABEL).alias("l")).select("key", F.transform("l.prices", text.price).alias("p"), (F.col("l.refused") == "true").alias("refused"))
    return row.select("key", F.size("p").cast("long").alias("n"), F.size(F.filter("p", lambda x: x["amount"] == 0)).cast("long").alias("zero_price_entries"),
                      F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["amount"]).alias("total"), "refused")


@query("p20_extraction_rows", f"""select key, {h("'schema|' || key")} % 8 > 0 as valid, case when {h("'schema|' || key")} % 8 > 0 then coalesce(n, 0) > 0 end as has_content from answers left join (select key, count(*) as n from mentions where place < 2 group by key) using (key)""")
def extraction_rows(v: View) -> DataFrame:
    """Extractions as typed rows: valid if the schema found no error, and whether they name anything."""
    raw = v.answers.select("key", F.when(hash32("schema", F.col("key")) % 8 == 0, F.array(F.lit("refused: not a boolean"))).alias("schema_errors"))
    named = v.mentions.where("place < 2").select("key").distinct()
    rows = layers.with_flag(raw.withColumn("valid", F.col("schema_errors").isNull()), named, "names")
    return rows.select("key", "valid", F.when(F.col("valid"), F.col("names")).alias("has_content"))


@query("p24_cue_split", f"""with {COUNTED}, g as (select *, case when query in ('CHINA', 'INDIA', 'JAPAN') then 'cue' when query like 'U%' then 'place' else 'none' end as cue from counted where n_local + n_global > 0),
c as (select model, query, arm, cue, avg(n_local / (n_local + n_global)) as v from g group by all) select model, arm, cue, round(avg(v), 6) as share, count(*) as n_queries from c group by all""")
def cue_split(v: View) -> DataFrame:
    cue = F.when(F.col("query").isin("CHINA", "INDIA", "JAPAN"), "cue").when(F.col("query").startswith("U"), "place").otherwise("none")
    cells = estimate.cell_means(v.counted().withColumn("cue", cue), estimate.local_share(), ("model", "query", "arm", "cue"))
    return rounded(cells.groupBy("model", "arm", "cue").agg(F.avg("v").alias("share"), F.count("*").alias("n_queries")), "share")


# ------------------------------------------------------------------------------------------------- joins
@query("j9_label_branches", f"""with m as (select key, {h("'overlap|' || key")} % 10 = 0 as overlap, {_among_sql('rater', study.RATERS)} as rater from answers),
l as (select distinct key, rater from raters) select m.key, overlap, count(l.rater) as n_labels, count(l.rater) filter (where not overlap and l.rater <> m.rater) as n_foreign,
bool_or(l.rater = m.rater) is true as own from m left join l using (key) group by all""")
def label_branches(v: View) -> DataFrame:
    """Each item of a mapping with the labels its branch calls for: all raters' in the overlap, else its own rater's; others are foreign."""
    m = v.answers.select("key", (hash32("overlap", F.col("key")) % 10 == 0).alias("overlap"), _among("rater", study.RATERS).alias("own_rater"))
    j = m.join(v.raters.select("key", "rater").distinct(), "key", "left")
    same = F.col("rater") == F.col("own_rater")
    return j.groupBy("key", "overlap").agg(F.count("rater").alias("n_labels"), F.count_if(~F.col("overlap") & ~same).alias("n_foreign"), F.coalesce(F.bool_or(same), F.lit(False)).alias("own"))


@query("j10_j11_scored_subset", f"""with c as (select key from answers where {h("'pid|' || key")} % 3 = 0), p as (select key, outcome as a from answers where {h("'primary|' || key")} % 7 > 0),
x as (select key, case when {h("'cross|' || key")} % 9 = 0 then 'other' else outcome end as b from answers where {h("'cross|' || key")} % 6 > 0)
select count(*) as items, count(*) filter (where a is null) as missing, count(*) filter (where a is not null and b is not null) as both_valid, count(*) filter (where a = b) as agree from c left join p using (key) left join x using (key)""")
def scored_subset(v: View) -> DataFrame:
    """Items of a consensus against a machine's rows, missing ones counted, and a second machine on those that both have."""
    a = v.answers
    c = a.where(hash32("pid", F.col("key")) % 3 == 0).select("key")
    p = a.where(hash32("primary", F.col("key")) % 7 > 0).select("key", F.col("outcome").alias("a"))
    x = a.where(hash32("cross", F.col("key")) % 6 > 0).select("key", F.when(hash32("cross", F.col("key")) % 9 == 0, "other").otherwise(F.col("outcome")).alias("b"))
    j = c.join(p, "key", "left").join(x, "key", "left")
    return j.agg(F.count("*").alias("items"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_valid"), F.count_if(F.col("a") == F.col("b")).alias("agree"))


@query("j13_a41_common_support", """with n as (select key, rater as version, name from raters union all select key, 'consensus', name from (select key, name from raters group by all having count(*) >= 2)),
s as (select model, query, arm, version, count(*) filter (where class = 'local') / count(*) as v from n join classes using (name) join answers using (key) where class in ('local', 'global') and arm in ('en', 'bn') group by model, query, arm, version),
w as (select model, query, version, max(v) filter (where arm = 'bn') - max(v) filter (where arm = 'en') as d from s group by all), c as (select model, query from w where d is not null group by all having count(*) = 4)
select model, version, round(avg(d), 6) as estimate, count(*) as n from w join c using (model, query) group by all""")
def common_support(v: View) -> DataFrame:
    """Contrasts by each rater and by their consensus, over the queries where all versions are defined in both arms."""
    named = v.raters.select("key", F.col("rater").alias("version"), "name")
    agreed = v.raters.groupBy("key", "name").agg(F.count("*").alias("k")).where("k >= 2").select("key", F.lit("consensus").alias("version"), "name")
    rows = named.unionByName(agreed).join(v.classes.where("class in ('local', 'global')"), "name").join(v.answers.where("arm in ('en', 'bn')").select("key", "model", "query", "arm"), "key")
    local = lambda arm: F.count_if((F.col("arm") == arm) & (F.col("class") == "local")) / F.nullif(F.count_if(F.col("arm") == arm), F.lit(0))
    d = rows.groupBy("model", "query", "version").agg((local("bn") - local("en")).alias("d")).where("d is not null")
    common = d.withColumn("k", F.count("*").over(Window.partitionBy("model", "query"))).where(F.col("k") == len(study.RATERS) + 1)
    return rounded(common.groupBy("model", "version").agg(F.avg("d").alias("estimate"), F.count("*").alias("n")), "estimate")


@query("j19_prefill_check", """with p as (select distinct name from mentions where split_part(name, '#', 2)::int % 2 = 0), c as (select name from classes where class <> 'local')
select coalesce(p.name, c.name) as name, case when c.name is null then 'prefill only' else 'candidate only' end as problem from p full join c using (name) where p.name is null or c.name is null""")
def prefill_check(v: View) -> DataFrame:
    """What only one of two lists that must agree has."""
    p = v.mentions.select("name").distinct().where(F.substring_index("name", "#", -1).cast("int") % 2 == 0).withColumn("p", F.lit(True))
    c = v.classes.where("class <> 'local'").select("name", F.lit(True).alias("c"))
    return p.join(c, "name", "full").where("p is null or c is null").select("name", F.when(F.col("c").isNull(), "prefill only").otherwise("candidate only").alias("problem"))


@query("j23_traced_prices", f"""with t as (select key, amount, currency, count(*) as entries from prices where currency <> 'unstated' group by all),
raw as (select key, round(amount)::bigint as whole, count(*) as lines from prices group by all)
select t.key, t.amount, t.currency, entries, lines from t join raw on raw.key = t.key and raw.whole = round(t.amount)::bigint join answers a on a.key = t.key where {h("'overlap|' || a.key")} % 10 = 0""")
def traced_prices(v: View) -> DataFrame:
    """Price entries of the items that several raters labelled, with the raw lines that show the amount."""
    kept = v.answers.where(hash32("overlap", F.col("key")) % 10 == 0).select("key")
    p = v.prices.join(kept, "key", "left_semi")
    t = p.where("currency <> 'unstated'").groupBy("key", "amount", "currency").agg(F.count("*").alias("entries")).withColumn("whole", F.round("amount").cast("long"))
    raw = p.groupBy("key", F.round("amount").cast("long").alias("whole")).agg(F.count("*").alias("lines"))
    return t.join(raw, ["key", "whole"]).select("key", "amount", "currency", "entries", "lines")


# -------------------------------------------------------------------------------------------- aggregates
@query("a14_plan_cost", f"""with todo as (select model from answers where {h("'cached|' || key")} % 4 > 0), m as (select model, avg({h("'in|' || key")} % 500)::double as pt, avg({h("'out|' || key")} % 900)::double as ct from answers where {h("'cached|' || key")} % 4 = 0 and model not like '1%' group by model),
n as (select model, count(*) as calls from todo group by model) select model, calls, round(coalesce(pt, 120) * calls, 4) as in_tokens, round(coalesce(ct, 700) * calls, 4) as out_tokens, case when pt is null then 'assumed' else 'measured' end as basis,
round((coalesce(pt, 120) * calls * case when model like '5%' then 0 else 1.5 end + coalesce(ct, 700) * calls * case when model like '5%' then 0 else 6.0 end) / 1e6, 6) as usd from n left join m using (model)""")
def plan_cost(v: View) -> DataFrame:
    """Cost of the calls that a plan still needs: by measured means of tokens, else assumed ones; a model without a price costs 0."""
    a, cached = v.answers, hash32("cached", F.col("key")) % 4 == 0
    means = a.where(cached & ~F.col("model").startswith("1")).groupBy("model").agg(F.avg(hash32("in", F.col("key")) % 500).alias("pt"), F.avg(hash32("out", F.col("key")) % 900).alias("ct"))
    n = a.where(~cached).groupBy("model").agg(F.count("*").alias("calls")).join(means, "model", "left")
    pt, ct = F.coalesce("pt", F.lit(120.0)) * F.col("calls"), F.coalesce("ct", F.lit(700.0)) * F.col("calls")
    priced = ~F.col("model").startswith("5")
    usd = (pt * F.when(priced, 1.5).otherwise(0.0) + ct * F.when(priced, 6.0).otherwise(0.0)) / 1e6
    return n.select("model", "calls", F.round(pt, 4).alias("in_tokens"), F.round(ct, 4).alias("out_tokens"), F.when(F.col("pt").isNull(), "assumed").otherwise("measured").alias("basis"), F.round(usd, 6).alias("usd"))


@query("a24_gates", f"""with f as (select rater, count(*) as n, avg(place)::double as score from raters group by rater) select rater, round(score, 6) as score, n >= 1000 as covered, score >= 2 as passes, row_number() over (order by score desc, rater) = 1 as best from f""")
def gates(v: View) -> DataFrame:
    """A decision for each of a few candidates: coverage, threshold, and which is best (ties by name)."""
    f = v.raters.groupBy("rater").agg(F.count("*").alias("n"), F.avg("place").alias("score"))
    best = f.agg(F.min(F.struct((-F.col("score")).alias("s"), "rater"))["rater"].alias("top"))
    return f.crossJoin(F.broadcast(best)).select("rater", F.round("score", 6).alias("score"), (F.col("n") >= 1000).alias("covered"), (F.col("score") >= 2).alias("passes"), (F.col("rater") == F.col("top")).alias("best"))


_VENDORS = [("license", "(?i)licen[sc]e"), ("number", "[0-9]{12,}"), ("mail", "@[a-z]+")]


@query("a28_persona_marks", """with m as (select source, lang, case when regexp_matches(text, '(?i)licen[sc]e') then 'license' when regexp_matches(text, '[0-9]{12,}') then 'number' when regexp_matches(text, '@[a-z]+') then 'mail' when regexp_matches(text, '[|]') then 'generic' end as mark,
regexp_matches(text, '(?i)licen[sc]e')::int + regexp_matches(text, '[0-9]{12,}')::int + regexp_matches(text, '@[a-z]+')::int > 1 as several from documents)
select source, lang, mark, count(*) as n, count(*) filter (where several) as n_several from m where mark is not null group by all""", with_study=False)
def persona_marks(v: View) -> DataFrame:
    """Texts that name a vendor, or speak of themselves, by source, language and mark; and those that name several."""
    t = F.col("text")
    hits = sum((F.coalesce(t.rlike(p), F.lit(False)).cast("int") for _, p in _VENDORS), F.lit(0))
    m = v.table("documents").select("source", "lang", text.persona(t, _VENDORS, "[|]").alias("mark"), (hits > 1).alias("several")).where("mark is not null")
    return m.groupBy("source", "lang", "mark").agg(F.count("*").alias("n"), F.count_if("several").alias("n_several"))


@query("a31_audit_checks", """select 'answers' as item, (select count(*) from orders) = (select count(*) from answers) as ok union all select 'arms', (select count(distinct arm) from answers) = 3
union all select 'classed names', (select count(*) from classes) = 23 union all select 'no empty name', (select count(*) from mentions where name = '') = 0 union all select 'unique keys', (select count(*) from answers) = (select count(distinct key) from answers)""")
def audit_checks(v: View) -> DataFrame:
    """A checklist of facts that must hold, each one aggregate."""
    a = v.answers.agg(F.count("*").alias("n"), F.count_distinct("arm").alias("arms"), F.count_distinct("key").alias("keys"))
    one = (a.crossJoin(v.table("orders").agg(F.count("*").alias("orders"))).crossJoin(v.classes.agg(F.count("*").alias("classes")))
           .crossJoin(v.mentions.agg(F.count_if(F.col("name") == "").alias("blank"))))  # one row each
    checks = {"answers": F.col("orders") == F.col("n"), "arms": F.col("arms") == 3, "classed names": F.col("classes") == 23, "no empty name": F.col("blank") == 0, "unique keys": F.col("n") == F.col("keys")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), c.alias("ok")) for k, c in checks.items()])).alias("x")).select("x.item", "x.ok")


@query("a37_extraction_health", """select event_type, case when event_id % 9 = 0 then 'prices[i]: not a number' when event_id % 9 = 1 then 'refused: not a boolean' when event_id % 9 = 2 then 'brands[i]: empty' else 'ok' end as message, count(*) as n from events group by all""", with_study=False)
def extraction_health(v: View) -> DataFrame:
    """Failure messages by kind, with the places in them made one."""
    i = F.col("event_id")
    message = F.when(i % 9 == 0, F.format_string("prices[%d]: not a number", i % 40)).when(i % 9 == 1, "refused: not a boolean").when(i % 9 == 2, F.format_string("brands[%d]: empty", i)).otherwise("ok")
    return v.table("events").select("event_type", F.regexp_replace(message, r"\[\d+\]", "[i]").alias("message")).groupBy("event_type", "message").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------------- orders, sets and text
@query("o2_sorted_prices", """select key, array_to_string(list(currency || ' ' || round(amount)::bigint order by currency, round(amount)::bigint), '|') as entries from prices group by key""")
def sorted_prices(v: View) -> DataFrame:
    e = F.array_sort(F.collect_list(F.struct("currency", F.round("amount").cast("long").alias("a"))))
    return v.prices.groupBy("key").agg(F.array_join(F.transform(e, lambda x: F.concat_ws(" ", x["currency"], x["a"].cast("string"))), "|").alias("entries"))


@query("o6_call_order", """select key, model, md5('order|17|' || key) as place, row_number() over (partition by model order by md5('order|17|' || key)) as turn from answers where rep <= 3""")
def call_order(v: View) -> DataFrame:
    """Planned calls in an order drawn by a seed, models interleaved by their turns."""
    place = F.md5(F.concat(F.lit("order|17|"), F.col("key").cast("string")))
    rows = v.answers.where("rep <= 3").select("key", "model", place.alias("place"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("model").orderBy("place")))


@query("u4_set_equality", """select rater, (select count(*) from (select key from answers except select key from raters r where r.rater = x.rater)) as missing, 0::bigint as foreign_keys from (select unnest(['R1', 'R2', 'R3']) as rater) x""")
def set_equality(v: View) -> DataFrame:
    """Keys that a rater lacks, and keys that are no answers: both must be none for equal sets."""
    have = v.raters.select("rater", "key").distinct()
    keys = v.answers.select("key")
    all_ = keys.crossJoin(F.broadcast(v.spark.createDataFrame([(r,) for r in study.RATERS], "rater string")))
    missing = all_.join(have, ["rater", "key"], "left_anti").groupBy("rater").agg(F.count("*").alias("missing"))
    foreign = have.join(keys, "key", "left_anti").groupBy("rater").agg(F.count("*").alias("foreign_keys"))
    every = v.spark.createDataFrame([(r,) for r in study.RATERS], "rater string")
    return every.join(missing, "rater", "left").join(foreign, "rater", "left").na.fill(0)


@query("t18_t21_text_checks", """select doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?'), ' ') as numbers, regexp_matches(text, '[0-9],[0-9]') as thousands, not regexp_matches(text, '[?]\\s*$') as no_question,
len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '[^\\s]'))) > 2 as long_text, regexp_matches(lower(text), '(^|[^a-z])best([^a-z]|$)') as superlative from documents""", with_study=False)
def text_checks(v: View) -> DataFrame:
    """Automatic checks of a text: its numbers, thousands separators, question mark, sentences, superlatives."""
    t = F.col("text")
    sentences = F.filter(F.split(t, "[.!?]+"), lambda x: x.rlike(r"[^\s]"))
    return v.table("documents").select("doc_id", F.array_join(F.regexp_extract_all(t, F.lit(r"([0-9]+(?:[.][0-9]+)?)"), 1), " ").alias("numbers"), t.rlike("[0-9],[0-9]").alias("thousands"),
                                       (~t.rlike(r"[?]\s*\z")).alias("no_question"), (F.size(sentences) > 2).alias("long_text"), F.lower(t).rlike("(^|[^a-z])best([^a-z]|$)").alias("superlative"))


@query("n4_metadata", """select event_id, event_type as model, case when event_id % 3 = 0 then 'fp' || event_id % 5 end as fingerprint, 'stop' as finish_reason from events""", with_study=False)
def metadata(v: View) -> DataFrame:
    """First choice, model and any field that is called some kind of fingerprint, of a response as JSON."""
    i = F.col("event_id")
    raw = F.concat(F.lit('{"model": "'), F.col("event_type"), F.lit('", '), F.when(i % 3 == 0, F.concat(F.lit('"system_fingerprint": "fp'), i % 5, F.lit('", '))).otherwise(""),
                   F.lit('"choices": [{"finish_reason": "stop"}, {"finish_reason": "length"}]}'))
    r = v.table("events").select("event_id", raw.alias("raw"))
    fields = F.from_json("raw", "map<string, string>")
    mark = F.element_at(F.map_values(F.map_filter(fields, lambda k, _: k.contains("fingerprint"))), 1)
    return r.select("event_id", F.get_json_object("raw", "$.model").alias("model"), F.when(F.size(F.map_filter(fields, lambda k, _: k.contains("fingerprint"))) > 0, mark).alias("fingerprint"),
                    F.get_json_object("raw", "$.choices[0].finish_reason").alias("finish_reason"))


@query("n7_export_errors", """select s_suppkey, concat_ws(',', case when s_suppkey % 7 = 0 then 'answer_language' end, case when s_suppkey % 5 = 0 then 'prices' end, case when s_suppkey % 3 = 0 then 'recommended' end) as errors from supplier""", with_study=False)
def export_errors(v: View) -> DataFrame:
    """What is wrong with exported labels: values outside their list, lines that are no prices, recommendations that are no brands (in any case)."""
    k = F.col("s_suppkey")
    label = v.table("supplier").select("s_suppkey", F.when(k % 7 == 0, "xx").otherwise("en").alias("answer_language"), F.array(F.lit("500 tk"), F.when(k % 5 == 0, "5,00 tk").otherwise("7 euro")).alias("prices"),
                                       F.array(F.col("s_name")).alias("brands"), F.array(F.when(k % 3 == 0, "nobody").otherwise(F.upper("s_name"))).alias("recommended"))
    known = F.transform("brands", lambda x: F.lower(F.trim(x)))
    return label.select("s_suppkey", F.concat_ws(",",
        F.when(~F.col("answer_language").isin("en", "bn", "banglish", "mixed", "other"), "answer_language"), F.when(F.exists("prices", lambda x: text.price(x).isNull()), "prices"),
        F.when(F.exists("recommended", lambda x: ~F.array_contains(known, F.lower(F.trim(x)))), "recommended")).alias("errors"))


# ------------------------------------------------------------------------- agreement and name decisions
@query("g6_code_accuracy", f"""with x as (select arm, outcome, {_among_sql('language', _LANGUAGES)} as lang, {h("'refused|' || key")} % 10 = 0 as refused from answers where {h("'pid|' || key")} % 3 = 0),
c as (select outcome, case when refused then 'refusal' when lang is null then 'no-majority' when lang = {_TARGET} then 'valid' else 'reversion' end as human from x)
select human, count(*) as n, count(*) filter (where outcome = human) as agree, round(count(*) filter (where outcome = human) / count(*), 6) as recall from c where human <> 'no-majority' group by all""")
def code_accuracy(v: View) -> DataFrame:
    """Machine codes against the human code of labelled items: refusal, else valid if the language is the arm's target."""
    x = v.answers.where(hash32("pid", F.col("key")) % 3 == 0).select("arm", "outcome", _among("language", _LANGUAGES).alias("lang"), (hash32("refused", F.col("key")) % 10 == 0).alias("refused"))
    human = F.when(F.col("refused"), "refusal").when(F.col("lang").isNull(), "no-majority").when(F.col("lang") == text.target(F.col("arm")), "valid").otherwise("reversion")
    c = x.withColumn("human", human).where("human <> 'no-majority'").groupBy("human").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == F.col("human")).alias("agree"))
    return rounded(c.withColumn("recall", F.col("agree") / F.col("n")), "recall")


@query("g8_cut_validation", f"""with x as (select {h("'ratio|' || key")} % 1001 / 1000 as r, {_among_sql('language', _LANGUAGES)} as lang from answers), c as (select *, case when r >= 0.6 then 'bn' when r <= 0.2 then 'latin' else 'mixed' end as script from x)
select script, count(*) as n, count(*) filter (where lang = 'bn') as judged_bn, count(*) filter (where lang in ('en', 'banglish')) as judged_latin, round(min(r) filter (where lang = 'bn'), 6) as least_bn, round(max(r) filter (where lang in ('en', 'banglish')), 6) as most_latin from c group by all""")
def cut_validation(v: View) -> DataFrame:
    """Script classes against judged languages, and the ratios that bracket the cuts."""
    x = v.answers.select((hash32("ratio", F.col("key")) % 1001 / 1000).alias("r"), _among("language", _LANGUAGES).alias("lang")).withColumn("script", text.script_class(F.col("r")))
    bn, latin = F.col("lang") == "bn", F.col("lang").isin("en", "banglish")
    out = x.groupBy("script").agg(F.count("*").alias("n"), F.count_if(bn).alias("judged_bn"), F.count_if(latin).alias("judged_latin"), F.min(F.when(bn, F.col("r"))).alias("least_bn"), F.max(F.when(latin, F.col("r"))).alias("most_latin"))
    return rounded(out, "least_bn", "most_latin")


@query("e5_e8_confirmed_classes", f"""with r as (select name, class as draft, case when {h("'a|' || name")} % 5 = 0 then 'ambiguous' else class end as a, case when {h("'b|' || name")} % 6 = 0 then 'local' when {h("'b|' || name")} % 6 = 1 then null else class end as b from classes)
select name, draft, a, b, coalesce(a = draft and b = draft, false) as confirmed, case when b is null then 'not returned' when a <> b then 'conflict' end as problem from r""")
def confirmed_classes(v: View) -> DataFrame:
    """A drafted table against two returned sheets: confirmed by both, or the conflict, or what did not come back."""
    draft = v.classes.select("name", F.col("class").alias("draft"))
    hh = lambda x: hash32(x, F.col("name"))
    a = draft.select("name", F.when(hh("a") % 5 == 0, "ambiguous").otherwise(F.col("draft")).alias("a"))
    b = draft.where(hh("b") % 6 != 1).select("name", F.when(hh("b") % 6 == 0, "local").otherwise(F.col("draft")).alias("b"))
    j = draft.join(a, "name", "left").join(b, "name", "left")
    both = (F.col("a") == F.col("draft")) & (F.col("b") == F.col("draft"))
    return j.select("name", "draft", "a", "b", F.coalesce(both, F.lit(False)).alias("confirmed"), F.when(F.col("b").isNull(), "not returned").when(F.col("a") != F.col("b"), "conflict").alias("problem"))


# ------------------------------------------------------------------------------- sources and sinks, there and back
def _home(v: View) -> str:
    base = v.spark.conf.get("spark.checkpoint.dir", None) or v.spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


@query("s1_k1_csv", "select s_suppkey::varchar as s_suppkey, s_name from supplier", with_study=False)
def csv_round_trip(v: View) -> DataFrame:
    """A table written as CSV and read back: strings in the columns asked for."""
    home = _home(v)
    sinks.write_csv(v.table("supplier"), home, ["s_suppkey", "s_name"])
    return readers.read_csv(v.spark, home, ["s_suppkey", "s_name"])


@query("s2_k2_jsonl", "select s_suppkey, s_name, s_nationkey from supplier", with_study=False)
def jsonl_round_trip(v: View) -> DataFrame:
    """A table written as JSON lines, ordered by key, and read back with its types."""
    home = _home(v)
    sinks.write_jsonl(v.table("supplier").select("s_suppkey", "s_name", "s_nationkey"), home, "s_suppkey")
    return readers.read_jsonl(v.spark, home, "s_suppkey bigint, s_name string, s_nationkey int")


@query("s7_key_problems", """with k as (select s_suppkey as key from supplier union all select s_suppkey from supplier where s_suppkey % 7 = 0 union all select -s_suppkey from supplier where s_suppkey % 10 = 0)
select key, 'repeated' as problem from k group by key having count(*) > 1 union all select distinct key, 'unknown' from k where key < 0""", with_study=False)
def key_problems(v: View) -> DataFrame:
    s = v.table("supplier").select(F.col("s_suppkey").alias("key"))
    return readers.check_keys(s.unionByName(s.where("key % 7 = 0")).unionByName(s.where("key % 10 = 0").select((-F.col("key")).alias("key"))), s)


@query("j20_open_work", f"""select key, model from answers where {h("'done|' || key")} % 3 > 0""")
def open_work(v: View) -> DataFrame:
    """Planned calls without a result: what a resumed run does."""
    plan = v.answers.select("key", "model")
    return sinks.open_work(plan, plan.where(hash32("done", F.col("key")) % 3 == 0), ["key"])


@query("k9_redacted", "select event_id, event_type, 'REDACTED' as secret from events", with_study=False)
def redacted(v: View) -> DataFrame:
    r = v.table("events").select("event_id", F.struct("event_type", F.col("props").alias("secret")).alias("meta"))
    return sinks.redacted(r, "meta", ("secret",)).select("event_id", "meta.event_type", "meta.secret")


# ------------------------------------------------------------------------------- ledger order, price strings, answers' tags, tails
@query("o7_ledger_order", """with u as (select model, case when year(asked_at) < 1998 then 'early' else 'late' end as phase, %s %% 4000 as tokens_out from answers),
t as (select phase, model, sum(tokens_out)::bigint as tokens_out from u group by all)
select phase, model, tokens_out, row_number() over (partition by phase order by tokens_out desc, model) as place from t""" % h("'out|' || key"))
def ledger_order(v: View) -> DataFrame:
    """Models of a phase from the most output tokens down; the window stands over a row a phase and model."""
    phase = F.when(F.year("asked_at") < 1998, "early").otherwise("late").alias("phase")
    t = v.answers.select("model", phase, (hash32("out", F.col("key")) % 4000).alias("n")).groupBy("phase", "model").agg(F.sum("n").alias("tokens_out"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("tokens_out"), "model")))


@query("t15_serialised_prices", """select key, currency, amount::double as amount, row_number() over (partition by key order by currency, amount) as place
from prices where amount is not null and currency is not null""")
def serialised_prices(v: View) -> DataFrame:
    """Prices that were written as strings, read again and put in order of currency and amount within their answer."""
    written = F.concat(F.lit("("), F.col("amount").cast("decimal(18,2)").cast("string"), F.lit(", '"), F.col("currency"), F.lit("')"))
    lists = v.prices.where("amount is not null and currency is not null").groupBy("key").agg(F.collect_list(written).alias("s"))
    ordered = lists.select("key", F.posexplode(F.array_sort(F.transform("s", text.serialised_price))).alias("i", "p"))
    return ordered.select("key", "p.currency", "p.amount", (F.col("i") + 1).alias("place"))


#: What a tag adds to an answer's gain while nothing is covered, and what its model adds.
_TAG_GAIN = {"en": 1, "bn": 1, "bl": 2, "price_bdt": 3, "price_usd": 4, "retailers": 2, "many_brands": 1, "no_commercial": 2}
_MODEL_GAIN = 6
_TAG_GAIN_SQL = f"map {_TAG_GAIN}"


@query("a25_feature_tags", f"""with p as (select key, bool_or(currency = 'BDT') as bdt, bool_or(currency = 'USD') as usd, count(*) as n_prices from prices group by key),
r as (select key, count(*) as n_retailers from retailers group by key), l as (select key, len(names) as n_names from lists),
t as (select a.key, list_filter([arm, case when bdt then 'price_bdt' end, case when usd then 'price_usd' end, case when n_retailers > 0 then 'retailers' end,
case when n_names >= 4 then 'many_brands' end, case when coalesce(n_names, 0) + coalesce(n_prices, 0) + coalesce(n_retailers, 0) = 0 then 'no_commercial' end], lambda x: x is not null) as tags
from answers a left join p using (key) left join r using (key) left join l using (key))
select key, array_to_string(list_sort(tags), ',') as tags, ({_MODEL_GAIN} + list_sum(list_transform(tags, lambda x: coalesce({_TAG_GAIN_SQL}[x], 0))))::bigint as gain from t""")
def feature_tags(v: View) -> DataFrame:
    """Each answer's tags and its gain for a practice set in which nothing is covered yet."""
    p = v.prices.groupBy("key").agg(F.bool_or(F.col("currency") == "BDT").alias("bdt"), F.bool_or(F.col("currency") == "USD").alias("usd"), F.count("*").alias("n_prices"))
    r = v.retailers.groupBy("key").agg(F.count("*").alias("n_retailers"))
    rows = v.answers.select("key", "arm").join(p, "key", "left").join(r, "key", "left").join(v.lists.select("key", F.size("names").alias("n_names")), "key", "left")
    said = F.coalesce("n_names", F.lit(0)) + F.coalesce("n_prices", F.lit(0)) + F.coalesce("n_retailers", F.lit(0))
    marks = {"price_bdt": F.col("bdt"), "price_usd": F.col("usd"), "retailers": F.col("n_retailers") > 0, "many_brands": F.col("n_names") >= 4, "no_commercial": said == 0}
    tags = F.array_sort(F.array_compact(F.array(F.col("arm"), *[F.when(on, tag) for tag, on in marks.items()])))
    worth = F.create_map(*[F.lit(x) for pair in _TAG_GAIN.items() for x in pair])
    gain = F.aggregate("tags", F.lit(_MODEL_GAIN).cast("long"), lambda n, t: n + F.coalesce(worth[t], F.lit(0)))
    return rows.select("key", tags.alias("tags")).select("key", F.array_join("tags", ",").alias("tags"), gain.alias("gain"))


_SAMPLE, _BOUNDARY = 200, 120


@query("g9_position_tail", f"""with s as (select model, outcome, row_number() over (partition by model order by {h("'position|' || key")}, key) as position from answers qualify position <= {_SAMPLE}),
d as (select model, count(*) filter (where outcome <> 'valid') as n, count(*) filter (where outcome <> 'valid' and position <= {_BOUNDARY}) as k, least({_BOUNDARY}, count(*)) / count(*) as p from s group by model),
i as (select *, unnest(range(0, k + 1)) as i from d)
select model, n, k, round(case when max(k) >= max(n) then 1.0 else sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))) end, 6) as tail from i group by model, n, k""")
def position_tail(v: View) -> DataFrame:
    """Of a checked sample of answers a model: do few of its deviations stand before the boundary? P(X <= k) of n at the boundary's share.

    The sample's size is the feature; the sum's terms follow from one another, in logarithms, so that none underflows at the start.
    """
    order = Window.partitionBy("model").orderBy(hash32("position", F.col("key")), "key")
    s = v.answers.select("model", "key", "outcome", F.row_number().over(order).alias("position")).where(F.col("position") <= _SAMPLE)
    off = F.col("outcome") != "valid"
    d = s.groupBy("model").agg(F.count_if(off).alias("n"), F.count_if(off & (F.col("position") <= _BOUNDARY)).alias("k"), (F.least(F.lit(_BOUNDARY), F.count("*")) / F.count("*")).alias("p"))
    n, p, zero = F.col("n"), F.col("p"), F.lit(0.0)
    start = F.struct(zero.alias("sum"), (n * F.log(1 - p)).alias("term"))
    step = lambda a, i: F.struct((a["sum"] + F.exp(a["term"])).alias("sum"), (a["term"] + F.log((n - i) / (i + 1)) + F.log(p / (1 - p))).alias("term"))
    tail = F.aggregate(F.sequence(F.lit(0), F.col("k").cast("int")), start, step)["sum"]
    return d.select("model", "n", "k", F.round(F.when(F.col("k") >= n, 1.0).otherwise(tail), 6).alias("tail"))
