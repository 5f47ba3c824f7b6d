"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import free_name, guarded, materialise, quoted

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more than this many times.
MAX_RATE = 3
#: Bits of md5 that make the draw.
DRAW_HEX = 13


def word_count(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Targets by source from rows (source, size): source, source_size, target.

    All sizes are shared by weight; a target stops at max_rate times its source's size and the
    excess is reshared by weight until none is above. That is water filling: a source is capped
    if, with all sources of a smaller or equal cap per weight capped, the level of the rest
    would still exceed its own cap per weight. Sums are whole numbers, so reruns agree exactly.
    The two windows see one row for each source, already aggregated.
    """
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), F.col("_i") % len(weights) + 1)
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = (per.withColumn("_i", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
              .withColumn("_w", w).withColumn("_cap", F.lit(int(max_rate)).cast("long") * F.col("source_size")))
    every = Window.partitionBy(F.lit(0))
    below = (Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_i")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = (ranked.withColumn("_total", F.sum("source_size").over(every)).withColumn("_weights", F.sum("_w").over(every))
              .withColumn("_cap_sum", F.sum("_cap").over(below)).withColumn("_w_sum", F.sum("_w").over(below))
              # capped: (total - caps below) / (weights from here on) >= cap / weight
              .withColumn("_capped", (F.col("_total") - F.col("_cap_sum") + F.col("_cap")) * F.col("_w")
                          >= F.col("_cap") * (F.col("_weights") - F.col("_w_sum") + F.col("_w")))
              .withColumn("_left", F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(every))
              .withColumn("_open", F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_w"))).over(every)))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
        (F.col("_left") * F.col("_w")).cast("double") / F.col("_open"))
    return filled.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the key only; null keys share one."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, DRAW_HEX), 16, 10).cast("double") / float(16 ** DRAW_HEX)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 17,
             key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each row: key, size, source_size, target, copies.

    copies is floor(rate) plus one with a probability of rate's fraction, drawn from a hash of
    the key, where rate = target / source_size. One row for each row of docs, repeated rows
    included (they draw alike); null texts have size 0; null sources form one source, the last.
    Every document of a source of size 0 is taken no times. Empty tables give empty results.
    """
    key, text, source = map(quoted, (key, text, source))
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    # two long columns and a short string for each document; the text is scanned once
    sized = materialise(sized)
    targets = guarded(materialise(source_targets(sized, weights, max_rate)
                                  .withColumnRenamed("source", "_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_rate)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_rate", rate)
    whole = F.floor("_rate")
    extra = (draw(F.col("key"), seed) < F.col("_rate") - whole).cast("long")
    return joined.select("key", "size", "source_size", "target", (whole + extra).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 17,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as mix_plan says, with docs' columns.

    The copies follow from the row's own key and its source's rate, so the texts are read once
    more and only met with the small table of sources; they are never shuffled. Null texts have
    size 0, null sources are one source; repeated rows draw alike, rows of size 0 follow their
    source's rate, and a source of size 0 goes. Other columns, whatever their names, pass through.
    Empty in, empty out.
    """
    key, text, source = map(quoted, (key, text, source))
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    plan = source_targets(sized, weights, max_rate)
    s, r, n = (free_name(x, docs) for x in ("_source", "_rate", "_copy"))
    rates = plan.select(F.col("source").alias(s), F.when(
        F.col("source_size") > 0, F.least(F.lit(float(max_rate)), F.col("target") / F.col("source_size"))).otherwise(0.0).alias(r))
    rates = guarded(materialise(rates))
    whole = F.floor(r)
    copies = (whole + (draw(F.col(key), seed) < F.col(r) - whole).cast("long")).cast("int")
    out = docs.join(rates, docs[source].eqNullSafe(F.col(s)), "left")
    return out.withColumn(n, F.explode(F.array_repeat(F.lit(0), copies))).select(*map(quoted, docs.columns))


def op1(docs: DataFrame) -> DataFrame:
    """The contract's view of mix_plan: doc_id, size, source_size, target, taken."""
    plan = mix_plan(docs)
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\x09-\\x0D]+')), 0)::bigint as size from documents
), per as (select source, sum(size)::bigint as source_size from d group by source),
r as (
  select *, (row_number() over (order by source nulls last) - 1)::int as i, {MAX_RATE} * source_size as cap from per
), v as (select *, ([{', '.join(map(str, WEIGHTS))}])[i % {len(WEIGHTS)} + 1] as w from r),
f as (
  select *, sum(source_size) over () as total, sum(w) over () as ws,
    sum(cap) over (order by cap::double / w, i rows unbounded preceding) as cs,
    sum(w) over (order by cap::double / w, i rows unbounded preceding) as wc from v
), c as (select *, (total - cs + cap) * w >= cap * (ws - wc + w) as capped from f),
g as (
  select *, total - sum(case when capped then cap else 0 end) over () as rest,
    sum(case when capped then 0 else w end) over () as open from c
), t as (
  select source, source_size,
    case when capped then cap::double else (rest * w)::double / open::double end as target from g
), j as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then least({float(MAX_RATE)}::double, t.target / t.source_size::double) else 0.0 end as rate,
    ('0x' || substr(md5('17|' || coalesce(d.doc_id::varchar, 'null')), 1, {DRAW_HEX}))::bigint::double / {float(16 ** DRAW_HEX)!r}::double as u
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  ((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken from j
"""
