"""Queries whose operators iterate or simulate: rows-only checks, brute force in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import consensus, estimate, layers, models, resample, simulate, study
from quillon.plans.catalogue import CONTRASTS, View, query, rounded
from quillon.functions.sets import set_f1
from quillon.streaming import runs


#: Re-assignments of name sets a query; each costs the subsets of a query's distinct sets.
SET_DRAWS = 2000


@query("l4_length_model")
def length_model(v: View) -> DataFrame:
    return rounded(models.lmm(v.answers, F.log(F.col("amount") + 1), CONTRASTS), "estimate", "se", "z", "p", "ratio")


@query("h1_h5_paired_tests")
def paired_tests(v: View) -> DataFrame:
    d = estimate.paired(v.share_cells(), CONTRASTS)
    return rounded(models.paired_tests(d), "w", "p_rank", "p_flip")


@query("h2_h3_randomisation")
def randomisation(v: View) -> DataFrame:
    rows = v.counted().select("model", "query", "arm", estimate.local_share().alias("v"))
    sides = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.when(F.col("arm") == a, "a").when(F.col("arm") == b, "b").alias("side")) for a, b in CONTRASTS])).alias("s")
    values = rows.select("model", "query", "v", sides).select("model", "query", "v", "s.contrast", "s.side").where("side is not null")
    shares = models.randomisation(values, draws=10_000).withColumn("statistic", F.lit("local share"))
    sets = models.set_randomisation(v.lists, CONTRASTS, draws=SET_DRAWS).withColumn("statistic", F.lit("excess divergence"))
    return rounded(shares.unionByName(sets), "observed", "p")


@query("l5_outcome_tests")
def outcome_tests(v: View) -> DataFrame:
    """Refusals among answers that are not degenerate, each contrast with the method that gave its P."""
    return rounded(models.outcome_tests(v.answers.where(layers.predicates()["primary"]), (F.col("outcome") == "refusal").cast("int"), CONTRASTS), "estimate", "p")


@query("g5_alternative_annotator")
def alternative_annotator(v: View) -> DataFrame:
    s = consensus.rater_sets(v.raters, v.answers, study.RATERS).join(v.lists.select("key", "names"), "key")
    rows = []
    for r in study.RATERS:
        a, b = [x for x in study.RATERS if x != r]
        rows.append(F.struct(F.lit(r).alias("rater"), ((set_f1(F.col("names"), F.col(a)) + set_f1(F.col("names"), F.col(b))) / 2).alias("machine"),
                             ((set_f1(F.col(r), F.col(a)) + set_f1(F.col(r), F.col(b))) / 2).alias("human")))
    scores = s.select(F.col("key").alias("item"), F.explode(F.array(*rows)).alias("x")).select("item", "x.*")
    return rounded(models.alternative_annotator(scores), "mean", "advantage", "p", "winning_rate")


@query("c5_dispersion", """select arm, round(greatest(0.0, least(0.95, sum((x - n * p) * (x - n * p) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)))), 6) as rho from (
  select arm, x, n, sum(x) over (partition by arm) / sum(n) over (partition by arm) as p from (
    select a.arm, key, count(*) filter (where currency = 'BDT') as x, count(*)::double as n from answers a join prices using (key) group by all)) where n >= 2 and p > 0 and p < 1 group by all""")
def dispersion(v: View) -> DataFrame:
    counts = v.answers.join(v.prices.select("key", "currency"), "key").groupBy("arm", "key").agg(F.count_if(F.col("currency") == "BDT").alias("x"), F.count("*").alias("n"))
    return rounded(simulate.dispersion(counts), "rho")


@query("x_stream_windows", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all", with_study=False)
def stream_windows(v: View) -> DataFrame:
    """events as a stream, each event once, counted by hour; files come in any order of time, so no watermark drops late ones."""
    base = v.spark.conf.get("spark.checkpoint.dir", None) or v.spark.conf.get("spark.sql.warehouse.dir")
    home = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = v.table("events")
    events.write.parquet(f"{home}/in")
    stream = runs.once(runs.read_calls(v.spark, f"{home}/in", events.schema).withColumn("ts", F.col("ts").cast("timestamp")), "event_id", late=None)
    hours = stream.select("event_id", "event_type", "value", F.date_trunc("hour", "ts").alias("start"))
    runs.drain(hours, f"{home}/out", f"{home}/checkpoint")
    got = v.spark.read.parquet(f"{home}/out").groupBy("start", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return got.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
