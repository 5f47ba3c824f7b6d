"""The study view: repeated labelled answers derived from the order tables.

An answer is an order: its priority is the model, its status the arm, its customer's nation the
query (the unit of inference) and region the category. Its lines' brands are the names mentioned,
in line order; line prices are price entries, suppliers retailers. What the tables lack (outcomes,
raters, second draws) follows from md5 of the key, so any engine derives the same view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARMS = {"O": "en", "F": "bn", "P": "bl"}
CONTRASTS = (("bn", "en"), ("bl", "en"), ("bn", "bl"))
CURRENCY = {"A": "BDT", "R": "USD", "N": "unstated"}
#: Brands of a higher number are in no class table.
LAST_CLASSED = 23
RATERS = ("R1", "R2", "R3")
#: In how many of 100 mentions a rater misses a name.
MISSES = 20
#: Lines whose keys one task groups, about.
LINES_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash32(*parts: Column | str) -> Column:
    """The first 32 bits of md5 of the parts joined by |."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def by_key(rows: DataFrame, key: str, lines: DataFrame) -> DataFrame:
    """rows dealt by key to as many tasks as lines ask for, by number: else the last tasks of a job, which adaptive execution joins by their
    compressed bytes, hold more of a larger table. Groups and joins by key that follow need no other shuffle. Small tables stay as they are."""
    tasks = -(-lines.count() // LINES_A_TASK)
    return rows.repartition(tasks, key) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows


def choose(value: Column, names: dict[str, str]) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, model, arm, query, category, rep, outcome, truncated, asked_at, amount."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("query"), F.col("r_name").alias("category"))
    joined = (t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
              .join(places, F.col("c_nationkey") == F.col("n_nationkey")))
    named = joined.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("model"), choose(F.col("o_orderstatus"), ARMS).alias("arm"),
                          "query", "category", F.col("o_orderdate").alias("asked_at"), F.col("o_totalprice").alias("amount"))
    h = hash32("outcome", F.col("key")) % 100
    return (named.withColumn("rep", F.row_number().over(Window.partitionBy("model", "arm", "query").orderBy("key")))
            .withColumn("outcome", F.when(h < 2, "degenerate").when(h < 5, "refusal").when(h < 15, "reversion").otherwise("valid"))
            .withColumn("truncated", hash32("truncated", F.col("key")) % 50 == 0))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, name, place: each answer's distinct names with the place of their first mention."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    # the order of lines is made total: (orderkey, linenumber) repeats
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand")
    named = lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand")
    first = by_key(named, "l_orderkey", lines).groupBy(
        F.col("l_orderkey").alias("key"), F.col("p_brand").alias("name")).agg(F.min(order).alias("_o"))
    return first.select("key", "name", F.row_number().over(Window.partitionBy("key").orderBy("_o", "name")).alias("place"))


def name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, class: local, global or ambiguous; later numbers have no row."""
    number = F.substring_index("p_brand", "#", -1).cast("int")
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), number.alias("_n")).distinct()
    return names.where(F.col("_n") <= LAST_CLASSED).select("name", F.when(F.col("_n") % 4 == 0, "local").when(F.col("_n") % 4 == 3, "ambiguous").otherwise("global").alias("class"))


def name_lists(answers_: DataFrame, mentions_: DataFrame) -> DataFrame:
    """answers with names (a sorted set) and names_order (by first mention); empty lists without mentions."""
    packed = mentions_.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_l"))
    lists = packed.select("key", F.transform("_l", lambda x: x["name"]).alias("names_order"))
    empty = F.array().cast("array<string>")
    return answers_.join(lists, "key", "left").withColumn("names_order", F.coalesce("names_order", empty)).withColumn("names", F.array_sort("names_order"))


def price_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, amount, currency: a row for each line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("amount"), choose(F.col("l_returnflag"), CURRENCY).alias("currency"))


def retailer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("key"), F.col("s_name").alias("retailer")).distinct()


def rater_names(mentions_: DataFrame) -> DataFrame:
    """key, rater, name, place: what each of three raters lists; each misses some mentions."""
    each = mentions_.withColumn("rater", F.explode(F.array(*map(F.lit, RATERS))))
    return each.where(hash32(F.col("rater"), F.col("key"), F.col("name")) % 100 >= MISSES).select("key", "rater", "name", "place")


STUDY_SQL = f"""
answers as (
  select *, row_number() over (partition by model, arm, query order by key) as rep,
    case when h < 2 then 'degenerate' when h < 5 then 'refusal' when h < 15 then 'reversion' else 'valid' end as outcome,
    ('0x' || substr(md5('truncated|' || key), 1, 8))::ubigint % 50 = 0 as truncated
  from (select o_orderkey as key, o_orderpriority as model, case o_orderstatus when 'O' then 'en' when 'F' then 'bn' when 'P' then 'bl' end as arm,
      n_name as query, r_name as category, o_orderdate as asked_at, o_totalprice as amount,
      ('0x' || substr(md5('outcome|' || o_orderkey), 1, 8))::ubigint % 100 as h
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)),
mentions as (
  select key, name, row_number() over (partition by key order by o, name) as place from (
    select l_orderkey as key, p_brand as name, min((l_linenumber, l_partkey, l_suppkey, p_brand)) as o
    from lineitem join part on l_partkey = p_partkey group by all)),
classes as (
  select name, case when n % 4 = 0 then 'local' when n % 4 = 3 then 'ambiguous' else 'global' end as class
  from (select distinct p_brand as name, split_part(p_brand, '#', 2)::int as n from part) where n <= {LAST_CLASSED}),
lists as (
  select a.*, coalesce(l, []) as names_order, list_sort(coalesce(l, [])) as names
  from answers a left join (select key, list(name order by place) as l from mentions group by key) using (key)),
prices as (
  select l_orderkey as key, l_extendedprice as amount, case l_returnflag when 'A' then 'BDT' when 'R' then 'USD' when 'N' then 'unstated' end as currency from lineitem),
retailers as (select distinct l_orderkey as key, s_name as retailer from lineitem join supplier on l_suppkey = s_suppkey),
raters as (
  select key, rater, name, place from mentions, (select unnest(['R1', 'R2', 'R3']) as rater)
  where ('0x' || substr(md5(rater || '|' || key || '|' || name), 1, 8))::ubigint % 100 >= {MISSES})
"""
