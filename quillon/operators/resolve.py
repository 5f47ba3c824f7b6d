"""Names as written, resolved to entries of a name table; upkeep of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters with marks, and the letters below the marks.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"

EXCLUDED = "__not_a_brand__"
#: Rows added by decisions come after all rows of the table.
NEW_ORDINAL = 2 ** 31 - 1


def simple_fold(s: Column) -> Column:
    """Decomposed and without combining marks where every engine agrees (accents of Latin letters), in lower
    case, without a final bracket, single blanks. text.fold is the full Unicode folding of the same form.
    """
    s = F.translate(s, ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"\s*\([^()]*\)\s*$", ""), r"\s+", " "))


def key_map(names: DataFrame, exclusions: DataFrame | None = None, fold=simple_fold) -> DataFrame:
    """(surface, id) from names (id, display, aliases 'a|b', ordinal) and exclusions (surface).

    Display name and aliases are keys; of rows with one surface the last ordinal wins, and an
    exclusion wins over all.
    """
    keys = names.select("id", "ordinal", F.explode(F.concat(F.array("display"), F.split(F.coalesce("aliases", F.lit("")), r"\|"))).alias("s"))
    keys = keys.select(fold(F.col("s")).alias("surface"), "id", F.col("ordinal").cast("long").alias("ordinal")).where("surface <> ''")
    if exclusions is not None:
        keys = keys.unionByName(exclusions.select(fold(F.col("surface")).alias("surface"), F.lit(EXCLUDED).alias("id"), F.lit(2 ** 62).alias("ordinal")))
    return keys.groupBy("surface").agg(F.max_by("id", F.struct("ordinal", "id")).alias("id"))


def collisions(names: DataFrame, fold=simple_fold) -> DataFrame:
    """Surfaces that more than one id claims: must be empty before a table is extended."""
    keys = names.select("id", F.explode(F.concat(F.array("display"), F.split(F.coalesce("aliases", F.lit("")), r"\|"))).alias("s"))
    return keys.select("id", fold(F.col("s")).alias("surface")).where("surface <> ''").groupBy("surface").agg(F.count_distinct("id").alias("n_ids")).where("n_ids > 1")


def prefix(s: Column, words: int) -> Column:
    """The first words of a folded name if it has more, else null."""
    w = F.split(s, " ")
    return F.when(F.size(w) > words, F.array_join(F.slice(w, 1, words), " "))


def resolve(mentions: DataFrame, keys: DataFrame, surface: str = "surface", fold=simple_fold) -> DataFrame:
    """mentions with id: of the whole folded surface, else of its first three, two or one words; null if none.

    Each try is an equi-join on the surface; Catalyst broadcasts the key table where it is small.
    """
    out = mentions.withColumn("_s", fold(F.col(surface)))
    tries = []
    for n in (0, 3, 2, 1):
        k = keys.select(F.col("surface").alias(f"_k{n}"), F.col("id").alias(f"_id{n}"))
        out = out.withColumn(f"_t{n}", F.col("_s") if n == 0 else prefix(F.col("_s"), n)).join(k, F.col(f"_t{n}") == F.col(f"_k{n}"), "left").drop(f"_t{n}", f"_k{n}")
        tries.append(f"_id{n}")
    return out.withColumn("id", F.coalesce(*tries)).drop("_s", *tries)


def candidates(mentions: DataFrame, keys: DataFrame, surface: str = "surface", group: str = "query", least: int = 1, fold=simple_fold) -> DataFrame:
    """Unresolved surfaces: folded form, mentions, distinct spellings and groups, most frequent first-sorted spelling."""
    open_ = resolve(mentions, keys, surface, fold).where("id is null").withColumn("folded", fold(F.col(surface)))
    forms = open_.groupBy("folded", F.col(surface).alias("form")).agg(F.count("*").alias("c"), F.collect_set(group).alias("g"))
    return forms.groupBy("folded").agg(F.sum("c").alias("n"), F.count("*").alias("n_forms"), F.size(F.array_distinct(F.flatten(F.collect_list("g")))).alias("n_groups"),
                                       F.min(F.struct((-F.col("c")).alias("c"), "form"))["form"].alias("form")).where(F.col("n") >= least)


def extend(names: DataFrame, decisions: DataFrame) -> DataFrame:
    """A name table with decisions (folded, action new|alias|exclude|unidentified, id) applied.

    New names become rows, aliases join their id's list; the other two change nothing here.
    """
    more = decisions.where("action = 'alias'").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("folded")), "|").alias("_more"))
    kept = names.join(more, "id", "left").withColumn("aliases", F.concat_ws("|", F.nullif("aliases", F.lit("")), "_more")).drop("_more")
    new = decisions.where("action = 'new'").select("id", F.col("folded").alias("display"), F.lit("").alias("aliases"), F.lit(NEW_ORDINAL).alias("ordinal"))
    return kept.unionByName(new, allowMissingColumns=True)


KINDS = ("brand", "retailer", "both", "alias", "exclude", "unidentified")


def extend_round(names: DataFrame, decisions: DataFrame, round_: int, source: str) -> DataFrame:
    """The next version of a name table (id, display, aliases, class, ordinal, round, provenance) by a round of decisions.

    decisions: (kind, id, display, class, form, how), one row a form. New entities (brand, retailer, both) become rows of the
    round, with their further forms as aliases; aliases join their target's list, whose provenance says so. Forms that
    the entity has already, folded, are not added. Excluded and unidentified forms change no row.
    """
    new = decisions.where(F.col("kind").isin("brand", "retailer", "both"))
    other = F.when(simple_fold(F.col("form")) != simple_fold(F.col("display")), F.col("form"))
    made = new.groupBy("id", "display", "class", "kind", "how").agg(F.array_join(F.array_sort(F.collect_set(other)), "|").alias("aliases"))
    made = made.select("id", "display", "aliases", "class", F.lit(NEW_ORDINAL).cast("long").alias("ordinal"), F.lit(round_).alias("round"),
                       F.concat(F.lit(f"{source} ("), "how", F.lit(")"), F.when(F.col("kind") == "both", "; brand and retailer").otherwise("")).alias("provenance"))
    base = names.select("id", "display", F.coalesce("aliases", F.lit("")).alias("aliases"), "class", F.col("ordinal").cast("long").alias("ordinal"), "round", "provenance").unionByName(made)
    more = decisions.where("kind = 'alias'").groupBy("id").agg(F.array_sort(F.collect_set("form")).alias("_more"))
    have = F.transform(F.concat(F.array("display"), F.split("aliases", r"\|")), simple_fold)
    joined = base.join(more, "id", "left").withColumn("_new", F.filter(F.coalesce("_more", F.array().cast("array<string>")), lambda x: ~F.array_contains(have, simple_fold(x))))
    listed = F.array_join(F.concat(F.filter(F.split("aliases", r"\|"), lambda x: x != ""), F.col("_new")), "|")
    noted = F.when(F.col("_more").isNotNull(), F.concat("provenance", F.lit(f"; aliases extended, {source}"))).otherwise(F.col("provenance"))
    return joined.select("id", "display", listed.alias("aliases"), "class", "ordinal", "round", noted.alias("provenance"))


def extension_problems(names: DataFrame, decisions: DataFrame, extended: DataFrame) -> DataFrame:
    """(problem, surface, old_id, new_id): what speaks against an extension; empty if it may be used.

    resolved: a new form that the old table knows already; id taken: a new entity with an old id; no target: an alias of
    nothing; two entities: a folded surface of the extended table under two ids; moved or lost: an old surface
    that no longer leads to its id; unexplained: a new surface that no decision asked for. The last three compare both
    tables' key maps both ways, so an empty result proves that no old surface moved.
    """
    none = F.lit(None).cast("string")
    old, new = key_map(names), key_map(extended)
    fresh = decisions.where(F.col("kind") != "unidentified")
    known = resolve(fresh.select(F.col("form").alias("surface"), F.col("id").alias("new_id")).distinct(), old).where("id is not null").select(F.lit("resolved").alias("problem"), simple_fold(F.col("surface")).alias("surface"), F.col("id").alias("old_id"), "new_id")
    entities = decisions.where(F.col("kind").isin("brand", "retailer", "both"))
    taken = entities.select("id").distinct().join(names.select("id"), "id").select(F.lit("id taken").alias("problem"), none.alias("surface"), F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    ids = names.select("id").union(entities.select("id")).distinct()
    loose = decisions.where("kind = 'alias'").select("id").distinct().join(ids, "id", "left_anti").select(F.lit("no target").alias("problem"), none.alias("surface"), none.alias("old_id"), F.col("id").alias("new_id"))
    two = collisions(extended).select(F.lit("two entities").alias("problem"), "surface", none.alias("old_id"), none.alias("new_id"))
    both = old.withColumnRenamed("id", "old_id").join(new.withColumnRenamed("id", "new_id"), "surface", "full")
    asked = decisions.where(F.col("kind").isin("brand", "retailer", "both", "alias")).select(F.explode(F.array("form", F.coalesce("display", "form"))).alias("s")).select(simple_fold(F.col("s")).alias("surface")).distinct()
    gone = both.where("old_id is not null and not (old_id <=> new_id)").select(F.when(F.col("new_id").isNull(), "lost").otherwise("moved").alias("problem"), "surface", "old_id", "new_id")
    extra = both.where("old_id is null").join(asked, "surface", "left_anti").select(F.lit("unexplained").alias("problem"), "surface", "old_id", "new_id")
    out = known
    for part in (taken, loose, two, gone, extra):
        out = out.unionByName(part)
    return out


def merge_back(base: DataFrame, decided: DataFrame, key: str, value: str) -> DataFrame:
    """base with value replaced where decided has one; conflict marks a decision that contradicts an earlier one."""
    new = decided.select(key, F.col(value).alias("_new"))
    out = base.join(new, key, "left")
    return out.withColumn("conflict", F.col(value).isNotNull() & F.col("_new").isNotNull() & (F.col(value) != F.col("_new"))).withColumn(value, F.coalesce("_new", value)).drop("_new")
