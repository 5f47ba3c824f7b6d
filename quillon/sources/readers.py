"""Sources: tables of strings, JSON lines, single records, rater exports, rules, keys, sheets, gates."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headed CSV of strings; a byte-order mark is dropped, a row of the wrong width fails."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a bad line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A tree of files of one JSON record each: (records, unreadable files)."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = raw.select("file", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select("r.*", "file").drop("_corrupt_record"), parsed.where(bad).select("file")


EXPORT = """task string, rater string, partial boolean, exported_at string, labels array<struct<pid:string,brands:array<string>,recommended:array<string>,
prices:array<string>,retailers:array<string>,refused:string,answer_language:string,comments:string>>"""


def read_export(spark: SparkSession, path: str, task: str, rater: str) -> DataFrame:
    """Labels of one rater's export; it fails for another task or rater, a partial export or a repeated pid."""
    raw = spark.read.schema(EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    fine = (F.col("task") == task) & (F.col("rater") == rater) & ~F.coalesce("partial", F.lit(False)) & (
        F.size(F.array_distinct(F.transform("labels", lambda x: x["pid"]))) == F.size("labels"))
    checked = raw.withColumn("_ok", F.assert_true(F.coalesce(fine, F.lit(False)), F.lit(f"not a whole export of {task} by {rater}")))
    return checked.where("_ok is null").select("rater", F.explode("labels").alias("x")).select("rater", "x.*").withColumn("refused", F.lower("refused") == "true")


def read_rules(spark: SparkSession, path: str) -> list[str]:
    """Patterns of a text file, comments and blanks out, each compiled to see that it is one."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").collect()
    out = [r["value"].strip() for r in rows]
    for p in out:
        re.compile(p)
    return out


def check_keys(keys: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """What is wrong with a list of keys: (key, problem) for repeated and unknown ones."""
    twice = keys.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated").alias("problem"))
    return twice.unionByName(keys.join(known, key, "left_anti").distinct().select(key, F.lit("unknown").alias("problem")))


def match_fragments(fragments: DataFrame, records: DataFrame, key: str = "key", length: int = 12) -> DataFrame:
    """Records by the first characters of their key (a file name's fragment), and how many share them."""
    short = records.withColumn("fragment", F.substring(key, 1, length))
    n = short.groupBy("fragment").agg(F.count("*").alias("candidates"))
    return fragments.join(short, "fragment", "left").join(n, "fragment", "left")


NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(raw: bytes) -> list[dict[str, str]]:
    """Rows of a workbook's first sheet by its header."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = min(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n))
        table = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{NS['m']}}}row"):
            cells = {}
            for c in row.iter(f"{{{NS['m']}}}c"):
                text = "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}v", "}t")))
                cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(text)] if c.get("t") == "s" else text
            table.append(cells)
    header, *body = table or [{}]
    return [{name: r.get(col, "") for col, name in header.items()} for r in body]


def read_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns, as strings, of the first sheet of each workbook."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                yield pd.DataFrame(sheet_rows(raw), columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def gate(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (name, sha256) that are missing or differ: empty if all may be read."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("_is"))
    return manifest.join(found, "name", "left").where(~F.coalesce(F.col("_is") == F.col("sha256"), F.lit(False))).select("name", "sha256", F.col("_is").alias("found"))


def synthetic_study(spark: SparkSession, queries: int = 50, models: int = 3, reps: int = 5, shift: float = 0.0, names: int = 12, seed: int = 1) -> DataFrame:
    """A study with a planted effect: model, query, arm, rep, names, outcome.

    Each query has gamma preferences over names; arms other than en multiply those of local names
    (every fourth) by exp(shift). Numbers depend on the seed and the query only, not on tasks.
    """
    arms = ("en", "bn", "bl")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for q in f["id"]:
                rng = np.random.default_rng([seed, int(q)])
                taste = rng.gamma(0.7, 1.0, names) + 1e-3
                for m in range(models):
                    for arm in arms:
                        w = taste * np.where((np.arange(names) % 4 == 0) & (arm != "en"), np.exp(shift), 1.0)
                        for r in range(reps):
                            k = min(names, 1 + rng.poisson(2.5))
                            got = rng.choice(names, k, replace=False, p=w / w.sum())
                            rows.append((f"M{m}", f"Q{q:03d}", arm, r, [f"N{g}" for g in got], "valid" if rng.random() > 0.05 else "refusal"))
            yield pd.DataFrame(rows, columns=["model", "query", "arm", "rep", "names", "outcome"])

    return spark.range(queries).mapInPandas(run, "model string, query string, arm string, rep int, names array<string>, outcome string")
