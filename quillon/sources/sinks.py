"""Sinks: CSV, JSON lines, append logs, result trees, reports, redacted copies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.option("header", True).option("lineSep", "\n").csv(path)


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """Lines ordered by key, fields by name: the same bytes for the same rows."""
    df.select(*sorted(df.columns)).orderBy(key).write.json(path)


def append_log(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def open_work(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of a plan has no result yet: a resumed run does only this."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def result_tree(results: DataFrame, levels: tuple[str, ...], value: str) -> str:
    """Nested JSON of a small result table."""
    tree: dict = {}
    for r in results.select(*levels, value).toLocalIterator():
        node = tree
        for name in levels[:-1]:
            node = node.setdefault(str(r[name]), {})
        node[str(r[levels[-1]])] = r[value]
    return json.dumps(tree, sort_keys=True, ensure_ascii=False, indent=1)


def markdown(results: DataFrame, columns: list[str], digits: int = 3) -> str:
    """A small result table as a Markdown table, in its order."""
    show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [[show(r[c]) for c in columns] for r in results.select(*columns).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [columns, ["---"] * len(columns), *rows])


def redacted(records: DataFrame, struct: str, fields: tuple[str, ...], mark: str = "REDACTED") -> DataFrame:
    """records with fields of a struct column replaced by a mark."""
    col = F.col(struct)
    for f in fields:
        col = col.withField(f, F.lit(mark))
    return records.withColumn(struct, col)


def split_superseded(records: DataFrame, current: Column | None = None, key: str = "key", retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(live, moved): records with other parameters than the current, or over the retry cap, are moved."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("attempt"))
    marked = records.withColumn("_old", (nth > retries + 1) | ~F.coalesce(current if current is not None else F.lit(True), F.lit(False)))
    return marked.where("not _old").drop("_old"), marked.where("_old").drop("_old")
