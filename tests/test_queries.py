"""Every registered query of the study view against DuckDB, where it has a statement."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quillon.plans import catalogue, designs, families, models, records  # noqa: F401  the others register their queries there

DATA = Path("/root/testdata/sf0.001")


def rows_of(df: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind in "fiu" else x
    return sorted(str([plain(x) if not isinstance(x, (bool, str)) else x for x in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    if name not in catalogue.SQL:
        assert len(got)
        return
    want = duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda rows: [r.replace(".0,", ",").replace(".0]", "]") for r in rows]
    assert norm(rows_of(got)) == norm(rows_of(want))


def test_interval_overlap_reads_all_answers(spark, duck):
    whole = catalogue.SQL["j21_interval_overlap"].replace("where key % 1000 = 0 ", "")
    assert rows_of(catalogue.QUERIES["j21_interval_overlap"](spark, str(DATA)).toPandas()) == rows_of(duck.execute(whole).df())


def test_readme_claims_only_registered_statements():
    """Numbers that the README lists as having DuckDB statements are in names of queries that have one."""
    import re

    text = Path(__file__).resolve().parents[1].joinpath("README.md").read_text().split("With DuckDB statements:")[1].split("These are the numbers")[0]
    have = {m.upper() for name in catalogue.SQL for m in re.findall(r"(?:^|_)([a-z][0-9]+)(?=_)", name)}
    for first, last in re.findall(r"\b([A-Z][0-9]+)(?:–([A-Z][0-9]+))?", text):
        for n in range(int(first[1:]), int((last or first)[1:]) + 1):
            assert f"{first[0]}{n}" in have


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "a4_paired_local_share" in e.queries()
