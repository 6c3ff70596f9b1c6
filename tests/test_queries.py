"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names():
    import __spark_entry__ as entry

    return sorted(set(entry.queries()) - set(entry.LLM_QUERIES))


def _normal(df: pd.DataFrame) -> list[tuple]:
    def text(value):
        if pd.api.types.is_scalar(value) and pd.isna(value):
            return ""
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(int(value))
        try:
            return repr(round(float(value), 6))
        except (TypeError, ValueError):
            return str(value)

    return sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", _names())
def test_query(spark, sf_dir, duck, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _normal(got) == _normal(want)
