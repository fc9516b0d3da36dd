"""Every registered query against its DuckDB twin on the smallest scale
(the driver runs the same comparison at sf0.01; scripts/oracle_check.py)."""
import hashlib
import math

import duckdb
import pandas as pd
import pytest

from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "∅"
    if not isinstance(v, (list, dict, str, bytes)):
        try:
            if pd.isna(v):
                return "∅"
        except (TypeError, ValueError):
            pass
    if isinstance(v, float):
        return "∅" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "item"):
        v = v.item()
    return str(v)


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted("\x1f".join(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False))
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_queries_match_oracle(spark, duck):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    bad = []
    for name, sql in o.items():
        a = _digest(q[name](spark, SF001).toPandas())
        b = _digest(duck.execute(sql).df())
        if a != b:
            bad.append((name, a[:2], b[:2]))
    assert not bad, bad
