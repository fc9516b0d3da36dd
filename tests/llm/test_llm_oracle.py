"""The llm queries that SQL can express against DuckDB, row by row."""

import duckdb
import pytest
from pagesift.llm import queries

from .edge import SF, collect


def rows(records):
    return sorted(str([(k, round(v, 6) if isinstance(v, float) else v) for k, v in sorted(r.items())]) for r in records)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    assert rows(collect(queries.QUERIES[name](spark, SF))) == rows(found)


@pytest.mark.parametrize("name", ["op1_stratified_shards", "op7_sainte_lague_mix"])
def test_settings_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("3", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows(collect(queries.QUERIES[name](spark, SF))))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
