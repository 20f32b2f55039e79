"""The training-data queries that SQL can express, on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_a_single_row_group_is_dealt_over_the_cores(spark, tmp_path):
    from tessera.llm.common import read

    rows = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 20) AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "many"))
    held = lambda df: sum(1 for r in df.groupBy(F.spark_partition_id()).count().collect() if r[1])
    one, many = read(spark, str(tmp_path / "one")), read(spark, str(tmp_path / "many"))
    assert held(one) == spark.sparkContext.defaultParallelism
    assert "Exchange" in one._jdf.queryExecution().toString() and "Exchange" not in many._jdf.queryExecution().toString()
    assert sorted(one.collect()) == sorted(many.collect()) == sorted(rows.collect())
    empty = str(tmp_path / "none")
    rows.where("doc_id < 0").write.parquet(empty)
    assert read(spark, empty).count() == 0
