from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import registry
from lectern.llm.common import join_skewed, salted_rank, work_dir

from ..conftest import SMALL
from ..test_oracle import TABLES, plain


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_salted_rank(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, F.lit(None)).otherwise(F.lit(1)).alias("k"), "id")
    out = salted_rank(df, ["k"], ["id"], "r", 1000).collect()
    assert sorted(r["r"] for r in out if r["k"] is None) == list(range(900)) and sorted(r["r"] for r in out if r["k"]) == list(range(100))


def test_join_with_hot_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("top"))
    got = sorted((r["id"], r["k"], r["top"]) for r in join_skewed(rows, values.where("k < 4000"), ["k"], 5000, 10).collect())
    assert got == [(i, 0 if i < 2000 else i, 1999 if i < 2000 else i) for i in range(4000)]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        applicationId, master = "none", "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        work_dir(Session())
