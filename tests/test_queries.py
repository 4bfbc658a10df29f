"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fileprune import queries as core

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None)), sorted(frame.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got, columns = rows(entry.queries()[name](spark, SF).toPandas())
    wanted, expected = rows(con.execute(entry.oracle_sql()[name]).df())
    assert columns == expected
    plain = lambda table: [tuple(x.removesuffix(".0") for x in r) for r in table]
    assert sorted(plain(got)) == sorted(plain(wanted))


def test_sql_temporal_join_with_many_users(spark, tmp_path):
    """Tables with more users than sf0.1 has: 10,000 is somebody's key there."""
    import datetime as d

    begin = d.datetime(2024, 1, 1)
    events = [(i, begin + d.timedelta(hours=i), user, "click", 1.0, "{}") for i, user in enumerate([1, 5, 9, 10_000, 1, 12_000])]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, _ = rows(entry.queries()["sql_temporal_join"](spark, str(tmp_path)).toPandas())
    wanted, _ = rows(con.execute(entry.oracle_sql()["sql_temporal_join"]).df())
    assert got == wanted and len(got) == 3


def test_shards_are_written_without_a_shuffle(spark, tmp_path):
    """A file for each shard, of many tasks' rows and of more shards than a task writes at once; null has one too."""
    source = spark.range(0, 3000, 1, 6).selectExpr("id", "cast(nullif(id % 40, 39) as int) AS _shard")
    sc = spark.sparkContext
    sc.setJobGroup("shards", "shards")
    place = core._written(spark, source, str(tmp_path / "shards"))
    stages = [i for job in sc.statusTracker().getJobIdsForGroup("shards") for i in sc.statusTracker().getJobInfo(job).stageIds]
    assert stages and sum(sc._jsc.sc().statusStore().lastStageAttempt(i).shuffleWriteBytes() for i in stages) == 0
    folders = [f for f in os.listdir(place) if f.startswith("_shard=")]
    assert len(folders) == 40 and all(len([f for f in os.listdir(f"{place}/{d}") if f.endswith(".parquet")]) == 1 for d in folders)
    back = spark.read.parquet(place)
    assert back.exceptAll(source).isEmpty() and back.count() == 3000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_range_join_shuffles_no_lines(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        plan = core.range_join(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_custkey", "c_name", "n", "total"]
