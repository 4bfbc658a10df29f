"""Queries of the index over the given tables, with the same in SQL.

Each table is first written as shards whose number is a function of a row's keys, so that SQL can say which rows lie in
the files that a location leaves over. Shards and indexes are made once for a session and a data folder.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileprune.index import FileIndex, join_index
from fileprune.plans.catalog import IndexCatalog
from fileprune.sources.filelist import FileList
from fileprune.sources.fs import Files
from fileprune.sources.paths import working_root
from fileprune.streaming.incremental import index_stream

#: Bytes of a row group of a shard.
ROW_GROUP = 16 << 20

_made: dict[tuple, object] = {}


def _once(spark: SparkSession, *key, make: Callable):
    key = (spark.sparkContext.applicationId, *key)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession, sf_dir: str) -> str:
    """The session's own folder for this data; storage of indexes lies there too."""
    root = _once(spark, "root", sf_dir, make=lambda: f"{working_root(spark)}/fileprune-queries/{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}-{uuid.uuid4().hex}")
    spark.conf.set("spark.fileprune.storagePath", f"{root}/storage")
    return root


def _key_max(spark: SparkSession, sf_dir: str) -> int:
    return _once(spark, "max", sf_dir, make=lambda: _table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0])


def _order_max(spark: SparkSession, sf_dir: str) -> int:
    return _once(spark, "omax", sf_dir, make=lambda: _table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0])


def _orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").withColumn("_shard", F.expr(f"(o_custkey - 1) * 8 div {_key_max(spark, sf_dir)}"))


def _lines(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").withColumn("_shard", F.expr(f"(l_orderkey - 1) * 8 div {_order_max(spark, sf_dir)}"))


def _lines_by_month(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").withColumn("_shard", F.year("l_shipdate") * 12 + F.month("l_shipdate"))


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").withColumn("_shard", F.dayofyear("ts"))


def _baskets(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"))).alias("items"))
    return _orders(spark, sf_dir).join(items, "o_orderkey").select("o_orderkey", "o_custkey", "items", "_shard")


SHARDS = {"orders": _orders, "lines": _lines, "months": _lines_by_month, "events": _events, "baskets": _baskets}


def _written(spark: SparkSession, rows: DataFrame, path: str) -> str:
    """One Parquet file for each ``_shard``: its folder.

    Tasks write what they read by shard; then a task for each shard puts those files together. So a shard's task reads
    compressed columns, no row is shuffled, and rows are sorted only where a task meets over 16 shards. Row groups are small,
    as a file's readers share it by row groups.
    """
    files, parts, groups = Files(spark), f"{path}-parts", ROW_GROUP
    with _settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "16", "spark.sql.unionOutputPartitioning": "false"}):
        rows.write.partitionBy("_shard").option("parquet.block.size", groups).option("compression", "zstd").parquet(parts)
        shards = [n for n in files.names(parts) if n.startswith("_shard=")]
        if all(len([f for f in files.names(f"{parts}/{n}") if f.endswith(".parquet")]) == 1 for n in shards):
            return parts
        plain, kind = rows.drop("_shard").schema, rows.schema["_shard"].dataType
        number = lambda n: F.lit(None if n.endswith("__HIVE_DEFAULT_PARTITION__") else int(n.removeprefix("_shard="))).cast(kind).alias("_shard")
        each = [spark.read.schema(plain).parquet(f"{parts}/{n}").coalesce(1).select("*", number(n)) for n in shards]
        reduce(DataFrame.unionAll, each).write.partitionBy("_shard").option("parquet.block.size", groups).parquet(path)
    files.delete(parts)
    return path


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for a block of work."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _sharded(spark: SparkSession, sf_dir: str, name: str) -> str:
    def make() -> str:
        return _written(spark, SHARDS[name](spark, sf_dir), f"{_root(spark, sf_dir)}/{name}")

    return _once(spark, "shards", sf_dir, name, make=make)


def _index(spark: SparkSession, sf_dir: str, kind: str, shards: str, define: Callable[[FileIndex], None]) -> FileIndex:
    def make() -> FileIndex:
        path = _sharded(spark, sf_dir, shards)
        schema = SHARDS[shards](spark, sf_dir).drop("_shard").schema
        index = FileIndex(spark, kind, schema, "parquet")
        define(index)
        index.add_file(path)
        index.update()
        return index

    _root(spark, sf_dir)
    return _once(spark, "index", sf_dir, kind, make=make)


def _by_customer(spark, sf_dir):
    return _index(spark, sf_dir, "orders_by_customer", "orders", lambda i: i.add_index("o_custkey"))


def _by_order(spark, sf_dir):
    def define(i):
        i.add_index("l_orderkey")
        i.add_index("l_partkey")
        i.add_bloom_index("l_suppkey", 0.01)

    return _index(spark, sf_dir, "lines_by_order", "lines", define)


def _by_date(spark, sf_dir):
    return _index(spark, sf_dir, "lines_by_date", "months", lambda i: i.add_range_index("l_shipdate"))


def _by_bloom(spark, sf_dir):
    return _index(spark, sf_dir, "lines_by_bloom", "lines", lambda i: i.add_bloom_index("l_orderkey", 0.01))


def _by_user(spark, sf_dir):
    def define(i):
        i.add_temporal_index("user_id", "ts")
        i.add_index("event_type")

    return _index(spark, sf_dir, "events_by_user", "events", define)


def _segment(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")


def _shard_numbers(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("filename", r"_shard=(\d+)", 1).cast("long").alias("shard")).distinct()


_OSHARD = "((o_custkey - 1) * 8 // (SELECT max(c_custkey) FROM customer))"
_SEGMENT = "(SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING')"
_LOCATED = f"(SELECT * FROM orders WHERE {_OSHARD} IN (SELECT {_OSHARD} FROM orders WHERE o_custkey IN (SELECT o_custkey FROM {_SEGMENT})))"


def _summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def regular_inner_join(spark, sf_dir):
    return _summed(_by_customer(spark, sf_dir).join(_segment(spark, sf_dir), "o_custkey"), "o_custkey", "c_name")


def df_left_inner_join(spark, sf_dir):
    return _summed(join_index(_segment(spark, sf_dir), _by_customer(spark, sf_dir), "o_custkey"), "o_custkey", "c_name")


def left_semi_df_left(spark, sf_dir):
    return join_index(_segment(spark, sf_dir), _by_customer(spark, sf_dir), "o_custkey", "left_semi")


def left_anti_df_left(spark, sf_dir):
    """Of twice the customers' keys, half of which are nobody's, those without orders."""
    twice = _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("o_custkey"), "c_name")
    return join_index(twice, _by_customer(spark, sf_dir), "o_custkey", "left_anti")


def left_outer_df_left(spark, sf_dir):
    return _summed(join_index(_segment(spark, sf_dir), _by_customer(spark, sf_dir), "o_custkey", "left"), "o_custkey", "c_name")


def right_outer_located(spark, sf_dir):
    return _summed(_by_customer(spark, sf_dir).join(_segment(spark, sf_dir), "o_custkey", "right"), "o_custkey", "c_name")


def full_outer_located(spark, sf_dir):
    return _summed(_by_customer(spark, sf_dir).join(_segment(spark, sf_dir), "o_custkey", "full"), "o_custkey", "c_name")


def full_outer_all(spark, sf_dir):
    return _summed(_by_customer(spark, sf_dir).join(_segment(spark, sf_dir), "o_custkey", "full", scope="all"), "o_custkey", "c_name")


def left_anti_index_left_located(spark, sf_dir):
    return _summed(_by_customer(spark, sf_dir).join(_segment(spark, sf_dir), "o_custkey", "left_anti"), "o_custkey")


def _pairs(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select("l_partkey", "l_suppkey").distinct()


def _lines_out(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def multi_key_and(spark, sf_dir):
    return _lines_out(_by_order(spark, sf_dir).join(_pairs(spark, sf_dir), ["l_partkey", "l_suppkey"]))


def partially_indexed_join(spark, sf_dir):
    asked = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select("l_orderkey", "l_linenumber")
    return _lines_out(_by_order(spark, sf_dir).join(asked, ["l_orderkey", "l_linenumber"]))


def bloom_inner_join(spark, sf_dir):
    asked = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _by_bloom(spark, sf_dir).join(asked, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def range_join(spark, sf_dir):
    asked = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderdate").alias("l_shipdate")).distinct()
    return _lines_out(_by_date(spark, sf_dir).join(F.broadcast(asked), "l_shipdate"))  # the days of a calendar: no more with more orders


def range_between_scan(spark, sf_dir):
    import datetime as d

    bounds = (d.datetime(1995, 3, 1), d.datetime(1995, 4, 15))
    return _lines_out(_by_date(spark, sf_dir).scan(between={"l_shipdate": bounds}))


def range_locate(spark, sf_dir):
    import datetime as d

    dates = [d.datetime(1995, 3, 11), d.datetime(1996, 8, 2), d.datetime(1999, 12, 31)]
    return _shard_numbers(_by_date(spark, sf_dir).locate({"l_shipdate": dates}))


def regular_locate(spark, sf_dir):
    return _shard_numbers(_by_customer(spark, sf_dir).locate({"o_custkey": list(range(1, 30))}))


def and_locate(spark, sf_dir):
    return _shard_numbers(_by_order(spark, sf_dir).locate({"l_orderkey": [1, 2, 3, 7], "l_partkey": list(range(1, 60))}))


def empty_locate(spark, sf_dir):
    return _shard_numbers(_by_customer(spark, sf_dir).locate({"o_custkey": [-1]}))


def temporal_locate(spark, sf_dir):
    return _shard_numbers(_by_user(spark, sf_dir).locate({"user_id": [1, 2, 3, 4, 5]}))


def _users(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("user_id").distinct()


def temporal_join(spark, sf_dir):
    return _by_user(spark, sf_dir).join(_users(spark, sf_dir), "user_id").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


def temporal_with_other_predicate(spark, sf_dir):
    asked = _users(spark, sf_dir).withColumn("event_type", F.lit("click"))
    return _by_user(spark, sf_dir).join(asked, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


def temporal_two_keys(spark, sf_dir):
    def define(i):
        i.add_temporal_index("user_id", "ts")
        i.add_temporal_index("event_type", "ts")

    index = _index(spark, sf_dir, "events_two_keys", "events", define)
    asked = _table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return index.join(asked, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


def computed_join(spark, sf_dir):
    index = _index(spark, sf_dir, "orders_by_month", "orders", lambda i: i.add_computed_index("month", "date_format(o_orderdate, 'yyyy-MM')"))
    asked = spark.createDataFrame([("1995-03",), ("1996-07",)], "month string")
    return _summed(index.join(asked, "month"), "month")


def exploded_join(spark, sf_dir):
    index = _index(spark, sf_dir, "baskets_by_part", "baskets", lambda i: i.add_exploded_field_index("items", "partkey", "p_partkey"))
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return index.join(parts, "p_partkey").groupBy("p_partkey", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("orders"))


def select_projection(spark, sf_dir):
    return _by_customer(spark, sf_dir).select("o_orderkey", "o_custkey").join(_segment(spark, sf_dir), "o_custkey")


def scan_eq(spark, sf_dir):
    return _by_customer(spark, sf_dir).scan({"o_custkey": [7]}).select("o_orderkey", "o_custkey", "o_orderstatus")


def scan_in(spark, sf_dir):
    return _by_customer(spark, sf_dir).scan({"o_custkey": [7, 11, 13]}, where="o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderstatus")


def scan_full(spark, sf_dir):
    return _summed(_by_customer(spark, sf_dir).scan(), "o_orderpriority")


def _view(spark, sf_dir) -> None:
    _by_customer(spark, sf_dir)
    IndexCatalog(spark).register("orders_by_customer", "fp_orders")
    _table(spark, sf_dir, "customer").createOrReplaceTempView("fp_customer")


def sql_view_join(spark, sf_dir):
    _view(spark, sf_dir)
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM fp_orders JOIN fp_customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


def sql_view_left_join(spark, sf_dir):
    _view(spark, sf_dir)
    return spark.sql("SELECT c_nationkey, count(o_orderkey) AS n FROM fp_customer LEFT JOIN fp_orders ON o_custkey = c_custkey GROUP BY c_nationkey")


def sql_view_theta(spark, sf_dir):
    _view(spark, sf_dir)
    return spark.sql("SELECT c_custkey, count(*) AS n FROM fp_orders JOIN fp_customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY c_custkey")


def stats(spark, sf_dir):
    return _by_order(spark, sf_dir).stats().withColumns({c: F.col(c).cast("double") for c in ("AvgValues", "StdDev")})


def _fresh(spark, sf_dir, kind: str) -> tuple[FileIndex, str]:
    """A new, empty index over order shards, as the queries of its life change it."""
    path = _sharded(spark, sf_dir, "orders")
    _root(spark, sf_dir)
    return FileIndex(spark, f"{kind}_{uuid.uuid4().hex}", SHARDS["orders"](spark, sf_dir).drop("_shard").schema, "parquet"), path


def incremental_update(spark, sf_dir):
    index, path = _fresh(spark, sf_dir, "incremental")
    index.add_index("o_custkey")
    for shard in (0, 1, 2):
        index.add_file(f"{path}/_shard={shard}")
        index.update()
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return _summed(index.join(keys, "o_custkey"), "o_orderstatus")


def backfill(spark, sf_dir):
    index, path = _fresh(spark, sf_dir, "backfill")
    index.add_index("o_custkey")
    index.add_file(path)
    index.update()
    index.add_index("o_orderpriority")
    index.update()
    return _shard_numbers(index.locate({"o_orderpriority": ["1-URGENT"], "o_custkey": [1, 2, 3]}))


def delete_files(spark, sf_dir):
    index, path = _fresh(spark, sf_dir, "delete")
    index.add_index("o_custkey")
    index.add_file(path)
    index.update()
    index.delete_files(f"{path}/_shard=0")
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return _summed(index.join(keys, "o_custkey"), "o_orderstatus")


def catalog_df(spark, sf_dir):
    _by_customer(spark, sf_dir)
    return IndexCatalog(spark).to_df().where("name = 'orders_by_customer'").drop("total_size")


def join_before_update(spark, sf_dir):
    index, path = _fresh(spark, sf_dir, "unbuilt")
    index.add_temporal_index("o_custkey", "o_orderdate")
    index.add_file(path)
    joined = join_index(_segment(spark, sf_dir), index, "o_custkey", "left")
    return joined.groupBy("c_name").agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("newest"))


def pending_backfill(spark, sf_dir):
    index, path = _fresh(spark, sf_dir, "pending")
    index.add_index("o_custkey")
    index.add_file(path)
    index.update()
    index.add_index("o_orderpriority")
    index.add_range_index("o_orderdate")
    asked = spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "o_orderpriority string")
    return _summed(index.join(asked, "o_orderpriority"), "o_orderpriority")


def scan_history(spark, sf_dir):
    return _by_user(spark, sf_dir).scan({"user_id": [1, 2, 3]}, latest=False).select("event_id", "user_id")


def scan_exploded(spark, sf_dir):
    index = _index(spark, sf_dir, "baskets_by_part", "baskets", lambda i: i.add_exploded_field_index("items", "partkey", "p_partkey"))
    return index.scan({"p_partkey": [3, 5, 8]}).select("o_orderkey", F.size("items").alias("n"))


def auto_bloom_locate(spark, sf_dir):
    key = "spark.fileprune.largeIndexLimit"
    spark.conf.set(key, "1")
    try:
        index, path = _fresh(spark, sf_dir, "auto_bloom")
        index.add_index("o_custkey")
        index.add_file(path)
        index.update()
    finally:
        spark.conf.unset(key)
    if index.metadata.auto_bloom != ["o_custkey"]:
        raise ValueError("no filters were built")
    return _shard_numbers(index.locate({"o_custkey": [7, 11, 13, 400]}))


def _sql(spark, sf_dir, view: str, query: str) -> DataFrame:
    """A query over a view, with the number of the view's files that it read."""
    catalog = IndexCatalog(spark)
    out = catalog.sql(query)
    return out.withColumn("files_read", F.lit(catalog.files_read(view)).cast("long"))


def sql_where_eq(spark, sf_dir):
    _view(spark, sf_dir)
    return _sql(spark, sf_dir, "fp_orders", "SELECT o_orderkey, o_orderstatus FROM fp_orders WHERE o_custkey = 7 AND o_totalprice > 1000")


def sql_where_in(spark, sf_dir):
    _view(spark, sf_dir)
    return _sql(spark, sf_dir, "fp_orders", f"SELECT o_custkey, count(*) AS n FROM fp_orders WHERE o_custkey IN ({', '.join(map(str, range(20, 40)))}) GROUP BY o_custkey")


def sql_where_range(spark, sf_dir):
    _by_date(spark, sf_dir)
    IndexCatalog(spark).register("lines_by_date", "fp_lines")
    return _sql(spark, sf_dir, "fp_lines", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM fp_lines WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-05-01' GROUP BY l_returnflag")


def sql_after_update(spark, sf_dir):
    """The view is registered before the index has its second half, and before that is indexed."""
    index, path = _fresh(spark, sf_dir, "growing")
    index.add_index("o_custkey")
    index.add_file(*(f"{path}/_shard={i}" for i in range(4)))
    index.update()
    view = f"fp_{index.name}"
    IndexCatalog(spark).register(index.name, view)
    index.add_file(path)
    index.update()
    return _sql(spark, sf_dir, view, f"SELECT o_orderstatus, count(*) AS n FROM {view} GROUP BY o_orderstatus")


def sql_join_pruned(spark, sf_dir):
    _view(spark, sf_dir)
    query = "SELECT o_custkey, c_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM fp_orders JOIN fp_customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 AND c_nationkey = 3 GROUP BY o_custkey, c_name"
    return _sql(spark, sf_dir, "fp_orders", query)


def sql_temporal_join(spark, sf_dir):
    """Three users, and a key that is nobody's at any size."""
    _by_user(spark, sf_dir)
    IndexCatalog(spark).register("events_by_user", "fp_events")
    spark.createDataFrame([(u,) for u in (1, 5, 9, -1)], "user_id long").createOrReplaceTempView("fp_asked")
    return IndexCatalog(spark).sql("SELECT event_id, user_id, event_type FROM fp_events JOIN fp_asked USING (user_id)")


def range_locate_many(spark, sf_dir):
    """More values than are held one by one: their least and greatest decide."""
    dates = _table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01'").select(F.col("o_orderdate").alias("l_shipdate"))
    return _shard_numbers(_by_date(spark, sf_dir).locate(dates))


def file_list_life(spark, sf_dir):
    path = _sharded(spark, sf_dir, "orders")
    _root(spark, sf_dir)
    files = FileList(spark, f"list_{uuid.uuid4().hex}")
    files.add_file(path, f"{path}/_shard=1")
    files.remove_file(f"{path}/_shard=0")
    if files.has_file(f"{path}/_shard=0") or not FileList.exists(spark, files.name):
        raise ValueError("the ledger is wrong")
    return _shard_numbers(files.files)


def unindexed_files(spark, sf_dir):
    index, path = _fresh(spark, sf_dir, "unindexed")
    index.add_index("o_custkey")
    index.add_file(f"{path}/_shard=2", f"{path}/_shard=5")
    index.update()
    index.add_file(path)
    return _shard_numbers(spark.createDataFrame([(f,) for f in sorted(index.unindexed_files())], "filename string"))


def compacted(spark, sf_dir):
    """Several updates, a deletion, compaction and vacuum, each by itself and on its own after two batches."""
    spark.conf.set("spark.fileprune.autoCompactThreshold", "2")
    try:
        index, path = _fresh(spark, sf_dir, "compacted")
        index.add_index("o_custkey")
        for shard in (0, 1, 2, 3):
            index.add_file(f"{path}/_shard={shard}")
            index.update()
    finally:
        spark.conf.unset("spark.fileprune.autoCompactThreshold")
    index.delete_files(f"{path}/_shard=2")
    index.compact()
    index.vacuum(0)
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return _summed(index.join(keys, "o_custkey"), "o_orderpriority")


def batched_update(spark, sf_dir):
    """Files are indexed in batches of few distinct values; statistics are those of the files."""
    conf = {"spark.fileprune.batchedUpdate": "true", "spark.fileprune.largeIndexLimit": "300"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        index, path = _fresh(spark, sf_dir, "batched")
        index.add_index("o_custkey")
        index.add_file(path)
        index.update()
    finally:
        for key in conf:
            spark.conf.unset(key)
    shard = F.regexp_extract("filename", r"_shard=(\d+)", 1).cast("long").alias("shard")
    return index.tables.stats().read().groupBy(shard).agg(F.sum("n_rows").alias("n"), F.sum("nd_o_custkey").alias("keys"))


def temporal_select(spark, sf_dir):
    """The timestamp that decides isn't selected."""
    return _by_user(spark, sf_dir).select("event_id", "user_id").join(_users(spark, sf_dir), "user_id")


def sql_temporal_scan(spark, sf_dir):
    _by_user(spark, sf_dir)
    IndexCatalog(spark).register("events_by_user", "fp_events")
    return IndexCatalog(spark).sql("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM fp_events GROUP BY event_type")


def streamed_update(spark, sf_dir):
    """An index that follows a stream of file names."""
    index, path = _fresh(spark, sf_dir, "streamed")
    index.add_index("o_custkey")
    place = f"{_root(spark, sf_dir)}/{index.name}"
    spark.createDataFrame([(f"{path}/_shard={i}",) for i in (1, 3, 6)], "value string").write.text(f"{place}/names")
    index_stream(index, spark.readStream.text(f"{place}/names"), "value", f"{place}/checkpoint").awaitTermination()
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return _summed(index.join(keys, "o_custkey"), "o_orderstatus")


def removed_index(spark, sf_dir):
    index, path = _fresh(spark, sf_dir, "removed")
    index.add_index("o_custkey")
    index.add_file(path)
    found = [FileIndex.exists(spark, index.name), IndexCatalog(spark).exists(index.name), index.name in IndexCatalog(spark).list(), index.name in IndexCatalog(spark).find_indexes(sorted(index.unindexed_files())[0])]
    FileIndex.remove(spark, index.name)
    return spark.createDataFrame([(all(found), FileIndex.exists(spark, index.name))], "before boolean, after boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        regular_inner_join, df_left_inner_join, left_semi_df_left, left_anti_df_left, left_outer_df_left, right_outer_located, full_outer_located, full_outer_all,
        left_anti_index_left_located, multi_key_and, partially_indexed_join, bloom_inner_join, range_join, range_between_scan, range_locate, regular_locate, and_locate,
        empty_locate, temporal_locate, temporal_join, temporal_with_other_predicate, temporal_two_keys, computed_join, exploded_join, select_projection, scan_eq, scan_in,
        scan_full, sql_view_join, sql_view_left_join, sql_view_theta, stats, incremental_update, backfill, delete_files, catalog_df,
        join_before_update, pending_backfill, scan_history, scan_exploded, auto_bloom_locate, sql_where_eq, sql_where_in, sql_where_range, sql_after_update, sql_join_pruned, sql_temporal_join,
        range_locate_many, file_list_life, unindexed_files, compacted, batched_update, temporal_select, sql_temporal_scan, streamed_update, removed_index,
    )
}

_SUM = "count(*) AS n, round(sum(o_totalprice), 2) AS total"
_LINES = "l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity"
_LSHARD = "((l_orderkey - 1) * 8 // (SELECT max(o_orderkey) FROM orders))"
_LATEST = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events)"

ORACLE_SQL: dict[str, str] = {
    "regular_inner_join": f"SELECT o_custkey, c_name, {_SUM} FROM orders JOIN {_SEGMENT} s USING (o_custkey) GROUP BY ALL",
    "df_left_inner_join": f"SELECT o_custkey, c_name, {_SUM} FROM {_SEGMENT} s JOIN orders USING (o_custkey) GROUP BY ALL",
    "left_semi_df_left": f"SELECT * FROM {_SEGMENT} s WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.o_custkey)",
    "left_anti_df_left": "SELECT c_custkey * 2 AS o_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey * 2)",
    "left_outer_df_left": f"SELECT o_custkey, c_name, {_SUM} FROM {_SEGMENT} s LEFT JOIN orders USING (o_custkey) GROUP BY ALL",
    "right_outer_located": f"SELECT o_custkey, c_name, {_SUM} FROM {_LOCATED} o RIGHT JOIN {_SEGMENT} s USING (o_custkey) GROUP BY ALL",
    "full_outer_located": f"SELECT o_custkey, c_name, {_SUM} FROM {_LOCATED} o FULL JOIN {_SEGMENT} s USING (o_custkey) GROUP BY ALL",
    "full_outer_all": f"SELECT o_custkey, c_name, {_SUM} FROM orders o FULL JOIN {_SEGMENT} s USING (o_custkey) GROUP BY ALL",
    "left_anti_index_left_located": f"SELECT o_custkey, {_SUM} FROM {_LOCATED} o WHERE o_custkey NOT IN (SELECT o_custkey FROM {_SEGMENT}) GROUP BY ALL",
    "multi_key_and": f"SELECT {_LINES} FROM lineitem l JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) p USING (l_partkey, l_suppkey)",
    "partially_indexed_join": f"SELECT {_LINES} FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) p USING (l_orderkey, l_linenumber)",
    "bloom_inner_join": "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') USING (l_orderkey) GROUP BY ALL",
    "range_join": f"SELECT {_LINES} FROM lineitem l WHERE l_shipdate IN (SELECT o_orderdate FROM orders WHERE o_orderstatus = 'P')",
    "range_between_scan": f"SELECT {_LINES} FROM lineitem l WHERE l_shipdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-04-15'",
    "range_locate": "WITH r AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS shard, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1) SELECT DISTINCT shard FROM r JOIN (VALUES (TIMESTAMP '1995-03-11'), (TIMESTAMP '1996-08-02'), (TIMESTAMP '1999-12-31')) v (t) ON t BETWEEN a AND b",
    "regular_locate": f"SELECT DISTINCT {_OSHARD}::BIGINT AS shard FROM orders WHERE o_custkey BETWEEN 1 AND 29",
    "and_locate": f"SELECT DISTINCT {_LSHARD}::BIGINT AS shard FROM lineitem WHERE l_orderkey IN (1, 2, 3, 7) INTERSECT SELECT DISTINCT {_LSHARD}::BIGINT AS shard FROM lineitem WHERE l_partkey BETWEEN 1 AND 59",
    "empty_locate": f"SELECT DISTINCT {_OSHARD}::BIGINT AS shard FROM orders WHERE o_custkey = -1",
    "temporal_locate": "SELECT DISTINCT dayofyear(t)::BIGINT AS shard FROM (SELECT user_id, max(ts) AS t FROM events WHERE user_id BETWEEN 1 AND 5 GROUP BY 1)",
    "temporal_join": f"SELECT event_id, user_id, event_type, round(value, 4) AS value FROM {_LATEST} WHERE k = 1",
    "temporal_with_other_predicate": f"SELECT event_id, user_id, event_type FROM {_LATEST} WHERE k = 1 AND event_type = 'click'",
    "temporal_two_keys": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS j FROM events) WHERE k = 1 AND j = 1",
    "computed_join": f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {_SUM} FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1995-03', '1996-07') GROUP BY ALL",
    "exploded_join": "SELECT p_partkey, p_brand, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "select_projection": f"SELECT o_custkey, o_orderkey, c_name FROM orders JOIN {_SEGMENT} s USING (o_custkey)",
    "scan_eq": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7",
    "scan_in": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (7, 11, 13) AND o_orderstatus = 'O'",
    "scan_full": f"SELECT o_orderpriority, {_SUM} FROM orders GROUP BY ALL",
    "sql_view_join": f"SELECT c_mktsegment, {_SUM} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "sql_view_left_join": "SELECT c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "sql_view_theta": "SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY ALL",
    "stats": f"""WITH d AS (SELECT {_LSHARD} AS shard, count(DISTINCT l_orderkey) AS a, count(DISTINCT l_partkey) AS b FROM lineitem GROUP BY 1), u AS (SELECT 'l_orderkey' AS "Column", a AS n FROM d UNION ALL SELECT 'l_partkey', b FROM d)
        SELECT "Column", count(*) AS "FileCount", min(n)::INT AS "MinValues", max(n)::INT AS "MaxValues", round(avg(n), 1) AS "AvgValues", quantile_disc(n, 0.5)::INT AS "MedianValues", round(stddev_samp(n), 1) AS "StdDev" FROM u GROUP BY 1""",
    "incremental_update": f"SELECT o_orderstatus, {_SUM} FROM orders WHERE {_OSHARD} IN (0, 1, 2) GROUP BY ALL",
    "backfill": f"SELECT DISTINCT {_OSHARD}::BIGINT AS shard FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT DISTINCT {_OSHARD}::BIGINT AS shard FROM orders WHERE o_custkey IN (1, 2, 3)",
    "delete_files": f"SELECT o_orderstatus, {_SUM} FROM orders WHERE {_OSHARD} <> 0 GROUP BY ALL",
    "catalog_df": f"""SELECT 'orders_by_customer' AS name, 'parquet' AS format, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns, 'o_custkey' AS indexes, '' AS bloom, '' AS "range", '' AS temporal, '' AS computed, '' AS exploded, count(DISTINCT {_OSHARD}) AS file_count FROM orders""",
    "join_before_update": f"SELECT c_name, 0::BIGINT AS n, NULL::TIMESTAMP AS newest FROM {_SEGMENT} s GROUP BY ALL",
    "pending_backfill": f"SELECT o_orderpriority, {_SUM} FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL",
    "scan_history": "SELECT event_id, user_id FROM events WHERE user_id IN (1, 2, 3)",
    "scan_exploded": "SELECT o_orderkey, count(*)::INT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING bool_or(l_partkey IN (3, 5, 8))",
    "auto_bloom_locate": f"SELECT DISTINCT {_OSHARD}::BIGINT AS shard FROM orders WHERE o_custkey IN (7, 11, 13, 400)",
    "sql_where_eq": f"SELECT o_orderkey, o_orderstatus, (SELECT count(DISTINCT {_OSHARD}) FROM orders WHERE o_custkey = 7) AS files_read FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000",
    "sql_where_in": f"SELECT o_custkey, count(*) AS n, (SELECT count(DISTINCT {_OSHARD}) FROM orders WHERE o_custkey BETWEEN 20 AND 39) AS files_read FROM orders WHERE o_custkey BETWEEN 20 AND 39 GROUP BY o_custkey",
    "sql_where_range": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, 2::BIGINT AS files_read FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-05-01' GROUP BY ALL",
    "sql_after_update": f"SELECT o_orderstatus, count(*) AS n, (SELECT count(DISTINCT {_OSHARD}) FROM orders) AS files_read FROM orders GROUP BY o_orderstatus",
    "sql_join_pruned": f"""WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 AND c_nationkey = 3)
        SELECT o_custkey, c_name, {_SUM}, (SELECT count(DISTINCT {_OSHARD}) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) AS files_read FROM orders JOIN c ON o_custkey = c_custkey GROUP BY ALL""",
    "sql_temporal_join": f"SELECT event_id, user_id, event_type FROM {_LATEST} WHERE k = 1 AND user_id IN (1, 5, 9)",
    "range_locate_many": "WITH r AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS shard, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1) SELECT shard FROM r WHERE b >= (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') AND a <= (SELECT max(o_orderdate) FROM orders)",
    "file_list_life": f"SELECT DISTINCT {_OSHARD}::BIGINT AS shard FROM orders WHERE {_OSHARD} <> 0",
    "unindexed_files": f"SELECT DISTINCT {_OSHARD}::BIGINT AS shard FROM orders WHERE {_OSHARD} NOT IN (2, 5)",
    "compacted": f"SELECT o_orderpriority, {_SUM} FROM orders WHERE {_OSHARD} IN (0, 1, 3) GROUP BY ALL",
    "batched_update": f"SELECT {_OSHARD}::BIGINT AS shard, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1",
    "temporal_select": f"SELECT event_id, user_id FROM {_LATEST} WHERE k = 1",
    "sql_temporal_scan": f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {_LATEST} WHERE k = 1 GROUP BY ALL",
    "streamed_update": f"SELECT o_orderstatus, {_SUM} FROM orders WHERE {_OSHARD} IN (1, 3, 6) GROUP BY ALL",
    "removed_index": "SELECT true AS before, false AS after",
}
