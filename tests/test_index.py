"""The index against small files with known answers."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileprune import FileIndex, FileList, IndexCatalog, errors, join_index
from fileprune.functions.schema import field_exists, field_type
from fileprune.operators import build, locate
from fileprune.plans.metadata import STORAGE_VERSION, IndexMetadata
from fileprune.plans.planner import byte_batches, create_batches
from fileprune.sources.lock import IndexLock
from fileprune.sources.paths import clean_file_name, validated

TABLE1 = T.StructType().add("Id", "integer").add("Version", "integer").add("Value", "double")
TEMPORAL = T.StructType().add("Id", "integer").add("Value", "double").add("UpdatedAt", "timestamp")


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture()
def parts(storage):
    return [put(storage / "da ta" / "part0.csv", "Id,Version,Value\n1,1,5.0\n2,1,3.0\n3,1,4.0\n1,2,4.5\n"), put(storage / "da ta" / "part1.csv", "Id,Version,Value\n4,1,2.0\n4,2,9.0\n3,2,4.0\n1,3,5.0\n")]


def index_of(spark, parts, define, schema=TABLE1, name="t"):
    index = FileIndex(spark, name, schema, "csv", {"header": "true"})
    define(index)
    index.add_file(*parts)
    index.update()
    return index


def names(found):
    return {f.rsplit("/", 1)[1] for f in found}


def test_regular_and_semantics(spark, parts):
    index = index_of(spark, parts, lambda i: (i.add_index("Id"), i.add_index("Version")))
    assert names(index.locate_files({"Id": [4], "Version": [1]})) == {"part1.csv"}
    assert index.locate_files({"Id": [2], "Version": [3]}) == set() == index.locate_files({})
    asked = spark.createDataFrame([(1, 3)], "Id int, Version int")
    assert index.join(asked, ["Version", "Id"], "left_semi").count() == 1
    assert index.join(asked, ["Version"], "fullouter").count() == 4
    assert index.join(asked, ["Version", "Id"], "fullouter").count() == 4
    assert index.join(asked, ["Id"], "fullouter", scope="all").count() == 8
    assert join_index(asked, index, "Id").columns[0] == "Id"
    assert index.last_report.files_total == 2
    assert index.select("Id", "Value").join(asked, "Id").columns == ["Id", "Value", "Version"]
    with pytest.raises(errors.ColumnNotFoundException):
        index.locate_files({"Value": [1]})
    with pytest.raises(ValueError):
        index.join(spark.createDataFrame([(5.0,)], "Value double"), "Value")
    assert index.join(spark.createDataFrame([(99, 1)], "Id int, x int"), "Id").columns == ["Id", "Version", "Value", "x"]


def test_bloom_range_and_backfill(spark, parts):
    index = index_of(spark, parts, lambda i: (i.add_bloom_index("Id"), i.add_range_index("Version")))
    assert index.locate_files({"Id": [999]}) == set()
    assert names(index.locate_files({"Id": [2]})) == {"part0.csv"}
    assert names(index.locate_files({"Version": [3]})) == {"part1.csv"}
    assert names(index.locate_files(spark.range(5, 6).select(F.col("id").cast("int").alias("Version")))) == set()
    index.add_index("Value")
    assert index.columns_to_backfill() == {"Value"}
    index.update()
    assert names(index.locate_files({"Value": [4.5]})) == {"part0.csv"} and index.locate_files({"Value": [-1.0]}) == set()
    assert index.scan(between={"Version": (2, None)}).count() == 4


def test_many_range_values(spark, parts):
    index = index_of(spark, parts, lambda i: i.add_range_index("Id"))
    values = spark.range(4, 5000).select(F.col("id").cast("int").alias("Id"))
    assert names(index.locate_files(values)) == {"part1.csv"}


@pytest.fixture()
def versions(storage):
    return [
        put(storage / "v0.csv", "Id,Value,UpdatedAt\n" + "".join(f"{i},{i}00,2024-01-15 10:00:00\n" for i in (1, 2, 3, 4))),
        put(storage / "v1.csv", "Id,Value,UpdatedAt\n1,150,2024-06-15 12:00:00\n2,250,2024-03-15 11:00:00\n5,500,2024-06-15 12:00:00\n"),
    ]


def test_temporal(spark, versions):
    index = index_of(spark, versions, lambda i: i.add_temporal_index("Id", "UpdatedAt"), TEMPORAL)
    assert names(index.locate_files({"Id": [1]})) == {"v1.csv"} and names(index.locate_files({"Id": [3]})) == {"v0.csv"}
    got = {r.Id: r.Value for r in index.join(spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "Id int"), "Id").collect()}
    assert got == {1: 150.0, 2: 250.0, 3: 300.0, 5: 500.0}
    assert index.scan().count() == 5
    assert index.select("Id", "Value").join(spark.createDataFrame([(1,)], "Id int"), "Id").collect() == [(1, 150.0)]
    IndexCatalog(spark).register("t", "latest_versions")
    assert spark.sql("select sum(Value) from latest_versions").first()[0] == 150 + 250 + 300 + 400 + 500


def test_latest_is_global(spark, storage):
    a, b = put(storage / "a.csv", "Id,Kind,At\n1,x,2024-01-01 00:00:00\n"), put(storage / "b.csv", "Id,Kind,At\n1,y,2024-02-01 00:00:00\n")
    index = index_of(spark, [a, b], lambda i: (i.add_temporal_index("Id", "At"), i.add_index("Kind")), T.StructType.fromDDL("Id int, Kind string, At timestamp"))
    assert index.join(spark.createDataFrame([(1, "x")], "Id int, Kind string"), ["Id", "Kind"]).count() == 0


def test_null_timestamp_is_oldest(spark, storage):
    a, b = put(storage / "a.csv", "Id,Value,UpdatedAt\n1,100,\n"), put(storage / "b.csv", "Id,Value,UpdatedAt\n1,150,2024-06-15 12:00:00\n")
    index = index_of(spark, [a, b], lambda i: i.add_temporal_index("Id", "UpdatedAt"), TEMPORAL)
    assert [r.Value for r in index.join(spark.createDataFrame([(1,)], "Id int"), "Id").collect()] == [150.0]


def test_computed_and_exploded(spark, storage):
    cats = [put(storage / "c0.csv", "Id,Value\ncat1_1,5\ncat1_2,3\ncat2_1,4\ncat2_2,4.5\n"), put(storage / "c1.csv", "Id,Value\ncat1_3,8\ncat3_1,9\ncat4_1,2\ncat4_2,7.5\n")]
    index = index_of(spark, cats, lambda i: (i.add_computed_index("Category", "substring(Id, 1, 4)"), i.add_index("Id")), T.StructType.fromDDL("Id string, Value double"))
    assert index.join(spark.createDataFrame([("cat1", "Ok")], "Category string, Status string"), "Category").count() == 3
    assert index.join(spark.createDataFrame([("cat4", "Bad")], "Category string, Status string"), "Category").count() == 2
    assert index.scan().columns == ["Id", "Value"]
    path = put(storage / "e.json", "\n".join(json.dumps(x) for x in [{"event": "a", "users": [{"id": 1, "role": "x"}, {"id": 2, "role": "y"}]}, {"event": "b", "users": [{"id": 2, "role": "z"}]}, {"event": "c", "users": []}]))
    events = FileIndex(spark, "e", T.StructType.fromDDL("event string, users array<struct<id:bigint,role:string>>"), "json")
    events.add_exploded_field_index("users", "id", "user_id")
    events.add_exploded_field_index("users", "role", "role")
    events.add_file(path)
    events.update()
    assert events.join(spark.createDataFrame([(2,)], "user_id long"), "user_id").count() == 2
    assert events.scan().count() == 3
    with pytest.raises(errors.ColumnNotFoundException):
        events.add_exploded_field_index("users", "nope", "other")


def test_one_kind_for_a_column(spark, storage):
    schema = T.StructType.fromDDL("a int, at timestamp, items array<struct<id:int>>")
    add = {
        "regular": lambda i: i.add_index("a"), "bloom": lambda i: i.add_bloom_index("a"), "range": lambda i: i.add_range_index("a"), "temporal": lambda i: i.add_temporal_index("a", "at"),
        "computed": lambda i: i.add_computed_index("a", "1"), "exploded": lambda i: i.add_exploded_field_index("items", "id", "a"),
    }
    for first in add:
        index = FileIndex(spark, f"kind_{first}", schema, "parquet")
        add[first](index)
        add[first](index)
        for second in add:
            if second != first:
                with pytest.raises(ValueError):
                    add[second](index)
    for bad in (None, " ", "filename", "a.b"):
        with pytest.raises(ValueError):
            index.add_index(bad)
    with pytest.raises(errors.ColumnNotFoundException):
        index.add_index("nope")


def test_life(spark, parts):
    index = index_of(spark, parts[:1], lambda i: i.add_index("Id"))
    assert index.unindexed_files() == set() and index.update() == 0
    index.add_file(parts[1], parts[1])
    assert names(index.unindexed_files()) == {"part1.csv"} and index.update() == 1
    total = index.metadata.total_size
    index.compact()
    index.vacuum(0)
    assert names(index.locate_files({"Id": [1]})) == {"part0.csv", "part1.csv"}
    index.delete_files(parts[0])
    assert names(index.locate_files({"Id": [1]})) == {"part1.csv"} and not index.has_file(parts[0]) and index.has_file(parts[1])
    assert 0 < index.metadata.total_size < total
    assert index.stats().collect()[0].asDict()["MaxValues"] == 3
    assert FileIndex(spark, "t").indexes == {"Id"}
    assert FileIndex.remove(spark, "t") and not FileIndex.exists(spark, "t")
    with pytest.raises(errors.IndexNotFoundException):
        FileIndex.remove(spark, "t")


def test_reopening(spark, storage):
    with pytest.raises(errors.SchemaNotProvidedException):
        FileIndex(spark, "new")
    with pytest.raises(errors.MissingFormatException):
        FileIndex(spark, "new", TABLE1)
    index = FileIndex(spark, "new", TABLE1, "csv")
    index.add_index("Id")
    with pytest.raises(errors.FormatMismatchException):
        FileIndex(spark, "new", format="json")
    other = T.StructType.fromDDL("Key int")
    with pytest.raises(errors.SchemaMismatchException):
        FileIndex(spark, "new", other)
    with pytest.raises(errors.IndexNotFoundInNewSchemaException):
        FileIndex(spark, "new", other, allow_schema_mismatch=True)
    assert FileIndex(spark, "new", T.StructType.fromDDL("Id int, x int"), allow_schema_mismatch=True).schema.names == ["Id", "x"]


def test_catalog(spark, parts):
    index_of(spark, parts, lambda i: i.add_index("Id"), name="one")
    catalog = IndexCatalog(spark)
    assert catalog.list() == ["one"] and catalog.exists("one") and not catalog.exists("two")
    assert catalog.describe("one").file_count == 2 and catalog.find_indexes(parts[0]) == ["one"]
    assert catalog.to_df().count() == 1 and catalog.register_all("v_") == ["v_one"]
    assert spark.sql("select * from v_one where Id in (1, 2)").count() == 4
    assert catalog.remove("one") and catalog.list() == []


def test_batches_and_auto_bloom(spark, parts):
    assert create_batches({"a": {"x": 5}, "b": {"x": 4}, "c": {"x": 1}, "d": {"x": 20}}, 10) == [["d"], ["a", "b", "c"]]
    assert create_batches({"a": {}, "b": {}}, 10) == [["a", "b"]] and create_batches({}, 1) == []
    spark.conf.set("spark.fileprune.largeIndexLimit", "1")
    spark.conf.set("spark.fileprune.batchedUpdate", "true")
    try:
        index = index_of(spark, parts, lambda i: i.add_index("Id"))
        assert index.metadata.auto_bloom == ["Id"] and index.metadata.batches_since_compact == 2
        assert [len(index.locate_files({"Id": [i]})) for i in (2, 3, 4)] == [1, 2, 1]
    finally:
        spark.conf.unset("spark.fileprune.largeIndexLimit")
        spark.conf.unset("spark.fileprune.batchedUpdate")


def test_lock(spark, storage):
    path = str(storage / "x.lock")
    one, two = IndexLock(spark, path), IndexLock(spark, path)
    spark.conf.set("spark.fileprune.lockMaxWait", "0")
    try:
        with one.held():
            assert one.refresh(strict=True)
            with pytest.raises(errors.IndexLockException):
                two.acquire()
            assert not two.refresh()
        (storage / "x.lock").write_text("broken")
        two.acquire()
        two.release()
        assert not (storage / "x.lock").exists()
    finally:
        spark.conf.unset("spark.fileprune.lockMaxWait")


def test_small_things(spark, storage):
    schema = T.StructType.fromDDL("a struct<b:int>, c array<struct<d:int>>")
    assert field_exists(schema, "a.b") and not field_exists(schema, "c.d") and field_type(schema, "x") is None
    assert clean_file_name("__a b/c--") == "a_b_c"
    for bad in ("", ".x", "a/b", "a..b", None):
        with pytest.raises(ValueError):
            validated(bad)
    assert IndexMetadata.parse('{"format": "csv", "schema": "{}"}').indexes == []
    with pytest.raises(errors.MetadataMissingOrCorruptException):
        IndexMetadata.parse('{"format": "csv"}')
    with pytest.raises(errors.UnsupportedMetadataVersionException):
        IndexMetadata.parse('{"format": "csv", "schema": "{}", "metadata_version": 99}')
    with pytest.raises(errors.FileListNotFoundException):
        FileList.remove(spark, "nothing")


def test_pruned_join_is_the_join(spark, storage):
    """Random shards: an inner join by way of the index gives what the join of everything gives, and blooms lose nothing."""
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(8), i) for i in range(400)]
    folder = str(storage / "rows")
    spark.createDataFrame(rows, "k int, b int, v int").withColumn("shard", F.col("k") % 7).repartition("shard").write.partitionBy("shard").parquet(folder)
    index = FileIndex(spark, "random", T.StructType.fromDDL("k int, b int, v int"), "parquet")
    index.add_bloom_index("k", 0.1)
    index.add_index("b")
    index.add_file(folder)
    index.update()
    for _ in range(3):
        keys = {(rng.randrange(45), rng.randrange(9)) for _ in range(6)}
        got = index.join(spark.createDataFrame(list(keys), "k int, b int"), ["k", "b"]).select("k", "b", "v").collect()
        assert sorted(map(tuple, got)) == sorted(r for r in rows if r[:2] in keys)


def test_stream_of_files(spark, parts, storage):
    from fileprune.streaming.incremental import index_stream

    listing = storage / "listing"
    put(listing / "a.txt", "\n".join(parts))
    index = FileIndex(spark, "streamed", TABLE1, "csv", {"header": "true"})
    index.add_index("Id")
    query = index_stream(index, spark.readStream.text(str(listing)), "value", str(storage / "ckpt"))
    query.awaitTermination()
    assert names(index.locate_files({"Id": [4]})) == {"part1.csv"}


def test_history_is_scanned_in_all_files(spark, versions):
    index = index_of(spark, versions, lambda i: i.add_temporal_index("Id", "UpdatedAt"), TEMPORAL)
    assert sorted(r.Value for r in index.scan({"Id": [1]}, latest=False).collect()) == [100.0, 150.0]
    assert [r.Value for r in index.scan({"Id": [1]}).collect()] == [150.0]


def test_temporal_before_update(spark, versions):
    index = FileIndex(spark, "t", TEMPORAL, "csv", {"header": "true"})
    index.add_index("Value")
    index.add_file(*versions)
    index.update()
    index.add_temporal_index("Id", "UpdatedAt")
    asked = spark.createDataFrame([(1,), (9,)], "Id int")
    assert [r.Value for r in index.join(asked, "Id").collect()] == [150.0]
    assert index.scan().count() == 5
    fresh = FileIndex(spark, "fresh", TEMPORAL, "csv", {"header": "true"})
    fresh.add_temporal_index("Id", "UpdatedAt")
    got = fresh.join(asked, "Id")
    assert got.columns == ["Id", "Value", "UpdatedAt"] and got.count() == 0
    assert fresh.join(asked, "Id", "right").count() == 2


def test_unindexed_versions_count(spark, versions, storage):
    """A scan reads files that aren't indexed yet, and a later version there is the latest."""
    index = index_of(spark, versions, lambda i: i.add_temporal_index("Id", "UpdatedAt"), TEMPORAL)
    index.add_file(put(storage / "v2.csv", "Id,Value,UpdatedAt\n1,170,2025-01-01 00:00:00\n2,1,2020-01-01 00:00:00\n"))
    assert {r.Id: r.Value for r in index.scan().collect()} == {1: 170.0, 2: 250.0, 3: 300.0, 4: 400.0, 5: 500.0}


def test_pending_columns_prune_nothing(spark, parts):
    index = index_of(spark, parts, lambda i: i.add_index("Id"))
    index.add_index("Version")
    index.add_range_index("Value")
    assert names(index.locate_files({"Version": [3]})) == {"part0.csv", "part1.csv"}
    assert index.join(spark.createDataFrame([(3,)], "Version int"), "Version").count() == 1
    assert index.join(spark.createDataFrame([(9.0,)], "Value double"), "Value").count() == 1
    assert index.scan(between={"Value": (8.0, None)}).count() == 1
    assert names(index.locate_files({"Id": [2], "Version": [3]})) == {"part0.csv"}


def test_repartitioned_sources(spark, parts):
    spark.conf.set("spark.fileprune.repartitionDataFiles", "true")
    try:
        index = index_of(spark, parts, lambda i: i.add_index("Id"))
        assert index.join(spark.createDataFrame([(1,)], "Id int"), "Id").count() == 3
    finally:
        spark.conf.unset("spark.fileprune.repartitionDataFiles")


def test_a_stale_handle_reverts_nothing(spark, parts):
    old = index_of(spark, parts, lambda i: i.add_index("Id"))
    new = FileIndex(spark, "t")
    new.add_index("Version")
    new.update()
    old.delete_files(parts[0])
    old.compact()
    old.add_range_index("Value")
    assert FileIndex(spark, "t").indexes == {"Id", "Version", "Value"} == old.indexes
    assert set(FileIndex(spark, "t").metadata.built) == {"Id", "Version"}
    assert names(FileIndex(spark, "t").locate_files({"Version": [2]})) == {"part1.csv"}


def test_scan_by_an_element(spark, storage):
    path = put(storage / "e.json", "\n".join(json.dumps(x) for x in [{"event": "a", "users": [{"id": 1}, {"id": 2}]}, {"event": "b", "users": [{"id": 3}]}, {"event": "c"}]))
    index = FileIndex(spark, "e", T.StructType.fromDDL("event string, users array<struct<id:bigint>>"), "json")
    index.add_exploded_field_index("users", "id", "user_id")
    index.add_computed_index("upper_event", "upper(event)")
    index.add_file(path)
    index.update()
    assert [r.event for r in index.scan({"user_id": [2, 9]}).collect()] == ["a"]
    assert [r.event for r in index.scan({"upper_event": ["B"]}).collect()] == ["b"]


def test_a_file_read_again_loses_its_old_values(spark, storage):
    """A value that a file doesn't have any more goes when the file is indexed again, also if nothing takes its place."""
    a, b = put(storage / "a.csv", "Id,Value,UpdatedAt\n1,100,2025-01-01 00:00:00\n"), put(storage / "b.csv", "Id,Value,UpdatedAt\n1,150,2024-06-15 12:00:00\n")
    index = index_of(spark, [a, b], lambda i: i.add_temporal_index("Id", "UpdatedAt"), TEMPORAL)
    (storage / "a.csv").write_text("Id,Value,UpdatedAt\n,100,2025-01-01 00:00:00\n")
    spark.catalog.clearCache()
    index.add_index("Value")  # its backfill reads all files again
    index.update()
    assert [r.Value for r in index.join(spark.createDataFrame([(1,)], "Id int"), "Id").collect()] == [150.0]


def test_a_join_of_other_types_finds_what_the_join_finds(spark, storage):
    path = [put(storage / "s0.csv", "Code,Value\n05,1\n7,2\n"), put(storage / "s1.csv", "Code,Value\n8,3\n")]
    schema = T.StructType.fromDDL("Code string, Value double")
    for define in (lambda i: i.add_index("Code"), lambda i: i.add_bloom_index("Code"), lambda i: i.add_range_index("Code")):
        index = index_of(spark, path, define, schema, name=f"s{random.random()}".replace(".", ""))
        assert index.join(spark.createDataFrame([(5,)], "Code int"), "Code").count() == 1
        assert index.join(spark.createDataFrame([("7",)], "Code string"), "Code").count() == 1


def test_recovery_of_a_failed_update(spark, parts, monkeypatch):
    """What a failed update had finished isn't done again, and nothing of it is seen before the files are indexed."""
    from fileprune.operators import build

    index = FileIndex(spark, "t", TABLE1, "csv", {"header": "true"})
    index.add_index("Id")
    index.add_index("Version")
    index.add_file(*parts)
    seen, plain = [], build.values_of

    def failing(rows, meta, column):
        seen.append(column)
        if column == "Version" and seen.count("Version") == 1:
            raise RuntimeError("lost")
        return plain(rows, meta, column)

    monkeypatch.setattr(build, "values_of", failing)
    with pytest.raises(RuntimeError):
        index.update()
    assert index.locate_files({"Id": [1]}) == set() and names(index.unindexed_files()) == {"part0.csv", "part1.csv"}
    assert index.update() == 2 and seen == ["Id", "Version", "Version"]
    assert names(index.locate_files({"Id": [4], "Version": [2]})) == {"part1.csv"}
    assert not index.files.names(f"{index.path}/staging")


def test_auto_bloom_narrows_and_loses_nothing(spark, parts):
    spark.conf.set("spark.fileprune.largeIndexLimit", "3")
    try:
        index = index_of(spark, parts[:1], lambda i: (i.add_index("Id"), i.add_index("Version")))
        assert index.metadata.auto_bloom == ["Id"]
        index.add_file(parts[1])
        index.update()
        assert [len(index.locate_files({"Id": [i]})) for i in (1, 2, 3, 4, 9)] == [2, 1, 2, 1, 0]
    finally:
        spark.conf.unset("spark.fileprune.largeIndexLimit")


def read_by(spark, query, view):
    catalog = IndexCatalog(spark)
    rows = sorted(map(tuple, catalog.sql(query).collect()))
    assert catalog.report(view).files <= catalog.files_read(view)  # files that aren't indexed yet are read too
    return rows, catalog.files_read(view)


def test_sql_prunes(spark, parts, storage):
    index = index_of(spark, parts, lambda i: (i.add_index("Id"), i.add_range_index("Version"), i.add_bloom_index("Value")))
    IndexCatalog(spark).register("t", "pruned")
    spark.createDataFrame([(2, "two"), (77, "none")], "key int, label string").createOrReplaceTempView("labels_of")
    everything = sorted(map(tuple, index.scan().collect()))
    for condition, files in [
        ("Id = 2", 1), ("2 = Id", 1), ("Id IN (2, 4)", 2), ("Id IN (2, 4) AND Version = 1 AND Id < 3", 2), ("Version > 2", 1), ("3 <= Version", 1), ("Version < 2 AND Id = 4", 1), ("Value = 9.0", 1),
        ("Id = 2 OR Version = 3", 2), ("NOT Id = 2", 2), ("Id = 99", 0), ("abs(Id) = 2", 2),
    ]:
        got, read = read_by(spark, f"SELECT * FROM pruned WHERE {condition}", "pruned")
        want = sorted(map(tuple, index.scan(where=condition).collect()))
        assert (condition, got, read) == (condition, want, files)
    assert read_by(spark, "SELECT label, Value FROM pruned JOIN labels_of ON Id = key", "pruned") == ([("two", 3.0)], 1)
    assert read_by(spark, "SELECT label, Value FROM labels_of LEFT JOIN pruned ON Id = key", "pruned") == ([("none", None), ("two", 3.0)], 1)
    assert read_by(spark, "SELECT count(*) FROM pruned LEFT JOIN labels_of ON Id = key", "pruned") == ([(8,)], 2)
    assert read_by(spark, "SELECT count(*) FROM pruned FULL JOIN labels_of ON Id = key", "pruned") == ([(9,)], 2)
    assert read_by(spark, "SELECT Id FROM pruned WHERE Id IN (SELECT key FROM labels_of)", "pruned") == ([(2,)], 1)
    assert read_by(spark, "SELECT count(*) FROM pruned WHERE Id NOT IN (SELECT key FROM labels_of)", "pruned") == ([(7,)], 2)
    assert read_by(spark, "SELECT a.Id FROM pruned a JOIN pruned b ON a.Id = b.Id AND a.Version = b.Version WHERE b.Version = 3", "pruned")[0] == [(1,)]
    assert read_by(spark, "SELECT Id, c FROM (SELECT Id, count(*) AS c FROM pruned GROUP BY Id) WHERE Id = 1", "pruned")[0] == [(1, 3)]
    assert read_by(spark, "SELECT * FROM (SELECT * FROM pruned ORDER BY Version DESC LIMIT 1) WHERE Id = 2", "pruned") == ([], 2)
    assert sorted(map(tuple, spark.sql("SELECT * FROM pruned").collect())) == everything


def test_sql_follows_the_ledger(spark, versions, storage):
    index = index_of(spark, versions, lambda i: (i.add_temporal_index("Id", "UpdatedAt"), i.add_index("Value")), TEMPORAL)
    IndexCatalog(spark).register("t", "now")
    index.add_file(put(storage / "v2.csv", "Id,Value,UpdatedAt\n1,170,2025-01-01 00:00:00\n8,1,2020-01-01 00:00:00\n"))
    assert read_by(spark, "SELECT Id, Value FROM now WHERE Id IN (1, 8)", "now")[0] == [(1, 170.0), (8, 1.0)]
    index.update()
    assert read_by(spark, "SELECT Id, Value FROM now WHERE Id IN (1, 8)", "now") == ([(1, 170.0), (8, 1.0)], 1)
    assert read_by(spark, "SELECT Id FROM now WHERE Value = 100.0", "now")[0] == []  # a version that isn't the latest
    spark.createDataFrame([(3,)], "key int").createOrReplaceTempView("asked_key")
    assert read_by(spark, "SELECT Value FROM now JOIN asked_key ON Id = key", "now") == ([(300.0,)], 1)


def test_storage_of_earlier_versions(spark, storage):
    """File sizes that weren't kept are filled in, an exploded field's values move under the alias, unknown entries stay."""
    path = put(storage / "e.json", "\n".join(json.dumps(x) for x in [{"event": "a", "users": [{"id": 1}, {"id": 2}]}, {"event": "b", "users": [{"id": 3}]}]))
    index = FileIndex(spark, "e", T.StructType.fromDDL("event string, users array<struct<id:bigint>>"), "json")
    index.add_exploded_field_index("users", "id", "user_id")
    index.add_file(path)
    index.update()
    stats = index.tables.stats()
    stats.overwrite(stats.read().withColumn("file_size", F.lit(None).cast("long")))
    postings = storage / "storage" / "indexes" / "e" / "postings"
    (postings / "user_id").rename(postings / "users")
    body = json.loads(index.metadata.dump()) | {"storage_format_version": 1, "of_another_tool": [1]}
    index.files.replace(f"{index.path}/metadata.json", json.dumps(body))
    again = FileIndex(spark, "e")
    assert again.metadata.storage_format_version == STORAGE_VERSION and json.loads(again.files.read(f"{again.path}/metadata.json"))["of_another_tool"] == [1]
    assert again.tables.stats().read().first()["file_size"] == len((storage / "e.json").read_bytes())
    assert names(again.locate_files({"user_id": [3]})) == {"e.json"}
    index.files.replace(f"{index.path}/metadata.json", json.dumps(body | {"storage_format_version": 2}))
    (postings / "user_id").rename(postings / "lost")
    with pytest.raises(errors.StorageMigrationException):
        FileIndex(spark, "e")


def test_filters_of_an_earlier_version_are_built_anew(spark, parts):
    index = index_of(spark, parts, lambda i: (i.add_bloom_index("Id"), i.add_index("Version")))
    index.files.replace(f"{index.path}/metadata.json", json.dumps(json.loads(index.metadata.dump()) | {"storage_format_version": 3}))
    again = FileIndex(spark, "t")
    assert again.columns_to_backfill() == {"Id"} and names(again.locate_files({"Id": [2]})) == {"part0.csv", "part1.csv"}
    again.update()
    assert names(again.locate_files({"Id": [2]})) == {"part0.csv"}


def test_bloom_filters(spark):
    """No value is lost, and of others about as many are found as asked for; a file's filter has several blocks."""
    from fileprune.functions import bloom

    rows = [(f"f{f}", v) for f, n in ((0, 3), (1, 500), (2, 20_000)) for v in range(f * 100_000, f * 100_000 + n)]
    values = spark.createDataFrame(rows, "filename string, value int")
    for fpr in (0.1, 0.01):
        filters = bloom.build(values, fpr).cache()
        assert filters.where("filename = 'f2'").count() > 10
        asked = lambda ids: spark.createDataFrame([(i,) for i in ids], "value int")
        for f, v in rows[::4001]:
            assert f in {r.filename for r in bloom.probe(filters, asked([v]), fpr).collect()}
        one = F.lit(1).cast("long")
        found = filters.where("filename = 'f2'").join(
            spark.range(10_000_000, 10_020_000).select(F.col("id").cast("string").alias("value"), F.lit(filters.where("filename = 'f2'").first().m).alias("m")).select(
                "m", bloom._block(F.col("value"), F.col("m")), bloom._positions(F.col("value"), bloom.hashes(fpr)).alias("positions")
            ), ["m", "block"],
        ).where(F.forall("positions", lambda p: F.call_function("shiftright", F.element_at("words", F.floor(p / 64).cast("int") + 1), p % 64).bitwiseAND(one) == 1)).count()
        assert found < 1.3 * fpr * 20_000
    assert bloom.probe(bloom.build(values, 0.1), spark.createDataFrame([], "value int"), 0.1).count() == 0


def test_large_files_are_one_batch_and_batches_count_their_own_rows(spark, parts, monkeypatch):
    index = index_of(spark, parts[:1], lambda i: (i.add_index("Id"), i.add_index("Version")))
    assert index._batches(index.metadata, {"b": 300 << 20, "a": 300 << 20}) == [["a", "b"]]  # as batches go one after the other
    assert byte_batches({"a": 5, "b": 6, "c": 1, "d": None, "e": 20}, 10) == [["a"], ["b", "c", "d"], ["e"]] and byte_batches({}, 1) == []
    read = []
    monkeypatch.setattr(build, "distinct_counts", lambda tables, count=build.distinct_counts: read.append({c: t.select("filename").distinct().count() for c, t in tables.items()}) or count(tables))
    index.add_file(parts[1])
    index.update()
    assert read == [{"Id": 1, "Version": 1}]  # not the files that were indexed before
    assert {r["Column"]: (r["FileCount"], r["MinValues"], r["MaxValues"]) for r in index.stats().collect()} == {"Id": (2, 3, 3), "Version": (2, 2, 3)}


def test_listed_values_are_broadcast(spark, parts):
    index = index_of(spark, parts, lambda i: (i.add_index("Id"), i.add_index("Version")))
    kind = T.IntegerType()
    hinted = locate.literal_values(spark, [1, 2], kind)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted  # whatever size Spark takes rows from the driver to have
    assert names(index.locate_files({"Id": [4], "Version": [1]})) == {"part1.csv"}


def test_values_that_find_every_file_leave_the_others_unasked(spark, parts, monkeypatch):
    index = index_of(spark, parts, lambda i: (i.add_index("Id"), i.add_bloom_index("Version"), i.add_temporal_index("Value", "Value")))
    monkeypatch.setattr(locate, "LARGE_BYTES", 0)
    monkeypatch.setattr(locate, "FIRST_SHARE", 1)
    asked = lambda ids: spark.createDataFrame([(i,) for i in ids], "Id int")
    every = index.locate(asked([1, 7]))
    assert "postings" not in every._jdf.queryExecution().optimizedPlan().toString() and not any("postings" in f for f in every.inputFiles())
    assert names(index.locate_files(asked([1, 7]))) == {"part0.csv", "part1.csv"}
    for ids, found in (([4], {"part1.csv"}), ([2], {"part0.csv"}), ([2, 4], {"part0.csv", "part1.csv"}), ([99], set()), ([], set())):
        assert names(index.locate_files(asked(ids))) == found
    monkeypatch.setattr(locate, "FIRST_SHARE", 1 << 40)  # the first values find nothing
    assert names(index.locate_files(asked([4, 2]))) == {"part0.csv", "part1.csv"}
    versions = spark.createDataFrame([(3,), (8,)], "Version int")
    assert "part1.csv" in names(index.locate_files(versions))
    assert names(index.locate_files(spark.createDataFrame([(9.0,)], "Value double"))) == {"part1.csv"}
