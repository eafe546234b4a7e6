from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

import pytest
from pyspark.errors import StreamingQueryException

from gradus.operators import catalog as ops
from gradus.operators import chunking
from gradus.sources.snapshots import SnapshotStore
from gradus.streaming import jobs

UPLOADS = "arrival bigint, file_name string, content string, uploaded_at timestamp_ntz"


def uploads(spark, *contents, start=0, name="f"):
    data = [
        (start + i, name, text, datetime(2024, 1, 1, 0, start + i)) for i, text in enumerate(contents)
    ]
    return spark.createDataFrame(data, UPLOADS)


def ingest(spark, batch, known):
    hashed, _ = ops.hash_uploads(batch)
    decisions = ops.decide_versions(hashed, known)
    chunks = ops.with_document(chunking.paragraph_chunks(batch, "arrival", "content"), decisions)
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return decisions, ops.swap(known, ops.register_pending(decisions), counts), chunks


def empty(spark):
    return spark.createDataFrame([], ops.CATALOG_SCHEMA)


def test_version_chain(spark):
    decisions, after, _ = ingest(spark, uploads(spark, "A", " A\n", "B", "A"), empty(spark))
    assert rows(decisions, "arrival", "action", "version") == [
        (0, "NEW", 1), (1, "UNCHANGED", 1), (2, "NEW_VERSION", 2), (3, "NEW_VERSION", 3),
    ]
    assert rows(after, "version", "status", "is_current") == [
        (1, "READY", False), (2, "READY", False), (3, "READY", True),
    ]
    again, _, _ = ingest(spark, uploads(spark, "A", start=9), after)
    assert rows(again, "action", "version") == [("UNCHANGED", 3)]


def test_deleted_and_rolled_back_documents_go_on_counting(spark):
    _, after, _ = ingest(spark, uploads(spark, "A", "B", "C"), empty(spark))
    group = after.first()["document_group_id"]
    gone, unknown = ops.soft_delete(after, spark.createDataFrame([(group,), ("x",)], "document_group_id string"))
    assert [r["document_group_id"] for r in unknown.collect()] == ["x"]
    assert gone.where("is_current").count() == 0
    decisions, back, _ = ingest(spark, uploads(spark, "C", start=5), gone)
    assert rows(decisions, "action", "version") == [("NEW_VERSION", 4)]
    assert rows(back.where("is_current"), "version") == [(4,)]
    requests = spark.createDataFrame(
        [(1, group, 1), (2, group, 77)], "request_no bigint, document_group_id string, version int"
    )
    rolled, rejects = ops.roll_back(after, requests)
    assert rows(rolled.where("is_current"), "version") == [(1,)]
    assert rows(rejects, "version", "reason") == [(77, "NOT_FOUND")]
    decisions, _, _ = ingest(spark, uploads(spark, "D", start=6), rolled)
    assert rows(decisions, "action", "version") == [("NEW_VERSION", 4)]


def test_failed_and_empty_uploads_change_nothing(spark):
    good, turned_away = ops.hash_uploads(uploads(spark, "", " \n", "ok"))
    assert good.count() == 1 and turned_away.count() == 2
    _, after, _ = ingest(spark, uploads(spark, "A"), empty(spark))
    hashed, _ = ops.hash_uploads(uploads(spark, "B", start=3))
    pending = ops.register_pending(ops.decide_versions(hashed, after))
    none = spark.createDataFrame([], "document_id string, chunks bigint")
    failed = ops.swap(after, pending, none)
    assert rows(failed, "version", "status", "is_current") == [(1, "READY", True), (2, "FAILED", False)]
    requests = spark.createDataFrame(
        [(1, after.first()["document_group_id"], 2)], "request_no bigint, document_group_id string, version int"
    )
    assert rows(ops.roll_back(failed, requests)[1], "reason") == [("NOT_READY",)]


def test_lists_stats_and_purge(spark):
    batch = uploads(spark, "A", "B").unionByName(uploads(spark, "one\n\ntwo", start=5, name="g"))
    _, after, chunks = ingest(spark, batch, empty(spark))
    flagged = ops.flag_chunks(chunks, after)
    assert rows(ops.list_documents(after), "file_name", "total_versions", "active_version", "status") == [
        ("f", 2, 2, "ACTIVE"), ("g", 1, 1, "ACTIVE"),
    ]
    stats = ops.stats(after, flagged).first()
    assert (stats["total_documents"], stats["total_versions"], stats["total_chunks"], stats["active_chunks"]) == (2, 3, 4, 3)
    group = after.where("file_name = 'g'").select("document_group_id")
    assert ops.purge(after, group).count() == 2 and ops.purge(flagged, group).count() == 2
    assert [r["version"] for r in ops.version_history(after, after.select("document_group_id")).where("file_name='f'").collect()] == [2, 1]


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.read("t", "a int").count() == 0
    store.publish({"t": spark.range(3).selectExpr("cast(id as int) a")}, "job", 0)
    store.publish({"t": spark.range(9).selectExpr("cast(id as int) a")}, "job", 0)
    assert store.read("t", "a int").count() == 3 and store.version() == 1
    store.publish({"t": spark.range(5).selectExpr("cast(id as int) a")}, "job", 1)
    assert store.read("t", "a int").count() == 5 and store.last_batch("job") == 1


def test_streamed_ingest_equals_batches(spark, tmp_path):
    one, two = uploads(spark, "A", "A", "B"), uploads(spark, "B", "C", start=10)
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def chunk(batch):
        return chunking.paragraph_chunks(batch, "arrival", "content")

    def run():
        stream = jobs.file_stream(spark, str(tmp_path / "in"), UPLOADS)
        writer = jobs.ingest(stream, store, chunk, str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()

    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    two.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    _, first, _ = ingest(spark, one, empty(spark))
    _, want, _ = ingest(spark, two, first)
    columns = ("id", "version", "file_hash", "status", "is_current", "total_chunks")
    got = store.read("catalog", ops.CATALOG_SCHEMA)
    assert rows(got, *columns) == rows(want, *columns)
    chunks = store.appended("chunks", "document_id string, chunk_id string, chunk_index int, content string")
    assert ops.flag_chunks(chunks, got).where("is_current").count() == 1
    version = store.version()
    run()
    assert store.version() == version


def test_batch_killed_between_its_writes(spark, tmp_path):
    """What the dead batch wrote is not seen; its replay gives what the batch operators give."""
    one, two = uploads(spark, "A", "A", "B"), uploads(spark, "B", "C", start=10)

    class Dies(SnapshotStore):
        dead = False

        def publish(self, tables, stream=None, batch=None):
            if batch == 1 and not self.dead:
                self.dead = True
                raise RuntimeError("dead before the commit")
            return super().publish(tables, stream, batch)

    store = Dies(spark, str(tmp_path / "store"))
    schema = "document_id string, chunk_id string, chunk_index int, content string"

    def chunk(batch):
        return chunking.paragraph_chunks(batch, "arrival", "content")

    def run():
        stream = jobs.file_stream(spark, str(tmp_path / "in"), UPLOADS)
        writer = jobs.ingest(stream, store, chunk, str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()

    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    before = rows(store.read("catalog", ops.CATALOG_SCHEMA), "id", "version", "is_current")
    two.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        run()
    # The chunks are on disk, and nobody sees them: the catalog and they are published as one.
    assert store.appended("chunks", schema).count() == 3
    assert jobs.ingested_chunks(store, schema).count() == 2
    assert rows(store.read("catalog", ops.CATALOG_SCHEMA), "id", "version", "is_current") == before
    run()
    _, first, _ = ingest(spark, one, empty(spark))
    _, want, _ = ingest(spark, two, first)
    columns = ("id", "version", "file_hash", "status", "is_current", "total_chunks")
    assert rows(store.read("catalog", ops.CATALOG_SCHEMA), *columns) == rows(want, *columns)
    assert jobs.ingested_chunks(store, schema).count() == 3
    # Published, but the stream's own mark is lost: the same batch once more changes nothing.
    version = store.version()
    for mark in (tmp_path / "state" / "commits").glob("*1*"):
        mark.unlink()
    run()
    assert store.version() == version and jobs.ingested_chunks(store, schema).count() == 3


def test_hash_of_files_as_they_are(spark):
    import glob
    import hashlib

    from gradus.sources.tables import file_bytes

    pattern = "/root/testdata/sf0.001/*.parquet"
    want = {}
    for path in glob.glob(pattern):
        with open(path, "rb") as file:
            want[path] = hashlib.sha256(file.read()).hexdigest()
    hashed = ops.hash_files(file_bytes(spark, pattern)).collect()
    assert {r["path"].removeprefix("file:"): r["file_hash"] for r in hashed} == want
