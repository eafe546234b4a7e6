"""Queries over the versioned catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import catalog as ops
from gradus.operators import chunking
from gradus.plans import query, views
from gradus.sources.tables import table


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    hashed, _ = ops.hash_uploads(views.uploads(spark, d))
    return ops.decide_versions(hashed, views.prior_catalog(spark, d))


def _paragraphs(spark: SparkSession, d: str, decisions: DataFrame) -> DataFrame:
    texts = views.uploads(spark, d).withColumn(
        "content", F.replace("content", F.lit("\n"), F.lit("\n\n"))
    )
    return ops.with_document(chunking.paragraph_chunks(texts, "arrival", "content"), decisions)


def _swapped(spark: SparkSession, d: str, decisions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    counts = paragraphs.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return ops.swap(views.prior_catalog(spark, d), ops.register_pending(decisions), counts)


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    decisions = _decisions(spark, d)
    return _swapped(spark, d, decisions, _paragraphs(spark, d, decisions))


def _snapshot_and_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    decisions = _decisions(spark, d)
    paragraphs = _paragraphs(spark, d, decisions)
    snapshot = _swapped(spark, d, decisions, paragraphs)
    return snapshot, ops.flag_chunks(paragraphs, snapshot)


@query(
    "content_hash",
    f"SELECT doc_id, sha256({views.STRIP.format('text')}) AS file_hash FROM documents",
)
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").withColumnRenamed("text", "content")
    return ops.hash_uploads(texts)[0].select("doc_id", "file_hash")


@query(
    "byte_hash",
    """SELECT doc_id, octet_length(encode(text)) AS length, sha256(encode(text)) AS file_hash
FROM documents WHERE text <> ''""",
)
def byte_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the raw bytes of each document, white space and all, as of a file that is uploaded."""
    raw = F.col("text").cast("binary")
    files = table(spark, d, "documents").select(
        "doc_id", F.octet_length(raw).cast("bigint").alias("length"), raw.alias("content")
    )
    return ops.hash_files(files).drop("content")


@query(
    "version_decisions",
    f"""WITH {views.DECISIONS}
SELECT arrival, file_name, file_hash, document_group_id, version, action, document_id FROM decisions""",
)
def version_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d).select(
        "arrival", "file_name", "file_hash", "document_group_id", "version", "action", "document_id"
    )


@query(
    "pending_documents",
    f"""WITH {views.DECISIONS}
SELECT document_id AS id, document_group_id, file_name, version, file_hash, 'PROCESSING' AS status,
       false AS is_current, uploaded_at AS created_at FROM decisions WHERE action <> 'UNCHANGED'""",
)
def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    pending = ops.register_pending(_decisions(spark, d))
    return pending.drop("total_chunks", "error_message", "updated_at")


_SNAPSHOT_COLUMNS = (
    "id, document_group_id, file_name, version, file_hash, status, is_current, total_chunks, "
    "created_at, updated_at"
)


@query("graceful_swap", f"WITH {views.DECISIONS} SELECT {_SNAPSHOT_COLUMNS} FROM snapshot")
def graceful_swap(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d).drop("error_message")


@query(
    "document_list",
    f"""WITH {views.DECISIONS}
SELECT document_group_id, file_name, count(*) AS total_versions,
       max(CASE WHEN is_current THEN version END) AS active_version,
       max(CASE WHEN is_current THEN id END) AS active_document_id, max(updated_at) AS updated_at,
       CASE WHEN max(CASE WHEN is_current THEN version END) IS NOT NULL THEN 'ACTIVE'
            ELSE 'INACTIVE' END AS status
FROM snapshot GROUP BY document_group_id, file_name""",
)
def document_list(spark: SparkSession, d: str) -> DataFrame:
    return ops.list_documents(_snapshot(spark, d))


def _french(spark: SparkSession, d: str) -> DataFrame:
    files = views.uploads(spark, d).where("file_name like '%/fr'").select("file_name").distinct()
    return files.select(F.md5("file_name").alias("document_group_id"))


_FRENCH = "SELECT md5(file_name) FROM uploads WHERE file_name LIKE '%/fr'"


@query(
    "version_history",
    f"""WITH {views.DECISIONS} SELECT document_group_id, version, id, is_current FROM snapshot
WHERE document_group_id IN ({_FRENCH})""",
)
def version_history(spark: SparkSession, d: str) -> DataFrame:
    return ops.version_history(_snapshot(spark, d), _french(spark, d)).select(
        "document_group_id", "version", "id", "is_current"
    )


def _rollbacks(spark: SparkSession, d: str) -> DataFrame:
    """Every upload asks its file back to a version between 0 (never there) and 7."""
    return views.uploads(spark, d).select(
        F.col("arrival").alias("request_no"),
        F.md5("file_name").alias("document_group_id"),
        (F.col("arrival") % 8).cast("int").alias("version"),
    )


_ROLLBACKS = f"""{views.DECISIONS},
requests AS (SELECT arrival AS request_no, md5(file_name) AS document_group_id,
                    CAST(arrival % 8 AS INTEGER) AS version FROM uploads),
found AS (SELECT r.*, s.status FROM requests r LEFT JOIN snapshot s USING (document_group_id, version)),
goals AS (SELECT document_group_id, arg_max(version, request_no) AS goal
          FROM found WHERE status = 'READY' GROUP BY document_group_id)"""


@query(
    "rollback",
    f"""WITH {_ROLLBACKS} SELECT id, document_group_id, version,
  CASE WHEN goal IS NULL THEN is_current ELSE version = goal END AS is_current
FROM snapshot LEFT JOIN goals USING (document_group_id)""",
)
def rollback(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = ops.roll_back(_snapshot(spark, d), _rollbacks(spark, d))
    return rows.select("id", "document_group_id", "version", "is_current")


@query(
    "rollback_rejects",
    f"""WITH {_ROLLBACKS} SELECT request_no, document_group_id, version, 'NOT_FOUND' AS reason
FROM found WHERE status IS NULL""",
)
def rollback_rejects(spark: SparkSession, d: str) -> DataFrame:
    return ops.roll_back(_snapshot(spark, d), _rollbacks(spark, d))[1]


@query(
    "soft_delete",
    f"""WITH {views.DECISIONS} SELECT id, document_group_id, version,
  is_current AND document_group_id NOT IN ({_FRENCH}) AS is_current FROM snapshot""",
)
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = ops.soft_delete(_snapshot(spark, d), _french(spark, d))
    return rows.select("id", "document_group_id", "version", "is_current")


@query(
    "purge",
    f"""WITH {views.DECISIONS}
SELECT 'catalog' AS kind, id, count(*) AS n FROM snapshot
WHERE document_group_id NOT IN ({_FRENCH}) GROUP BY id
UNION ALL
SELECT 'chunks', document_id, count(*) FROM paragraphs
WHERE document_group_id NOT IN ({_FRENCH}) GROUP BY document_id""",
)
def purge(spark: SparkSession, d: str) -> DataFrame:
    gone = _french(spark, d)
    snapshot, stored = _snapshot_and_chunks(spark, d)
    catalog = ops.purge(snapshot, gone).groupBy("id")
    chunks = ops.purge(stored, gone).groupBy(F.col("document_id").alias("id"))
    n = F.count(F.lit(1)).alias("n")
    return (
        catalog.agg(n)
        .select(F.lit("catalog").alias("kind"), "id", "n")
        .unionByName(chunks.agg(n).select(F.lit("chunks").alias("kind"), "id", "n"))
    )


@query(
    "catalog_stats",
    f"""WITH {views.DECISIONS}
SELECT (SELECT count(DISTINCT document_group_id) FROM snapshot) AS total_documents,
       (SELECT count(*) FROM snapshot) AS total_versions, count(*) AS total_chunks,
       count(*) FILTER (is_current) AS active_chunks
FROM paragraphs p JOIN snapshot s ON p.document_id = s.id""",
)
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.stats(*_snapshot_and_chunks(spark, d))
