"""Versioned document catalog as snapshots.

``uploads``: arrival (bigint, unique), file_name, content, uploaded_at.
``catalog``: id, document_group_id, file_name, version, file_hash, status, is_current,
total_chunks, error_message, created_at, updated_at.
Operators return the new snapshot; ``gradus.sources.snapshots`` publishes it.

Versions are one more than the highest so far. (Numbering from the current version, as a one-row
lookup would, gives a number twice after a rollback or while another upload is still running.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import is_blank, stable_id, strip
from gradus.operators.ordered import bucket_of, carry_last, running_sum
from gradus.session import checkpointed, stacked

CATALOG_SCHEMA = (
    "id string, document_group_id string, file_name string, version int, file_hash string, "
    "status string, is_current boolean, total_chunks int, error_message string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
COLUMNS = [part.split()[0] for part in CATALOG_SCHEMA.split(", ")]


def content_hash(content: Column) -> Column:
    return F.sha2(strip(content), 256)


def hash_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashed uploads, and the empty ones that are turned away."""
    empty = is_blank(F.col("content"))
    good = uploads.where(~empty).withColumn("file_hash", content_hash(F.col("content")))
    return good, uploads.where(empty).withColumn("reason", F.lit("EMPTY_CONTENT"))


def hash_files(files: DataFrame) -> DataFrame:
    """Hash of raw bytes, for files read as binary."""
    return files.where("length > 0").withColumn("file_hash", F.sha2("content", 256))


def decide_versions(hashed: DataFrame, catalog: DataFrame) -> DataFrame:
    """UNCHANGED, NEW or NEW_VERSION for each upload of a batch, in order of arrival.

    An upload is compared with the content that is current when it arrives: the upload before it,
    or the catalog's current version for the first. Going back to older content is a new version.
    Content itself is not carried along; only its hash is shuffled. Decisions are kept on the
    checkpoint storage, as everything that follows is built on them.
    """
    known = catalog.groupBy("file_name").agg(
        F.max_by("document_group_id", "version").alias("_group"),
        F.max("version").alias("_highest"),
        F.max_by(
            F.struct("id", "version", "file_hash"), F.when(F.col("is_current"), F.col("version"))
        ).alias("_current"),
    )
    rows = hashed.drop("content").join(known, "file_name", "left")
    chained = carry_last(
        rows,
        ["file_name"],
        ["arrival"],
        bucket_of(F.col("arrival")),
        {"_before": F.col("file_hash")},
        include_current=False,
    )
    live = F.coalesce("_before", "_current.file_hash")
    changed = chained.withColumn("_changed", (~live.eqNullSafe(F.col("file_hash"))).cast("int"))
    counted = running_sum(
        changed,
        ["file_name"],
        [F.col("arrival")],
        bucket_of(F.col("arrival")),
        {"_changes": F.col("_changed")},
    )
    version = F.when(F.col("_changes") == 0, F.col("_current.version")).otherwise(
        (F.coalesce("_highest", F.lit(0)) + F.col("_changes")).cast("int")
    )
    group = F.coalesce("_group", stable_id(F.col("file_name")))
    kept = counted.withColumn("version", version).withColumn("document_group_id", group)
    fresh_id = stable_id(F.col("file_name"), F.col("version"))
    decided = kept.withColumns(
        {
            "action": F.when(F.col("_changed") == 0, "UNCHANGED")
            .when(F.col("version") == 1, "NEW")
            .otherwise("NEW_VERSION"),
            "document_id": F.when(F.col("_changes") == 0, F.col("_current.id")).otherwise(fresh_id),
        }
    ).drop("_group", "_highest", "_current", "_before", "_changed", "_changes")
    return checkpointed(decided)


def with_document(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chunks keyed by arrival, of the uploads that need processing, under their document's id."""
    wanted = decisions.where("action <> 'UNCHANGED'").select("arrival", "document_id")
    return chunks.join(wanted, "arrival").drop("arrival")


def register_pending(decisions: DataFrame) -> DataFrame:
    """Catalog rows of the uploads that have to be processed."""
    return decisions.where("action <> 'UNCHANGED'").select(
        F.col("document_id").alias("id"),
        "document_group_id",
        "file_name",
        "version",
        "file_hash",
        F.lit("PROCESSING").alias("status"),
        F.lit(False).alias("is_current"),
        F.lit(0).alias("total_chunks"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("uploaded_at").alias("created_at"),
        F.col("uploaded_at").alias("updated_at"),
    )


def swap(catalog: DataFrame, pending: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Snapshot after processing: documents with chunks go live, others fail and change nothing.

    ``chunk_counts``: document_id, chunks.
    """
    n = F.coalesce("chunks", F.lit(0)).cast("int")
    done = (
        pending.join(chunk_counts.withColumnRenamed("document_id", "id"), "id", "left")
        .withColumns(
            {
                "status": F.when(n > 0, "READY").otherwise("FAILED"),
                "total_chunks": n,
                "error_message": F.when(n == 0, F.lit("Document produced 0 chunks.")),
                "_ready": F.when(n > 0, F.col("version")),
            }
        )
        .drop("chunks")
    )
    winners = (
        done.where("_ready is not null")
        .groupBy("document_group_id")
        .agg(
            F.max("_ready").alias("_winner"),
            F.max_by("updated_at", "_ready").alias("_swapped_at"),
        )
    )
    rows = stacked(catalog.withColumn("_ready", F.lit(None).cast("int")), done)
    is_current = F.when(F.col("_winner").isNull(), F.col("is_current")).otherwise(
        F.col("version") == F.col("_winner")
    )
    lost = F.col("is_current") & F.col("_winner").isNotNull()
    return rows.join(winners, "document_group_id", "left").select(
        *[c for c in COLUMNS if c not in ("is_current", "updated_at")],
        is_current.alias("is_current"),
        F.when(lost, F.col("_swapped_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*COLUMNS)


def flag_chunks(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks stamped with their document's catalog data; ``is_current`` follows the catalog."""
    stamp = catalog.select(
        F.col("id").alias("document_id"), "document_group_id", "file_name", "version", "is_current",
        F.col("file_name").alias("source"), F.lit("text").alias("type"),
    )
    mine = chunks.drop(*[c for c in stamp.columns if c != "document_id"])
    return mine.join(stamp, "document_id")


def list_documents(catalog: DataFrame) -> DataFrame:
    live = F.col("is_current")
    return (
        catalog.groupBy("document_group_id", "file_name")
        .agg(
            F.count(F.lit(1)).alias("total_versions"),
            F.max(F.when(live, F.col("version"))).alias("active_version"),
            F.max(F.when(live, F.col("id"))).alias("active_document_id"),
            F.max("updated_at").alias("updated_at"),
        )
        .withColumn(
            "status", F.when(F.col("active_version").isNotNull(), "ACTIVE").otherwise("INACTIVE")
        )
        .orderBy(F.col("updated_at").desc(), "document_group_id")
    )


def version_history(catalog: DataFrame, groups: DataFrame) -> DataFrame:
    return catalog.join(
        groups.select("document_group_id").distinct(), "document_group_id", "left_semi"
    ).orderBy("document_group_id", F.col("version").desc())


def unknown_groups(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(
        catalog.select("document_group_id"), "document_group_id", "left_anti"
    ).withColumn("reason", F.lit("NOT_FOUND"))


def roll_back(catalog: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``requests``: request_no, document_group_id, version. The last valid one of a group counts."""
    found = requests.join(
        catalog.select("document_group_id", "version", "status"),
        ["document_group_id", "version"],
        "left",
    )
    rejects = found.where("status is null or status <> 'READY'").select(
        *requests.columns,
        F.when(F.col("status").isNull(), "NOT_FOUND").otherwise("NOT_READY").alias("reason"),
    )
    goals = (
        found.where("status = 'READY'")
        .groupBy("document_group_id")
        .agg(F.max_by("version", "request_no").alias("_goal"))
    )
    rows = catalog.join(goals, "document_group_id", "left").withColumn(
        "is_current",
        F.when(F.col("_goal").isNull(), F.col("is_current")).otherwise(
            F.col("version") == F.col("_goal")
        ),
    )
    return rows.select(*COLUMNS), rejects


def soft_delete(catalog: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes all versions of the requested groups offline; history stays."""
    gone = requests.select("document_group_id").distinct().withColumn("_gone", F.lit(True))
    rows = catalog.join(gone, "document_group_id", "left").withColumn(
        "is_current", F.col("is_current") & F.col("_gone").isNull()
    )
    return rows.select(*COLUMNS), unknown_groups(catalog, requests)


def purge(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Catalog or chunk table without the requested groups."""
    return table.join(requests.select("document_group_id"), "document_group_id", "left_anti")


def stats(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, active chunks, logical documents and versions."""
    documents = catalog.agg(
        F.countDistinct("document_group_id").alias("total_documents"),
        F.count(F.lit(1)).alias("total_versions"),
    )
    parts = chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(F.coalesce("is_current", F.lit(False))).alias("active_chunks"),
    )
    names = documents.columns + parts.columns
    none = F.lit(None).cast("bigint")
    both = stacked(
        documents.select("*", *[none.alias(c) for c in parts.columns]),
        parts.select("*", *[none.alias(c) for c in documents.columns]),
    )
    return both.agg(*[F.max(c).alias(c) for c in names])
