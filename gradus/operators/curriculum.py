"""Ingested sources and their chunks: upserts, checkpoints, summaries and the curriculum roll-up.

``sources``: source_id, file_hash, title, domain_id, skill_id, document_type, total_pages,
total_chars, total_chunks, vector_status, created_at, updated_at.
``chunks``: source_id, page_number, chunk_index, text, char_count, subject_code, subject_name,
grade, book_edition, chapter_name, lesson_name, pattern_name, section_type, diagrams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import is_blank, stable_id, strip
from gradus.operators.ordered import bucket_of, dense_index, running_sum
from gradus.session import stacked

# Defaults of missing metadata.
METADATA = (
    "subjectCode string, subjectName string, grade int, bookEdition string, chapterName string, "
    "lessonName string, patternName string, sectionType string, hasDiagram boolean, dpiUsed int, "
    "imagePlaceholders array<struct<id:string,pageNumber:int,diagramType:string,"
    "description:string,suggestedAction:string>>"
)
DEFAULTS = {
    "subjectCode": "MATH", "subjectName": "Toán học", "grade": 12,
    "bookEdition": "Chân trời sáng tạo", "chapterName": "", "lessonName": "", "patternName": "",
    "sectionType": "THEORY", "hasDiagram": False, "dpiUsed": 56,
}


def upsert_sources(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known hashes go back to PROCESSING with the new page count, others are added.

    ``incoming``: file_hash, title, domain_id, skill_id, document_type, total_pages, seen_at.
    """
    latest = incoming.groupBy("file_hash").agg(
        F.max_by(
            F.struct("title", "domain_id", "skill_id", "document_type", "total_pages", "seen_at"),
            "seen_at",
        ).alias("_in")
    )
    first = sources.groupBy("file_hash").agg(F.min("source_id").alias("_first"))
    known = (
        sources.join(latest, "file_hash", "left")
        .join(first, "file_hash", "left")
        .withColumn("_hit", F.col("_in").isNotNull() & (F.col("source_id") == F.col("_first")))
    )
    updated = known.withColumns(
        {
            "total_pages": F.when(F.col("_hit"), F.col("_in.total_pages")).otherwise(
                F.col("total_pages")
            ),
            "vector_status": F.when(F.col("_hit"), "PROCESSING").otherwise(F.col("vector_status")),
            "updated_at": F.when(F.col("_hit"), F.col("_in.seen_at")).otherwise(F.col("updated_at")),
        }
    ).select(*sources.columns)
    added = latest.join(sources.select("file_hash"), "file_hash", "left_anti").select(
        stable_id(F.lit("source"), F.col("file_hash")).alias("source_id"),
        "file_hash",
        "_in.title", "_in.domain_id", "_in.skill_id",
        F.coalesce("_in.document_type", F.lit("TEXTBOOK")).alias("document_type"),
        "_in.total_pages",
        F.lit(0).alias("total_chars"),
        F.lit(0).alias("total_chunks"),
        F.lit("PROCESSING").alias("vector_status"),
        F.col("_in.seen_at").alias("created_at"),
        F.col("_in.seen_at").alias("updated_at"),
    )
    return stacked(updated, added.select(*sources.columns))


def newest_sources(sources: DataFrame) -> DataFrame:
    """The latest source of each hash, by one partially aggregated pass."""
    rest = [c for c in sources.columns if c != "file_hash"]
    return (
        sources.where(~is_blank(F.col("file_hash")))
        .groupBy("file_hash")
        .agg(F.max_by(F.struct(*rest), F.struct("updated_at", "source_id")).alias("_s"))
        .select("file_hash", "_s.*")
    )


def checkpoints(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """How far each file got: last page stored, and whether that is all of it."""
    last = chunks.groupBy("source_id").agg(F.max("page_number").alias("_last"))
    page = F.coalesce("_last", F.lit(0))
    return newest_sources(sources).join(last, "source_id", "left").select(
        "file_hash", "source_id", page.alias("last_page"), "total_pages", "vector_status",
        "total_chars", "total_chunks",
        ((page >= F.col("total_pages")) & (F.col("total_pages") > 0)).alias("is_completed"),
    )


def pages_to_ingest(pages: DataFrame, progress: DataFrame, forced: DataFrame) -> DataFrame:
    """Incoming pages (file_hash, page_number, ...) that are not stored yet; all of a forced file."""
    done = progress.join(forced.select("file_hash"), "file_hash", "left_anti").select(
        "file_hash", "last_page"
    )
    return (
        pages.join(done, "file_hash", "left")
        .where(F.col("page_number") > F.coalesce("last_page", F.lit(0)))
        .drop("last_page")
    )


def reset_sources(chunks: DataFrame, forced_sources: DataFrame) -> DataFrame:
    return chunks.join(forced_sources.select("source_id"), "source_id", "left_anti")


def read_metadata(chunks: DataFrame, column: str = "metadata") -> DataFrame:
    """JSON metadata as typed columns. What is missing or broken gets its default."""
    parsed = F.from_json(F.col(column), METADATA, {"mode": "PERMISSIVE"})
    rows = chunks.withColumn("_m", parsed)
    return rows.select(
        *chunks.columns,
        *[F.coalesce(f"_m.{k}", F.lit(v)).alias(k) for k, v in DEFAULTS.items()],
        F.coalesce(
            "_m.imagePlaceholders",
            F.array().cast(
                "array<struct<id:string,pageNumber:int,diagramType:string,description:string,"
                "suggestedAction:string>>"
            ),
        ).alias("imagePlaceholders"),
    )


def write_metadata(chunks: DataFrame, fields: list[str]) -> DataFrame:
    return chunks.withColumn("metadata", F.to_json(F.struct(*fields))).drop(*fields)


def store_books(
    sources: DataFrame, chunks: DataFrame, books: DataFrame, book_chunks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables after finished books are stored; publish the two in one snapshot.

    ``books`` has the columns of ``sources`` without status; totals of known ids are replaced.
    """
    new = books.select(
        "source_id", F.struct(*[c for c in books.columns if c != "source_id"]).alias("_new")
    )
    replaced = ["title", "total_pages", "total_chars", "total_chunks", "updated_at"]
    old = sources.select(
        "source_id", F.struct(*[c for c in sources.columns if c != "source_id"]).alias("_old")
    )
    both = old.join(new, "source_id", "full_outer")
    fresh = F.col("_new").isNotNull()

    def value(name: str) -> Column:
        if name == "vector_status":
            return F.when(fresh, "COMPLETED").otherwise(F.col("_old.vector_status"))
        if name in replaced:
            return F.coalesce(f"_new.{name}", f"_old.{name}")
        return F.coalesce(f"_old.{name}", f"_new.{name}")

    stored = both.select(
        "source_id", *[value(c).alias(c) for c in sources.columns if c != "source_id"]
    )
    return stored.select(*sources.columns), stacked(chunks, book_chunks.select(*chunks.columns))


def _first_seen(chunks: DataFrame, column: str) -> DataFrame:
    """Distinct names of a source in the order they first appear."""
    seen = (
        chunks.where(~is_blank(F.col(column)))
        .groupBy("source_id", column)
        .agg(F.min(F.struct("page_number", "chunk_index")).alias("_at"))
    )
    return seen.groupBy("source_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_at", column))), lambda x: x[column]
        ).alias(column)
    )


def source_summaries(
    sources: DataFrame, chunks: DataFrame, newest: int | None = None
) -> DataFrame:
    """Sources with chunks, all or the ``newest``: first chunk's identity, diagrams, names in order."""
    listed = sources.where("total_chunks > 0")
    if newest is not None:
        listed = listed.orderBy(F.col("updated_at").desc(), "source_id").limit(newest)
    mine = chunks.join(listed.select("source_id"), "source_id", "left_semi")
    facts = mine.groupBy("source_id").agg(
        F.min_by(
            F.struct("subject_code", "subject_name", "grade", "book_edition"),
            F.struct("page_number", "chunk_index"),
        ).alias("_first"),
        F.sum("diagrams").alias("total_diagrams"),
    )
    out = listed.join(facts, "source_id", "left")
    for column, name in (
        ("chapter_name", "chapters"), ("lesson_name", "lessons"), ("pattern_name", "patterns")
    ):
        out = out.join(
            _first_seen(mine, column).withColumnRenamed(column, name), "source_id", "left"
        )
    return out.select(
        "source_id", "title", "file_hash", "vector_status", "total_pages", "total_chunks",
        "_first.*", "total_diagrams", "chapters", "lessons", "patterns",
    )


def delete_sources(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Source or chunk table without the requested sources."""
    return table.join(requests.select("source_id"), "source_id", "left_anti")


def chunks_by_hash(sources: DataFrame, chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    wanted = newest_sources(sources).join(hashes.select("file_hash"), "file_hash", "left_semi")
    return (
        wanted.select("file_hash", "source_id")
        .join(chunks, "source_id")
    )


# Names and texts of the roll-up, numbers of chunks shown, weight of a pattern.
DEFAULT_LESSON = "Bài 1: Nội dung trọng tâm"
DEFAULT_PATTERN = "Dạng 1: Kiến thức & Kỹ năng cốt lõi"
PAGES_AT_ONCE = 16
SHOWN = {"THEORY": 4, "EXAMPLE": 2, "EXERCISE": 2}
EXAMPLES_TITLE = "\n### 📌 Ví dụ minh họa SGK:\n"
EXERCISES_TITLE = "\n### 📄 Bài toán mẫu áp dụng phương pháp:\n"
METHOD_STEPS = (
    "**Bước 1:** Xác định giả thiết và đơn vị kiến thức thuộc *%s* (%s).\n"
    "**Bước 2:** Áp dụng định lý, công thức chuẩn SGK GDPT 2018 và biến đổi tương đương.\n"
    "**Bước 3:** Kiểm tra điều kiện xác định và đối chiếu đáp án.\n"
)
PATTERN_WEIGHT = 0.05
NUMBERED_PATTERN = r"(?iu)^Dạng\s*\d+\s*:\s*"


def _or_default(column: str, default: Column) -> Column:
    return F.when(is_blank(F.col(column)), default).otherwise(F.col(column))


def _placed(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, books): chunks under the names that the roll-up gives them, and each source's book."""
    place = F.struct("page_number", "chunk_index")
    firsts = chunks.groupBy("source_id").agg(
        F.min_by(F.struct("subject_name", "grade", "book_edition"), place).alias("_book")
    )
    rows = chunks.join(firsts, "source_id").select(
        "source_id",
        _or_default(
            "chapter_name",
            F.concat(
                F.lit("Chương 1: "), "_book.subject_name", F.lit(" Lớp "),
                F.col("_book.grade").cast("string"),
            ),
        ).alias("chapter"),
        _or_default("lesson_name", F.lit(DEFAULT_LESSON)).alias("lesson"),
        _or_default("pattern_name", F.lit(DEFAULT_PATTERN)).alias("pattern"),
        "page_number", "chunk_index", "diagrams",
        F.when(F.col("section_type").isin("THEORY", "FORMULA", "PASSAGE"), "THEORY")
        .otherwise(F.col("section_type"))
        .alias("_kind"),
        F.concat(F.lit("**[Trang "), "page_number", F.lit("]** "), "text", F.lit("\n")).alias("_part"),
    )
    return rows, firsts


def roll_up_sections(chunks: DataFrame, shown: dict[str, int] | None = None) -> DataFrame:
    """Every chunk as a row of its section: source, chapter, lesson, pattern, kind, its rank in order of
    pages, its part of the text, and the characters of the section up to and including it.

    Nothing is cut or brought together, so a section may have any number of chunks. ``shown`` keeps the
    first so many of a kind, and kinds it does not name fall away.
    """
    rows, _ = _placed(chunks)
    keys = ["source_id", "chapter", "lesson", "pattern", "_kind"]
    sized = running_sum(
        rows,
        keys,
        [F.col("page_number"), F.col("chunk_index")],
        bucket_of(F.col("page_number"), PAGES_AT_ONCE),
        {"section_rank": F.lit(1).cast("bigint"), "chars_so_far": F.length("_part").cast("bigint")},
    )
    if shown is not None:
        limit = F.coalesce(*[F.when(F.col("_kind") == kind, n) for kind, n in shown.items()], F.lit(0))
        sized = sized.where(F.col("section_rank") <= limit)
    return sized.select(
        *keys[:-1], F.col("_kind").alias("kind"), "page_number", "chunk_index", "section_rank",
        F.col("_part").alias("part"), "chars_so_far",
    )


def roll_up(chunks: DataFrame, shown: dict[str, int] = SHOWN) -> DataFrame:
    """One row per source, chapter, lesson and pattern, in the order they first appear, with
    weights, page span, recap and method. Only the few chunks ``shown`` of a kind are brought together;
    the rank filter drops the others before the shuffle. ``roll_up_sections`` has all of them as rows.
    """
    place = F.struct("page_number", "chunk_index")
    keys = ["source_id", "chapter", "lesson", "pattern"]
    rows, firsts = _placed(chunks)
    groups = rows.groupBy(*keys).agg(
        F.min(place).alias("_at"),
        F.min_by("_part", place).alias("_fallback"),
        F.sum("diagrams").alias("diagrams"),
        F.count(F.lit(1)).alias("chunks"),
        F.min("page_number").alias("_low"),
        F.max("page_number").alias("_high"),
    )
    in_order = Window.partitionBy(*keys, "_kind").orderBy("page_number", "chunk_index")
    kept = (
        rows.where(F.col("_kind").isin(*shown))
        .withColumn("_rank", F.row_number().over(in_order))
        .where(F.col("_rank") <= max(shown.values()))
        .where(F.col("_rank") <= F.coalesce(*[F.when(F.col("_kind") == kind, n) for kind, n in shown.items()]))
    )

    def listed(kind: str, tail: str) -> Column:
        mine = F.collect_list(F.when(F.col("_kind") == kind, F.struct("_rank", "_part")))
        parts = F.transform(F.sort_array(mine), lambda p: F.concat(p["_part"], F.lit(tail)))
        return F.array_join(parts, "").alias(f"_{kind.lower()}")

    texts = kept.groupBy(*keys).agg(
        listed("THEORY", "\n"), listed("EXAMPLE", "\n"), listed("EXERCISE", "")
    )
    lessons = groups.groupBy("source_id", "chapter", "lesson").agg(
        F.min("_low").alias("page_start"), F.max("_high").alias("page_end")
    )
    lesson_counts = lessons.groupBy("source_id", "chapter").agg(F.count(F.lit(1)).alias("_lessons"))
    chapter_counts = lesson_counts.groupBy("source_id").agg(F.count(F.lit(1)).alias("_chapters"))
    numbered = Window.partitionBy("source_id", "chapter", "lesson").orderBy("_at")
    weight = F.bround(F.lit(1.0) / F.col("_chapters"), 2)
    theory = F.coalesce("_theory", F.lit(""))
    example, exercise = F.coalesce("_example", F.lit("")), F.coalesce("_exercise", F.lit(""))
    recap = F.concat(
        F.when(theory == "", F.col("_fallback")).otherwise(theory),
        F.when(example == "", "").otherwise(F.concat(F.lit(EXAMPLES_TITLE), example)),
    )
    method = F.concat(
        F.format_string(METHOD_STEPS, "lesson", "pattern"),
        F.when(exercise == "", "").otherwise(F.concat(F.lit(EXERCISES_TITLE), exercise)),
    )
    grade = F.col("_book.grade").cast("string")
    marked = F.contains(F.col("chapter"), F.concat(F.lit("[Lớp "), grade, F.lit("]")))
    return (
        groups.withColumn("pattern_number", F.row_number().over(numbered))
        .join(texts, keys, "left")
        .join(lessons, ["source_id", "chapter", "lesson"])
        .join(lesson_counts, ["source_id", "chapter"])
        .join(chapter_counts, "source_id")
        .join(firsts, "source_id")
        .select(
            "source_id",
            F.when(marked, F.col("chapter"))
            .otherwise(
                F.concat(
                    F.lit("[Lớp "), grade, F.lit(" - "), "_book.book_edition", F.lit("] "), "chapter"
                )
            )
            .alias("chapter_name"),
            weight.alias("chapter_weight"),
            F.col("lesson").alias("lesson_name"),
            F.bround(weight / F.col("_lessons"), 2).alias("lesson_weight"),
            "page_start",
            "page_end",
            "pattern_number",
            F.concat(
                F.lit("Dạng "), "pattern_number", F.lit(": "),
                strip(F.regexp_replace("pattern", NUMBERED_PATTERN, "")),
            ).alias("pattern_name"),
            F.lit(PATTERN_WEIGHT).alias("pattern_weight"),
            strip(recap).alias("theory_recap"),
            strip(method).alias("solution_method"),
            "chunks",
            "diagrams",
        )
    )


def curriculum_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(
        F.countDistinct("page_number").alias("total_pages"),
        F.sum("char_count").alias("total_chars"),
        F.sum("diagrams").alias("total_diagrams"),
    )


def dedupe_patterns(patterns: DataFrame) -> DataFrame:
    """``patterns``: lesson_id, lesson_name, position, pattern_name. Names that differ only in their
    number or case are one pattern; the rest are numbered afresh. ``owner`` is the position kept.
    """
    bare = strip(F.regexp_replace(F.coalesce("pattern_name", F.lit("")), NUMBERED_PATTERN, ""))
    kept = (
        patterns.withColumn("_bare", bare)
        .groupBy("lesson_id", F.lower("_bare").alias("_form"))
        .agg(
            F.min("position").alias("owner"),
            F.min_by(F.struct("lesson_name", "_bare"), "position").alias("_p"),
        )
    )
    numbered = dense_index(kept, ["lesson_id"], [F.col("owner")], bucket_of(F.col("owner")))
    number = (F.col("idx") + 1).cast("string")
    unnamed = F.concat(
        F.lit("Trọng tâm kiến thức "), "_p.lesson_name", F.lit(" phần "), number
    )
    name = F.when(F.col("_p._bare") == "", unnamed).otherwise(F.col("_p._bare"))
    return numbered.select(
        "lesson_id", "owner", "_form",
        F.concat(F.lit("Dạng "), number, F.lit(": "), name).alias("pattern_name"),
    )


def merge_pattern_questions(patterns: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions``: lesson_id, position (of the pattern), question_no, content. Those of a repeated
    pattern move to the one kept, unless it has the same content already.
    """
    owners = dedupe_patterns(patterns).select("lesson_id", "_form", "owner")
    bare = strip(F.regexp_replace(F.coalesce("pattern_name", F.lit("")), NUMBERED_PATTERN, ""))
    homes = patterns.select("lesson_id", "position", F.lower(bare).alias("_form")).join(
        owners, ["lesson_id", "_form"]
    )
    rows = questions.join(homes.drop("_form"), ["lesson_id", "position"])
    place = F.struct("position", "question_no")
    first = rows.groupBy("lesson_id", "owner", "content").agg(F.min(place).alias("_first"))
    return (
        rows.join(first, ["lesson_id", "owner", "content"])
        .where((F.col("position") == F.col("owner")) | (place == F.col("_first")))
        .drop("_first")
    )


def completeness(chapters: DataFrame, lessons: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """Curricula lacking chapters, lessons or patterns. Each table has ``key``; ``chapters`` also
    lists curricula without any (chapter null).
    """
    counted = chapters.groupBy(key).agg(F.count("chapter").alias("chapters"))
    for name, table in (("lessons", lessons), ("patterns", patterns)):
        counted = counted.join(
            table.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left"
        ).withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return counted.withColumn(
        "is_incomplete",
        (F.col("chapters") == 0) | (F.col("lessons") == 0) | (F.col("patterns") == 0),
    )
