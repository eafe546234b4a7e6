"""Queries over ingested sources and the curriculum roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import curriculum as ops
from gradus.plans import query, views
from gradus.sources.tables import table


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier is an ingested source; every hash belongs to three of them."""
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.format_string("s%09d", s).alias("source_id"),
        F.md5((F.floor(s / 3)).cast("string")).alias("file_hash"),
        F.col("s_name").alias("title"),
        F.col("s_nationkey").cast("string").alias("domain_id"),
        F.lit(None).cast("string").alias("skill_id"),
        F.lit("TEXTBOOK").alias("document_type"),
        (s % 5 * 4 + 1).cast("int").alias("total_pages"),
        F.lit(100).alias("total_chars"),
        (s % 4).cast("int").alias("total_chunks"),
        F.lit("COMPLETED").alias("vector_status"),
        views._at(s).alias("created_at"),
        views._at(s * 7 % 101).alias("updated_at"),
    )


_SOURCES = """sources AS (
  SELECT printf('s%09d', s_suppkey) AS source_id, md5(CAST(s_suppkey // 3 AS VARCHAR)) AS file_hash, s_name AS title,
         CAST(s_nationkey AS VARCHAR) AS domain_id, CAST(s_suppkey % 5 * 4 + 1 AS INTEGER) AS total_pages,
         CAST(s_suppkey % 4 AS INTEGER) AS total_chunks, 'COMPLETED' AS vector_status,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(s_suppkey) AS created_at,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(s_suppkey * 7 % 101) AS updated_at
  FROM supplier)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a chunk of a source."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.format_string("s%09d", p % 10).alias("source_id"),
        (p % 13 + 1).cast("int").alias("page_number"),
        p.alias("chunk_index"),
        F.concat_ws(" ", "p_name", "p_brand").alias("text"),
        F.length(F.concat_ws(" ", "p_name", "p_brand")).alias("char_count"),
        F.when(p % 2 == 0, "MATH").otherwise("CHEM").alias("subject_code"),
        F.when(p % 2 == 0, "Toán học").otherwise("Hóa học").alias("subject_name"),
        (p % 3 + 10).cast("int").alias("grade"),
        F.lit("Cánh diều").alias("book_edition"),
        F.when(p % 6 > 0, F.concat(F.lit("Chương "), p % 6)).alias("chapter_name"),
        F.when(p % 4 > 0, F.concat(F.lit("Bài "), p % 4)).otherwise(" ").alias("lesson_name"),
        F.when(p % 5 > 0, F.concat(F.lit("Dạng "), p % 9, F.lit(": "), "p_type")).alias("pattern_name"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("THEORY", "EXAMPLE", "EXERCISE", "FORMULA", "COVER", "PASSAGE", "EXERCISE")]),
            (p % 7 + 1).cast("int"),
        ).alias("section_type"),
        (p % 2).alias("diagrams"),
    )


_CHUNKS = """chunks AS (
  SELECT printf('s%09d', p_partkey % 10) AS source_id, CAST(p_partkey % 13 + 1 AS INTEGER) AS page_number,
         p_partkey AS chunk_index, p_name || ' ' || p_brand AS text,
         CASE WHEN p_partkey % 2 = 0 THEN 'MATH' ELSE 'CHEM' END AS subject_code,
         CASE WHEN p_partkey % 2 = 0 THEN 'Toán học' ELSE 'Hóa học' END AS subject_name,
         CAST(p_partkey % 3 + 10 AS INTEGER) AS grade, 'Cánh diều' AS book_edition,
         CASE WHEN p_partkey % 6 > 0 THEN 'Chương ' || (p_partkey % 6) END AS chapter_name,
         CASE WHEN p_partkey % 4 > 0 THEN 'Bài ' || (p_partkey % 4) ELSE ' ' END AS lesson_name,
         CASE WHEN p_partkey % 5 > 0 THEN 'Dạng ' || (p_partkey % 9) || ': ' || p_type END AS pattern_name,
         ['THEORY', 'EXAMPLE', 'EXERCISE', 'FORMULA', 'COVER', 'PASSAGE', 'EXERCISE'][p_partkey % 7 + 1] AS section_type,
         p_partkey % 2 AS diagrams
  FROM part)"""
_NEWEST = """newest AS (
  SELECT s.* FROM (SELECT file_hash, arg_max(source_id, struct_pack(u := updated_at, s := source_id)) AS source_id
                   FROM sources GROUP BY file_hash) n JOIN sources s USING (source_id))"""


@query(
    "upsert_sources",
    f"""WITH {_SOURCES},
inc AS (SELECT md5(CAST(c_custkey % 60 AS VARCHAR)) AS file_hash, arg_max(c_name, c_custkey) AS title,
               CAST(arg_max(c_nationkey, c_custkey) AS INTEGER) AS total_pages,
               TIMESTAMP '2025-01-01 00:00:00' + to_minutes(max(c_custkey)) AS seen_at FROM customer GROUP BY 1),
firsts AS (SELECT file_hash, min(source_id) AS f FROM sources GROUP BY file_hash)
SELECT source_id, s.file_hash, s.title, CASE WHEN i.title IS NOT NULL AND f = source_id THEN i.total_pages ELSE s.total_pages END AS total_pages,
       CASE WHEN i.title IS NOT NULL AND f = source_id THEN 'PROCESSING' ELSE vector_status END AS vector_status,
       CASE WHEN i.title IS NOT NULL AND f = source_id THEN seen_at ELSE updated_at END AS updated_at
FROM sources s JOIN firsts USING (file_hash) LEFT JOIN inc i ON i.file_hash = s.file_hash
UNION ALL
SELECT md5('source#' || file_hash), file_hash, title, total_pages, 'PROCESSING', seen_at FROM inc
WHERE file_hash NOT IN (SELECT file_hash FROM sources)""",
)
def upsert_sources(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    base = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    incoming = table(spark, d, "customer").select(
        F.md5((c % 60).cast("string")).alias("file_hash"),
        F.col("c_name").alias("title"),
        F.lit("d").alias("domain_id"),
        F.lit(None).cast("string").alias("skill_id"),
        F.lit(None).cast("string").alias("document_type"),
        F.col("c_nationkey").alias("total_pages"),
        (base + F.make_dt_interval(mins=c.cast("int"))).alias("seen_at"),
    )
    return ops.upsert_sources(_sources(spark, d), incoming).select(
        "source_id", "file_hash", "title", "total_pages", "vector_status", "updated_at"
    )


_PROGRESS = f"""{_SOURCES}, {_CHUNKS}, {_NEWEST},
progress AS (
  SELECT file_hash, source_id, coalesce(last, 0) AS last_page, total_pages,
         coalesce(last, 0) >= total_pages AND total_pages > 0 AS is_completed
  FROM newest LEFT JOIN (SELECT source_id, max(page_number) AS last FROM chunks GROUP BY source_id) USING (source_id))"""


@query("ingest_checkpoints", f"WITH {_PROGRESS} SELECT * FROM progress")
def ingest_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    found = ops.checkpoints(_sources(spark, d), _chunks(spark, d))
    return found.select("file_hash", "source_id", "last_page", "total_pages", "is_completed")


@query(
    "pages_to_ingest",
    f"""WITH {_PROGRESS},
incoming AS (SELECT md5(CAST(doc_id % 50 AS VARCHAR)) AS file_hash, CAST(doc_id // 50 + 1 AS INTEGER) AS page_number FROM documents),
forced AS (SELECT DISTINCT md5(CAST(s_nationkey AS VARCHAR)) AS file_hash FROM supplier WHERE s_acctbal < 0 OR s_nationkey < 4)
SELECT i.* FROM incoming i LEFT JOIN progress p ON p.file_hash = i.file_hash AND i.file_hash NOT IN (SELECT file_hash FROM forced)
WHERE page_number > coalesce(last_page, 0)""",
)
def pages_to_ingest(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    incoming = table(spark, d, "documents").select(
        F.md5((i % 50).cast("string")).alias("file_hash"),
        (F.floor(i / 50) + 1).cast("int").alias("page_number"),
    )
    forced = table(spark, d, "supplier").where("s_acctbal < 0 or s_nationkey < 4").select(
        F.md5(F.col("s_nationkey").cast("string")).alias("file_hash")
    )
    progress = ops.checkpoints(_sources(spark, d), _chunks(spark, d))
    return ops.pages_to_ingest(incoming, progress, forced)


@query(
    "chunk_metadata",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 12 ELSE CAST(user_id % 3 + 10 AS INTEGER) END AS grade,
       CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 'MATH' ELSE event_type END AS "subjectCode",
       'THEORY' AS "sectionType", event_id % 5 <> 0 AS "hasDiagram", CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS placeholders
FROM events""",
)
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    fields = ["subjectCode", "grade", "hasDiagram", "imagePlaceholders"]
    rows = table(spark, d, "events").select(
        "event_id",
        F.when(i % 3 > 0, F.col("event_type")).alias("subjectCode"),
        (F.col("user_id") % 3 + 10).cast("int").alias("grade"),
        F.lit(True).alias("hasDiagram"),
        F.array(F.struct(F.lit("x").alias("id"), F.lit(1).alias("pageNumber"))).alias("imagePlaceholders"),
    )
    stored = ops.write_metadata(rows, fields)
    broken = stored.withColumn(
        "metadata", F.when(i % 5 == 0, F.lit("{broken")).otherwise(F.col("metadata"))
    )
    return ops.read_metadata(broken).select(
        "event_id", "grade", "subjectCode", "sectionType", "hasDiagram",
        F.size("imagePlaceholders").alias("placeholders"),
    )


@query(
    "store_books",
    f"""WITH {_SOURCES}, {_CHUNKS},
books AS (SELECT printf('s%09d', c_custkey * 2) AS source_id, c_name AS title, c_nationkey AS total_pages FROM customer)
SELECT coalesce(s.source_id, b.source_id) AS source_id, coalesce(b.title, s.title) AS title,
       coalesce(b.total_pages, s.total_pages) AS total_pages, coalesce(s.domain_id, CASE WHEN b.source_id IS NOT NULL THEN 'new' END) AS domain_id,
       CASE WHEN b.source_id IS NOT NULL THEN 'COMPLETED' ELSE vector_status END AS vector_status,
       2 * n AS stored_chunks
FROM sources s FULL JOIN books b USING (source_id)
LEFT JOIN (SELECT source_id, count(*) AS n FROM chunks GROUP BY source_id) USING (source_id)""",
)
def store_books(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    sources, chunks = _sources(spark, d), _chunks(spark, d)
    books = table(spark, d, "customer").select(
        F.format_string("s%09d", c * 2).alias("source_id"),
        F.md5(c.cast("string")).alias("file_hash"),
        F.col("c_name").alias("title"),
        F.lit("new").alias("domain_id"),
        F.lit(None).cast("string").alias("skill_id"),
        F.lit("TEXTBOOK").alias("document_type"),
        F.col("c_nationkey").alias("total_pages"),
        F.lit(1).alias("total_chars"),
        F.lit(1).alias("total_chunks"),
        views._at(c).alias("created_at"),
        views._at(c).alias("updated_at"),
    )
    stored, all_chunks = ops.store_books(sources, chunks, books, chunks)
    n = all_chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("stored_chunks"))
    return stored.join(n, "source_id", "left").select(
        "source_id", "title", "total_pages", "domain_id", "vector_status", "stored_chunks"
    )


_NAMES = "\n".join(
    f"""LEFT JOIN (SELECT source_id, string_agg(n, ';' ORDER BY pg, ix) AS {plural} FROM (
  SELECT source_id, {single}_name AS n, min(struct_pack(p := page_number, i := chunk_index)).p AS pg,
         min(struct_pack(p := page_number, i := chunk_index)).i AS ix
  FROM chunks WHERE trim({single}_name) <> '' GROUP BY source_id, {single}_name) GROUP BY source_id) USING (source_id)"""
    for single, plural in (("chapter", "chapters"), ("lesson", "lessons"), ("pattern", "patterns"))
)


@query(
    "source_summaries",
    f"""WITH {_SOURCES}, {_CHUNKS},
listed AS (SELECT * FROM sources WHERE total_chunks > 0)
SELECT source_id, title, total_pages, subject_code, grade, total_diagrams, chapters, lessons, patterns FROM listed
LEFT JOIN (SELECT source_id, arg_min(subject_code, struct_pack(p := page_number, i := chunk_index)) AS subject_code,
                  arg_min(grade, struct_pack(p := page_number, i := chunk_index)) AS grade,
                  CAST(sum(diagrams) AS BIGINT) AS total_diagrams FROM chunks GROUP BY source_id) USING (source_id)
{_NAMES}""",
)
def source_summaries(spark: SparkSession, d: str) -> DataFrame:
    found = ops.source_summaries(_sources(spark, d), _chunks(spark, d))
    return found.select(
        "source_id", "title", "total_pages", "subject_code", "grade", "total_diagrams",
        *[F.array_join(c, ";").alias(c) for c in ("chapters", "lessons", "patterns")],
    )


@query(
    "delete_sources",
    f"""WITH {_SOURCES}, {_CHUNKS},
gone AS (SELECT printf('s%09d', s_suppkey) AS source_id FROM supplier WHERE s_acctbal < 4000)
SELECT s.source_id, count(c.chunk_index) AS chunks FROM sources s LEFT JOIN chunks c USING (source_id)
WHERE source_id NOT IN (SELECT source_id FROM gone) GROUP BY s.source_id""",
)
def delete_sources(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "supplier").where("s_acctbal < 4000").select(
        F.format_string("s%09d", "s_suppkey").alias("source_id")
    )
    chunks = ops.delete_sources(_chunks(spark, d), gone)
    counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))
    kept = ops.delete_sources(_sources(spark, d), gone).join(counts, "source_id", "left")
    return kept.select("source_id", F.coalesce("chunks", F.lit(0).cast("bigint")).alias("chunks"))


@query(
    "chunks_by_hash",
    f"""WITH {_SOURCES}, {_CHUNKS}, {_NEWEST}
SELECT file_hash, source_id, page_number, chunk_index, text FROM newest JOIN chunks USING (source_id)""",
)
def chunks_by_hash(spark: SparkSession, d: str) -> DataFrame:
    sources = _sources(spark, d)
    found = ops.chunks_by_hash(sources, _chunks(spark, d), sources.select("file_hash").distinct())
    return found.select("file_hash", "source_id", "page_number", "chunk_index", "text")


def _shown(kind: str, k: int, tail: str) -> str:
    return (
        f"coalesce(string_agg(CASE WHEN kind = '{kind}' AND rk <= {k} THEN part || {tail} END, '' "
        "ORDER BY page_number, chunk_index), '')"
    )


@query(
    "curriculum_roll_up",
    f"""WITH {_CHUNKS},
book AS (SELECT source_id, arg_min(struct_pack(n := subject_name, g := grade, e := book_edition),
                                   struct_pack(p := page_number, i := chunk_index)) AS b FROM chunks GROUP BY source_id),
named AS (
  SELECT source_id, b, page_number, chunk_index, diagrams,
    CASE WHEN coalesce(trim(chapter_name), '') = '' THEN 'Chương 1: ' || b.n || ' Lớp ' || b.g ELSE chapter_name END AS chapter,
    CASE WHEN coalesce(trim(lesson_name), '') = '' THEN '{ops.DEFAULT_LESSON}' ELSE lesson_name END AS lesson,
    CASE WHEN coalesce(trim(pattern_name), '') = '' THEN '{ops.DEFAULT_PATTERN}' ELSE pattern_name END AS pattern,
    CASE WHEN section_type IN ('THEORY', 'FORMULA', 'PASSAGE') THEN 'THEORY' ELSE section_type END AS kind,
    '**[Trang ' || page_number || ']** ' || text || chr(10) AS part
  FROM chunks JOIN book USING (source_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, chapter, lesson, pattern, kind ORDER BY page_number, chunk_index) AS rk FROM named),
groups AS (
  SELECT source_id, chapter, lesson, pattern, any_value(b) AS b, min(struct_pack(p := page_number, i := chunk_index)) AS pos,
    first(part ORDER BY page_number, chunk_index) AS fallback, CAST(sum(diagrams) AS BIGINT) AS diagrams, count(*) AS chunks,
    {_shown('THEORY', 4, 'chr(10)')} AS th, {_shown('EXAMPLE', 2, 'chr(10)')} AS ex, {_shown('EXERCISE', 2, "''")} AS ec,
    min(page_number) AS lo, max(page_number) AS hi
  FROM ranked GROUP BY source_id, chapter, lesson, pattern),
counted AS (
  SELECT *, min(lo) OVER l AS page_start, max(hi) OVER l AS page_end, row_number() OVER (l ORDER BY pos) AS pattern_number,
    (SELECT count(DISTINCT chapter) FROM groups x WHERE x.source_id = g.source_id) AS nc,
    (SELECT count(DISTINCT lesson) FROM groups x WHERE x.source_id = g.source_id AND x.chapter = g.chapter) AS nl
  FROM groups g WINDOW l AS (PARTITION BY source_id, chapter, lesson))
SELECT source_id, '[Lớp ' || b.g || ' - ' || b.e || '] ' || chapter AS chapter_name, round_even(1.0::DOUBLE / nc, 2) AS chapter_weight,
  lesson AS lesson_name, round_even(round_even(1.0::DOUBLE / nc, 2) / nl, 2) AS lesson_weight, page_start, page_end,
  CAST(pattern_number AS INTEGER) AS pattern_number,
  'Dạng ' || pattern_number || ': ' || trim(regexp_replace(pattern, '(?i)^Dạng\\s*\\d+\\s*:\\s*', '')) AS pattern_name,
  0.05::DOUBLE AS pattern_weight,
  {views.STRIP.format("(CASE WHEN th = '' THEN fallback ELSE th END || CASE WHEN ex = '' THEN '' ELSE chr(10) || '### 📌 Ví dụ minh họa SGK:' || chr(10) || ex END)")} AS theory_recap,
  {views.STRIP.format("('**Bước 1:** Xác định giả thiết và đơn vị kiến thức thuộc *' || lesson || '* (' || pattern || ').' || chr(10) || '**Bước 2:** Áp dụng định lý, công thức chuẩn SGK GDPT 2018 và biến đổi tương đương.' || chr(10) || '**Bước 3:** Kiểm tra điều kiện xác định và đối chiếu đáp án.' || chr(10) || CASE WHEN ec = '' THEN '' ELSE chr(10) || '### 📄 Bài toán mẫu áp dụng phương pháp:' || chr(10) || ec END)")} AS solution_method,
  chunks, diagrams
FROM counted""",
)
def curriculum_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return ops.roll_up(_chunks(spark, d))


@query(
    "curriculum_sections",
    f"""WITH {_CHUNKS},
book AS (SELECT source_id, arg_min(struct_pack(n := subject_name, g := grade),
                                   struct_pack(p := page_number, i := chunk_index)) AS b FROM chunks GROUP BY source_id),
named AS (
  SELECT source_id, page_number, chunk_index,
    CASE WHEN coalesce(trim(chapter_name), '') = '' THEN 'Chương 1: ' || b.n || ' Lớp ' || b.g ELSE chapter_name END AS chapter,
    CASE WHEN coalesce(trim(lesson_name), '') = '' THEN '{ops.DEFAULT_LESSON}' ELSE lesson_name END AS lesson,
    CASE WHEN coalesce(trim(pattern_name), '') = '' THEN '{ops.DEFAULT_PATTERN}' ELSE pattern_name END AS pattern,
    CASE WHEN section_type IN ('THEORY', 'FORMULA', 'PASSAGE') THEN 'THEORY' ELSE section_type END AS kind,
    '**[Trang ' || page_number || ']** ' || text || chr(10) AS part
  FROM chunks JOIN book USING (source_id))
SELECT *, row_number() OVER w AS section_rank, CAST(sum(length(part)) OVER w AS BIGINT) AS chars_so_far
FROM named WINDOW w AS (PARTITION BY source_id, chapter, lesson, pattern, kind ORDER BY page_number, chunk_index)""",
)
def curriculum_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of the curriculum in its section, whole."""
    return ops.roll_up_sections(_chunks(spark, d))


@query(
    "curriculum_totals",
    f"""WITH {_CHUNKS} SELECT source_id, count(DISTINCT page_number) AS total_pages,
  CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum(diagrams) AS BIGINT) AS total_diagrams
FROM chunks GROUP BY source_id""",
)
def curriculum_totals(spark: SparkSession, d: str) -> DataFrame:
    return ops.curriculum_totals(_chunks(spark, d))


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    """A type is a lesson, its parts are the patterns."""
    p = F.col("p_partkey")
    name = F.when(p % 10 == 0, "Dạng 3:").when(
        p % 3 == 0, F.concat(F.lit("dạng "), p, F.lit(": "), F.upper("p_name"))
    ).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(
        F.col("p_type").alias("lesson_id"), F.lower("p_type").alias("lesson_name"),
        p.alias("position"), name.alias("pattern_name"),
    )


_PATTERNS = """patterns AS (
  SELECT p_type AS lesson_id, lower(p_type) AS lesson_name, p_partkey AS position,
         trim(regexp_replace(CASE WHEN p_partkey % 10 = 0 THEN 'Dạng 3:' WHEN p_partkey % 3 = 0 THEN 'dạng ' || p_partkey || ': ' || upper(p_name)
              ELSE p_name END, '(?i)^Dạng\\s*\\d+\\s*:\\s*', '')) AS bare FROM part),
owners AS (SELECT lesson_id, lower(bare) AS form, min(position) AS owner, arg_min(bare, position) AS bare,
                  any_value(lesson_name) AS lesson_name FROM patterns GROUP BY ALL)"""


@query(
    "dedupe_patterns",
    f"""WITH {_PATTERNS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY owner) AS n FROM owners)
SELECT lesson_id, owner, 'Dạng ' || n || ': ' || CASE WHEN bare = '' THEN 'Trọng tâm kiến thức ' || lesson_name || ' phần ' || n ELSE bare END AS pattern_name
FROM numbered""",
)
def dedupe_patterns(spark: SparkSession, d: str) -> DataFrame:
    return ops.dedupe_patterns(_patterns(spark, d)).drop("_form")


@query(
    "merge_pattern_questions",
    f"""WITH {_PATTERNS},
asked AS (SELECT p_type AS lesson_id, l_partkey AS position, l_orderkey * 10 + l_linenumber AS question_no,
                 'q' || CAST(floor(l_quantity) AS INTEGER) AS content FROM lineitem JOIN part ON p_partkey = l_partkey),
homes AS (SELECT a.*, o.owner FROM asked a JOIN patterns p USING (lesson_id, position)
          JOIN owners o ON o.lesson_id = a.lesson_id AND o.form = lower(p.bare))
SELECT lesson_id, position, question_no, content, owner FROM (
  SELECT *, rank() OVER (PARTITION BY lesson_id, owner, content ORDER BY position, question_no) AS rk FROM homes)
WHERE position = owner OR rk = 1""",
)
def merge_pattern_questions(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    questions = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("lesson_id"),
        F.col("l_partkey").alias("position"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question_no"),
        F.concat(F.lit("q"), F.col("l_quantity").cast("int")).alias("content"),
    )
    found = ops.merge_pattern_questions(_patterns(spark, d), questions)
    return found.select("lesson_id", "position", "question_no", "content", "owner")


@query(
    "curriculum_completeness",
    """WITH c AS (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 9 = 0) AS chapters,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS lessons,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 1000) AS patterns FROM nation)
SELECT k AS curriculum_id, chapters, lessons, patterns, chapters = 0 OR lessons = 0 OR patterns = 0 AS is_incomplete FROM c""",
)
def curriculum_completeness(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").withColumnRenamed("c_nationkey", "curriculum_id")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("curriculum_id"))
    chapters = nations.join(
        customers.where("c_custkey % 9 = 0").select("curriculum_id", F.col("c_name").alias("chapter")),
        "curriculum_id", "left",
    )
    lessons = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "curriculum_id")
    return ops.completeness(chapters, lessons, customers.where("c_acctbal < 1000"), "curriculum_id")


@query(
    "reset_sources",
    f"""WITH {_SOURCES}, {_CHUNKS}, {_NEWEST}
SELECT source_id, chunk_index FROM chunks WHERE source_id NOT IN (
  SELECT source_id FROM newest JOIN supplier ON printf('s%09d', s_suppkey) = source_id WHERE s_acctbal < 4000)""",
)
def reset_sources(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks after a forced re-ingest of some files, whose newest sources start over."""
    forced = table(spark, d, "supplier").where("s_acctbal < 4000").select(
        F.format_string("s%09d", "s_suppkey").alias("source_id")
    )
    newest = ops.newest_sources(_sources(spark, d)).join(forced, "source_id", "left_semi")
    return ops.reset_sources(_chunks(spark, d), newest).select("source_id", "chunk_index")
