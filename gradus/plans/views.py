"""The supplied tables seen as the data the operators work on, in Spark and in the check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import catalog as catalog_ops
from gradus.operators import novelty as novelty_ops
from gradus.sources.tables import table


def responses(spark: SparkSession, d: str) -> DataFrame:
    """A line item is an answer: a customer's orders of one year are one sitting of a test."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("student_id"),
        F.year("o_orderdate").alias("submission_id"),
        (
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000
            + F.col("l_partkey") % 10_000_000
        ).alias("answer_no"),
        F.col("l_partkey").alias("question_id"),
        (F.col("l_partkey") % 25).alias("skill_id"),
        (F.col("l_partkey") % 5).alias("domain_id"),
        (F.col("l_partkey") % 7 + 1).cast("int").alias("difficulty_level"),
        (F.col("l_returnflag") != "R").alias("is_correct"),
        F.col("l_quantity").cast("int").alias("time_spent_seconds"),
    )


RESPONSES = """responses AS (
  SELECT o_custkey AS student_id, CAST(year(o_orderdate) AS INTEGER) AS submission_id,
         (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey % 10000000 AS answer_no, l_partkey AS question_id,
         l_partkey % 25 AS skill_id, l_partkey % 5 AS domain_id,
         CAST(l_partkey % 7 + 1 AS INTEGER) AS difficulty_level,
         l_returnflag <> 'R' AS is_correct, CAST(floor(l_quantity) AS INTEGER) AS time_spent_seconds
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def domain_names(spark: SparkSession, d: str) -> DataFrame:
    """Domain 4 has no name on purpose: its id stands in for one."""
    return table(spark, d, "region").select(
        F.col("r_regionkey").cast("bigint").alias("domain_id"), F.col("r_name").alias("domain_name")
    ).where("domain_name <> 'MIDDLE EAST'")


DOMAIN_NAMES = """domain_names AS (
  SELECT CAST(r_regionkey AS BIGINT) AS domain_id, r_name AS domain_name
  FROM region WHERE r_name <> 'MIDDLE EAST')"""


def skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills 25 to 29 are in the catalog but in no answer."""
    return table(spark, d, "part").select(
        (F.col("p_partkey") % 30).alias("skill_id"), (F.col("p_partkey") % 5).alias("domain_id")
    ).distinct()


SKILLS = "skills AS (SELECT DISTINCT p_partkey % 30 AS skill_id, p_partkey % 5 AS domain_id FROM part)"


def targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("student_id"),
        (F.col("c_custkey") % 7 * 75 + 600).cast("int").alias("target_score"),
    )


TARGETS = """targets AS (
  SELECT c_custkey AS student_id, CAST(c_custkey % 7 * 75 + 600 AS INTEGER) AS target_score
  FROM customer)"""


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Each document is an upload of its source's file; every third one is sent twice."""
    again = F.sequence(F.lit(0), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0))
    return (
        table(spark, d, "documents")
        .withColumn("_again", F.explode(again))
        .select(
            (F.col("doc_id") * 2 + F.col("_again")).alias("arrival"),
            F.concat_ws("/", "source", "lang").alias("file_name"),
            F.col("text").alias("content"),
            _at(F.col("doc_id") * 2 + F.col("_again")).alias("uploaded_at"),
        )
    )


def _at(minutes: Column) -> Column:
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return base + F.make_dt_interval(mins=minutes.cast("int"))


UPLOADS = """uploads AS (
  SELECT doc_id * 2 + again AS arrival, source || '/' || lang AS file_name, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 2 + again) AS uploaded_at
  FROM documents, LATERAL (SELECT unnest(range(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END)) AS again))"""

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def prior_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Version 3 of each file that is not Spanish, holding its first upload; German is offline."""
    first = uploads(spark, d).groupBy("file_name").agg(F.min_by("content", "arrival").alias("content"))
    lang = F.substring_index("file_name", "/", -1)
    start = F.lit("2023-12-31 00:00:00").cast("timestamp_ntz")
    return first.where(lang != "es").select(
        F.md5(F.concat(F.lit("prior#"), "file_name")).alias("id"),
        F.md5("file_name").alias("document_group_id"),
        "file_name",
        F.lit(3).alias("version"),
        catalog_ops.content_hash(F.col("content")).alias("file_hash"),
        F.lit("READY").alias("status"),
        (lang != "de").alias("is_current"),
        F.lit(1).alias("total_chunks"),
        F.lit(None).cast("string").alias("error_message"),
        start.alias("created_at"),
        start.alias("updated_at"),
    )


DECISIONS = f"""{UPLOADS},
prior AS (
  SELECT md5('prior#' || file_name) AS id, md5(file_name) AS document_group_id, file_name,
         3 AS version, sha256({STRIP.format('content')}) AS file_hash,
         split_part(file_name, '/', 2) <> 'de' AS is_current
  FROM (SELECT file_name, arg_min(content, arrival) AS content FROM uploads GROUP BY file_name)
  WHERE split_part(file_name, '/', 2) <> 'es'),
hashed AS (SELECT *, sha256({STRIP.format('content')}) AS file_hash FROM uploads),
chained AS (
  SELECT h.*, p.id AS cur_id, p.version AS base, p.is_current AS cur,
         coalesce(lag(h.file_hash) OVER (PARTITION BY h.file_name ORDER BY arrival),
                  CASE WHEN p.is_current THEN p.file_hash END) IS DISTINCT FROM h.file_hash AS changed
  FROM hashed h LEFT JOIN prior p USING (file_name)),
counted AS (
  SELECT *, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY file_name ORDER BY arrival) AS changes
  FROM chained),
decisions AS (
  SELECT arrival, file_name, content, uploaded_at, file_hash, md5(file_name) AS document_group_id,
         CAST(CASE WHEN changes = 0 THEN base ELSE coalesce(base, 0) + changes END AS INTEGER) AS version,
         CASE WHEN NOT changed THEN 'UNCHANGED'
              WHEN coalesce(base, 0) + changes = 1 THEN 'NEW' ELSE 'NEW_VERSION' END AS action,
         CASE WHEN changes = 0 THEN cur_id
              ELSE md5(file_name || '#' || (coalesce(base, 0) + changes)) END AS document_id
  FROM counted),
paragraphs AS (
  SELECT document_id, document_group_id,
         unnest(list_filter(string_split_regex(replace(content, chr(10), chr(10) || chr(10)),
                                               '\\r?\\n\\r?\\n'), lambda p: p <> '')) AS content
  FROM decisions WHERE action <> 'UNCHANGED'),
winners AS (
  SELECT document_group_id, max(version) AS winner, arg_max(uploaded_at, version) AS swapped_at
  FROM decisions WHERE action <> 'UNCHANGED' GROUP BY document_group_id),
snapshot AS (
  SELECT p.id, p.document_group_id, p.file_name, p.version, p.file_hash, 'READY' AS status,
         CASE WHEN w.winner IS NULL THEN p.is_current ELSE false END AS is_current, 1 AS total_chunks,
         TIMESTAMP '2023-12-31 00:00:00' AS created_at,
         CASE WHEN p.is_current AND w.winner IS NOT NULL THEN swapped_at
              ELSE TIMESTAMP '2023-12-31 00:00:00' END AS updated_at
  FROM prior p LEFT JOIN winners w USING (document_group_id)
  UNION ALL
  SELECT d.document_id, d.document_group_id, file_name, version, file_hash, 'READY',
         version = winner, CAST(n AS INTEGER), uploaded_at, uploaded_at
  FROM decisions d JOIN winners w USING (document_group_id)
  JOIN (SELECT document_id, count(*) AS n FROM paragraphs GROUP BY document_id) c USING (document_id)
  WHERE action <> 'UNCHANGED')"""


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """Archetypes: mean vector of each label's five facets; facet 4 is not verified."""
    spots = table(spark, d, "embeddings").select(
        "label", (F.col("vec_id") % 5).cast("int").alias("facet"), F.posexplode("embedding").alias("pos", "x")
    )
    means = spots.groupBy("label", "facet", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy("label", "facet").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]
        ).alias("embedding")
    )
    number = F.col("label") * 10 + F.col("facet")
    return packed.select(
        F.format_string("A%03d", number).alias("archetype_id"),
        F.col("label").alias("skill_id"),
        F.concat(F.lit("P"), number.cast("string")).alias("pattern_code"),
        F.concat_ws(" ", F.lit("Pattern"), "label", "facet").alias("pattern_name"),
        F.when(F.col("facet") != 3, F.concat(F.lit("Theorem "), "label")).alias("core_theorems"),
        F.lit(None).cast("string").alias("fast_solving_heuristics"),
        (F.col("facet") != 4).alias("is_verified"),
        "embedding",
    )


CENTROIDS = """centroids AS (
  SELECT printf('A%03d', label * 10 + facet) AS archetype_id, label AS skill_id,
         'P' || (label * 10 + facet) AS pattern_code, 'Pattern ' || label || ' ' || facet AS pattern_name,
         CASE WHEN facet <> 3 THEN 'Theorem ' || label END AS core_theorems,
         facet <> 4 AS is_verified, list(x ORDER BY pos) AS embedding
  FROM (SELECT label, facet, pos, avg(x) AS x
        FROM (SELECT label, vec_id % 5 AS facet, unnest(embedding)::DOUBLE AS x,
                     generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, facet, pos)
  GROUP BY label, facet)"""


def vector_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding is a question; skills 10 and 11 have no archetype."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("question_id"),
        ((F.col("label") + F.col("vec_id")) % 12).cast("int").alias("skill_id"),
        "embedding",
    )


VECTOR_QUESTIONS = """questions AS (
  SELECT vec_id AS question_id, CAST((label + vec_id) % 12 AS INTEGER) AS skill_id, embedding
  FROM embeddings)"""


def vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding is the chunk of a document version; a file is (label, vec_id mod 20)."""
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat_ws("/", "label", F.col("vec_id") % 20).alias("file_name"),
        "embedding",
    )
    latest = rows.groupBy("file_name").agg(F.max("chunk_id").alias("_latest"))
    text = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return (
        rows.join(latest, "file_name")
        .join(text, "chunk_id", "left")
        .select(
            "chunk_id", "file_name", "embedding", "content",
            (F.col("chunk_id") == F.col("_latest")).alias("is_current"),
            F.lit(1).alias("version"),
            F.md5(F.col("chunk_id").cast("string")).alias("document_id"),
            F.lit("text").alias("type"),
            F.lit(0).alias("chunk_index"),
        )
    )


VECTOR_CHUNKS = """chunks AS (
  SELECT vec_id AS chunk_id, label || '/' || (vec_id % 20) AS file_name, embedding, d.text AS content,
         vec_id = max(vec_id) OVER (PARTITION BY label, vec_id % 20) AS is_current
  FROM embeddings LEFT JOIN documents d ON doc_id = vec_id)"""


def book_pages(spark: SparkSession, d: str) -> DataFrame:
    """A source is a book, its documents are the pages, with the marks of a textbook woven in."""
    page = (F.floor(F.col("doc_id") / 20) + 1).cast("int")
    return table(spark, d, "documents").select(
        F.col("source").alias("source_id"),
        page.alias("page_number"),
        F.col("doc_id").alias("chunk_index"),
        F.expr(BOOK_TEXT.format(page="(doc_id div 20 + 1)")).alias("text"),
        F.col("text").alias("plain_text"),
    )


# One text for both engines: only functions that they share.
BOOK_TEXT = """concat(
  CASE WHEN {page} = 1 THEN concat('[TAXONOMY: subject="', CASE WHEN doc_id % 2 = 0 THEN 'Toán' ELSE 'Hóa học' END,
                                   '" | grade="lớp ', CAST(10 + doc_id % 3 AS VARCHAR(2)), '"]', chr(10)) ELSE '' END,
  CASE WHEN {page} % 17 = 5 THEN concat('[TAXONOMY: chapter="Mở rộng ', CAST({page} AS VARCHAR(9)), '" | lesson="unknown" | section="example"]', chr(10)) ELSE '' END,
  CASE WHEN {page} % 8 = 2 THEN concat('# Chương ', CAST({page} % 6 + 1 AS VARCHAR(9)), ': Phần ', substring(text, 1, 12), chr(10)) ELSE '' END,
  CASE WHEN {page} % 4 = 3 THEN concat('Bài ', CAST({page} % 5 + 1 AS VARCHAR(9)), '. Về ', substring(text, 1, 9), chr(10)) ELSE '' END,
  CASE WHEN {page} % 3 = 1 THEN concat('**Dạng ', CAST({page} % 4 + 1 AS VARCHAR(9)), ' - Loại ', substring(text, 1, 7), '**', chr(10)) ELSE '' END,
  CASE WHEN {page} % 11 = 7 THEN concat('[IMAGE_PLACEHOLDER: type="graph_2d" | desc="Đồ thị ', CAST({page} AS VARCHAR(9)), '"]', chr(10), '[IMAGE_PLACEHOLDER: mạch điện số ', CAST({page} AS VARCHAR(9)), ']', chr(10)) ELSE '' END,
  CASE WHEN {page} % 9 = 4 THEN concat('Hình 1.', CAST({page} AS VARCHAR(9)), ': Sơ đồ thí nghiệm', chr(10)) ELSE '' END,
  CASE WHEN {page} % 13 = 6 THEN concat('Nhà xuất bản: Trẻ', chr(10)) ELSE '' END,
  CASE WHEN {page} % 29 = 12 THEN concat('Trình bày bìa và chủ biên', chr(10)) ELSE '' END,
  CASE WHEN {page} % 5 = 0 THEN concat(CAST({page} % 1000 AS VARCHAR(9)), chr(10), 'Nguồn: Sưu tầm', chr(10), 'Em có biết?', chr(10)) ELSE '' END,
  CASE WHEN {page} % 10 = 8 THEN concat('Ví dụ 3. Lời giải', chr(10)) ELSE '' END,
  CASE WHEN {page} % 10 = 9 THEN concat('Luyện tập 2', chr(10)) ELSE '' END,
  CASE WHEN {page} % 10 = 3 THEN concat('Định lí $a$ $b$ $c$ $d$', chr(10)) ELSE '' END,
  text)"""

BOOK_PAGES = f"""book_pages AS (
  SELECT source AS source_id, CAST(doc_id // 20 + 1 AS INTEGER) AS page_number, doc_id AS chunk_index,
         {BOOK_TEXT.format(page='(doc_id // 20 + 1)')} AS text, text AS plain_text
  FROM documents)"""


def exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item is an exemplar of all five facets of a label."""
    facets = F.explode(F.array(*[F.lit(i) for i in range(5)]))
    return table(spark, d, "benchmark").withColumn("facet", facets).select(
        F.format_string("A%03d", F.col("item_id") % 10 * 10 + F.col("facet")).alias("archetype_id"),
        (F.col("item_id") * 10 + F.col("facet")).alias("exemplar_id"),
        F.col("text").alias("question_latex"),
        F.concat(F.lit("Solution "), "item_id").alias("golden_solution"),
        F.substring(F.lit("ABCD"), (F.col("item_id") % 4 + 1).cast("int"), F.lit(1)).alias("correct_option"),
        F.array(F.lit("read"), F.lit("solve")).alias("explanation_steps"),
        F.col("item_id").alias("created_at"),
    )


EXEMPLARS = """exemplars AS (
  SELECT printf('A%03d', item_id % 10 * 10 + facet) AS archetype_id, item_id * 10 + facet AS exemplar_id,
         text AS question_latex, item_id AS created_at
  FROM benchmark, range(5) f(facet))"""


def traps(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a trap of an archetype."""
    return table(spark, d, "part").select(
        F.format_string(
            "A%03d", F.col("p_partkey") % 10 * 10 + F.floor(F.col("p_partkey") / 10) % 5
        ).alias("archetype_id"),
        F.concat(F.lit("T"), "p_partkey").alias("trap_id"),
        F.concat(F.lit("T"), "p_partkey").alias("trap_code"),
        F.col("p_name").alias("trap_name"),
        F.when(
            F.col("p_size") % 5 > 0, F.substring(F.lit("ABCD"), F.col("p_size") % 5, F.lit(1))
        ).alias("wrong_option"),
        F.col("p_type").alias("misconception_explanation"),
        F.col("p_brand").alias("socratic_hint"),
    )


TRAPS = """traps AS (
  SELECT printf('A%03d', p_partkey % 10 * 10 + p_partkey // 10 % 5) AS archetype_id,
         'T' || p_partkey AS trap_id, 'T' || p_partkey AS trap_code, p_name AS trap_name,
         CASE WHEN p_size % 5 > 0 THEN substr('ABCD', p_size % 5, 1) END AS wrong_option,
         p_type AS misconception_explanation, p_brand AS socratic_hint
  FROM part)"""


def _skill_key(number: Column) -> Column:
    return F.md5(F.concat(F.lit("skill"), number.cast("string")))


def asks(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding is a question asked of the tutor; every ninth has a malformed id."""
    v = F.col("vec_id")
    items = table(spark, d, "benchmark").select("item_id", "text")
    return (
        table(spark, d, "embeddings")
        .withColumn("item_id", F.col("label") + v % 4 * 10)
        .join(items, "item_id")
        .select(
            F.when(v % 9 == 0, F.concat(F.lit("q-"), v))
            .otherwise(F.md5(F.concat(F.lit("q"), v)))
            .alias("question_id"),
            _skill_key((F.col("label") + v) % 12).alias("skill_id"),
            "text",
            F.when(v % 7 > 0, F.substring(F.lit("abcd"), (v % 4 + 1).cast("int"), F.lit(1))).alias(
                "selected_option"
            ),
            F.substring(F.lit("ABCD"), (F.floor(v / 4) % 4 + 1).cast("int"), F.lit(1)).alias("correct_option"),
            "embedding",
        )
    )


ASKS = """asks AS (
  SELECT CASE WHEN vec_id % 9 = 0 THEN 'q-' || vec_id ELSE md5('q' || vec_id) END AS question_id,
         md5('skill' || ((label + vec_id) % 12)) AS skill_id, text,
         CASE WHEN vec_id % 7 > 0 THEN substr('abcd', vec_id % 4 + 1, 1) END AS selected_option,
         substr('ABCD', vec_id // 4 % 4 + 1, 1) AS correct_option, embedding
  FROM embeddings JOIN benchmark ON item_id = label + vec_id % 4 * 10)"""


def keyed_archetypes(spark: SparkSession, d: str) -> DataFrame:
    return centroids(spark, d).withColumn("skill_id", _skill_key(F.col("skill_id")))


def content_questions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        F.md5(F.concat(F.lit("q"), v)).alias("question_id"),
        _skill_key(v % 60).alias("skill_id"),
        F.when(v % 4 == 1, "  ").when(v % 4 > 1, F.concat(F.lit("Explanation "), v)).alias("explanation"),
    )


CONTENT_QUESTIONS = """content_questions AS (
  SELECT md5('q' || vec_id) AS question_id, md5('skill' || (vec_id % 60)) AS skill_id,
         CASE WHEN vec_id % 4 = 1 THEN '  ' WHEN vec_id % 4 > 1 THEN 'Explanation ' || vec_id END AS explanation
  FROM embeddings)"""


def materials(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.md5(F.concat(F.lit("m"), s)).alias("material_id"),
        _skill_key(s * 7 % 90).alias("skill_id"),
        F.col("s_name").alias("title"),
        F.when(s % 3 > 0, F.concat(F.lit("Lesson "), s)).alias("content"),
    )


MATERIALS = """materials AS (
  SELECT md5('m' || s_suppkey) AS material_id, md5('skill' || (s_suppkey * 7 % 90)) AS skill_id,
         s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN 'Lesson ' || s_suppkey END AS content
  FROM supplier)"""


def exam_questions(spark: SparkSession, d: str) -> DataFrame:
    """An order is an exam, its line items are the questions (a number may come up twice)."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    p = F.col("l_partkey")
    return lines.join(parts, p == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("exam_id"),
        F.col("l_linenumber").alias("question_number"),
        (p * 10 + F.col("l_linenumber")).alias("arrival"),
        (F.col("l_linenumber") * 3 - 2).alias("page_number"),
        F.when(p % 11 == 0, "  ")
        .otherwise(F.concat_ws(" ", "p_name", F.lit("\n of"), "p_type", F.lit(" hình bên")))
        .alias("content"),
        F.create_map(
            F.lit("B"), F.col("p_brand"),
            F.lit("A"), F.col("p_type"),
            F.lit("D"), F.when(p % 3 > 0, F.concat(F.lit(" size\t"), "p_size")).otherwise(" "),
            F.lit("C"), F.when(p % 5 > 0, F.col("p_size").cast("string")),
        ).alias("options"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("a", " (B) ", "2", "3", "Answer: C", "ZZ", "", "[d].", "Bx")]),
            (p % 9 + 1).cast("int"),
        ).alias("correct_option"),
        F.when(p % 4 == 0, F.concat(F.lit("because "), "p_name")).alias("explanation"),
        (p % 9 - 1).cast("int").alias("difficulty_level"),
        F.when(p % 6 == 0, F.concat(F.lit("/img/"), p)).alias("image_url"),
    )


EXAM_QUESTIONS = """exam_questions AS (
  SELECT l_orderkey AS exam_id, l_linenumber AS question_number, l_partkey * 10 + l_linenumber AS arrival,
         l_linenumber * 3 - 2 AS page_number,
         CASE WHEN l_partkey % 11 = 0 THEN '  '
              ELSE p_name || ' ' || chr(10) || ' of ' || p_type || '  hình bên' END AS content,
         p_type AS oa, p_brand AS ob, CASE WHEN l_partkey % 5 > 0 THEN CAST(p_size AS VARCHAR) END AS oc,
         CASE WHEN l_partkey % 3 > 0 THEN ' size' || chr(9) || p_size ELSE ' ' END AS od,
         ['a', ' (B) ', '2', '3', 'Answer: C', 'ZZ', '', '[d].', 'Bx'][l_partkey % 9 + 1] AS correct_option,
         CASE WHEN l_partkey % 4 = 0 THEN 'because ' || p_name END AS explanation,
         CAST(l_partkey % 9 - 1 AS INTEGER) AS difficulty_level,
         CASE WHEN l_partkey % 6 = 0 THEN '/img/' || l_partkey END AS image_url
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def novelty_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding is a parsed question, with the text of a benchmark item."""
    v = F.col("vec_id")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("content"))
    return (
        table(spark, d, "embeddings")
        .withColumn("item_id", F.col("label") + v % 4 * 10)
        .join(items, "item_id")
        .select(
            v.alias("question_id"),
            F.concat(F.lit("exam-"), v % 8).alias("source_exam"),
            "content",
            F.create_map(F.lit("B"), F.lit(" two "), F.lit("A"), F.concat(F.lit("one "), v % 3)).alias("options"),
            (v % 40 + 1).cast("int").alias("question_number"),
            F.when(v % 2 == 0, "A").alias("correct_option"),
            F.when(v % 5 == 0, F.concat(F.lit("/img/"), v)).alias("image_url"),
            _at(v).alias("created_at"),
            "embedding",
        )
    )


NOVELTY_QUESTIONS = """novelty_questions AS (
  SELECT vec_id AS question_id, 'exam-' || (vec_id % 8) AS source_exam,
         trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' A. one ' || (vec_id % 3) || ' B. two' AS question_text,
         CAST(vec_id % 40 + 1 AS INTEGER) AS question_number,
         CASE WHEN vec_id % 2 = 0 THEN 'A' END AS correct_option,
         CASE WHEN vec_id % 5 = 0 THEN '/img/' || vec_id END AS image_url,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS created_at, embedding
  FROM embeddings JOIN benchmark ON item_id = label + vec_id % 4 * 10)"""


def pending_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item was proposed before, a third of them already decided."""
    i = F.col("item_id")
    text = novelty_ops.question_text(
        F.col("text"), F.create_map(F.lit("B"), F.lit("two"), F.lit("A"), F.lit("one 0"))
    )
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("old-"), i).alias("id"),
        F.lit("earlier").alias("source_exam_name"),
        text.alias("raw_question_latex"),
        F.array().cast("array<string>").alias("image_urls"),
        F.lit("{}").alias("extracted_metadata"),
        F.when(i % 7 > 0, i / 100).alias("max_similarity_score"),
        F.format_string("A%03d", i % 50).alias("nearest_archetype_id"),
        F.when(i % 3 == 0, "APPROVED").otherwise("PENDING_REVIEW").alias("status"),
        F.lit(None).cast("string").alias("academic_feedback"),
        _at(i).alias("created_at"),
    )


PENDING_PROPOSALS = """proposals AS (
  SELECT 'old-' || item_id AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' A. one 0 B. two' AS raw_question_latex,
         CASE WHEN item_id % 7 > 0 THEN item_id / 100 END AS max_similarity_score,
         printf('A%03d', item_id % 50) AS nearest_archetype_id,
         CASE WHEN item_id % 3 = 0 THEN 'APPROVED' ELSE 'PENDING_REVIEW' END AS status,
         CAST(NULL AS VARCHAR) AS academic_feedback,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(item_id) AS created_at
  FROM benchmark)"""


# Text of one exam question, shared by both engines: {n} its number, {p} its part key.
EXAM_BLOCK = """concat(
  CASE WHEN {p} % 7 = 0 THEN concat('--- PAGE_', CAST({n} * 2 AS VARCHAR(9)), ' ---', chr(10)) ELSE '' END,
  CASE {p} % 10
    WHEN 5 THEN concat('Dựa vào thông tin sau, trả lời câu hỏi từ ', CAST({n} AS VARCHAR(9)), ' đến ', CAST({n} + 1 AS VARCHAR(9)), ':', chr(10), 'Đoạn văn ', p_name, chr(10), 'và hết.', chr(10))
    WHEN 6 THEN concat('Questions ', CAST({n} AS VARCHAR(9)), '-', CAST({n} + 2 AS VARCHAR(9)), chr(10), 'English passage ', p_type, chr(10))
    WHEN 7 THEN concat('Đọc đoạn trích và trả lời câu hỏi từ 9 đến 2', chr(10), 'bad', chr(10))
    ELSE '' END,
  CASE {p} % 6
    WHEN 0 THEN concat('Câu ', CAST({n} AS VARCHAR(9)), ': ', p_name, ' nào đúng?', chr(10), 'A. ', p_brand, chr(10), 'B. ', p_type, chr(10), 'C. ', CAST(p_size AS VARCHAR(9)), chr(10), 'D. none')
    WHEN 1 THEN concat('Question ', CAST({n} AS VARCHAR(9)), '. ', p_name, ' is A. ', p_brand, ' B. ', p_type, ' C) x')
    WHEN 2 THEN concat(CAST({n} AS VARCHAR(9)), '. ', p_name, ' bare', chr(10), 'A. ', p_brand, chr(10), 'B. ', p_type, '  twice')
    WHEN 3 THEN concat(CAST({n} AS VARCHAR(9)), '. ', p_name, ' listed only')
    WHEN 4 THEN concat('CÂU ', CAST({n} AS VARCHAR(9)), '. ', p_name, ' error A B C D')
    ELSE concat('Câu ', CAST({n} AS VARCHAR(9)), ':') END)"""


def exam_texts(spark: SparkSession, d: str) -> DataFrame:
    """An order is an exam; its line items, written out one below the other, are its text."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    block = F.expr(EXAM_BLOCK.format(n="l_linenumber", p="l_partkey"))
    parts_of = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_orderkey").alias("exam_id")
    )
    ordered = F.sort_array(
        F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", block.alias("block")))
    )
    return parts_of.agg(F.transform(ordered, lambda b: b["block"]).alias("_b")).select(
        "exam_id",
        F.concat(F.lit("Đề thi\n"), F.array_join("_b", "\n"), F.lit("\n--- HẾT ---\nThe end.")).alias("text"),
        F.lit(3).alias("total_pages"),
    )


EXAM_TEXTS = f"""exam_texts AS (
  SELECT l_orderkey AS exam_id, 'Đề thi' || chr(10) || string_agg({EXAM_BLOCK.format(n='l_linenumber', p='l_partkey')},
           chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) || chr(10) || '--- HẾT ---' || chr(10) || 'The end.' AS text,
         3 AS total_pages
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""


def passage_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each line item is the part of a passage over two numbers."""
    return exam_questions(spark, d).select(
        "exam_id",
        (F.col("question_number") - F.col("question_number") % 2).alias("start_question"),
        (F.col("question_number") - F.col("question_number") % 2 + 1).alias("end_question"),
        "arrival",
        F.when(F.col("arrival") % 4 == 0, F.upper(F.element_at(F.split("content", " "), 1)))
        .otherwise(F.col("content"))
        .alias("content"),
        "image_url",
    )


PASSAGE_PARTS = """passage_parts AS (
  SELECT exam_id, question_number - question_number % 2 AS start_question,
         question_number - question_number % 2 + 1 AS end_question, arrival,
         CASE WHEN arrival % 4 = 0 THEN upper(split_part(content, ' ', 1)) ELSE content END AS content,
         image_url
  FROM exam_questions)"""


def taxonomy_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Part names are patterns, placed under lessons and chapters of two made-up domains."""
    p = F.col("first")
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first"), F.min_by("p_type", "p_partkey").alias("p_type")).select(
        p.alias("ord"),
        F.concat(F.lit("S"), p % 9).alias("skill_id"),
        F.when(p % 4 == 0, "Tiếng Anh").when(p % 4 == 1, "Toán học").otherwise("Khoa học").alias("domain_name"),
        F.element_at(
            F.array(F.lit("Chương 1: Vật lí"), F.lit("Chương 2: Hóa học"), F.lit("Chương 3: Đại số")),
            (p % 3 + 1).cast("int"),
        ).alias("chapter_name"),
        F.concat(F.lit("Bài "), p % 5, F.lit(": "), "p_type").alias("lesson_name"),
        F.col("p_name").alias("pattern_name"),
    )


TAXONOMY_NODES = """nodes AS (
  SELECT p AS ord, 'S' || (p % 9) AS skill_id,
         CASE p % 4 WHEN 0 THEN 'Tiếng Anh' WHEN 1 THEN 'Toán học' ELSE 'Khoa học' END AS domain_name,
         ['Chương 1: Vật lí', 'Chương 2: Hóa học', 'Chương 3: Đại số'][p % 3 + 1] AS chapter_name,
         'Bài ' || (p % 5) || ': ' || p_type AS lesson_name, p_name AS pattern_name
  FROM (SELECT p_name, min(p_partkey) AS p, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY p_name))"""


def mapping_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each document is a question that mentions a part."""
    i = F.col("doc_id")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return (
        table(spark, d, "documents")
        .join(parts, i % 200 == F.col("p_partkey"))
        .select(
            i.alias("question_id"),
            F.concat_ws(" ", "text", "p_type").alias("content"),
            F.when(i % 3 == 0, F.concat(F.lit("Xét "), "p_name")).alias("passage_excerpt"),
            F.when(i % 2 == 0, F.upper("p_name")).when(i % 5 == 0, "Đại số").alias("suggested_skill_name"),
            F.element_at(
                F.array(F.lit("MATH"), F.lit("GENERAL"), F.lit("phys "), F.lit("ENGL")), (i % 4 + 1).cast("int")
            ).alias("subject_code"),
        )
    )


MAPPING_QUESTIONS = """asked AS (
  SELECT doc_id AS question_id, text || ' ' || p_type AS content,
         CASE WHEN doc_id % 3 = 0 THEN 'Xét ' || p_name END AS passage_excerpt,
         CASE WHEN doc_id % 2 = 0 THEN upper(p_name) WHEN doc_id % 5 = 0 THEN 'Đại số' END AS suggested_skill_name,
         ['MATH', 'GENERAL', 'PHYS', 'ENGL'][doc_id % 4 + 1] AS subject_code
  FROM documents JOIN part ON doc_id % 200 = p_partkey)"""


def book_sources(spark: SparkSession, d: str) -> DataFrame:
    return book_pages(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("_n")).select(
        "source_id",
        F.lit("PHYS").alias("subject_code"),
        F.lit(9).alias("grade"),
        F.lit("Cánh diều").alias("book_edition"),
    )


def book_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item is a node of the curriculum, named by its words."""
    w = F.split(F.lower(F.regexp_replace("text", r"[.,\s]+", " ")), " ")
    i = F.col("item_id")
    return table(spark, d, "benchmark").select(
        i.alias("ord"),
        F.when(i % 2 == 0, "MATH").otherwise("CHEM").alias("subject_code"),
        (i % 3 + 10).cast("int").alias("grade"),
        F.concat(F.lit("Chương "), i % 4 + 1, F.lit(": "), F.array_join(F.slice(w, 1, 2), " ")).alias("chapter_name"),
        F.concat(F.lit("Bài "), i % 5 + 1, F.lit(": "), F.array_join(F.slice(w, 3, 2), " ")).alias("lesson_name"),
        F.concat(F.lit("Dạng "), i % 6 + 1, F.lit(": "), F.array_join(F.slice(w, 5, 6), " ")).alias("pattern_name"),
    )


BOOK_NODES = """book_nodes AS (
  SELECT item_id AS ord, CASE WHEN item_id % 2 = 0 THEN 'MATH' ELSE 'CHEM' END AS subject_code,
         CAST(item_id % 3 + 10 AS INTEGER) AS grade,
         'Chương ' || (item_id % 4 + 1) || ': ' || array_to_string(w[1:2], ' ') AS chapter_name,
         'Bài ' || (item_id % 5 + 1) || ': ' || array_to_string(w[3:4], ' ') AS lesson_name,
         'Dạng ' || (item_id % 6 + 1) || ': ' || array_to_string(w[5:10], ' ') AS pattern_name
  FROM (SELECT item_id, string_split(lower(regexp_replace(text, '[.,\\s]+', ' ', 'g')), ' ') AS w FROM benchmark))"""
