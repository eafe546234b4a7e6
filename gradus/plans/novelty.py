"""Queries for novelty detection and the review of proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import novelty as ops
from gradus.plans import query, views
from gradus.sources.tables import table

THRESHOLD = 0.30


@query(
    "question_text",
    f"""WITH {views.EXAM_QUESTIONS}
SELECT exam_id, arrival, question_number, trim(regexp_replace(concat_ws(chr(10),
  {views.STRIP.format('content')},
  CASE WHEN trim(oa) <> '' THEN 'A. ' || {views.STRIP.format('oa')} END,
  CASE WHEN trim(ob) <> '' THEN 'B. ' || {views.STRIP.format('ob')} END,
  CASE WHEN trim(oc) <> '' THEN 'C. ' || {views.STRIP.format('oc')} END,
  CASE WHEN trim(od) <> '' THEN 'D. ' || {views.STRIP.format('od')} END), '\\s+', ' ', 'g')) AS question_text
FROM exam_questions WHERE trim(content) <> ''""",
)
def question_text(spark: SparkSession, d: str) -> DataFrame:
    good, _ = ops.with_text(views.exam_questions(spark, d))
    return good.select("exam_id", "arrival", "question_number", "question_text")


@query(
    "flatten_exams",
    f"""WITH {views.EXAM_QUESTIONS}
SELECT exam_id, question_number, content, CASE WHEN question_number IN (3, 4) THEN '3-4' END AS passage_range,
       count(*) AS copies
FROM exam_questions WHERE trim(content) <> '' GROUP BY ALL""",
)
def flatten_exams(spark: SparkSession, d: str) -> DataFrame:
    """Questions nested into exams (3 and 4 below a passage) and flattened again."""
    q = F.struct("question_number", "content", "correct_option")
    nested = views.exam_questions(spark, d).groupBy("exam_id").agg(
        F.collect_list(F.when(~F.col("question_number").isin(3, 4), q)).alias("single_questions"),
        F.array(
            F.struct(
                F.lit(3).alias("start_question"),
                F.lit(4).alias("end_question"),
                F.collect_list(F.when(F.col("question_number").isin(3, 4), q)).alias("questions"),
            )
        ).alias("passages"),
    )
    return (
        ops.flatten_exams(nested)
        .groupBy("exam_id", "question_number", "content", "passage_range")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


_DETECT = f"""{views.CENTROIDS}, {views.NOVELTY_QUESTIONS},
nearest AS (
  SELECT question_id, arg_max(archetype_id, struct_pack(s := sim, o := -n)) AS nearest_archetype_id,
         max(sim) AS max_similarity
  FROM (SELECT q.question_id, a.archetype_id, CAST(substr(a.archetype_id, 2) AS INTEGER) AS n,
               round(list_cosine_similarity(q.embedding::DOUBLE[], a.embedding), 6) AS sim
        FROM novelty_questions q, centroids a) GROUP BY question_id),
detected AS (
  SELECT *, CASE WHEN max_similarity < {THRESHOLD} THEN 'NOVEL_PATTERN_CANDIDATE'
                 ELSE 'MATCHED_EXISTING' END AS status
  FROM novelty_questions JOIN nearest USING (question_id))"""


def _detected(spark: SparkSession, d: str) -> DataFrame:
    good, _ = ops.with_text(views.novelty_questions(spark, d))
    return ops.detect(good, views.centroids(spark, d), THRESHOLD)


@query(
    "novelty_detection",
    f"""WITH {_DETECT} SELECT question_id, question_text, nearest_archetype_id, max_similarity, status
FROM detected""",
)
def novelty_detection(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d).select(
        "question_id", "question_text", "nearest_archetype_id", "max_similarity", "status"
    )


_STAGE = f"""{_DETECT}, {views.PENDING_PROPOSALS},
novel AS (SELECT * FROM detected WHERE status = 'NOVEL_PATTERN_CANDIDATE'),
staged AS (
  SELECT n.*, coalesce(e.existing, md5('proposal#' || question_text)) AS proposal_id,
         e.existing IS NOT NULL OR question_id <> min(question_id) OVER (PARTITION BY question_text)
           AS duplicate_proposal
  FROM novel n LEFT JOIN (SELECT raw_question_latex, min(id) AS existing FROM proposals
                          WHERE status = 'PENDING_REVIEW' GROUP BY raw_question_latex) e
    ON e.raw_question_latex = n.question_text)"""


def _staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return ops.stage(_detected(spark, d), views.pending_proposals(spark, d))


@query(
    "stage_proposals",
    f"WITH {_STAGE} SELECT question_id, proposal_id, duplicate_proposal FROM staged",
)
def stage_proposals(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d)[0].select("question_id", "proposal_id", "duplicate_proposal")


@query(
    "new_proposals",
    f"""WITH {_STAGE}
SELECT proposal_id AS id, source_exam AS source_exam_name, question_text AS raw_question_latex,
       coalesce(image_url, '') AS images,
       '{{"question_number":' || question_number || CASE WHEN correct_option IS NOT NULL
          THEN ',"correct_option":"A"' ELSE '' END
          || ',"options":{{"B":" two ","A":"one ' || (question_id % 3) || '"}}}}' AS extracted_metadata,
       max_similarity AS max_similarity_score, nearest_archetype_id
FROM staged WHERE NOT duplicate_proposal""",
)
def new_proposals(spark: SparkSession, d: str) -> DataFrame:
    fresh = _staged(spark, d)[1].withColumn("images", F.array_join("image_urls", ","))
    return fresh.select(
        "id", "source_exam_name", "raw_question_latex", "images", "extracted_metadata",
        "max_similarity_score", "nearest_archetype_id",
    )


@query(
    "novelty_summary",
    f"""WITH {_STAGE}
SELECT source_exam, count(*) AS total, count(*) FILTER (status = 'MATCHED_EXISTING') AS matched_existing,
       count(*) FILTER (status <> 'MATCHED_EXISTING') AS novel_candidates,
       coalesce(any_value(n), 0) AS new_proposals
FROM detected LEFT JOIN (SELECT source_exam, count(*) FILTER (NOT duplicate_proposal) AS n
                         FROM staged GROUP BY source_exam) USING (source_exam)
GROUP BY source_exam""",
)
def novelty_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.summary(_detected(spark, d), _staged(spark, d)[0])


@query(
    "proposal_queue",
    f"""WITH {views.CENTROIDS}, {views.PENDING_PROPOSALS},
page AS (SELECT * FROM proposals WHERE status = 'PENDING_REVIEW'
         ORDER BY max_similarity_score ASC NULLS FIRST, created_at DESC, id LIMIT 20 OFFSET 3)
SELECT p.id, p.max_similarity_score, p.nearest_archetype_id, pattern_code AS nearest_pattern_code,
       pattern_name AS nearest_pattern_name,
       (SELECT count(*) FROM proposals WHERE status = 'PENDING_REVIEW') AS total
FROM page p LEFT JOIN centroids ON archetype_id = nearest_archetype_id""",
)
def proposal_queue(spark: SparkSession, d: str) -> DataFrame:
    proposals = views.pending_proposals(spark, d)
    page = ops.proposal_queue(proposals, views.centroids(spark, d), limit=20, offset=3)
    total = ops.proposal_total(proposals).withColumn("status", F.lit(ops.PENDING))
    return page.join(total, "status").select(
        "id", "max_similarity_score", "nearest_archetype_id", "nearest_pattern_code",
        "nearest_pattern_name", "total",
    )


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Two decisions for each earlier proposal, some of them invalid."""
    i, n = F.col("item_id"), F.col("n")
    number = i * 2 + n
    return (
        table(spark, d, "benchmark")
        .withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            number.alias("decision_no"),
            F.concat(F.lit("old-"), i).alias("proposal_id"),
            F.element_at(
                F.array(F.lit("APPROVED"), F.lit("MERGED"), F.lit("REJECTED")), (number % 3 + 1).cast("int")
            ).alias("decision"),
            F.concat(F.lit("note "), number).alias("academic_feedback"),
            F.when(number % 4 == 1, F.format_string("A%03d", i % 60)).alias("merged_into_archetype_id"),
        )
    )


_REVIEW = f"""{views.CENTROIDS}, {views.PENDING_PROPOSALS},
decisions AS (
  SELECT no AS decision_no, 'old-' || item_id AS proposal_id, ['APPROVED', 'MERGED', 'REJECTED'][no % 3 + 1] AS decision,
         'note ' || no AS academic_feedback, CASE WHEN no % 4 = 1 THEN printf('A%03d', item_id % 60) END AS target
  FROM (SELECT item_id, item_id * 2 + n AS no FROM benchmark, range(2) r(n))),
judged AS (
  SELECT d.*, CASE WHEN decision = 'MERGED' AND target IS NULL THEN 'MISSING_TARGET'
                   WHEN target IS NOT NULL AND archetype_id IS NULL THEN 'UNKNOWN_TARGET'
                   WHEN p.id IS NULL THEN 'NOT_PENDING' END AS reason
  FROM decisions d LEFT JOIN centroids ON archetype_id = target
  LEFT JOIN proposals p ON p.id = proposal_id AND p.status = 'PENDING_REVIEW'),
firsts AS (SELECT proposal_id, min(decision_no) AS no FROM judged WHERE reason IS NULL GROUP BY proposal_id)"""


@query(
    "review_decisions",
    f"""WITH {_REVIEW}
SELECT p.id, coalesce(j.decision, p.status) AS status, j.academic_feedback,
       coalesce(j.target, p.nearest_archetype_id) AS nearest_archetype_id
FROM proposals p LEFT JOIN firsts f ON f.proposal_id = p.id
LEFT JOIN judged j ON j.proposal_id = p.id AND j.decision_no = f.no""",
)
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    updated, _ = ops.review(
        views.pending_proposals(spark, d), _decisions(spark, d), views.centroids(spark, d)
    )
    return updated.select("id", "status", "academic_feedback", "nearest_archetype_id")


@query(
    "review_rejects",
    f"""WITH {_REVIEW}
SELECT decision_no, proposal_id, coalesce(reason, CASE WHEN decision_no <> no THEN 'NOT_PENDING' END) AS reason
FROM judged LEFT JOIN firsts USING (proposal_id) WHERE reason IS NOT NULL OR decision_no <> no""",
)
def review_rejects(spark: SparkSession, d: str) -> DataFrame:
    _, rejects = ops.review(
        views.pending_proposals(spark, d), _decisions(spark, d), views.centroids(spark, d)
    )
    return rejects.select("decision_no", "proposal_id", "reason")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier brings the seed of an archetype; some name a nation that is not a skill."""
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.alias("seed_no"),
        F.concat(F.lit("nation_"), F.col("s_nationkey") + s % 2 * 20).alias("skill_name"),
        F.concat(F.lit("P"), s % 120).alias("pattern_code"),
        F.col("s_name").alias("pattern_name"),
        F.concat(F.lit("About "), "s_name").alias("description"),
        F.lit("Theorem").alias("core_theorems"),
        F.lit(None).cast("string").alias("fast_solving_heuristics"),
    )


def _upsert(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    skills = table(spark, d, "nation").select(
        F.col("n_name").alias("skill_name"), F.col("n_nationkey").alias("skill_id")
    )
    bank = views.centroids(spark, d).withColumn("description", F.lit(None).cast("string"))
    return ops.upsert_archetypes(bank, _seeds(spark, d), skills)


@query(
    "upsert_archetypes",
    f"""WITH {views.CENTROIDS},
named AS (
  SELECT s.*, n_nationkey AS skill_id, 'P' || (s_suppkey % 120) AS pattern_code
  FROM supplier s LEFT JOIN nation ON lower(n_name) = 'nation_' || (s_nationkey + s_suppkey % 2 * 20)),
seeds AS (SELECT pattern_code, arg_max(s_name, s_suppkey) AS s_name, arg_max(skill_id, s_suppkey) AS skill_id
          FROM named WHERE skill_id IS NOT NULL GROUP BY pattern_code)
SELECT coalesce(c.archetype_id, md5('archetype#' || s.pattern_code)) AS archetype_id,
       coalesce(c.pattern_code, s.pattern_code) AS pattern_code, coalesce(s.skill_id, c.skill_id) AS skill_id,
       coalesce(s.s_name, c.pattern_name) AS pattern_name, coalesce(c.is_verified, true) AS is_verified,
       s_name || chr(10) || 'About ' || s_name || chr(10) || 'Theorem' AS embedding_text
FROM centroids c FULL JOIN seeds s USING (pattern_code)
UNION ALL
SELECT 'reject', pattern_code, NULL, s_name, NULL, NULL FROM named WHERE skill_id IS NULL""",
)
def upsert_archetypes(spark: SparkSession, d: str) -> DataFrame:
    merged, rejects = _upsert(spark, d)
    kept = merged.select(
        "archetype_id", "pattern_code", "skill_id", "pattern_name", "is_verified", "embedding_text"
    )
    turned_away = rejects.select(
        F.lit("reject").alias("archetype_id"), "pattern_code",
        F.lit(None).cast("int").alias("skill_id"), "pattern_name",
        F.lit(None).cast("boolean").alias("is_verified"),
        F.lit(None).cast("string").alias("embedding_text"),
    )
    return kept.unionByName(turned_away)


@query(
    "replaced_children",
    f"""WITH {views.TRAPS}
SELECT archetype_id, trap_id FROM traps WHERE archetype_id NOT LIKE 'A03%'
UNION ALL SELECT printf('A%03d', 30 + s_suppkey % 5), 'N' || s_suppkey FROM supplier""",
)
def replaced_children(spark: SparkSession, d: str) -> DataFrame:
    """Traps after an upsert of five archetypes, whose new traps are the suppliers."""
    traps = views.traps(spark, d).select("archetype_id", "trap_id")
    fresh = table(spark, d, "supplier").select(
        F.format_string("A%03d", F.col("s_suppkey") % 5 + 30).alias("archetype_id"),
        F.concat(F.lit("N"), "s_suppkey").alias("trap_id"),
    )
    seeded = views.centroids(spark, d).where("archetype_id LIKE 'A03%'").select("archetype_id")
    replaced = seeded.unionByName(fresh.select("archetype_id")).distinct()
    return ops.replace_children(traps, replaced, fresh)
