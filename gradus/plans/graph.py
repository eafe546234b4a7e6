"""Queries over the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import graph as ops
from gradus.plans import query, views
from gradus.sources.tables import table

# The supplied vectors lie far apart: the reference's 0.75 would ground none of them.
FLOOR = 0.30


def _anchor_sql(questions: str, archetypes: str) -> str:
    return f"""
sims AS (
  SELECT q.question_id, a.archetype_id, q.skill_id = a.skill_id AS same,
         round(list_cosine_similarity(q.embedding::DOUBLE[], a.embedding), 6) AS similarity
  FROM {questions} q, {archetypes} a WHERE is_verified),
ranked AS (
  SELECT *, 'GLOBAL' AS scope,
         row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, archetype_id) AS rank
  FROM sims
  UNION ALL
  SELECT *, 'SKILL', row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, archetype_id)
  FROM sims WHERE same),
chosen AS (
  SELECT question_id, CASE WHEN own IS NULL OR (own < {FLOOR} AND alls > own) THEN 'GLOBAL'
                           ELSE 'SKILL' END AS scope
  FROM (SELECT question_id, max(similarity) FILTER (scope = 'SKILL') AS own,
               max(similarity) FILTER (scope = 'GLOBAL') AS alls FROM ranked GROUP BY question_id)),
anchors AS (
  SELECT question_id, scope, CAST(rank AS INTEGER) AS rank, archetype_id, similarity
  FROM ranked JOIN chosen USING (question_id, scope) WHERE rank <= 3),
grounded AS (
  SELECT question_id, CASE WHEN similarity >= {FLOOR} THEN 'GROUNDED' ELSE 'LOW_CONFIDENCE' END AS status,
         CASE WHEN similarity >= {FLOOR} THEN scope END AS scope,
         CASE WHEN similarity >= {FLOOR} THEN archetype_id END AS archetype_id,
         CASE WHEN similarity >= {FLOOR} THEN similarity END AS similarity
  FROM anchors WHERE rank = 1)"""


_ANCHORS = f"{views.CENTROIDS}, {views.VECTOR_QUESTIONS}, {_anchor_sql('questions', 'centroids')}"


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return ops.anchors(views.vector_questions(spark, d), views.centroids(spark, d), FLOOR)


@query(
    "cosine_similarity",
    f"""WITH {views.CENTROIDS}
SELECT vec_id, archetype_id,
       round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding), 6) AS similarity
FROM embeddings e JOIN centroids c ON e.label = c.skill_id""",
)
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against all archetypes of its label: the ranking kernel with k = their number."""
    from gradus.operators.retrieval import vector_top_k

    found = vector_top_k(
        table(spark, d, "embeddings"), views.centroids(spark, d), "vec_id", "archetype_id", 5,
        query_scope="label", bank_scope="skill_id",
    )
    return found.drop("rank")


@query("anchor_search", f"WITH {_ANCHORS} SELECT * FROM anchors")
def anchor_search(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d)


@query("grounding", f"WITH {_ANCHORS} SELECT * FROM grounded")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    return ops.ground(views.vector_questions(spark, d), _anchors(spark, d), FLOOR)


@query(
    "graph_expansion_traps",
    f"""WITH {_ANCHORS}, {views.TRAPS}
SELECT question_id, archetype_id, trap_id, wrong_option, socratic_hint
FROM grounded JOIN traps USING (archetype_id)""",
)
def graph_expansion_traps(spark: SparkSession, d: str) -> DataFrame:
    grounded = ops.ground(views.vector_questions(spark, d), _anchors(spark, d), FLOOR)
    open_questions = grounded.withColumn("strategy", F.lit("ARCHETYPE_CANDIDATES"))
    return ops.candidate_traps(open_questions, views.traps(spark, d)).select(
        "question_id", "archetype_id", "trap_id", "wrong_option", "socratic_hint"
    )


def _asked(spark: SparkSession, d: str) -> DataFrame:
    asks, bank = views.asks(spark, d), views.keyed_archetypes(spark, d)
    return asks.drop("embedding").join(
        ops.ground(asks, ops.anchors(asks, bank, FLOOR), FLOOR), "question_id"
    )


_MATCH = """trim(regexp_replace(regexp_replace(lower({}), '[$\\\\{{}}]', '', 'g'), '\\s+', ' ', 'g'))"""


def _overlap(a: str, b: str) -> str:
    """Word overlap of two texts in match form, to four places."""
    x, y = (
        f"list_filter(list_distinct(string_split({_MATCH.format(t)}, ' ')), lambda w: w <> '')"
        for t in (a, b)
    )
    shared = f"len(list_intersect({x}, {y}))"
    whole = f"(len({x}) + len({y}) - {shared})"
    return f"round(CASE WHEN {whole} = 0 THEN 1 ELSE {shared} / {whole} END, 4)"


@query(
    "nearest_exemplars",
    f"""WITH {views.CENTROIDS}, {views.ASKS}, {views.EXEMPLARS},
archetypes AS (SELECT * REPLACE (md5('skill' || skill_id) AS skill_id) FROM centroids),
{_anchor_sql('asks', 'archetypes')},
pairs AS (
  SELECT question_id, exemplar_id, created_at, {_overlap('a.text', 'e.question_latex')} AS text_match_ratio
  FROM asks a JOIN grounded USING (question_id) JOIN exemplars e USING (archetype_id))
SELECT question_id, exemplar_id, text_match_ratio, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id
    ORDER BY text_match_ratio DESC, created_at, exemplar_id) AS rank FROM pairs) WHERE rank <= 2""",
)
def nearest_exemplars(spark: SparkSession, d: str) -> DataFrame:
    return ops.nearest_exemplars(_asked(spark, d), views.exemplars(spark, d))


@query(
    "match_form",
    f"SELECT doc_id, {_MATCH.format('text')} AS match_form FROM documents",
)
def match_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", ops.match_form(F.col("text")).alias("match_form")
    )


_GRAPH = f"""{views.CENTROIDS}, {views.ASKS}, {views.EXEMPLARS}, {views.TRAPS},
{views.CONTENT_QUESTIONS}, {views.MATERIALS},
archetypes AS (SELECT * REPLACE (md5('skill' || skill_id) AS skill_id) FROM centroids),
lessons AS (
  SELECT skill_id, arg_min(struct_pack(m := material_id, t := title, c := content), material_id) AS l
  FROM materials GROUP BY skill_id),
steps AS (
  SELECT a.question_id, q.explanation, q.skill_id AS q_skill, a.skill_id AS a_skill,
         CASE WHEN l1.l.c <> '' THEN l1.l END AS s1,
         CASE WHEN length(trim(q.explanation)) > 0 THEN
           struct_pack(m := q.question_id, t := '{ops.EXPLANATION_TITLE}', c := q.explanation) END AS s2,
         CASE WHEN l3.l.c <> '' THEN l3.l END AS s3
  FROM asks a LEFT JOIN content_questions q ON q.question_id = a.question_id
  LEFT JOIN lessons l1 ON l1.skill_id = q.skill_id
  LEFT JOIN lessons l3 ON l3.skill_id = a.skill_id),
picked AS (
  SELECT question_id, coalesce(s1, s2, s3) AS p,
         CASE WHEN coalesce(s1, s2) IS NOT NULL THEN explanation END AS explanation,
         CASE WHEN coalesce(s1, s2) IS NOT NULL THEN q_skill ELSE a_skill END AS material_skill_id,
         CASE WHEN s1 IS NOT NULL THEN 1 WHEN s2 IS NOT NULL THEN 2 ELSE 3 END AS priority
  FROM steps WHERE coalesce(s1, s2, s3) IS NOT NULL)"""


@query(
    "curriculum_material",
    f"""WITH {_GRAPH}
SELECT question_id, p.m AS material_id, p.t AS title, p.c AS content, explanation,
       material_skill_id, priority FROM picked""",
)
def curriculum_material(spark: SparkSession, d: str) -> DataFrame:
    asks = views.asks(spark, d).drop("embedding")
    return ops.materials_for(asks, views.content_questions(spark, d), views.materials(spark, d))


_SUBGRAPH = f"""{_GRAPH},
others AS (SELECT * FROM asks WHERE question_id NOT IN (SELECT question_id FROM picked)),
{_anchor_sql('others', 'archetypes')},
found AS (
  SELECT a.question_id, selected_option, correct_option,
         (SELECT min(archetype_id) FROM archetypes r WHERE r.skill_id = material_skill_id) AS archetype_id,
         'GROUNDED' AS status, 'CURRICULUM_MATERIAL' AS scope, 0.98::DOUBLE AS similarity,
         'CURRICULUM_' || substr(p.m, 1, 8) AS pattern_code, p.t AS pattern_name,
         p.c AS core_theorems, coalesce(explanation, '') <> '' AS is_exemplar
  FROM asks a JOIN picked USING (question_id)
  UNION ALL
  SELECT o.question_id, selected_option, correct_option, g.archetype_id, g.status, g.scope, g.similarity,
         r.pattern_code, r.pattern_name, r.core_theorems,
         EXISTS (SELECT 1 FROM exemplars e WHERE e.archetype_id = g.archetype_id
                 AND {_overlap('o.text', 'e.question_latex')} >= 0.9)
  FROM others o JOIN grounded g USING (question_id) LEFT JOIN archetypes r USING (archetype_id)),
resolved AS (
  SELECT f.*, n AS traps, t.tr AS trap,
         n IS NULL OR coalesce(upper(selected_option) = correct_option, false) AS none
  FROM found f
  LEFT JOIN (SELECT archetype_id, count(*) AS n FROM traps GROUP BY archetype_id) USING (archetype_id)
  LEFT JOIN (SELECT archetype_id, wrong_option AS l, arg_min(trap_id, trap_code) AS tr
             FROM traps WHERE wrong_option IS NOT NULL GROUP BY archetype_id, wrong_option) t
    ON t.archetype_id = f.archetype_id AND t.l = upper(selected_option)),
subgraphs AS (
  SELECT question_id, archetype_id, status, scope, similarity, pattern_code, pattern_name, core_theorems,
         CASE WHEN none THEN 'NONE' WHEN is_exemplar AND trap IS NOT NULL THEN 'EXEMPLAR_OPTION_LETTER'
              ELSE 'ARCHETYPE_CANDIDATES' END AS strategy,
         CASE WHEN NOT none AND is_exemplar THEN trap END AS matched_trap_id,
         CASE WHEN none OR (is_exemplar AND trap IS NOT NULL) THEN 0 ELSE traps END::BIGINT AS candidate_count
  FROM resolved)"""


def _subgraphs(spark: SparkSession, d: str) -> DataFrame:
    return ops.subgraphs(
        views.asks(spark, d),
        views.keyed_archetypes(spark, d),
        views.exemplars(spark, d),
        views.traps(spark, d),
        views.content_questions(spark, d),
        views.materials(spark, d),
        FLOOR,
    )


@query("subgraphs", f"WITH {_SUBGRAPH} SELECT * FROM subgraphs")
def subgraphs(spark: SparkSession, d: str) -> DataFrame:
    return _subgraphs(spark, d).drop(
        "text", "selected_option", "correct_option", "fast_solving_heuristics", "is_exemplar"
    )


@query(
    "trap_resolution",
    f"""WITH {_SUBGRAPH} SELECT strategy, status, count(*) AS questions,
       count(matched_trap_id) AS matched, sum(candidate_count)::BIGINT AS candidates
FROM subgraphs GROUP BY strategy, status""",
)
def trap_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _subgraphs(spark, d).groupBy("strategy", "status").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count("matched_trap_id").alias("matched"),
        F.sum("candidate_count").alias("candidates"),
    )


@query(
    "tutor_payload",
    f"""WITH {_SUBGRAPH},
lists AS (
  SELECT archetype_id, string_agg('- ' || trap_name || CASE WHEN wrong_option IS NOT NULL
             THEN ' (phương án ' || wrong_option || ')' ELSE '' END || ': ' || misconception_explanation,
             chr(10) ORDER BY wrong_option NULLS LAST, trap_code) AS bullets,
         first(socratic_hint ORDER BY wrong_option NULLS LAST, trap_code) AS hint
  FROM traps GROUP BY archetype_id)
SELECT question_id,
  coalesce(CASE WHEN status = 'GROUNDED' AND pattern_name <> '' THEN pattern_name END,
           '{ops.DEFAULT_PATTERN}') AS pattern_name,
  coalesce(CASE WHEN status = 'GROUNDED' AND core_theorems <> '' THEN core_theorems END,
           '{ops.DEFAULT_THEOREMS}') AS core_theorems,
  '' AS fast_solving_heuristics,
  CASE strategy WHEN 'EXEMPLAR_OPTION_LETTER' THEN t.trap_name
       WHEN 'ARCHETYPE_CANDIDATES' THEN '{ops.CANDIDATES_NAME}' ELSE '{ops.NO_TRAP_NAME}' END AS trap_name,
  CASE strategy WHEN 'EXEMPLAR_OPTION_LETTER' THEN t.misconception_explanation
       WHEN 'ARCHETYPE_CANDIDATES' THEN bullets ELSE '{ops.NO_TRAP_TEXT}' END AS misconception,
  CASE strategy WHEN 'EXEMPLAR_OPTION_LETTER' THEN t.socratic_hint
       WHEN 'ARCHETYPE_CANDIDATES' THEN hint ELSE '{ops.NO_TRAP_HINT}' END AS socratic_hint
FROM subgraphs s LEFT JOIN traps t ON t.trap_id = s.matched_trap_id
LEFT JOIN lists l ON l.archetype_id = s.archetype_id""",
)
def tutor_payload(spark: SparkSession, d: str) -> DataFrame:
    return ops.tutor_payload(_subgraphs(spark, d), views.traps(spark, d))
