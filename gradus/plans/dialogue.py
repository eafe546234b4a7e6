"""Queries over dialogue turns and the interaction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.markers import Markers
from gradus.functions.text import mentions
from gradus.operators import dialogue as ops
from gradus.operators import interactions as log_ops
from gradus.plans import query, views
from gradus.sources.tables import table

# The supplied turns are invented words, so the rules run on words that occur in them.
MARKERS = Markers(
    persona=("is", "en la", "die der", "was"),
    skeptic=("from", "nicht", "les en"),
    frustrated=("this", "eine", "thing in"),
    validity=("which", "inthe", "been", "éeaux"),
    task=("with", "por", "that the", "une"),
    knowledge=("heting", "zu", "del"),
    problem=("erening", "by"),
    curious=("are", "thation"),
    step=("and the", "ist"),
    greetings=("in", "than", "the"),
    meta=("ontion the", "und die"),
)


def _strings(words: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _mentions_sql(text: str, tokens: str, markers: tuple[str, ...]) -> str:
    loose = [m for m in markers if " " in m or len(m) > 4]
    strict = [m for m in markers if m not in loose]
    parts = [f"contains({text}, '{m}')" for m in loose]
    if strict:
        parts.append(f"list_has_any({tokens}, {_strings(strict)})")
    return "(" + " OR ".join(parts) + ")"


def _norm_sql(text: str) -> str:
    return f"regexp_replace(lower({views.STRIP.format(f'coalesce({text}, {chr(39) * 2})')}), '\\s+', ' ', 'g')"


_WORD = "[\\p{L}\\p{N}\\p{Mn}_]+"

_HISTORY = f"""said AS (SELECT * FROM conversations WHERE {views.STRIP.format('text')} <> ''),
turns AS (
  SELECT *, array_agg(CASE WHEN lower(role) IN ('tutor', 'ai', 'assistant', 'model') THEN 'tutor' ELSE 'student' END
                      || ':' || {views.STRIP.format('text')}) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history FROM said)"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_history(table(spark, d, "conversations"))


@query(
    "history_windows",
    f"""WITH {_HISTORY}
SELECT conv_id, turn, coalesce(array_to_string(history, '|'), '') AS history FROM turns""",
)
def history_windows(spark: SparkSession, d: str) -> DataFrame:
    said = F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), h["text"]))
    return _history(spark, d).select("conv_id", "turn", F.array_join(said, "|").alias("history"))


def _asks(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn is an ask; the item on screen differs by conversation."""
    c, t = F.col("conv_id"), F.col("turn")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    sign = F.when((c + t) % 4 == 2, " x = 2 √ y^2").when(c % 3 == 0, " ?").otherwise("")
    said = F.concat(F.when(c % 7 == 5, F.expr("substring(text, 1, 15)")).otherwise(F.col("text")), sign)
    return (
        _history(spark, d)
        .where("role = 'user'")
        .withColumn("item_id", c % 40)
        .join(items, "item_id")
        .select(
            "conv_id",
            "turn",
            said.alias("query"),
            F.when(c % 5 == 0, "Câu hỏi  ôn tập ĐGNL")
            .when(c % 5 == 1, F.concat(F.lit(" "), F.translate(said, "etin", "ETIN")))
            .when(c % 5 == 2, F.concat_ws(" ", F.expr("substring(text, 1, 60)"), "item"))
            .otherwise(F.col("item"))
            .alias("question_latex"),
            F.when(c % 4 == 0, F.create_map(F.lit("A"), F.col("item"), F.lit("B"), F.lit("b"), F.lit("C"), F.lit("c"))).alias("options"),
            "history",
        )
    )


_ASKS = f"""{_HISTORY},
asks0 AS (
  SELECT conv_id, turn, t.text AS text, history, b.text AS item,
         CASE WHEN conv_id % 7 = 5 THEN substr(t.text, 1, 15) ELSE t.text END
         || CASE WHEN (conv_id + turn) % 4 = 2 THEN ' x = 2 √ y^2' WHEN conv_id % 3 = 0 THEN ' ?' ELSE '' END AS query
  FROM turns t JOIN benchmark b ON item_id = conv_id % 40 WHERE role = 'user'),
asks AS (
  SELECT conv_id, turn, query, CASE conv_id % 5 WHEN 0 THEN 'Câu hỏi  ôn tập ĐGNL' WHEN 1 THEN ' ' || translate(query, 'etin', 'ETIN')
           WHEN 2 THEN substr(text, 1, 60) || ' ' || item ELSE item END AS question_latex,
         conv_id % 4 = 0 AND length(item) > 15 AS real_options, history IS NOT NULL AS has_history
  FROM asks0),
normed AS (SELECT *, {_norm_sql('query')} AS q, {_norm_sql('question_latex')} AS s FROM asks),
tokened AS (SELECT *, list_distinct(regexp_extract_all(q, '{_WORD}')) AS qt, list_distinct(regexp_extract_all(s, '{_WORD}')) AS st FROM normed),
flags AS (
  SELECT *, s NOT IN ('', 'câu hỏi của học sinh', 'câu hỏi ôn tập đgnl') AND NOT (q <> '' AND s = q) AS task,
    length(q) >= 25 AND (len(regexp_extract_all(q, '[=^\\\\$∫≤≥√π]|[0-9]')) >= 3 OR {_mentions_sql('q', 'qt', MARKERS.problem)}) AS problem,
    CASE WHEN len(qt) > 0 AND len(st) > 0 THEN len(list_intersect(qt, st)) / len(qt) ELSE 0 END AS share,
    {_mentions_sql('q', 'qt', MARKERS.persona)} AS persona, {_mentions_sql('q', 'qt', MARKERS.skeptic)} AS skeptic,
    {_mentions_sql('q', 'qt', MARKERS.frustrated)} AS frustrated, {_mentions_sql('q', 'qt', MARKERS.validity)} AS validity,
    {_mentions_sql('q', 'qt', MARKERS.task)} OR list_has_any(qt, ['a', 'b', 'c', 'd']) AS onward,
    {_mentions_sql('q', 'qt', MARKERS.knowledge)} AS knowledge FROM tokened),
labelled AS (
  SELECT *, CASE WHEN task THEN CASE WHEN q = '' THEN 'C4' WHEN validity THEN 'C3' WHEN problem AND share < 0.2 THEN 'C5'
        WHEN (persona OR skeptic OR frustrated) AND (onward OR has_history) THEN 'C2' WHEN persona AND NOT has_history THEN 'C1' ELSE 'C4' END
      ELSE CASE WHEN problem OR knowledge THEN 'C5' ELSE 'C1' END END AS category,
    CASE WHEN skeptic THEN 'SKEPTICAL' WHEN frustrated THEN 'FRUSTRATED'
         WHEN contains(q, '?') OR {_mentions_sql('q', 'qt', MARKERS.curious)} THEN 'CURIOUS' ELSE 'NEUTRAL' END AS student_mood
  FROM flags),
focused AS (
  SELECT *, CASE WHEN category = 'C1' THEN 'PERSONA' WHEN category = 'C3' THEN 'EXAM_VALIDITY'
                 WHEN category = 'C5' OR {_mentions_sql('q', 'qt', MARKERS.step)} THEN 'STEP_HINT' ELSE 'CONCEPT_EXPLANATION' END AS target_focus
  FROM labelled)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return ops.label(_asks(spark, d), MARKERS)


@query(
    "task_context",
    f"WITH {_ASKS} SELECT conv_id, turn, task AS has_task_context FROM flags",
)
def task_context(spark: SparkSession, d: str) -> DataFrame:
    task = ops.has_task(F.col("question_latex"), F.col("query"), MARKERS)
    return _asks(spark, d).select("conv_id", "turn", task.alias("has_task_context"))


@query(
    "marker_matches",
    "WITH t AS (SELECT conv_id, turn, lower(text) AS q, regexp_extract_all(lower(text), '"
    + _WORD
    + "') AS k FROM conversations) SELECT conv_id, turn, "
    + ", ".join(
        f"{_mentions_sql('q', 'k', getattr(MARKERS, name))} AS {name}"
        for name in ("persona", "skeptic", "frustrated", "validity", "task", "knowledge")
    )
    + " FROM t",
)
def marker_matches(spark: SparkSession, d: str) -> DataFrame:
    def hit(name: str) -> Column:
        return mentions(F.lower("text"), list(getattr(MARKERS, name))).alias(name)

    names = ("persona", "skeptic", "frustrated", "validity", "task", "knowledge")
    return table(spark, d, "conversations").select("conv_id", "turn", *[hit(n) for n in names])


@query(
    "turn_labels",
    f"""WITH {_ASKS} SELECT conv_id, turn, task AS has_task_context, category, student_mood, target_focus
FROM focused""",
)
def turn_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select(
        "conv_id", "turn", "has_task_context", "category", "student_mood", "target_focus"
    )


@query(
    "mood_and_focus",
    f"""WITH {_ASKS} SELECT category, student_mood, target_focus, count(*) AS turns FROM focused GROUP BY ALL""",
)
def mood_and_focus(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("category", "student_mood", "target_focus").agg(
        F.count(F.lit(1)).alias("turns")
    )


@query(
    "label_repairs",
    f"""WITH {_ASKS},
ext AS (SELECT *, 'C' || ((conv_id + turn) % 5 + 1) AS ec, ['NEUTRAL', 'CURIOUS'][turn % 2 + 1] AS em,
               ['PERSONA', 'STEP_HINT', 'EXAM_VALIDITY'][(conv_id * 2 + turn) % 3 + 1] AS ef FROM focused),
fixed AS (SELECT *, CASE WHEN task OR ec IN ('C1', 'C5') THEN ec WHEN category IN ('C1', 'C5') THEN category ELSE 'C1' END AS fc FROM ext),
aimed AS (SELECT *, CASE WHEN fc = 'C1' THEN 'PERSONA' WHEN fc = 'C3' THEN 'EXAM_VALIDITY'
                         WHEN ef = 'PERSONA' THEN CASE WHEN fc = 'C5' THEN 'STEP_HINT' ELSE 'CONCEPT_EXPLANATION' END ELSE ef END AS ff FROM fixed)
SELECT conv_id, turn, fc AS category, em AS student_mood, ff AS target_focus, fc <> ec OR ff <> ef AS repaired FROM aimed""",
)
def label_repairs(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    foci = F.array(F.lit("PERSONA"), F.lit("STEP_HINT"), F.lit("EXAM_VALIDITY"))
    external = table(spark, d, "conversations").where("role = 'user'").select(
        "conv_id",
        "turn",
        F.concat(F.lit("C"), (c + t) % 5 + 1).alias("ext_category"),
        F.when(t % 2 == 0, "NEUTRAL").otherwise("CURIOUS").alias("ext_mood"),
        F.element_at(foci, ((c * 2 + t) % 3 + 1).cast("int")).alias("ext_focus"),
    )
    return ops.repair_labels(_labelled(spark, d), external, ["conv_id", "turn"])


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns, some of which give an option away."""
    c, t = F.col("conv_id"), F.col("turn")
    given = F.element_at(
        F.array(*[F.lit(x) for x in ("A", "b", " C ", "D", "x")]), (t % 5 + 1).cast("int")
    )
    told = F.element_at(
        F.array(*[F.lit(x) for x in (
            ". Em chọn đáp án B nhé", ". Đáp án đúng là A.", " phương án D", ". Kết quả chính xác  c!", "",
        )]),
        (c % 5 + 1).cast("int"),
    )
    return table(spark, d, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.concat("text", told).alias("reply"), given.alias("correct_option")
    )


_LEAK = "CASE " + " ".join(
    f"WHEN upper(trim(correct_option)) = '{x}' THEN regexp_matches(lower(reply), "
    f"'(?:chọn|đáp án|phương án|kết quả)(?:\\s+đúng|\\s+chính xác)?\\s+(?:là\\s+)?{x.lower()}\\b|"
    f"(?:chọn|đáp án)\\s+phương án\\s+{x.lower()}\\b|\\bchọn\\s+đáp án\\s+{x.lower()}\\b')"
    for x in "ABCDEF"
) + " ELSE false END"
_REPLIES = """replies AS (
  SELECT conv_id, turn, text || ['. Em chọn đáp án B nhé', '. Đáp án đúng là A.', ' phương án D', '. Kết quả chính xác  c!', ''][conv_id % 5 + 1] AS reply,
         ['A', 'b', ' C ', 'D', 'x'][turn % 5 + 1] AS correct_option
  FROM conversations WHERE role = 'assistant')"""


@query(
    "answer_leaks",
    f"WITH {_REPLIES} SELECT conv_id, turn, {_LEAK} AS leaked FROM replies",
)
def answer_leaks(spark: SparkSession, d: str) -> DataFrame:
    leaked = ops.leaks_answer(F.col("reply"), F.col("correct_option"))
    return _replies(spark, d).select("conv_id", "turn", leaked.alias("leaked"))


@query(
    "leak_rates",
    f"""WITH {_REPLIES} SELECT turn, count(*) AS replies, count(*) FILTER ({_LEAK}) AS leaks,
       round(count(*) FILTER ({_LEAK}) / count(*), 4) AS leak_rate FROM replies GROUP BY turn""",
)
def leak_rates(spark: SparkSession, d: str) -> DataFrame:
    return ops.leak_rates(_replies(spark, d), "turn")


@query(
    "criteria_check",
    """WITH r AS (
  SELECT event_id, 'C' || (user_id % 5 + 1) AS category, event_id % 3 > 0 AS grounded, event_type = 'error' AS revealed,
         map {'consistent_with_ground_truth': event_id % 2 = 0, 'logically_sound_hint': event_id % 5 > 0,
              'redirect_to_learning': event_id % 7 > 0} AS v FROM events),
c AS (SELECT *, CASE WHEN category IN ('C2', 'C3', 'C4') AND NOT grounded THEN ['consistent_with_ground_truth', 'logically_sound_hint']
       WHEN category = 'C1' THEN ['friendly_and_pedagogical', 'redirect_to_learning'] WHEN category = 'C5' THEN ['logically_sound_hint']
       ELSE ['consistent_with_ground_truth', 'grounded_in_theorems'] END AS k FROM r)
SELECT event_id, array_to_string(k, ',') AS criteria,
       NOT revealed AND len(list_filter(k, lambda x: NOT coalesce(v[x], true))) = 0 AS is_passed FROM c""",
)
def criteria_check(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    verdicts = F.create_map(
        F.lit("consistent_with_ground_truth"), i % 2 == 0,
        F.lit("logically_sound_hint"), i % 5 > 0,
        F.lit("redirect_to_learning"), i % 7 > 0,
    )
    criteria = ops.required_criteria(F.concat(F.lit("C"), F.col("user_id") % 5 + 1), i % 3 > 0)
    return table(spark, d, "events").select(
        "event_id",
        F.array_join(criteria, ",").alias("criteria"),
        ops.passes(F.col("event_type") == "error", verdicts, criteria).alias("is_passed"),
    )


def _clean_sql(text: str) -> str:
    return f"regexp_replace(lower({views.STRIP.format(text)}), '[!.,?~^:;]+$', '')"


def _greets_sql(text: str) -> str:
    metas = " OR ".join(f"contains({text}, '{m}')" for m in MARKERS.meta)
    return (
        f"({text} IN ({', '.join(repr(g) for g in MARKERS.greetings)}) OR {metas} OR "
        f"(length({text}) <= 20 AND regexp_matches({text}, '^(?:{'|'.join(MARKERS.greetings)})(?: |$)')))"
    )


@query(
    "greetings",
    f"""WITH {_ASKS.replace('history IS NOT NULL AS has_history', 'false AS has_history')}
SELECT conv_id, turn, CASE WHEN {_greets_sql(_clean_sql('query'))} THEN true WHEN {_clean_sql('question_latex')} = '' THEN false
  WHEN real_options THEN false WHEN {_greets_sql(_clean_sql('question_latex'))} THEN true ELSE category = 'C1' END AS is_greeting
FROM labelled""",
)
def greetings(spark: SparkSession, d: str) -> DataFrame:
    greeting = ops.is_greeting(F.col("query"), F.col("question_latex"), F.col("options"), MARKERS)
    return _asks(spark, d).select("conv_id", "turn", greeting.alias("is_greeting"))


@query(
    "sessions",
    """SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return ops.sessions(ops.clear_sessions(turns, turns.where("role = 'system'")))


@query(
    "prompt_rendering",
    """SELECT p_partkey, 'Dạy ' || p_name || ' (' || p_brand || ', ' || p_name || ') {{unknown}} ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS prompt
FROM part""",
)
def prompt_rendering(spark: SparkSession, d: str) -> DataFrame:
    variables = F.create_map(
        F.lit("name"), F.col("p_name"),
        F.lit("brand"), F.col("p_brand"),
        F.lit("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")),
    )
    template = F.lit("Dạy {{name}} ({{brand}}, {{name}}) {{unknown}} {{type}}")
    return table(spark, d, "part").select(
        "p_partkey", ops.render(template, variables).alias("prompt")
    )


# -- interaction log ---------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Each event is an interaction."""
    i = F.col("event_id")
    letter = F.substring(F.lit("ABCD"), (i % 4 + 1).cast("int"), F.lit(1))
    told = F.array(
        F.struct(F.lit("student").alias("role"), F.col("event_type").alias("text")),
        F.struct(F.lit("tutor").alias("role"), F.lit("Xem lại bước 2.").alias("text")),
    )
    rows = table(spark, d, "events").select(
        i.alias("id"),
        F.col("user_id").alias("student_id"),
        (i % 100).alias("question_id"),
        F.when(i % 3 > 0, F.format_string("A%03d", i % 50)).alias("archetype_id"),
        F.when(i % 5 > 0, letter).alias("student_selected_option"),
        F.when(i % 6 > 0, "C").alias("correct_option"),
        F.when(i % 4 == 0, F.concat(F.lit("T"), i % 200)).alias("matched_trap_id"),
        told.alias("transcript"),
        F.when(i % 2 == 0, "PASSED").alias("validation_status"),
        (F.col("event_type") == "error").alias("student_reported"),
        F.when(i % 11 == 0, "SEEN").alias("mentor_resolution"),
        F.col("ts").alias("created_at"),
    )
    return log_ops.log_rows(rows).withColumn(
        "transcript", F.when(F.col("id") % 9 == 0, "{oops").otherwise(F.col("transcript"))
    )


_LOG = """log AS (
  SELECT event_id AS id, user_id AS student_id, event_id % 100 AS question_id,
         CASE WHEN event_id % 3 > 0 THEN printf('A%03d', event_id % 50) END AS archetype_id,
         CASE WHEN event_id % 5 > 0 THEN substr('ABCD', event_id % 4 + 1, 1) END AS student_selected_option,
         CASE WHEN event_id % 6 > 0 THEN 'C' END AS correct_option,
         CASE WHEN event_id % 4 = 0 THEN 'T' || (event_id % 200) END AS matched_trap_id,
         CASE WHEN event_id % 9 = 0 THEN '{oops' ELSE '[{"role":"student","text":"' || event_type || '"},{"role":"tutor","text":"Xem lại bước 2."}]' END AS transcript,
         event_type, CASE WHEN event_id % 2 = 0 THEN 'PASSED' END AS validation_status, event_type = 'error' AS student_reported,
         CASE WHEN event_id % 11 = 0 THEN 'SEEN' END AS mentor_resolution, ts AS created_at
  FROM events)"""


@query(
    "interaction_log",
    f"WITH {_LOG} SELECT id, student_id, transcript, created_at FROM log",
)
def interaction_log(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("id", "student_id", "transcript", "created_at")


_AUDIT = """SELECT id, student_id, coalesce(validation_status, 'PASSED') AS validation_status, student_reported,
       strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, pattern_code, trap_code,
       CASE WHEN transcript = '{oops' THEN '' ELSE event_type || '|Xem lại bước 2.' END AS said
FROM page LEFT JOIN centroids USING (archetype_id) LEFT JOIN traps ON trap_id = matched_trap_id"""


def _audited(rows: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("transcript", lambda t: t["text"]), "|")
    return rows.select(
        "id", "student_id", "validation_status", "student_reported", "created_at", "pattern_code",
        "trap_code", said.alias("said"),
    )


@query(
    "interaction_audit",
    f"WITH {views.CENTROIDS}, {views.TRAPS}, {_LOG}, page AS (SELECT * FROM log) {_AUDIT}",
)
def interaction_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audited(
        log_ops.audit_list(_log(spark, d), views.centroids(spark, d), views.traps(spark, d))
    )


@query(
    "reported_interactions_page",
    f"""WITH {views.CENTROIDS}, {views.TRAPS}, {_LOG},
page AS (SELECT * FROM log WHERE student_reported ORDER BY created_at DESC, id LIMIT 50 OFFSET 10) {_AUDIT}""",
)
def reported_interactions_page(spark: SparkSession, d: str) -> DataFrame:
    return _audited(
        log_ops.audit_list(
            _log(spark, d), views.centroids(spark, d), views.traps(spark, d),
            reported_only=True, limit=50, offset=10,
        )
    )


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Each click reports an interaction, which may not exist."""
    i = F.col("event_id")
    return table(spark, d, "events").where("event_type = 'click'").select(
        i.alias("report_no"),
        (i * 3 % 12_000 - i % 2 * 50).alias("interaction_id"),
        F.when(i % 3 > 0, F.concat(F.lit(" wrong "), i)).alias("reason"),
    )


_REPORTS = f"""{_LOG},
reports AS (SELECT event_id AS report_no, event_id * 3 % 12000 - event_id % 2 * 50 AS interaction_id,
                   CASE WHEN event_id % 3 > 0 THEN ' wrong ' || event_id END AS reason FROM events WHERE event_type = 'click'),
notes AS (SELECT interaction_id, arg_min(CASE WHEN reason IS NULL THEN 'REPORTED_BY_STUDENT' ELSE 'REPORTED: ' || trim(reason) END, report_no) AS note
          FROM reports GROUP BY interaction_id)"""


@query(
    "student_reports",
    f"""WITH {_REPORTS}
SELECT id, student_reported OR note IS NOT NULL AS student_reported, coalesce(mentor_resolution, note) AS mentor_resolution
FROM log LEFT JOIN notes ON interaction_id = id""",
)
def student_reports(spark: SparkSession, d: str) -> DataFrame:
    updated, _ = log_ops.apply_reports(_log(spark, d), _reports(spark, d))
    return updated.select("id", "student_reported", "mentor_resolution")


@query(
    "student_report_rejects",
    f"""WITH {_REPORTS} SELECT report_no, interaction_id, reason, 'NOT_FOUND' AS reason_rejected FROM reports
WHERE interaction_id NOT IN (SELECT id FROM log)""",
)
def student_report_rejects(spark: SparkSession, d: str) -> DataFrame:
    return log_ops.apply_reports(_log(spark, d), _reports(spark, d))[1]


def _mentor_events(spark: SparkSession, d: str) -> DataFrame:
    """Each customer is an event of a mentor."""
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        c.alias("event_id"),
        (c * 7).alias("interaction_id"),
        F.when(c % 4 == 0, "A001").alias("archetype_id"),
        F.when(c % 3 == 0, F.concat(F.lit("Tính "), "c_name")).when(c % 3 == 1, "").alias("question_latex"),
        F.col("c_mktsegment").alias("golden_solution"),
        F.when(c % 5 == 0, "D").alias("correct_option"),
        F.array(F.lit("b1")).alias("explanation_steps"),
        views._at(c).alias("created_at"),
        F.when(c % 2 == 0, F.concat(F.lit("CODE"), c)).alias("trap_code"),
        F.col("c_name").alias("trap_name"),
        F.when(c % 6 == 0, "A").alias("wrong_option"),
        F.col("c_mktsegment").alias("misconception_explanation"),
        F.lit("hint").alias("socratic_hint"),
    )


_MENTOR = f"""{_LOG},
aimed AS (
  SELECT c_custkey AS event_id, c_custkey * 7 AS interaction_id, c_name, c_mktsegment, l.id,
         coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'A001' END, l.archetype_id) AS target,
         l.question_id, l.correct_option, l.student_selected_option
  FROM customer LEFT JOIN log l ON l.id = c_custkey * 7),
valid AS (SELECT * FROM aimed WHERE id IS NOT NULL AND target IS NOT NULL)"""
_MENTOR_REJECTS = """SELECT event_id, interaction_id, CASE WHEN id IS NULL THEN 'NOT_FOUND' ELSE 'NO_ARCHETYPE' END AS reason
FROM aimed WHERE id IS NULL OR target IS NULL"""


@query(
    "mentor_exemplars",
    f"""WITH {_MENTOR}
SELECT target AS archetype_id, md5('exemplar#' || event_id) AS exemplar_id,
       CASE WHEN event_id % 3 = 0 THEN 'Tính ' || c_name ELSE 'Question ' || question_id END AS question_latex,
       c_mktsegment AS golden_solution, coalesce(CASE WHEN event_id % 5 = 0 THEN 'D' END, correct_option, 'A') AS correct_option FROM valid""",
)
def mentor_exemplars(spark: SparkSession, d: str) -> DataFrame:
    fresh, _, _ = log_ops.override_exemplars(_log(spark, d), _mentor_events(spark, d))
    return fresh.drop("explanation_steps", "created_at")


@query(
    "mentor_traps",
    f"""WITH {_MENTOR}
SELECT target AS archetype_id, md5('trap#' || event_id) AS trap_id,
       CASE WHEN event_id % 2 = 0 THEN 'CODE' || event_id ELSE 'TRAP_MENTOR_' || upper(substr(sha256(CAST(event_id AS VARCHAR)), 1, 8)) END AS trap_code,
       c_name AS trap_name, coalesce(CASE WHEN event_id % 6 = 0 THEN 'A' END, student_selected_option, 'B') AS wrong_option,
       c_mktsegment AS misconception_explanation, 'hint' AS socratic_hint FROM valid""",
)
def mentor_traps(spark: SparkSession, d: str) -> DataFrame:
    return log_ops.add_traps(_log(spark, d), _mentor_events(spark, d))[0]


@query(
    "mentor_resolutions",
    f"""WITH {_MENTOR} SELECT id, CASE WHEN id IN (SELECT interaction_id FROM valid) THEN 'OVERRIDDEN_EXEMPLAR_SAVED' ELSE mentor_resolution END AS mentor_resolution FROM log""",
)
def mentor_resolutions(spark: SparkSession, d: str) -> DataFrame:
    _, log, _ = log_ops.override_exemplars(_log(spark, d), _mentor_events(spark, d))
    return log.select("id", "mentor_resolution")


@query("mentor_rejects", f"WITH {_MENTOR} {_MENTOR_REJECTS}")
def mentor_rejects(spark: SparkSession, d: str) -> DataFrame:
    rejects = log_ops.add_traps(_log(spark, d), _mentor_events(spark, d))[2]
    return rejects.select("event_id", "interaction_id", "reason")
