"""Exam questions to taxonomy nodes by shared words, whole question tables at a time.

``nodes``: ord (their order), skill_id, domain_name, chapter_name, lesson_name, pattern_name, ...
``questions``: question_id, content, passage_excerpt, suggested_skill_name, subject_code.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import folded, meaningful_tokens, words_of
from gradus.operators.blocks import NODE_LIMITS, score_blocks

# Words without meaning here, weights, subjects by words in domain or chapter.
STOP_WORDS = [
    "cua", "va", "la", "cac", "cho", "trong", "khi", "sau", "day", "nao", "duoi",
    "theo", "voi", "mot", "nhung", "duoc", "khong", "co", "bang", "tu", "den",
    "chuong", "bai", "dang", "lop", "cau", "hoi", "tong", "hop", "trac", "nghiem",
]
PATTERN_PHRASE, LESSON_PHRASE, CHAPTER_PHRASE = 5.0, 4.0, 2.5
SKILL_WEIGHT, CONTENT_WEIGHT, PASSAGE_WEIGHT = 2.2, 1.1, 0.6
SUBJECT_BONUS, ENGLISH_BONUS, ENGLISH_ELSEWHERE, OTHERS_IN_ENGLISH = 1.5, 3.0, 0.2, 0.3
MIN_SCORE = 0.15
SUBJECT_WORDS = {
    "MATH": (["toan"], ["toan"]),
    "PHYS": ([], ["vat li", "vat ly"]),
    "CHEM": ([], ["hoa hoc"]),
    "BIOL": ([], ["sinh hoc"]),
    "VIET": (["tieng viet", "ngu van"], ["ngu van"]),
    "ENGL": (["tieng anh"], ["tieng anh"]),
    "HIST": ([], ["lich su"]),
    "GEO": ([], ["dia li", "dia ly"]),
    "LOGIC": (["logic", "tu duy"], []),
}
VIETNAMESE_LETTERS = (
    "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
)
ENGLISH_WORDS = (
    "the of and to is are was were has have had would could should which that with for in on by "
    "he she they his her their"
).split()
ENGLISH_HITS = 3
REASON = "Khớp từ khóa học thuật với cây Khung chương trình"
SCORE_DIGITS = 9


def language_signs(text: Column, ascii_words: bool = False) -> tuple[Column, Column]:
    """(has Vietnamese letters, is plain English)."""
    accented = text.rlike(f"(?iu)[{VIETNAMESE_LETTERS}]")
    hits = F.size(
        F.regexp_extract_all(text, F.lit("(?iu)" + words_of(rf"\b({'|'.join(ENGLISH_WORDS)})\b", ascii_words)), F.lit(1))
    )
    return accented, ~accented & (hits >= ENGLISH_HITS)


def _prepared_questions(questions: DataFrame, ascii_words: bool = False) -> DataFrame:
    raw = F.concat_ws(
        " ", F.coalesce("content", F.lit("")), F.coalesce("passage_excerpt", F.lit(""))
    )
    accented, english = language_signs(raw, ascii_words)
    skill = folded(F.col("suggested_skill_name"))

    def tokens(text: Column) -> Column:
        return meaningful_tokens(text, STOP_WORDS)

    return questions.select(
        "question_id",
        skill.alias("skill"),
        tokens(skill).alias("skill_tokens"),
        tokens(folded(F.col("content"))).alias("content_tokens"),
        tokens(folded(F.col("passage_excerpt"))).alias("passage_tokens"),
        F.upper(F.trim(F.coalesce("subject_code", F.lit("")))).alias("subject"),
        accented.alias("accented"),
        english.alias("english"),
    )


def _prepared_nodes(nodes: DataFrame) -> DataFrame:
    names = {n: folded(F.col(f"{n}_name")) for n in ("pattern", "lesson", "chapter", "domain")}
    tokens = meaningful_tokens(
        F.concat_ws(" ", names["pattern"], names["lesson"], names["chapter"]), STOP_WORDS
    )
    return nodes.select("ord", *[v.alias(k) for k, v in names.items()], tokens.alias("tokens")).where(
        F.size("tokens") > 0
    )


def _incidence(lists: pd.Series, place: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(lists), len(place)))
    for i, words in enumerate(lists):
        out[i, [place[w] for w in words if w in place]] = 1.0
    return out


def _phrase_boosts(skill: str, nodes: pd.DataFrame) -> np.ndarray:
    if len(skill) < 4:
        return np.zeros(len(nodes))
    out = []
    for pattern, lesson, chapter in zip(nodes["pattern"], nodes["lesson"], nodes["chapter"]):
        if skill in pattern or (len(pattern) >= 4 and pattern in skill):
            out.append(PATTERN_PHRASE)
        elif skill in lesson or (len(lesson) >= 4 and lesson in skill):
            out.append(LESSON_PHRASE)
        else:
            out.append(CHAPTER_PHRASE if skill in chapter else 0.0)
    return np.array(out)


def _subject_bonus(subject: str, nodes: pd.DataFrame) -> np.ndarray:
    in_domain, in_chapter = SUBJECT_WORDS.get(subject, ([], []))
    hit = [
        any(w in d for w in in_domain) or any(w in c for w in in_chapter)
        for d, c in zip(nodes["domain"], nodes["chapter"])
    ]
    return np.where(hit, SUBJECT_BONUS, 0.0)


def _best_nodes(batch: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    nodes = held.sort_values("ord", kind="stable").reset_index(drop=True)
    place = {w: i for i, w in enumerate(sorted({w for ws in nodes["tokens"] for w in ws}))}
    of_nodes = _incidence(nodes["tokens"], place).T
    norm = np.sqrt(np.maximum([len(w) for w in nodes["tokens"]], 3))
    english_node = np.array(
        ["tieng anh" in d or "tieng anh" in c for d, c in zip(nodes["domain"], nodes["chapter"])]
    )
    boosts = {s: _phrase_boosts(s, nodes) for s in batch["skill"].unique()}
    bonuses = {s: _subject_bonus(s, nodes) for s in batch["subject"].unique()}
    parts = []
    step = max(1, 4_000_000 // max(1, len(place), len(nodes)))
    for start in range(0, len(batch), step):
        rows = batch.iloc[start : start + step]
        score = np.stack([boosts[s] for s in rows["skill"]])
        for column, weight in (
            ("skill_tokens", SKILL_WEIGHT),
            ("content_tokens", CONTENT_WEIGHT),
            ("passage_tokens", PASSAGE_WEIGHT),
        ):
            score = score + (_incidence(rows[column], place) @ of_nodes) * weight
        score = score + np.stack([bonuses[s] for s in rows["subject"]])
        english = rows["english"].to_numpy(dtype=bool)[:, None]
        accented = rows["accented"].to_numpy(dtype=bool)[:, None]
        score = np.where(english & english_node, score + ENGLISH_BONUS, score)
        score = np.where(english & ~english_node, score * ENGLISH_ELSEWHERE, score)
        score = np.where(~english & english_node & accented, score * OTHERS_IN_ENGLISH, score)
        score = np.round(score / norm, SCORE_DIGITS)
        best = np.argmax(score, axis=1)
        parts.append(
            pd.DataFrame(
                {
                    "question_id": rows["question_id"].to_numpy(),
                    "ord": nodes["ord"].to_numpy()[best],
                    "score": score[np.arange(len(rows)), best],
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def map_questions(
    questions: DataFrame, nodes: DataFrame, ascii_words: bool = False, **limits: int
) -> DataFrame:
    """Best node per question with confidence; questions without a good one are left out.

    A node can win on its subject alone, so all nodes are scored for all questions: in blocks,
    inside tasks, with one row per question coming out. ``ascii_words``: English words are looked for
    between any signs that are no ASCII letter, digit or _, as SQL on DuckDB does.
    """
    q, n = _prepared_questions(questions, ascii_words), _prepared_nodes(nodes)
    types = [df.schema[c].dataType.simpleString() for df, c in ((q, "question_id"), (n, "ord"))]
    schema = f"question_id {types[0]}, ord {types[1]}, score double"
    width = F.length(F.concat_ws(" ", "pattern", "lesson", "chapter", "domain")) * 8 + 200
    found, complete = score_blocks(
        q, n, "question_id", "ord", _best_nodes, schema, width, **(NODE_LIMITS | limits)
    )
    if not complete:
        found = (
            found.groupBy("question_id")
            .agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("_b"))
            .select("question_id", "_b.*")
        )
    share = F.least(F.col("score") * 0.14, F.lit(0.47))
    confidence = F.greatest(
        F.lit(0.45), F.least(F.lit(0.92), F.bround(F.lit(0.45) + share, 2))
    )
    return (
        found.where(F.col("score") > MIN_SCORE)
        .join(nodes, "ord")
        .select(
            "question_id", "ord", *[c for c in nodes.columns if c != "ord"],
            confidence.alias("confidence"), F.lit(REASON).alias("reason"),
        )
    )


def prefer_primary(questions: DataFrame, primary: DataFrame, lexical: DataFrame) -> DataFrame:
    """A mapping from elsewhere wins; shared words fill the gaps. (question_id, ord, provider)"""
    p = primary.groupBy("question_id").agg(F.min("ord").alias("_p"))
    s = lexical.select("question_id", F.col("ord").alias("_s"))
    return (
        questions.select("question_id")
        .join(p, "question_id", "left")
        .join(s, "question_id", "left")
        .where("_p is not null or _s is not null")
        .select(
            "question_id",
            F.coalesce("_p", "_s").alias("ord"),
            F.when(F.col("_p").isNotNull(), "PRIMARY").otherwise("LEXICAL").alias("provider"),
        )
    )
