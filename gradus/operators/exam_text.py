"""Exam text to question and passage tables.

``exams``: exam_id, text, total_pages. A text is cut, inside its own row, where a question starts;
the pieces are then exploded with their number and page.

A question starts at a line "Câu n", "Question n" or "n." followed by text. A bare number with
nothing after it on any later line, which the reference takes at the very start of a text, is not
a start here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import strip
from gradus.session import stored

# Private-use glyphs of exam fonts and the LaTeX they stand for.
GLYPHS = {
    "\uf0a3": " \\le ",
    "\uf0b3": " \\ge ",
    "\uf03c": " < ",
    "\uf03e": " > ",
    "\uf03d": " = ",
    "\uf02b": " + ",
    "\uf02d": " - ",
    "\uf0b1": " \\pm ",
    "\uf0b4": " \\times ",
    "\uf0d7": " \\times ",
    "\uf0b8": " \\div ",
    "\uf0b9": " \\neq ",
    "\uf0a5": " \\infty ",
    "\uf0d6": " \\sqrt ",
    "\uf06f": " \\sqrt ",
    "\uf0ce": " \\in ",
    "\uf0cf": " \\notin ",
    "\uf0c7": " \\cap ",
    "\uf0c8": " \\cup ",
    "\uf0c6": " \\varnothing ",
    "\uf0de": " \\Rightarrow ",
    "\uf0ae": " \\rightarrow ",
    "\uf0db": " \\Leftrightarrow ",
    "\uf0ab": " \\leftrightarrow ",
    "\uf044": " \\Delta ",
    "\uf061": " \\alpha ",
    "\uf062": " \\beta ",
    "\uf067": " \\gamma ",
    "\uf064": " \\delta ",
    "\uf06d": " \\mu ",
    "\uf070": " \\pi ",
    "\uf077": " \\omega ",
    "\uf0a2": "'",
    "\uf0e6": "(",
    "\uf0e8": ")",
    "\uf0e7": "(",
    "\uf0eb": ")",
}
# Repairs of a misread equals sign and of degree marks (pattern, replacement).
REPAIRS = [
    (r"\b([a-zA-Z])\s*≡\s*(log|ln|sin|cos|tan|\d+)", "$1 = $2"),
    (r"(\d+(?:[.,]\d+)?)\s*\\circ\s*([CFKcfk])(?![A-Za-z])", r"$1^\\circ\\text{$2}"),
    (r"\\circ\s*([CFKcfk])(?![A-Za-z])", r"^\\circ\\text{$1}"),
]
# Limits and marks of the exam layout.
MAX_QUESTION = 500
MAX_PASSAGE_SPAN = 25
LETTERS = "ABCD"
PAGE_MARK = r"---\s*PAGE_(\d+)\s*---"
END_MARK = r"[-–—]{3,}\s*HẾT\s*[-–—]{3,}"
QUESTION_WORDS = "Câu|Question"
PASSAGE_OPENERS = (
    "Dựa (?:vào|theo) (?:các )?(?:thông tin|đoạn trích|văn bản|dữ liệu|dãy điện hóa)"
    "|Đọc (?:đoạn trích|văn bản|thông tin)"
)
BODY_END_OPENERS = (
    "Dựa (?:vào|theo) (?:các )?(?:thông tin|đoạn trích|văn bản|dữ liệu)"
    "|Đọc (?:đoạn trích|văn bản|thông tin)"
)
PASSAGE_RANGE = r"(?:câu(?:\s+hỏi)?\s+từ|từ\s+câu)\s+(\d+)\s+(?:đến|[-–])\s+(\d+)"
ENGLISH_RANGE = r"Questions?\s+(\d+)\s*[-–to]+\s*(\d+)"

_CUT, _PAGE = "\u0001", "\u0002"
_QUESTION_LINE = rf"\s*(?:(?:{QUESTION_WORDS})\s+\d+|\d{{1,3}}\s*[.:]\s+[^\n])"
_QUESTION = rf"(?iu)^\s*(?:(?:{QUESTION_WORDS})\s+(\d+)|(\d{{1,3}})\s*[.:])\s*[:.]?\s*"
_BODY_END = (
    rf"(?isu)(?:\n\s*(?:{BODY_END_OPENERS}|Questions?\s+\d+\s*[-–to]+\s*\d+)|{END_MARK}).*$"
)
_PASSAGE = (
    rf"(?isu)(?:(?:{PASSAGE_OPENERS})[^0-9\n]{{0,80}}?{PASSAGE_RANGE}|{ENGLISH_RANGE})[^\n]*\n(.*)$"
)
_OPTION = r"(?s)(?:^|\s)([A-D])\s*[.)]\s+(.*?)(?=\s+[A-D]\s*[.)]\s+|$)"
_FIRST_OPTION = r"(?s)(?:^|\s)A\s*[.)]\s+.*$"
_LETTERS_ONLY = r"(?is)\s+A\s+B\s+C\s+D\s*$"


def repaired(text: Column) -> Column:
    fixed = text
    for glyph, latex in GLYPHS.items():
        fixed = F.replace(fixed, F.lit(glyph), F.lit(latex))
    fixed = F.when(text.rlike("[\uf000-\uf0ff]"), fixed).otherwise(text)
    for pattern, replacement in REPAIRS:
        fixed = F.regexp_replace(fixed, pattern, replacement)
    return fixed


def repair_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows each repair rule applies to: (rule, rows)."""
    rules = [(f"U+{ord(g):04X}", F.contains(F.col(text), F.lit(g))) for g in GLYPHS]
    rules += [(f"repair_{i + 1}", F.col(text).rlike(p)) for i, (p, _) in enumerate(REPAIRS)]
    counts = texts.agg(*[F.count_if(hit).alias(name) for name, hit in rules])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n, _ in rules])
    return counts.select(F.inline(pairs))


def _without_marks(text: Column) -> Column:
    bare = F.when(F.contains(text, F.lit("PAGE_")), F.regexp_replace(text, PAGE_MARK, "")).otherwise(text)
    return strip(bare)


def pieces(exams: DataFrame) -> DataFrame:
    """Text cut before each question: (exam_id, pos, piece, page_number). Piece 0 is what is before
    the first question. A piece is on the page of the last mark before it, page 1 without one.

    All is done within the text's row: it is split at the page marks, each part is cut with its page's
    number before each piece, and the parts are put together again, so that a piece may go on over marks.
    """
    text = F.col("text")
    ended = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n|\r", "\n")).otherwise(text)
    single = F.when(F.contains("_ended", F.lit("\n\n")), F.regexp_replace("_ended", r"\n{2,}", "\n"))
    # Matches that are looked for only where they can be, each in a column of its own.
    unix = exams.where("text is not null").select("exam_id", ended.alias("_ended")).select(
        "exam_id", F.coalesce(single, F.col("_ended")).alias("_unix")
    )
    paged = F.when(F.contains("_unix", F.lit("PAGE_")), F.col("_unix"))
    none = F.array().cast("array<string>")
    found = unix.select(
        "exam_id",
        F.coalesce(F.split(paged, PAGE_MARK), F.array("_unix")).alias("_parts"),
        F.coalesce(F.regexp_extract_all(paged, F.lit(PAGE_MARK), F.lit(0)), none).alias("_found"),
    )
    numbers = F.transform(
        "_found", lambda m: F.coalesce(F.regexp_extract(m, PAGE_MARK, 1).try_cast("int"), F.lit(1))
    )
    marked = found.select(
        "exam_id",
        "_parts",
        F.concat(F.array(F.lit("")), "_found").alias("_marks"),
        F.concat(F.array(F.lit(1)), numbers).alias("_pages"),
    )
    parts = F.transform(
        F.arrays_zip("_parts", "_marks", "_pages"),
        lambda p: F.concat(
            p["_marks"],
            F.regexp_replace(
                p["_parts"],
                F.lit(rf"(?iu)\n(?={_QUESTION_LINE})"),
                F.concat(F.lit(_CUT), p["_pages"].cast("string"), F.lit(_PAGE)),
            ),
        ),
    )
    # A text may also begin with a question.
    start = F.regexp_replace(F.array_join(parts, ""), rf"(?iu)^(?={_QUESTION_LINE})", f"{_CUT}1{_PAGE}")
    rows = marked.select("exam_id", F.posexplode(F.split(start, _CUT)).alias("pos", "_cut"))
    page = F.instr("_cut", _PAGE)
    return rows.select(
        "exam_id",
        "pos",
        F.when(F.col("pos") == 0, F.col("_cut")).otherwise(F.expr(f"substring(_cut, instr(_cut, '{_PAGE}') + 1)")).alias("piece"),
        F.when(F.col("pos") == 0, 1)
        .otherwise(F.substring("_cut", F.lit(1), page - 1).cast("int"))
        .alias("page_number"),
    )


def split_options(rows: DataFrame, body: str = "body") -> DataFrame:
    """Adds stem and option_a ... option_d of a question body. The expensive matches are columns of
    their own first, so that each is made once.
    """
    first = F.array_position("_keys", "A")
    real = (first > 0) & (F.size("_keys") - first + 1 >= 2)
    matched = rows.withColumns(
        {
            "_keys": F.regexp_extract_all(body, F.lit(_OPTION), F.lit(1)),
            "_values": F.regexp_extract_all(body, F.lit(_OPTION), F.lit(2)),
        }
    ).withColumns({"_first": first.cast("int"), "_real": real})
    judged = matched.withColumn(
        "_letters_only", ~F.col("_real") & F.col(body).rlike(_LETTERS_ONLY)
    ).withColumn("_counted", F.slice("_keys", F.greatest("_first", F.lit(1)), F.size("_keys")))
    out = {
        "stem": strip(
            F.when(F.col("_real"), F.regexp_replace(body, _FIRST_OPTION, ""))
            .when(F.col("_letters_only"), F.regexp_replace(body, _LETTERS_ONLY, ""))
            .otherwise(F.col(body))
        )
    }
    for letter in LETTERS:
        place = F.array_position("_counted", letter)
        value = F.get("_values", (F.col("_first") + place - 2).cast("int"))
        clean = F.regexp_replace(strip(value), r"\s+", " ")
        out[f"option_{letter.lower()}"] = (
            F.when(F.col("_real") & (place > 0), clean)
            .when(F.col("_letters_only"), letter)
            .otherwise("")
        )
    return judged.withColumns(out).drop(
        "_keys", "_values", "_first", "_real", "_letters_only", "_counted"
    )


def _read(cut: DataFrame, only_needed: bool = False) -> DataFrame:
    """Each piece with all that is read from it, in one pass over the pieces: what a question start
    says (question_number, explicit, body, stem, option_a ... option_d) and what a passage announced
    says (told, start_question, end_question, told_content).

    Matches are columns of their own, and there is no filter on them: it would be pushed below them and
    make each of them again. With ``only_needed`` the options of explicit questions are not read.
    """
    number = F.coalesce(F.nullif("_explicit", F.lit("")), F.col("_bare")).try_cast("int")
    is_told = F.col("piece").rlike(_PASSAGE)

    def group(n: int) -> Column:
        return F.regexp_extract("_told", _PASSAGE, n)

    matched = cut.withColumns(
        {
            "_asked": F.col("piece").rlike(_QUESTION),
            "_explicit": F.regexp_extract("piece", _QUESTION, 1),
            "_bare": F.regexp_extract("piece", _QUESTION, 2),
            "_told": F.when(is_told, F.col("piece")),
        }
    )
    parts = matched.withColumns(
        {"question_number": number, "_s1": group(1), "_e1": group(2), "_s2": group(3), "_e2": group(4)}
    )
    known = F.col("question_number").between(1, MAX_QUESTION)
    body = F.regexp_replace(F.regexp_replace("piece", _QUESTION, ""), _BODY_END, "")
    rows = parts.select(
        "exam_id",
        "pos",
        "page_number",
        "_asked",
        "question_number",
        (F.col("_explicit") != "").alias("explicit"),
        F.when(known, body).alias("_body"),
        F.col("_told").isNotNull().alias("told"),
        F.coalesce(F.nullif("_s1", F.lit("")), F.col("_s2")).try_cast("int").alias("start_question"),
        F.coalesce(F.nullif("_e1", F.lit("")), F.col("_e2")).try_cast("int").alias("end_question"),
        group(5).alias("_content"),
    )
    rows = rows.withColumns({"body": _without_marks(F.col("_body")), "told_content": _without_marks(F.col("_content"))})
    rows = rows.drop("_body", "_content")
    if only_needed:
        rows = rows.withColumn("_open", F.when(~F.col("explicit"), F.col("body")))
        return split_options(rows, "_open").drop("_open", "stem", "option_c", "option_d")
    return split_options(rows)


def rejects(cut: DataFrame) -> DataFrame:
    """What the limits of the layout set aside: (exam_id, pos, kind, first, last, reason).

    A question outside 1 to ``MAX_QUESTION``, and a passage that is announced backwards or for more
    than ``MAX_PASSAGE_SPAN`` numbers after its first. Numbers too long to read are null.
    """
    start, end, number = F.col("start_question"), F.col("end_question"), F.col("question_number")
    none, text = F.lit(None).cast("int"), ("kind", "first", "last", "reason")

    def row(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, text)])

    known = F.coalesce(number.between(1, MAX_QUESTION), F.lit(False))
    span = F.coalesce((end - start).between(0, MAX_PASSAGE_SPAN), F.lit(False))
    asked = F.when(
        F.col("_asked") & ~known, row(F.lit("QUESTION"), number, none, F.lit("NUMBER_OUT_OF_RANGE"))
    )
    why = F.when(end < start, "BACKWARDS").otherwise("SPAN_TOO_LONG")
    told = F.when(F.col("told") & ~span, row(F.lit("PASSAGE"), start, end, why))
    both = _read(cut).select("exam_id", "pos", F.explode(F.array(asked, told)).alias("_r"))
    return both.where("_r is not null").select("exam_id", "pos", "_r.*")


def questions(cut: DataFrame) -> DataFrame:
    """First occurrence of each number. Bare numbers need options A and B, else they do not count;
    an empty body does count, and the number stays without a question.
    """
    return _first_questions(_read(cut)).select(
        "exam_id", "question_number", "page_number", F.col("stem").alias("content"),
        *[f"option_{x.lower()}" for x in LETTERS],
    )


def _first_questions(read: DataFrame) -> DataFrame:
    counts = (F.col("body") == "") | F.col("explicit") | (
        (F.col("option_a") != "") & (F.col("option_b") != "")
    )
    # A window minimum, not a filter on the rank: a filter would be pushed below the matches and
    # make each of them twice.
    same = Window.partitionBy("exam_id", "question_number")
    return (
        read.withColumn("_at", F.when(F.col("body").isNotNull() & counts, F.col("pos")))
        .withColumn("_first", F.min("_at").over(same))
        .where("pos = _first and body <> ''")
    )


def passages(cut: DataFrame) -> DataFrame:
    """Passages announced for a range of questions: (exam_id, pos, start_question, end_question,
    content). The text runs to the next question.
    """
    return _told_passages(_read(cut))


def _told_passages(read: DataFrame) -> DataFrame:
    span = F.col("end_question") - F.col("start_question")
    return read.where(F.col("told") & span.between(0, MAX_PASSAGE_SPAN)).select(
        "exam_id", "pos", "start_question", "end_question", F.col("told_content").alias("content")
    )


def parse(exams: DataFrame, texts: bool = True) -> dict[str, DataFrame]:
    """questions (with passage_start and passage_end, null for single ones), passages, totals.

    The pieces are read once and stored with what was found in them. A passage names at most 26
    numbers, so it is exploded into them and met by an equi-join. Without ``texts`` the questions come
    without content and options, of which totals and passages need nothing.
    """
    content = [F.col("stem").alias("content"), *[F.col(f"option_{x.lower()}") for x in LETTERS]]
    read = _read(pieces(exams), only_needed=not texts).drop("_asked")
    # Of the body it matters only whether it is empty.
    read = stored(read.withColumn("body", F.when(F.col("body") == "", "").when(F.col("body") != "", "+")))
    asked = _first_questions(read).select(
        "exam_id", "question_number", "page_number", *(content if texts else [])
    )
    told = _told_passages(read)
    numbers = told.withColumn(
        "question_number", F.explode(F.sequence("start_question", "end_question"))
    )
    owner = numbers.groupBy("exam_id", "question_number").agg(
        F.min(F.struct("pos", "start_question", "end_question")).alias("_p")
    )
    placed = asked.join(owner, ["exam_id", "question_number"], "left").select(
        *asked.columns,
        F.col("_p.pos").alias("passage_pos"),
        F.col("_p.start_question").alias("passage_start"),
        F.col("_p.end_question").alias("passage_end"),
    )
    sizes = placed.where("passage_pos is not null").groupBy(
        "exam_id", F.col("passage_pos").alias("pos")
    ).agg(F.count(F.lit(1)).alias("questions"))
    kept = (
        told.join(sizes, ["exam_id", "pos"], "left")
        .withColumn("questions", F.coalesce("questions", F.lit(0).cast("bigint")))
        .where("questions > 0 or content <> ''")
    )
    return {
        "questions": placed.drop("passage_pos"),
        "passages": kept.drop("pos"),
        "totals": totals(exams, placed, kept),
    }


def totals(exams: DataFrame, placed: DataFrame, kept: DataFrame) -> DataFrame:
    q = placed.groupBy("exam_id").agg(
        F.max("page_number").alias("_page"),
        F.count_if(F.col("passage_start").isNull()).alias("_single"),
    )
    p = kept.groupBy("exam_id").agg(F.count(F.lit(1)).alias("_passages"))
    return (
        exams.select("exam_id", "total_pages")
        .join(q, "exam_id", "left")
        .join(p, "exam_id", "left")
        .select(
            "exam_id",
            F.greatest(F.lit(1), "total_pages", F.coalesce("_page", F.lit(1))).alias("total_pages"),
            F.coalesce("_passages", F.lit(0)).alias("total_passages"),
            F.coalesce("_single", F.lit(0)).alias("total_single_questions"),
        )
    )
