"""Exams put together from an item bank, and checks of generated items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import contains_any, strip
from gradus.operators.ordered import bucket_of, dense_index
from gradus.operators.substrings import small
from gradus.session import checkpointed

# Size limits, domains by words of a prompt (first match counts), names.
MIN_QUESTIONS = 5
LETTERS = "ABCD"
BLOOM_LEVELS = range(1, 7)
ALL = "ALL"
PROMPT_WORDS = {
    "dom_lang": [
        "full văn", "full van", "chuyên sâu văn", "chuyen sau van", "chuyên sâu ngữ văn", "môn văn",
        "mon van", "môn ngữ văn",
    ],
    "dom_math": [
        "full toán", "full toan", "chuyên sâu toán", "chuyen sau toan", "môn toán", "mon toan",
        "giải tích", "hình học không gian",
    ],
    "dom_logic": [
        "full logic", "chuyên sâu logic", "chuyen sau logic", "môn logic", "tư duy suy luận",
    ],
    "dom_nat_sci": ["full khtn", "chuyên sâu khtn", "chuyen sau khtn", "khoa học tự nhiên"],
    "dom_soc_sci": [
        "full khxh", "chuyên sâu khxh", "chuyen sau khxh", "khoa học xã hội", "địa lý", "dia ly",
        "địa lí", "dia li", "lịch sử", "lich su",
    ],
}
DOMAIN_NAMES = {
    "dom_math": "Toán học & Phân tích số liệu",
    "dom_logic": "Tư duy Logic & Suy luận",
    "dom_lang": "Sử dụng Ngôn ngữ & Văn học",
    "dom_nat_sci": "Khoa học Tự nhiên (Lý - Hóa - Sinh)",
    "dom_soc_sci": "Khoa học Xã hội (Sử - Địa)",
}
#: Places of pools that may be broadcast to the requests; beyond it they are joined.
BROADCAST_PLACES = 500_000
OPTION_FILLER = "Phương án "
DEFAULT_DOMAIN, DEFAULT_SKILL, DEFAULT_SKILL_NAME = "dom_math", "sk_general", "Kỹ năng chuyên môn"
DEFAULT_BLOOM = 2


def requested_domain(domain: Column, prompt: Column) -> Column:
    """The domain asked for; where that is open, the one the prompt speaks of."""
    text = F.lower(F.coalesce(prompt, F.lit("")))
    asked = F.coalesce(domain, F.lit(ALL))
    spoken = None
    for name, words in PROMPT_WORDS.items():
        hit = contains_any(text, words)
        spoken = F.when(hit, name) if spoken is None else spoken.when(hit, name)
    return F.when(asked == ALL, F.coalesce(spoken, F.lit(ALL))).otherwise(asked)


def assemble(
    requests: DataFrame, bank: DataFrame, most: int | None = None, columns: tuple[str, ...] = ()
) -> DataFrame:
    """Rows (request_id, position from 1, item_id), with ``columns`` of the bank.

    ``requests``: request_id, domain_id, bloom_level, question_count, prompt. ``bank``: item_id
    (order of the bank), domain_id, bloom. A pool is what is left after domain and Bloom level, each
    ignored if it would leave nothing; position i takes the pool's item i modulo its size. ``item_id``
    is an integer. Requests may be limited to ``most`` questions; pools are whole. Items behind the
    last place that any request reaches are never drawn, so only the others meet the requests.
    """
    carried = [F.col(c).alias(f"_c_{c}") for c in columns]
    member = bank.select(
        "item_id",
        *carried,
        F.explode(F.array(F.col("domain_id"), F.lit(ALL))).alias("_domain"),
        F.col("bloom"),
    ).withColumn("_bloom", F.explode(F.array(F.col("bloom"), F.lit(0))))
    pool = ["_domain", "_bloom"]
    sizes = member.groupBy(*pool).agg(F.count(F.lit(1)).alias("_size"))
    places = dense_index(member, pool, [F.col("item_id")], bucket_of(F.col("item_id")), "_index")
    places = places.select(*pool, "_index", "item_id", *[f"_c_{c}" for c in columns])
    level = F.when(F.col("bloom_level").between(1, 6), F.col("bloom_level")).otherwise(0)
    count = F.greatest(F.lit(MIN_QUESTIONS), F.col("question_count"))
    if most is not None:
        count = F.least(F.lit(most), count)
    rows = requests.select(
        "request_id",
        requested_domain(F.col("domain_id"), F.col("prompt")).alias("_asked"),
        level.alias("_level"),
        count.alias("_count"),
    )
    reach = rows.agg(F.max("_count")).first()[0] or 0
    places = small(checkpointed(places.where(F.col("_index") < reach)), BROADCAST_PLACES)
    whole = sizes.where("_bloom = 0").select(F.col("_domain").alias("_asked"), F.lit(True).alias("_has"))
    rows = rows.join(whole, "_asked", "left").withColumn(
        "_domain", F.when(F.col("_has"), F.col("_asked")).otherwise(ALL)
    )
    narrow = sizes.select(
        "_domain", F.col("_bloom").alias("_level"), F.lit(True).alias("_narrow")
    )
    rows = rows.join(narrow, ["_domain", "_level"], "left").withColumn(
        "_bloom", F.when(F.col("_narrow"), F.col("_level")).otherwise(0)
    )
    drawn = (
        rows.join(sizes, pool)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
        .withColumn("_index", F.pmod(F.col("_i"), F.col("_size")))
    )
    return drawn.join(places, [*pool, "_index"]).select(
        "request_id", (F.col("_i") + 1).alias("position"), "item_id",
        *[F.col(f"_c_{c}").alias(c) for c in columns],
    )


def distributions(questions: DataFrame, key: str) -> DataFrame:
    """Counts per option letter and Bloom level of each exam, zeros included."""
    letter = F.upper("correct")
    return questions.groupBy(key).agg(
        *[F.count_if(letter == x).alias(f"option_{x.lower()}") for x in LETTERS],
        *[F.count_if(F.col("bloom") == n).alias(f"bloom_{n}") for n in BLOOM_LEVELS],
    )


def validated(items: DataFrame) -> DataFrame:
    """Generated items made usable: four options, a valid key (by position if it is none), a Bloom
    level from 1 to 6 and defaults; ``repairs`` counts what had to be changed.

    ``items``: index (from 0 in its exam), requested_domain, options, correct, bloom, domain_id,
    skill_id, skill_name, content, explanation. An item without a domain belongs to the one that was
    asked for; if all were, every item counts as mathematics.
    """
    given = F.coalesce("options", F.array().cast("array<string>"))
    fillers = F.array(*[F.lit(f"{OPTION_FILLER}{x}") for x in LETTERS])
    padded = F.slice(F.concat(given, F.slice(fillers, F.size(given) + 1, F.lit(4))), 1, 4)
    options = F.when(F.size(given) >= 4, F.slice(given, 1, 4)).otherwise(padded)
    key = F.upper(strip(F.coalesce("correct", F.lit("A"))))
    cycle = F.element_at(
        F.array(*[F.lit(x) for x in LETTERS]), (F.col("index") % 4 + 1).cast("int")
    )
    level = F.coalesce("bloom", F.lit(DEFAULT_BLOOM))
    name = F.format_string("q%02d", F.col("index") + 1)
    broken = [F.size(given) != 4, ~key.isin(*LETTERS), ~level.between(1, 6)]

    def default(column: str, value: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(value)).otherwise(
            F.col(column)
        )

    own = F.when(F.coalesce("domain_id", F.lit("")) != "", F.col("domain_id"))
    domain = F.when(F.col("requested_domain") == ALL, DEFAULT_DOMAIN).otherwise(
        F.coalesce(own, "requested_domain")
    )
    names = F.create_map(*[F.lit(x) for pair in DOMAIN_NAMES.items() for x in pair])
    return items.withColumns(
        {
            "id": name,
            "options": options,
            "correct": F.when(key.isin(*LETTERS), key).otherwise(cycle),
            "bloom": F.least(F.lit(6), F.greatest(F.lit(1), level)),
            "domain_id": domain,
            "domain_name": F.coalesce(names[domain], F.lit(DOMAIN_NAMES[DEFAULT_DOMAIN])),
            "skill_id": default("skill_id", DEFAULT_SKILL),
            "skill_name": default("skill_name", DEFAULT_SKILL_NAME),
            "content": F.coalesce("content", F.concat(F.lit("Câu hỏi "), name)),
            "explanation": F.coalesce("explanation", F.lit("")),
            "repairs": sum((b.cast("int") for b in broken), F.lit(0)),
        }
    )
