"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct five-word shingles. Each of ``PERMUTATIONS`` hash functions is
evaluated once for each shingle, and both its minimum and its maximum over the set are kept, either
of which two sets share with probability equal to their Jaccard similarity. Bands of ``ROWS`` minima,
or of ``ROWS`` maxima, of different functions are bucketed: sets of similarity 0.75 share none of the
52 bands with probability 8e-7. Of pairs that share one, an exact bound rules out nearly all that are
not similar: in a parity map of 2,048 bits each shingle that only one set has changes one bit, so maps
differ in no more bits than sets in shingles. The others are confirmed on the full sets.

Documents of equal sets are one class, found by a digest. In each bucket the classes are compared
with its least one first; then only pairs of a bucket whose classes these links have left in
different components are compared too. So a bucket of many copies costs one comparison for each,
and no link between components is lost.

A text without words (null, empty) has no shingles and is linked with nothing; one with fewer than
five words is a single shingle. Rows of equal id count as one document, null ids are in no class and
kept, an empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.links import components, pick
from gradus.llm.registry import query, read
from gradus.llm.words import slices, worker_memory
from gradus.session import checkpointed

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
PERMUTATIONS, ROWS = 130, 5
#: Words whose hashes a worker remembers; beyond it starts anew.
MEMORY = 300_000
#: 64-bit parts of a set's parity map.
PARTS = 32
#: Shingles hashed at once.
BLOCK = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _seeds(count: int) -> np.ndarray:
    return mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _ODD)


def word_hashes(memory: int = MEMORY):
    """bytes -> 64-bit hash; remembered, as most words come again."""
    import xxhash

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) >= memory:
                self.clear()
            found = self[word] = xxhash.xxh3_64_intdigest(word)
            return found

    return Hashes()


def shingles(text: str, hashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles. Words are cut at blanks and ASCII control spaces,
    A-Z are lower-cased: what ``bytes`` does by itself."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(each))
    rolled = np.full(len(each) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        rolled = rolled * _ODD + each[k : k + len(rolled)]
    return np.unique(mixed(rolled))


def signature(found: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minima, then maxima, under each hash function."""
    low, high = None, None
    for start in range(0, len(found), BLOCK):
        values = (found[start : start + BLOCK, None] ^ offsets) * multipliers
        a, b = values.min(0), values.max(0)
        low = a if low is None else np.minimum(low, a)
        high = b if high is None else np.maximum(high, b)
    return np.concatenate([low, high])


def bands(signs: np.ndarray) -> np.ndarray:
    """One key for each band: its place among the bands and its values."""
    values = mixed(signs.reshape(-1, ROWS))
    keys = np.arange(1, len(values) + 1, dtype=np.uint64) * _ODD
    for k in range(ROWS):
        keys = mixed(keys ^ values[:, k]) + _ODD
    return keys.view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    counts = np.bincount((found & np.uint64(64 * PARTS - 1)).astype(np.int64), minlength=64 * PARTS)
    return np.packbits(counts & 1).view(np.int64)


def near_enough(x: str, y: str):
    """The exact bounds on two sets' sizes and parity maps."""
    changed = " + ".join(f"bit_count({x}.bits[{k}] ^ {y}.bits[{k}])" for k in range(PARTS))
    return F.expr(
        f"least({x}.n, {y}.n) * {DENOMINATOR} >= greatest({x}.n, {y}.n) * {NUMERATOR}"
        f" AND ({changed}) * {DENOMINATOR + NUMERATOR} <= ({x}.n + {y}.n) * {DENOMINATOR - NUMERATOR}"
    )


def _functions():
    seeds = _seeds(PERMUTATIONS)
    return seeds[:PERMUTATIONS] | np.uint64(1), seeds[PERMUTATIONS:]


def sketched(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, keys of its bands, its parity map)."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))
    id_sql = docs.schema["doc_id"].dataType.simpleString()

    def tasks(batches):
        import hashlib

        hashes = worker_memory("word hashes", word_hashes)
        multipliers, offsets = _functions()
        for batch in batches:
            for part in slices(batch):
                sizes, digests, keys, bits = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, hashes)
                    sizes.append(len(found))
                    if len(found):
                        digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        keys.append(bands(signature(found, multipliers, offsets)))
                        bits.append(parity(found))
                    else:
                        digests.append(None)
                        keys.append(None)
                        bits.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "keys", "bits"],
                )

    schema = f"doc_id {id_sql}, n_shingles bigint, digest binary, keys array<bigint>, bits array<bigint>"
    return docs.mapInArrow(tasks, schema)


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored (a, b) pairs whose texts' full sets are similar enough.

    Texts are fetched for the documents of the pairs only, and each task remembers the last left set,
    as the pairs come sorted by it.
    """
    ids = checkpointed(
        pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    )
    texts = pick(docs, "doc_id", ids)
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
        .select("a", "b", "left", "right")
        .sortWithinPartitions("b")
    )
    id_sql = pairs.schema["a"].dataType.simpleString()

    def tasks(batches):
        hashes = worker_memory("word hashes", word_hashes)
        known: dict[str, np.ndarray] = {}

        def set_of(text):
            if text not in known:
                if len(known) > 256:
                    known.clear()
                known[text] = shingles(text, hashes)
            return known[text]

        for batch in batches:
            for part in slices(batch):
                similar = []
                for left, right in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = set_of(left), set_of(right)
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    if DENOMINATOR * len(small) < NUMERATOR * len(large):
                        similar.append(False)
                        continue
                    at = np.searchsorted(large, small)
                    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    union = len(small) + len(large) - shared
                    similar.append(DENOMINATOR * shared >= NUMERATOR * union)
                keep = pa.array(similar, pa.bool_())
                yield part.select(["a", "b"]).filter(keep)

    return both.mapInArrow(tasks, f"a {id_sql}, b {id_sql}")


def classes_and_links(df: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
    """(sketches, classes, links): every row's digest; of each digest its least document; confirmed
    links between the least documents."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))
    rows = checkpointed(sketched(df, id_column, text_column))
    classes = checkpointed(
        rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.max("n_shingles").alias("n"),
            F.first("keys").alias("keys"),
            F.first("bits").alias("bits"),
        )
    )
    sets = classes.select("rep", "n", "bits")
    members = classes.select("rep", F.explode("keys").alias("key"))
    # Buckets with one class alone, nearly all, end here.
    leaders = members.groupBy("key").agg(
        F.min("rep").alias("first"), F.count(F.lit(1)).alias("size")
    )
    shared = checkpointed(members.join(leaders.where("size > 1"), "key").drop("size"))
    stars = shared.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    near_stars = (
        stars.distinct()
        .join(sets.alias("x"), F.col("a") == F.col("x.rep"))
        .join(sets.alias("y"), (F.col("b") == F.col("y.rep")) & near_enough("x", "y"))
        .select("a", "b")
    )
    star_links = checkpointed(confirmed(docs, checkpointed(near_stars)))
    found = components(star_links)
    named = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"), "first"
    )
    # A bucket whose classes are in one component has nothing more to say.
    open_keys = named.groupBy("key").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high")
    ).where("_low <> _high")
    rest = named.join(open_keys.select("key"), "key").join(sets, "rep")
    x, y = rest.alias("x"), rest.alias("y")
    more = (
        x.join(
            y,
            F.expr("x.key = y.key AND x.rep < y.rep AND x.component <> y.component")
            & F.expr("x.rep <> x.first")
            & near_enough("x", "y"),
        )
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    more = checkpointed(more)
    links = star_links.unionByName(confirmed(docs, more))
    return rows, classes, checkpointed(links)


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    rows, classes, links = classes_and_links(df, id_column, text_column)
    found = components(links)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def representatives(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``df`` without the documents that are not kept, columns unchanged."""
    found = near_duplicates(df, id_column, text_column)
    dropped = checkpointed(found.where("NOT kept").select("doc_id").distinct())
    return pick(df, id_column, dropped, others=True)


@query("op2_minmax_dedup")
def op2_minmax_dedup(spark: SparkSession, base: str) -> DataFrame:
    return near_duplicates(read(spark, base, "documents"))
