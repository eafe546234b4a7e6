"""Document fingerprints from prefix polynomial hashes.

For a text c[0], c[1], ... of code points two arrays hold the sums of c[k] * base ** k modulo a
prime, up to each position. The difference of two entries is the hash of a span, so whether two
spans are equal is answered in constant time, and how far two texts agree from two given positions
is found by binary search. The fingerprint is the length and the hash of the whole text.

Two texts are compared by following their longest common extension, stepping over a difference by the
next window of ``RESUME`` code points that both have, and in the end the longest common suffix of what
is left. Windows are sought within ``GAP`` code points first, then within twice as many, up to the rest
of both texts, so a difference may have any length; each step goes on by at least half of what it looked
at, so that all steps together look at a few times the lengths of the texts. Their likeness is the number of code points that
extensions cover, over the length of the longer text; two empty texts are alike (1).

``edited`` compares each text with a changed form of itself and with the next document. Documents
are range partitioned by id, so that the next one is the next row; only the first and the last row
of each partition are carried over its border.

Nulls are empty texts, null ids come last, rows of equal id follow the hash of their texts, a single
document is its own next one, an empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.llm.words import slices
from gradus.session import checkpointed

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_566_083_941)
GAP, RESUME = 64, 16


class Powers:
    """base ** k modulo each prime, for k as far as was asked for."""

    def __init__(self, bases: tuple[int, ...]):
        self.bases = bases
        self.known = [np.ones(1, np.int64) for _ in PRIMES]

    def upto(self, size: int) -> list[np.ndarray]:
        while len(self.known[0]) < size:
            for i, (prime, base) in enumerate(zip(PRIMES, self.bases)):
                have = self.known[i]
                self.known[i] = np.concatenate([have, have * pow(base, len(have), prime) % prime])
        return self.known


POWERS = Powers(BASES)
INVERSES = Powers(tuple(pow(base, -1, prime) for prime, base in zip(PRIMES, BASES)))


class Prefixes:
    """A text's prefix arrays."""

    def __init__(self, points: np.ndarray):
        self.points, self.size, self._windows = points, len(points), None
        powers = POWERS.upto(2 * self.size + 1)
        self.sums = []
        for prime, power in zip(PRIMES, powers):
            sums = np.zeros(self.size + 1, np.int64)
            terms = (points.astype(np.int64) + 1) * power[: self.size] % prime
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % prime)

    @classmethod
    def of(cls, text: str) -> Prefixes:
        return cls(np.frombuffer(text.encode("utf-32-le"), "<u4"))

    def windows(self) -> np.ndarray:
        """Hashes of the RESUME code points at each position, the same wherever they stand."""
        if self._windows is None:
            count = max(self.size - RESUME + 1, 0)
            keys = np.zeros(count, np.int64)
            for prime, power, sums in zip(PRIMES, INVERSES.upto(count), self.sums):
                spans = (sums[RESUME:] - sums[:count]) % prime if count else keys
                keys = (keys << 31) | (spans * power[:count] % prime)
            self._windows = keys
        return self._windows

    def fingerprint(self) -> str:
        first, second = (int(sums[-1]) for sums in self.sums)
        return f"{self.size:x}-{first:08x}{second:08x}"


def same_span(a: Prefixes, i: int, b: Prefixes, j: int, size: int) -> bool:
    """Whether a[i : i + size] and b[j : j + size] have equal hashes."""
    for prime, power, x, y in zip(PRIMES, POWERS.known, a.sums, b.sums):
        left = (int(x[i + size]) - int(x[i])) * int(power[j])
        right = (int(y[j + size]) - int(y[j])) * int(power[i])
        if (left - right) % prime:
            return False
    return True


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How far a from i and b from j agree."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_suffix(a: Prefixes, b: Prefixes, most: int) -> int:
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, a.size - middle, b, b.size - middle, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys that both have stand first in each."""
    low = (1 << max(8, len(x).bit_length() + 3)) - 1
    met = np.zeros(low + 1, bool)
    # Most keys are ruled out by their low bits before any are sorted.
    met[x & low] = True
    second = np.flatnonzero(met[y & low])
    met[:] = False
    met[y[second] & low] = True
    first = np.flatnonzero(met[x & low])
    _, i, j = np.intersect1d(x[first], y[second], return_indices=True)
    return first[i], second[j]


def resume(a: Prefixes, i: int, b: Prefixes, j: int) -> tuple[int, int] | None:
    """The nearest positions from i and j on from which both texts have the same window, in the first
    reach (GAP, doubled up to the rest of both texts) that has any."""
    x, y = a.windows()[i:], b.windows()[j:]
    reach = GAP
    while len(x) and len(y):
        first, second = _shared(x[: reach + 1], y[: reach + 1])
        if len(first):
            at = int(np.argmin(first + second))
            return i + int(first[at]), j + int(second[at])
        if reach >= max(len(x), len(y)):
            break
        reach *= 2
    return None


def likeness(a: Prefixes, b: Prefixes) -> float:
    if not a.size and not b.size:
        return 1.0
    i = j = covered = 0
    while True:
        size = common_extension(a, i, b, j)
        covered, i, j = covered + size, i + size, j + size
        place = resume(a, i, b, j) if i < a.size and j < b.size else None
        if place is None:
            break
        i, j = place
    covered += common_suffix(a, b, min(a.size - i, b.size - j))
    return covered / max(a.size, b.size)


def compared(text: str, own: Prefixes, following: str, after: Prefixes) -> tuple:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    cut = own.size - own.size // 2
    changed = np.concatenate([own.points[:cut], after.points[: own.size // 2]])
    edited = Prefixes(changed)
    return (
        own.size,
        hashlib.sha256((text[:cut] + following[: own.size // 2]).encode()).hexdigest(),
        own.fingerprint(),
        edited.fingerprint(),
        likeness(own, edited),
        likeness(own, after),
    )


_MADE = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_MADE_SQL = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _walk(batches):
    """Rows of a sorted partition, each compared with the next; the first and the last as texts."""
    names = ["doc_id", "part", "border", "text", *[n for n, _ in _MADE]]
    kind = None
    types = [pa.int32(), pa.int32(), pa.string(), *[t for _, t in _MADE]]
    blank = (None,) * len(_MADE)

    def emitted(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types])], names)

    last = None
    for batch in batches:
        kind = batch.column(0).type
        for chunk in slices(batch):
            rows = []
            for key, text, part in zip(*[c.to_pylist() for c in chunk.columns]):
                now = Prefixes.of(text)
                if last is None:
                    rows.append((key, part, 0, text, *blank))
                else:
                    rows.append((last[0], part, None, None, *compared(*last[1:3], text, now)))
                last = (key, text, now, part)
            yield emitted(rows)
    if last is not None:
        yield emitted([(last[0], last[3], 1, last[1], *blank)])


def _meet(batches):
    for batch in batches:
        for chunk in slices(batch):
            rows = [
                (key, *compared(text, Prefixes.of(text), following, Prefixes.of(following)))
                for key, text, following in zip(*[c.to_pylist() for c in chunk.columns])
            ]
            types = [chunk.column(0).type, *[t for _, t in _MADE]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", *[n for n, _ in _MADE]]
            )


def edited(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprints and likenesses of each row (see ``compared``)."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))
    id_sql = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = checkpointed(
        dealt.withColumn("part", F.spark_partition_id()).mapInArrow(
            _walk, f"doc_id {id_sql}, part int, border int, text string, {_MADE_SQL}"
        )
    )
    # The last row of each partition meets the first of the next one; after the last comes the first.
    # Only the partitions' numbers go through one task, texts are joined by them.
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = walked.where("border = 0").select("part")
    next_part = F.coalesce(F.lead("part").over(line), F.first("part").over(whole))
    firsts = walked.where("border = 0").select(F.col("part").alias("to"), F.col("text").alias("following"))
    ends = (
        walked.where("border = 1")
        .select("doc_id", "text", "part")
        .join(parts.withColumn("to", next_part), "part")
        .join(firsts, "to")
        .select("doc_id", "text", "following")
    )
    met = ends.mapInArrow(_meet, f"doc_id {id_sql}, {_MADE_SQL}")
    inside = walked.where(F.col("border").isNull()).select(*met.columns)
    return inside.unionByName(met)


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    return edited(read(spark, base, "documents"))
