"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words. Lines of equal sets are found by a digest. For lines that
are merely similar, Jaccard similarity ``NUMERATOR`` / ``DENOMINATOR`` or more, the words of a line
are ordered by rarity and only those of its prefix are posted: two similar lines share a word there.
Postings meet by word; the sizes of the lines, the places of the shared word and a 256-bit parity map
of their words (each differing word changes one bit) rule out nearly all other pairs, also of lines
with hundreds of words, and the rest are compared word by word. A line is removed if an earlier line, by document id and line number, has
an equal or similar set, kept itself or not.

One earlier match is enough for that. Postings of a word come sorted by document and line. A line is
paired with the first earlier one that the bounds let pass, where the lines that were paired with none,
the word's leaders, come first; it becomes a leader where the bounds rule out all. So a posting makes
one pair at most, however many variants of a passage share a word. A line that was paired and yet has no
similar line after the comparison is compared with the other earlier lines of its words, four times as
many in each round, earliest first, until it has one or none is left. Nothing is capped; pairs are
ruled out by exact bounds alone.

``linked`` gives all similar pairs of different sets instead, and the members of each set. There every two
postings of a word that the bounds let pass make a pair, each pair is kept once, with one of its words, and
the lines of a word are dealt into blocks of ``SIDE``: a task compares two blocks, so that a line's text is
sent once for each block that it meets and no group of near copies is one task.

Rarity comes from word counts over all lines, held in a table of ``BUCKETS`` counters by hash: it is
broadcast, its size does not depend on the data, and words that share a counter only make the order a
little less good. Any order that is the same for all lines gives the same result. Texts are read twice,
for the counts and for the lines with their digests and prefixes, which are stored and serve for the
copies and for the postings.

Every line with a word counts, however short (``MIN_WORDS`` can be raised by those who want short lines
to stay). Sets of fewer than ``LEAST_NEAR`` words are similar to equal sets alone, so the digest finds
all their repeats and they are not posted. Lines without words stay, as they are what parts paragraphs.
Null and empty texts have nothing to remove. Documents without an id are left as they are; rows of equal id count as
one document with one text. An empty table gives no rows. ``deduplicated`` passes other columns on
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.links import PICK_LIMIT, pick
from gradus.llm.minmax import mixed
from gradus.llm.registry import query, read
from gradus.llm.words import slices, unused
from gradus.session import checkpointed, scratch_folder, stacked

NUMERATOR, DENOMINATOR = 85, 100
#: Fewest distinct words of a line that counts.
MIN_WORDS = 1
#: Words of the smallest set that a different set can be similar to, one with a word more.
LEAST_NEAR = -(-NUMERATOR // (DENOMINATOR - NUMERATOR))
BUCKETS = 1 << 18
#: A line's parity map, 64 bits each.
BITS = ["bits0", "bits1", "bits2", "bits3"]
#: Bytes of texts that are cut and hashed at once; longer texts in pieces of whole lines.
BLOCK_BYTES = 1 << 21
#: Earlier lines that an open line is compared with in its first round; four times as many in each next.
FIRST_ROUND = 4
#: Lines of one side of a block of pairs to compare.
SIDE = 512
#: Numbers of lines to compare that may be broadcast, 8 bytes each; beyond it texts are joined.
BROADCAST_LINES = 1_000_000


def line_words(line: str) -> set[bytes]:
    """Words between blanks and ASCII control spaces, A-Z lower-cased: what ``bytes`` does."""
    return set(line.encode().lower().split())


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return df.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
#: Words are hashed as polynomials of their bytes modulo 2 ** 64, then mixed.
_BASE, _INVERSE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))


def _powers(base: np.uint64, known: list, size: int) -> np.ndarray:
    """base ** k for k < size, grown by doubling and kept."""
    while len(known[0]) < size:
        step = known[0][-1:] * base
        known[0] = np.concatenate([known[0], known[0] * step])
    return known[0][:size]


def hashed(texts: list[str], powers: tuple[list, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, parted by line ends, and start and hash of each of their words."""
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * _powers(_BASE, powers[0], len(data)), out=sums[1:])
    spans = (sums[end] - sums[start]) * _powers(_INVERSE, powers[1], len(data) + 1)[start]
    return data, start, mixed(spans ^ ((end - start).astype(np.uint64) << np.uint64(48)))


class Block:
    """The lines of some texts with at least ``least`` distinct words, and their words' hashes end to
    end, sorted within a line. Cutting, hashing and sorting run over all texts at once."""

    def __init__(
        self, keys: list, texts: list[str], powers: tuple[list, list], least: int = MIN_WORDS,
        firsts: list[int] | None = None,
    ):
        """``firsts`` are the numbers of the texts' first lines, where they are pieces of texts."""
        self.counts = [text.count("\n") + 1 for text in texts]
        data, start, hashes = hashed(texts, powers)
        # Lines of the whole block are numbered; each text has at least one.
        line = np.searchsorted(np.flatnonzero(data == 10), start)
        order = np.argsort((line.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        hashes, line = hashes[order], line[order]
        same = (line[1:] == line[:-1]) & ((hashes[1:] >> np.uint64(24)) == (hashes[:-1] >> np.uint64(24)))
        if (same & (hashes[1:] != hashes[:-1])).any():
            order = np.lexsort((hashes, line))
            hashes, line = hashes[order], line[order]
            same = (line[1:] == line[:-1]) & (hashes[1:] == hashes[:-1])
        new = np.ones(len(hashes), bool)
        new[1:] = ~same
        hashes, line = hashes[new], line[new]
        sizes = np.bincount(line) if len(line) else np.zeros(0, np.int64)
        enough = sizes >= max(least, 1)
        self.words = hashes[enough[line]] if len(line) else hashes
        chosen = np.flatnonzero(enough)
        self.sizes = sizes[chosen]
        self.starts = np.cumsum(self.sizes) - self.sizes
        first = np.cumsum(self.counts) - self.counts
        text_of = np.searchsorted(first, chosen, side="right") - 1
        self.text = text_of
        self.doc = [keys[k] for k in text_of.tolist()]
        base = np.array(firsts or [0] * len(texts))
        self.line = (chosen - first[text_of] + base[text_of]).tolist()

    def digests(self) -> list[bytes]:
        """128 bits of each line's set: two sums of differently mixed hashes."""
        if not len(self.sizes):
            return []
        first = np.add.reduceat(mixed(self.words), self.starts)
        second = np.add.reduceat(mixed(self.words ^ np.uint64(0x5851F42D4C957F2D)), self.starts)
        packed = np.stack([first, second], 1).tobytes()
        return [packed[16 * k : 16 * k + 16] for k in range(len(self.sizes))]

    def parities(self) -> np.ndarray:
        """Each line's parity map, a row of four numbers."""
        bits = np.zeros((len(self.words), len(BITS)), np.uint64)
        at = (self.words >> np.uint64(62)).astype(np.int64)
        bits[np.arange(len(at)), at] = np.uint64(1) << ((self.words >> np.uint64(56)) & np.uint64(63))
        return np.bitwise_xor.reduceat(bits, self.starts, axis=0)

    def rarest(self, rank: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The first ``prefix`` words of each line in the order of ``rank`` of their counters."""
        line = np.repeat(np.arange(len(self.sizes), dtype=np.uint64), self.sizes)
        place = rank[_bucket(self.words)]
        # A block has less than 2 ** 21 lines with words.
        keys = (line << np.uint64(43)) | (place << np.uint64(25)) | (self.words >> np.uint64(39))
        order = np.argsort(keys)
        keys = keys[order]
        if (keys[1:] == keys[:-1]).any():
            order = np.lexsort((self.words, place, line))
        pos = np.arange(len(order)) - np.repeat(self.starts, self.sizes)
        return self.words[order][pos < np.repeat(prefix, self.sizes)]


def _pieces(text: str):
    """(number of the first line, lines) of a text, in pieces of about ``BLOCK_BYTES`` if it is longer."""
    start = line = 0
    while len(text) - start > BLOCK_BYTES:
        end = text.find("\n", start + BLOCK_BYTES)
        if end < 0:
            break
        piece = text[start:end]
        yield line, piece
        line += piece.count("\n") + 1
        start = end + 1
    yield line, text[start:] if start else text


def _parts(batches):
    """(keys, numbers of first lines, texts, type of the keys) of the batches' texts, part by part."""
    held, size, kind = [], 0, None
    for batch in batches:
        kind = batch.column(0).type
        for part in slices(batch, 256):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for line, piece in _pieces(text):
                    if held and size + len(piece) > BLOCK_BYTES:
                        yield *map(list, zip(*held)), kind
                        held, size = [], 0
                    held.append((key, line, piece))
                    size += len(piece)
    if held:
        yield *map(list, zip(*held)), kind


def _known_powers() -> tuple[list, list]:
    return [np.ones(1, np.uint64)], [np.ones(1, np.uint64)]


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """How many words of the lines fall on each counter; BUCKETS numbers, whatever the table."""

    def tasks(batches):
        powers = _known_powers()
        counts = np.zeros(BUCKETS, np.int64)
        for _, _, texts, _ in _parts(batches):
            counts += np.bincount(_bucket(hashed(texts, powers)[2]), minlength=BUCKETS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["bucket", "n"]
        )

    found = docs.mapInArrow(tasks, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = found.toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def line_sets(docs: DataFrame, counts: np.ndarray, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line, digest, n, parity map, words) of each line that counts: words are those of its
    prefix, none of a line that is similar to equal sets alone."""
    id_sql = docs.schema["doc_id"].dataType.simpleString()
    rank = np.empty(BUCKETS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def tasks(batches):
        powers = _known_powers()
        for keys, firsts, texts, kind in _parts(batches):
            block = Block(keys, texts, powers, min_words, firsts)
            if not len(block.sizes):
                continue
            n = block.sizes
            prefix = np.where(n >= LEAST_NEAR, n - -(-NUMERATOR * n // DENOMINATOR) + 1, 0)
            words = block.rarest(shared.value, prefix).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.doc, kind),
                    pa.array(block.line, pa.int32()),
                    pa.array(block.digests(), pa.binary()),
                    pa.array(n.astype(np.int32)),
                    *[pa.array(bits) for bits in block.parities().view(np.int64).T.copy()],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(words)),
                ],
                names=["doc_id", "line", "digest", "n", *BITS, "words"],
            )

    bits = ", ".join(f"{name} bigint" for name in BITS)
    return docs.mapInArrow(
        tasks, f"doc_id {id_sql}, line int, digest binary, n int, {bits}, words array<bigint>"
    )


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, of which later jobs read the columns that they need."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def copies(sets: DataFrame) -> DataFrame:
    """(doc_id, line, to_doc, to_line) of each line with an equal earlier one, and the earliest of these."""
    lines = sets.select("doc_id", "line", "digest")
    first = lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line")).alias("f"), F.count(F.lit(1)).alias("n"))
    # Only sets that several lines have are looked for in the lines.
    several = checkpointed(first.where("n > 1").drop("n"))
    return checkpointed(
        lines.join(_few(several), "digest")
        .where("doc_id <> f.doc_id OR line <> f.line")
        .select("doc_id", "line", F.col("f.doc_id").alias("to_doc"), F.col("f.line").alias("to_line"))
        .distinct()
    )


def postings(sets: DataFrame, repeated: DataFrame) -> DataFrame:
    """(word, doc_id, line, n, pos, parity map) of the prefix of each distinct set, by its earliest line."""
    first = sets.drop("digest").join(_few(repeated.select("doc_id", "line")), ["doc_id", "line"], "left_anti")
    return first.select(F.posexplode("words").alias("pos", "word"), "doc_id", "line", "n", *BITS).select(
        "word", "doc_id", "line", "n", "pos", *BITS
    )


def possible(x: str, y: str):
    """The length, positional and parity bounds for two postings of one word.

    ``need`` is the least overlap of similar sets of these sizes. Up to the word at most as many
    words are shared as the nearer place allows, after it as many as the shorter rest has.
    """
    need = f"ceil({NUMERATOR} * ({x}.n + {y}.n) / {DENOMINATOR + NUMERATOR})"
    return F.expr(
        f"{DENOMINATOR} * least({x}.n, {y}.n) >= {NUMERATOR} * greatest({x}.n, {y}.n)"
        f" AND least({x}.pos, {y}.pos) + least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {need}"
        f" AND {' + '.join(f'bit_count({x}.{b} ^ {y}.{b})' for b in BITS)} <= {x}.n + {y}.n - 2 * {need}"
    )


PAIR = ["x_doc", "x_line", "y_doc", "y_line"]


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored pairs of lines (x, y) whose sets are similar, with texts of these lines only."""
    sides = F.array(
        F.struct(F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line")),
        F.struct(F.col("y_doc").alias("doc_id"), F.col("y_line").alias("line")),
    )
    wanted = checkpointed(pairs.select(F.explode(sides).alias("s")).select("s.*").distinct())
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list("line").alias("wanted"))
    # Few lines are broadcast, after they were counted, so that texts stay where they are.
    if wanted.count() <= BROADCAST_LINES:
        by_doc = F.broadcast(by_doc)
    lines = (
        docs.join(by_doc, "doc_id")
        .select("doc_id", "wanted", F.split("text", "\n").alias("all"))
        .select(
            "doc_id",
            F.explode(
                F.transform("wanted", lambda k: F.struct(k.alias("line"), F.get("all", k).alias("content")))
            ).alias("l"),
        )
        .select("doc_id", "l.line", "l.content")
    )
    both = pairs.join(
        lines.select(F.col("doc_id").alias("x_doc"), F.col("line").alias("x_line"), F.col("content").alias("x")),
        ["x_doc", "x_line"],
    ).join(
        lines.select(F.col("doc_id").alias("y_doc"), F.col("line").alias("y_line"), F.col("content").alias("y")),
        ["y_doc", "y_line"],
    )

    def tasks(batches):
        for batch in batches:
            for part in slices(batch, 2048):
                similar = []
                for x, y in zip(part.column(4).to_pylist(), part.column(5).to_pylist()):
                    a, b = line_words(x), line_words(y)
                    overlap = len(a & b)
                    union = len(a) + len(b) - overlap
                    similar.append(DENOMINATOR * overlap >= NUMERATOR * union)
                yield part.select(PAIR).filter(pa.array(similar, pa.bool_()))

    id_sql = pairs.schema["x_doc"].dataType.simpleString()
    schema = f"x_doc {id_sql}, x_line int, y_doc {id_sql}, y_line int"
    return both.select(*PAIR, "x", "y").mapInArrow(tasks, schema)


def _pairs(found: DataFrame, y: str) -> DataFrame:
    return found.select(
        F.col("x.doc_id").alias("x_doc"), F.col("x.line").alias("x_line"),
        F.col(f"{y}.doc_id").alias("y_doc"), F.col(f"{y}.line").alias("y_line"),
    )


LATER = "struct(y.doc_id, y.line) < struct(x.doc_id, x.line)"


class _Earlier:
    """Postings of a word in order, and the first of them that may be similar to another."""

    #: Rows are looked at one by one up to as many, beyond it as arrays.
    FEW = 24

    def __init__(self):
        self.rows, self.arrays = [], None

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) % self.FEW == 0:
            bits = np.frombuffer(b"".join(r[4].to_bytes(8 * len(BITS), "little") for r in self.rows), np.uint64)
            numbers = [np.array([r[k] for r in self.rows], np.int64) for k in (2, 3)]
            self.arrays = [*numbers, bits.reshape(-1, len(BITS))]

    def first(self, n: int, pos: int, bits: int) -> tuple | None:
        start = 0
        if self.arrays is not None:
            m, at, other = self.arrays
            need = -(-NUMERATOR * (n + m) // (DENOMINATOR + NUMERATOR))
            may = DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)
            may &= np.minimum(pos, at) + np.minimum(n - pos, m - at) >= need
            own = np.frombuffer(bits.to_bytes(8 * len(BITS), "little"), np.uint64)
            may &= np.bitwise_count(other ^ own).sum(axis=1, dtype=np.int64) <= n + m - 2 * need
            if may.any():
                return self.rows[int(np.argmax(may))]
            start = len(m)
        # ``possible`` for two postings as numbers.
        least, most = -(-NUMERATOR * n // DENOMINATOR), DENOMINATOR * n // NUMERATOR
        for row in self.rows[start:] if start else self.rows:
            _, _, m, at, other = row
            if least <= m <= most:
                need = -(-NUMERATOR * (n + m) // (DENOMINATOR + NUMERATOR))
                left = n - pos if n - pos < m - at else m - at
                if (pos if pos < at else at) + left >= need and (bits ^ other).bit_count() <= n + m - 2 * need:
                    return row
        return None


class _Word:
    """The lines of a word so far: leaders, and those that were paired with one."""

    def __init__(self):
        self.leaders, self.others, self.last = _Earlier(), _Earlier(), None

    def meet(self, row: tuple) -> tuple | None:
        """An earlier line that may be similar to this one, a leader if there is one."""
        if row[:2] == self.last:  # rows of equal id
            return None
        self.last = row[:2]
        found = self.leaders.first(*row[2:]) or self.others.first(*row[2:])
        (self.leaders if found is None else self.others).add(row)
        return found


def led(posted: DataFrame) -> DataFrame:
    """(x, y, shared): a line and one earlier line of each of its words that the bounds let pass, and
    for how many words that is the same one.

    A word's postings are read in order by one task, which keeps them as numbers.
    """
    id_sql = posted.schema["doc_id"].dataType.simpleString()

    def tasks(batches):
        word, met = None, _Word()
        for batch in batches:
            kind = batch.column(1).type
            words = batch.column(0).to_numpy()
            same = np.zeros(len(words) + 1, bool)
            same[1:-1] = words[1:] == words[:-1]
            same[0] = len(words) > 0 and words[0] == word
            same[-1] = True  # the next batch may go on with the last word
            # Words of one posting, most of them, are not looked at.
            several = np.flatnonzero(same[:-1] | same[1:])
            part = batch.take(pa.array(several))
            columns = [part.column(k).to_pylist() for k in range(1, 5)]
            bits = np.stack([part.column(5 + k).to_numpy() for k in range(len(BITS))], 1).tobytes()
            size = 8 * len(BITS)
            columns.append([int.from_bytes(bits[k : k + size], "little") for k in range(0, len(bits), size)])
            pairs = []
            for w, row in zip(words[several].tolist(), zip(*columns)):
                if w != word:
                    word, met = w, _Word()
                if (other := met.meet(row)) is not None:
                    pairs.append((row[0], row[1], other[0], other[1]))
            if pairs:
                types = (kind, pa.int32(), kind, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in pairs], t) for k, t in enumerate(types)], names=PAIR
                )

    dealt = posted.repartition("word").sortWithinPartitions("word", "doc_id", "line")
    pairs = dealt.select("word", "doc_id", "line", "n", "pos", *BITS).mapInArrow(
        tasks, f"x_doc {id_sql}, x_line int, y_doc {id_sql}, y_line int"
    )
    return pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("shared"))


def settled(docs: DataFrame, pairs: DataFrame, first: int) -> DataFrame:
    """Similar pairs among the stored pairs (x, y, nth), at least one for each x that has any: the first
    ones of all x are compared, then four times as many of those that have none so far, and so on."""
    x_line = ["x_doc", "x_line"]
    low, high = 0, first
    most = pairs.agg(F.max("nth")).first()[0] or 0
    done = None
    while low < most:
        now = pairs.where((F.col("nth") > low) & (F.col("nth") <= high))
        if done is not None:
            now = checkpointed(now.join(done.select(*x_line).distinct(), x_line, "left_anti"))
        found = confirmed(docs, now.select(*PAIR))
        done = checkpointed(found if done is None else done.unionByName(found))
        low, high = high, 4 * high
    return pairs.select(*PAIR).limit(0) if done is None else done


def _few(rows: DataFrame) -> DataFrame:
    """Stored rows, broadcast if they were counted and are few."""
    return F.broadcast(rows) if rows.limit(PICK_LIMIT + 1).count() <= PICK_LIMIT else rows


def similar_lines(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(doc_id, line, to_doc, to_line): lines with an earlier similar line, and one such line.

    Postings are shuffled once, and those of words that an open line has once more.
    """
    x_line = ["x_doc", "x_line"]
    likely = Window.partitionBy(*x_line).orderBy(F.desc("shared"), "y_doc", "y_line")
    tested = checkpointed(led(posted).withColumn("nth", F.row_number().over(likely)))
    done = settled(docs, tested, 1)
    open_lines = checkpointed(
        tested.select(*x_line).distinct().join(done.select(*x_line).distinct(), x_line, "left_anti")
    )
    if not open_lines.isEmpty():
        named = open_lines.select(F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line"))
        own = checkpointed(posted.join(_few(named), ["doc_id", "line"], "left_semi").select(*posted.columns))
        others = pick(posted, "word", checkpointed(own.select("word").distinct()))
        rest = own.alias("x").join(
            others.alias("y"), F.expr(f"x.word = y.word AND {LATER}") & possible("x", "y")
        )
        left = _pairs(rest, "y").distinct().join(tested.select(*PAIR), PAIR, "left_anti")
        order = Window.partitionBy(*x_line).orderBy("y_doc", "y_line")
        left = checkpointed(left.withColumn("nth", F.row_number().over(order)))
        done = done.unionByName(settled(docs, left, FIRST_ROUND))
    to = F.min(F.struct("y_doc", "y_line"))
    return (
        done.groupBy("x_doc", "x_line")
        .agg(to.alias("to"))
        .select(
            F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line"),
            F.col("to.y_doc").alias("to_doc"), F.col("to.y_line").alias("to_line"),
        )
    )


def candidates(posted: DataFrame) -> DataFrame:
    """(a, b, word): all pairs of sets that the bounds let pass, each once, and a word that they share."""
    both = posted.alias("x").join(
        posted.alias("y"), F.expr("x.word = y.word AND x.ref < y.ref") & possible("x", "y")
    )
    pairs = both.select(F.col("x.ref").alias("a"), F.col("y.ref").alias("b"), F.col("x.word").alias("word"))
    return pairs.groupBy("a", "b").agg(F.min("word").alias("word"))


def all_similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, line, similar): each line that has earlier similar ones among the stored candidates
    (a, b, word), and all of these, (to_doc, to_line), in order."""
    ends = F.explode(F.array("a", "b")).alias("ref")
    groups = pairs.select("word", ends).distinct().groupBy("word").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("g"))
    large = checkpointed(groups.where("g > 1"))
    i, j = (F.pmod(F.xxhash64(end), F.coalesce("g", F.lit(1))) for end in ("a", "b"))
    block = ["word", "i", "j"]
    dealt = stored(
        pairs.join(_few(large), "word", "left").select(
            "word", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), "a", "b"
        )
    )
    meets = dealt.select(*block, ends).distinct().groupBy("ref").agg(F.collect_list(F.struct(*block)).alias("blocks"))
    wanted = checkpointed(sets.select("doc_id", "line", "ref").join(meets, "ref"))
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "ref", "blocks")).alias("wanted"))
    if (wanted.agg(F.sum(F.size("blocks"))).first()[0] or 0) <= BROADCAST_LINES:
        by_doc = F.broadcast(by_doc)
    members = (
        docs.join(by_doc, "doc_id")
        .select("doc_id", F.explode("wanted").alias("w"), F.split("text", "\n").alias("all"))
        .select(
            "doc_id", "w.line", F.col("w.ref").alias("a"), F.get("all", F.col("w.line")).alias("content"),
            F.explode("w.blocks").alias("block"),
        )
        .select("block.*", "a", F.lit(None).cast("bigint").alias("b"), "doc_id", "line", "content")
    )
    id_sql = docs.schema["doc_id"].dataType.simpleString()
    empty = {"doc_id": id_sql, "line": "int", "content": "string"}
    asked = dealt.select(*block, "a", "b", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])

    def links_of(found: dict, kind) -> pa.RecordBatch:
        flat = [y for earlier in found.values() for y in earlier]
        to = [pa.array([y[k] for y in flat], t) for k, t in enumerate((kind, pa.int32()))]
        ends = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in found], kind),
                pa.array([x[1] for x in found], pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(to, names=["to_doc", "to_line"])),
            ],
            names=["doc_id", "line", "similar"],
        )

    def tasks(batches):
        at, kind, held, known, found = None, None, {}, {}, {}
        for batch in batches:
            kind = batch.column(5).type
            for part in slices(batch, 1024):
                for word, i, j, a, b, doc, line, content in zip(*[c.to_pylist() for c in part.columns]):
                    if at != (word, i, j):
                        if found:
                            yield links_of(found, kind)
                        at, held, known, found = (word, i, j), {}, {}, {}
                    if b is None:
                        # Lines of a block share most words, which are kept once.
                        held[a] = (doc, line), {known.setdefault(w, w) for w in line_words(content)}
                        continue
                    (x, these), (y, those) = held[a], held[b]
                    overlap = len(these & those)
                    # Rows of equal id are one document.
                    if x != y and DENOMINATOR * overlap >= NUMERATOR * (len(these) + len(those) - overlap):
                        found.setdefault(max(x, y), []).append(min(x, y))
        if found:
            yield links_of(found, kind)

    # The lines of a block come before its pairs.
    ordered = stacked(members, asked).repartition(*block).sortWithinPartitions(*block, "b")
    found = ordered.mapInArrow(
        tasks, f"doc_id {id_sql}, line int, similar array<struct<to_doc: {id_sql}, to_line: int>>"
    )
    every = F.sort_array(F.array_distinct(F.flatten(F.collect_list("similar"))))
    return found.groupBy("doc_id", "line").agg(every.alias("similar"))


def _read_lines(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of the documents with an id, and (doc_id, n_lines) of all."""
    docs = _texts(df, id_column, text_column)
    lines_of = F.regexp_count("text", F.lit("\n")) + 1
    n_lines = F.when(F.col("text") == "", 0).otherwise(lines_of).cast("bigint").alias("n_lines")
    return docs.where("doc_id IS NOT NULL"), docs.select("doc_id", n_lines)


def _removed(repeated: DataFrame, similar: DataFrame) -> DataFrame:
    similar = similar.withColumn("near", F.lit(True))
    repeated = repeated.withColumn("near", F.lit(False))
    # A copy of a line may be near an earlier one too: it counts once, as a copy.
    to = F.min(F.struct("near", "to_doc", "to_line"))
    both = repeated.unionByName(similar).groupBy("doc_id", "line").agg(to.alias("t"))
    return both.select("doc_id", "line", "t.to_doc", "t.to_line", "t.near")


def removals(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS
):
    """(documents, removed): (doc_id, n_lines) of each document; (doc_id, line, to_doc, to_line, near)
    of each removed line and an earlier line that it repeats."""
    known, documents = _read_lines(df, id_column, text_column)
    sets = stored(line_sets(known, word_counts(known), min_words))
    repeated = copies(sets)
    return documents, _removed(repeated, similar_lines(known, postings(sets, repeated)))


def linked(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS
):
    """(documents, removed, near): the first two as ``removals`` gives them, with the earliest line that each
    repeats, which for a copy is the first line of its set; and (doc_id, line, similar) of each such first line
    that is similar to earlier ones, with all of these, (to_doc, to_line), in order."""
    known, documents = _read_lines(df, id_column, text_column)
    sets = stored(
        line_sets(known, word_counts(known), min_words).withColumn("ref", F.monotonically_increasing_id())
    )
    repeated = copies(sets)
    first = sets.join(_few(repeated.select("doc_id", "line")), ["doc_id", "line"], "left_anti")
    posted = first.select(F.posexplode("words").alias("pos", "word"), "ref", "n", *BITS)
    near = checkpointed(all_similar(known, sets, stored(candidates(posted))))
    nearest = near.select("doc_id", "line", F.inline(F.slice("similar", 1, 1)))
    return documents, _removed(repeated, nearest), near


def deduplicated(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``df`` without the removed lines in its text column; rows and other columns unchanged."""
    _, removed = removals(df, id_column, text_column, min_words)
    gone = removed.groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))
    name = unused(df, "lines_of")
    packed = gone.select(F.struct("doc_id", "_gone").alias(name))
    text = F.col(f"`{text_column}`")
    left = F.array_join(
        F.filter(
            F.split(text, "\n"),
            lambda _, k: ~F.array_contains(F.col(f"{name}._gone"), k),
        ),
        "\n",
    )
    columns = [
        F.when(F.col(name).isNull(), text).otherwise(left).alias(c) if c == text_column else F.col(f"`{c}`")
        for c in df.columns
    ]
    return df.join(packed, F.col(f"`{id_column}`") == F.col(f"{name}.doc_id"), "left").select(*columns)


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, base: str) -> DataFrame:
    """Each document's lines, how many are removed, how many of these as near copies, the removed lines with
    the earliest line (document and number) that each repeats, and all links of its lines to earlier lines
    of other words; a link stands between the first lines of their sets, of which ``links`` names the copies."""
    documents, removed, near = linked(read(spark, base, "documents"))
    link = F.struct("line", "to_doc", "to_line", "near")
    grouped = removed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.sum(F.col("near").cast("bigint")).alias("n_near"),
        F.sort_array(F.collect_list(link)).alias("links"),
    )
    similar = near.groupBy("doc_id").agg(
        F.sum(F.size("similar")).alias("n_pairs"),
        F.sort_array(F.collect_list(F.struct("line", "similar"))).alias("pairs"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        documents.groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
        .join(grouped, "doc_id", "left")
        .join(similar, "doc_id", "left")
        .select(
            "doc_id", "n_lines", F.coalesce("n_links", zero).alias("n_links"),
            F.coalesce("n_near", zero).alias("n_near"),
            F.coalesce("links", F.array().cast(grouped.schema["links"].dataType)).alias("links"),
            F.coalesce("n_pairs", zero).alias("n_pairs"),
            F.coalesce("pairs", F.array().cast(similar.schema["pairs"].dataType)).alias("pairs"),
        )
    )
