"""Repeated byte strings by a suffix array built block by block over a difference cover.

Every byte that lies in a string of ``SPAN`` bytes found twice or more, anywhere, is removed. The strings
of that length are the windows of the texts, and two equal ones are neighbours in the order of suffixes.

Suffixes are dealt into buckets by content before they are sorted. Of the grams of ``GRAM`` bytes in a
window the one of least hash, the leftmost of these, is its anchor: equal windows have equal grams at
equal places, so they have equal anchors, and windows of one anchor lie side by side. A stretch of
windows with one anchor is an item (about 1/150 of the bytes); its bucket is the hash of its anchor.
A bucket with one item has no repeated window. Items of equal bytes are one class: its windows are
repeated if it has two members or more. Only classes that share a bucket with other ones are sorted.

A task sorts the suffixes of its buckets in blocks of ``BLOCK_BYTES``. First the suffixes at places of a
difference cover modulo 31 (6 of 31 places) are ranked, by doubling. Then the windows are sorted bucket
by bucket of their leading bytes, ``BUCKET_WINDOWS`` at a time, by 32 bytes; of two windows that these do
not tell apart, both have a cover place after the same number of bytes, fewer than 31, and its ranks
decide. So memory is that of the cover and one bucket, however long the ties are. Neighbours in the
order that share ``SPAN`` bytes are repeated, compared byte for byte.

A bucket with more than ``HOT`` classes (a passage inside very many texts) is dealt again: its items are
cut into stretches of ``STEP`` windows by their distance to the anchor, and the bytes that all windows of
a stretch share, 385 of 400, are the new bucket. What still is too large is dealt by whole windows,
whose classes need no order. No bucket is capped and no window left out.

Matches never cross texts. Null and empty texts have no bytes, texts under ``SPAN`` bytes nothing to
remove. A text repeated in another row, of the same id or of none, is removed whole if it has ``SPAN``
bytes. Empty tables give no rows; other columns pass on whatever their names. Long texts are anchored
in pieces of ``PIECE`` bytes that overlap by a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.minmax import mixed
from gradus.llm.registry import query, read
from gradus.llm.words import slices, unused
from gradus.session import checkpointed, scratch_folder, stacked

SPAN, GRAM = 400, 112
PIECE = 1 << 19
BLOCK_BYTES = 2_000_000
BUCKET_WINDOWS = 200_000
HOT, STEP = 1000, 16
#: Classes or stretches that may be broadcast to the texts, about 60 bytes each; beyond it texts are joined.
BROADCAST_HELD = 50_000

#: A perfect difference set: each residue is the difference of two of its numbers.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)

_BASE, _INVERSE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_PLACE = 22


class Powers:
    """base ** k modulo 2 ** 64 of both bases, as far as a piece asks for."""

    def __init__(self):
        self.known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k, base in enumerate((_BASE, _INVERSE)):
            while len(self.known[k]) < n:
                self.known[k] = np.concatenate([self.known[k], self.known[k] * (self.known[k][-1:] * base)])
        return self.known[0][:n], self.known[1][:n]


def anchored(data: np.ndarray, ends: np.ndarray, powers: Powers, span: int, gram: int):
    """(first window, last window, anchor, hash of the anchor) of the items of texts laid end to end."""
    n, wide = len(data), span - gram + 1
    if n < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    up, down = powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # The leading bits of a hash and its place: the least is the leftmost of the least hashes.
    low = np.uint64((1 << _PLACE) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    rows = np.concatenate([keys, np.full(-len(keys) % wide, ~np.uint64(0))]).reshape(-1, wide)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    anchor = (np.minimum(after[:windows], before[wide - 1 : wide - 1 + windows]) & low).astype(np.int64)
    new = np.ones(windows, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    # A text's windows end where it does.
    starts = np.concatenate([[0], ends[:-1]])
    new[starts[starts < windows]] = True
    beyond = np.maximum(ends - span + 1, starts)
    new[beyond[beyond < windows]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], windows) - 1
    inside = first + span <= ends[np.searchsorted(ends, first, side="right")]
    first, last = first[inside], last[inside]
    return first, last, anchor[first], hashes[anchor[first]]


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


ITEM = "anchor bigint, class bigint, width int, off int, places array<bigint>"


def items(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, digest, anchor, class, width, off, places): a text's items; those of equal bytes are one
    row with the places of their first windows. ``width`` counts the windows, ``off`` leads to the anchor."""

    def rows(ids, digests, texts, powers):
        found = [[] for _ in range(6)]

        def flush(held: list[tuple[int, int, bytes]]):
            data = b"".join(t for *_, t in held)
            ends = np.cumsum([len(t) for *_, t in held])
            first, last, anchor, hashes = anchored(np.frombuffer(data, np.uint8), ends, powers, span, gram)
            owner = np.searchsorted(ends, first, side="right")
            base = [start - int(e) + len(t) for (_, start, t), e in zip(held, ends.tolist())]
            met: dict[tuple, list[int]] = {}
            for k, a, b, at, h in zip(
                owner.tolist(), first.tolist(), last.tolist(), anchor.tolist(), hashes.view(np.int64).tolist()
            ):
                key = (held[k][0], h, _digest(data[a : b + span]), b - a + 1, at - a)
                met.setdefault(key, []).append(base[k] + a)
            for (row, *item), places in met.items():
                for column, value in zip(found, (row, *item, places)):
                    column.append(value)

        held, size = [], 0
        for k, text in enumerate(texts):
            for start in range(0, len(text) - span + 1, PIECE):
                piece = text[start : start + PIECE + span - 1]
                if size + len(piece) > PIECE + span and held:
                    flush(held)
                    held, size = [], 0
                held.append((k, start, piece))
                size += len(piece)
        if held:
            flush(held)
        at = pa.array(found[0], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                ids.take(at), digests.take(at), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()),
                pa.array(found[3], pa.int32()), pa.array(found[4], pa.int32()),
                pa.array(found[5], pa.list_(pa.int64())),
            ],
            names=["id", "digest", "anchor", "class", "width", "off", "places"],
        )

    def tasks(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, 1024):
                yield rows(part.column(0), part.column(1), part.column(2).to_pylist(), powers)

    id_sql = docs.schema["id"].dataType.simpleString()
    long = docs.where(F.octet_length("text") >= span)
    return long.mapInArrow(tasks, f"id {id_sql}, digest bigint, {ITEM}")


def leading_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, its first byte leading; 8 bytes less."""
    out = np.empty(len(data) - 8, np.uint64)
    for k in range(8):
        part = data[k : k + (len(data) - k) // 8 * 8].view(">u8")
        out[k::8] = part[: len(out[k::8])]
    return out


#: Bytes from any place of a residue to the next place of the cover, and to one for two residues at once.
_NEXT = np.array([min(k for k in range(MODULUS) if (r + k) % MODULUS in COVER) for r in range(MODULUS)])
_BOTH = np.array(
    [
        [min(k for k in range(MODULUS) if (r + k) % MODULUS in COVER and (s + k) % MODULUS in COVER) for s in range(MODULUS)]
        for r in range(MODULUS)
    ]
)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """The dense rank of each row of keys, the first key leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at the cover's places by ``depth`` bytes at least; -1 at other places."""
    n = len(words) - 32
    at = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
    rank = np.full(n + MODULUS * 64, -1, np.int64)
    rank[at] = _ranks(*(words[at + 8 * k] for k in range(4)))
    known, step = 32, 1
    while known < depth:
        rank[at] = _ranks(rank[at], rank[np.minimum(at + MODULUS * step, len(rank) - 1)])
        known += MODULUS * step
        step = known // MODULUS
    return rank


def _settle(order: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Windows of tied groups in full order. ``order`` and ``group`` lie side by side, groups ascending.

    Windows of one residue are sorted by the ranks at their next cover place. A window's place among
    those of another residue is found by the ranks at the place that both have in the cover.
    """
    residue = order % MODULUS
    own = rank[order + _NEXT[residue]]
    by = np.lexsort((own, residue, group))
    order, group, residue = order[by], group[by], residue[by]
    start = np.flatnonzero(np.append(True, np.diff(group) != 0))
    size = np.diff(np.append(start, len(group)))
    several = np.repeat(np.maximum.reduceat(residue, start) != np.minimum.reduceat(residue, start), size)
    if not several.any():
        return order
    at = np.flatnonzero(several)
    top = np.int64(rank.max() + 2)
    parts = {r: at[residue[at] == r] for r in np.unique(residue[at]).tolist()}
    # A window's place in its group: how many of each residue are below it. Windows that the depth of
    # the ranks does not tell apart may get equal places, which lie between those of all others.
    below = np.zeros(len(order), np.int64)
    for r, mine in parts.items():
        heads = np.searchsorted(group[mine], group[mine], side="left")
        below[mine] = np.arange(len(mine)) - heads
        for s, theirs in parts.items():
            if s != r:
                step = _BOTH[r][s]
                keys = group[theirs] * top + rank[order[theirs] + step]
                asked = group[mine] * top + rank[order[mine] + step]
                found = np.searchsorted(keys, asked, side="right" if s < r else "left")
                below[mine] += found - np.searchsorted(keys, group[mine] * top, side="left")
    order[at] = order[at][np.lexsort((below[at], group[at]))]
    return order


def window_order(data: np.ndarray, windows: np.ndarray, span: int):
    """The windows (their first places) in the order of 2 * span bytes, a bucket of leading bytes at a time.

    ``data`` goes on for 2 * span zeros at least after the last window.
    """
    words = leading_words(data)
    rank = cover_ranks(words, 2 * span)
    lead = words[windows]
    cuts = np.sort(lead)[::BUCKET_WINDOWS][1:]
    bucket = np.searchsorted(np.unique(cuts), lead, side="right")
    for number in np.unique(bucket).tolist():
        mine = windows[bucket == number]
        keys = [words[mine + 8 * k] for k in range(4)]
        by = np.lexsort(keys[::-1])
        new = np.zeros(len(mine), bool)
        for key in keys:
            new[1:] |= key[by[1:]] != key[by[:-1]]
        yield _settle(mine[by], np.cumsum(new), rank), words


def repeated_windows(data: np.ndarray, windows: np.ndarray, span: int) -> np.ndarray:
    """Those of ``windows`` whose ``span`` bytes stand at another one too, ascending."""
    found = []
    for order, words in window_order(data, windows, span):
        pair = np.arange(1, len(order))
        for at in [*range(0, span - 7, 8), span - 8]:
            a, b = order[pair - 1], order[pair]
            pair = pair[words[a + at] == words[b + at]]
        found.append(order[np.union1d(pair, pair - 1)])
    return np.sort(np.concatenate(found)) if found else windows[:0]


def _sorted_block(rows: list[tuple], span: int):
    """(row, first, last) stretches of repeated windows in the texts of a block's classes.

    Anchors are laid on multiples of the modulus, so that windows of equal content have equal residues.
    """
    starts, parts, at = [], [], 0
    for _, _, width, off, text in rows:
        pad = -(at + off) % MODULUS
        starts.append(at + pad)
        parts += [bytes(pad), text]
        at += pad + len(text)
    data = np.frombuffer(b"".join([*parts, bytes(4 * span + MODULUS * 70)]), np.uint8)
    widths = np.array([r[2] for r in rows])
    starts = np.array(starts)
    ends = np.cumsum(widths)
    row = np.repeat(np.arange(len(rows)), widths)
    windows = np.arange(ends[-1]) - np.repeat(ends - widths, widths) + starts[row]
    found = repeated_windows(data, windows, span)
    owner = np.searchsorted(starts, found, side="right") - 1
    new = np.append(True, (np.diff(found) != 1) | (np.diff(owner) != 0))[: len(found)]
    first = np.flatnonzero(new)
    last = np.append(first, len(found))[1:] - 1
    owner = owner[first]
    return owner, found[first] - starts[owner], found[last] - starts[owner]


STRETCH = "anchor bigint, class bigint, first int, last int"


def sorted_buckets(classes: DataFrame, span: int = SPAN) -> DataFrame:
    """(anchor, class, first, last): stretches of windows of (anchor, class, width, off, text) that are
    repeated in their bucket, by suffix order. Buckets come whole, as many as fill a block at once."""

    def tasks(batches):
        def done(rows):
            owner, first, last = _sorted_block(rows, span)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][0] for k in owner.tolist()], pa.int64()),
                    pa.array([rows[k][1] for k in owner.tolist()], pa.int64()),
                    pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                ],
                names=["anchor", "class", "first", "last"],
            )

        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                for row in zip(*(column.to_pylist() for column in part.columns)):
                    if size > BLOCK_BYTES and row[0] != held[-1][0]:
                        yield done(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[4])
        if held:
            yield done(held)

    rows = classes.select("anchor", "class", "width", "off", "text")
    # By a hash of the anchor: Spark leaves out a repartition by a column that a join below has dealt
    # the rows by, and then may read that join's shuffle where it lies, which splits buckets.
    return rows.repartition(F.xxhash64("anchor")).sortWithinPartitions("anchor", "class").mapInArrow(tasks, STRETCH)


def shorter(classes: DataFrame, step: int, span: int = SPAN) -> DataFrame:
    """(anchor, class, n, at, bucket, part, width, off, text): classes in stretches of ``step`` windows by
    distance to the anchor. ``at`` is a stretch's first window; its bucket is what all windows share."""
    schema = "anchor bigint, class bigint, n bigint, at int, bucket bigint, part bigint, width int, off int, text binary"

    def tasks(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for anchor, name, n, width, off, text in zip(*(c.to_pylist() for c in part.columns)):
                    w = 0
                    while w < width:
                        chunk = (off - w) // step
                        # Windows of this chunk start chunk * step bytes or more before the anchor.
                        stop = min(width, off - chunk * step + 1)
                        core = text[off - chunk * step : off - (chunk + 1) * step + 1 + span]
                        own = text[w : stop - 1 + span]
                        bucket = _digest(core + chunk.to_bytes(8, "little", signed=True))
                        out.append((anchor, name, n, w, bucket, _digest(own + bytes([off - w - chunk * step & 255])), stop - w, off - w, own))
                        w = stop
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[k] for r in out], kind)
                        for k, kind in enumerate(
                            (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                        )
                    ],
                    names=["anchor", "class", "n", "at", "bucket", "part", "width", "off", "text"],
                )

    return classes.select("anchor", "class", "n", "width", "off", "text").mapInArrow(tasks, schema)


def _sizes(classes: DataFrame, bucket: str) -> DataFrame:
    """(bucket, hot) of the buckets with several classes, one of them met once only at least."""
    sizes = classes.groupBy(bucket).agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least"))
    return sizes.where("many > 1 AND least = 1").select(bucket, (F.col("many") > HOT).alias("hot"))


def stretches(classes: DataFrame, span: int = SPAN) -> DataFrame:
    """(anchor, class, first, last): repeated stretches of windows of (anchor, class, n, width, off, text,
    hot), by sorting, or for hot buckets after dealing them again."""
    cold = sorted_buckets(classes.where("NOT hot"), span)
    hot = classes.where("hot")
    if hot.isEmpty():
        return cold
    parts = checkpointed(shorter(hot, STEP, span))
    named = F.col("bucket").alias("anchor"), F.col("part").alias("class")
    first = F.min(F.struct("width", "off", "text")).alias("f")
    known = checkpointed(parts.groupBy("bucket", "part").agg(F.sum("n").alias("n"), first))
    sizes = checkpointed(_sizes(known, "bucket"))
    whole = parts.join(known.where("n > 1").select("bucket", "part"), ["bucket", "part"]).select(
        "anchor", "class", F.col("at").alias("first"), (F.col("at") + F.col("width") - 1).alias("last")
    )
    again = known.join(sizes.where("NOT hot"), "bucket").select(*named, "f.*")
    ordered = sorted_buckets(again, span).select(
        F.col("anchor").alias("bucket"), F.col("class").alias("part"), "first", "last"
    )
    narrow = parts.select("anchor", "class", "at", "bucket", "part")
    ordered = narrow.join(ordered, ["bucket", "part"]).select(
        "anchor", "class", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")
    )
    rest = parts.join(sizes.where("hot").select("bucket"), "bucket").withColumn("base", F.col("at"))
    # The windows of what is still hot, one by one; their stretch is carried in place of the class.
    single = shorter(
        rest.select(F.col("bucket").alias("anchor"), F.col("part").alias("class"), "n", "width", "off", "text").distinct(), 1, span
    ).select("anchor", "class", "at", F.col("part").alias("window"))
    members = rest.select("anchor", "class", "n", "at", F.col("bucket").alias("b"), "part")
    each = checkpointed(
        members.join(
            single.select(F.col("anchor").alias("b"), F.col("class").alias("part"), F.col("at").alias("plus"), "window"),
            ["b", "part"],
        ).select("anchor", "class", "n", "b", "window", (F.col("at") + F.col("plus")).alias("first"))
    )
    twice = each.groupBy("b", "window").agg(F.sum("n").alias("n")).where("n > 1").select("b", "window")
    alone = each.join(twice, ["b", "window"]).select("anchor", "class", "first", F.col("first").alias("last"))
    return stacked(cold, whole, ordered, alone)


def _fits(rows: DataFrame, held: str) -> DataFrame:
    """Stored rows, broadcast if what their arrays hold was counted and is little."""
    size = rows.agg(F.sum(F.size(held))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_HELD else rows


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, digest, spans): stretches (first byte, end) that repeated windows cover, of each text with
    one; they may overlap."""
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    items(docs, span, gram).write.parquet(f"{folder}/items")
    every = spark.read.parquet(f"{folder}/items")
    shared = (
        every.groupBy("anchor")
        .agg(F.sum(F.size("places")).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
        .where("n > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("several"))
    )
    every.join(shared, "anchor").write.parquet(f"{folder}/shared")
    met = spark.read.parquet(f"{folder}/shared")
    several = met.where("several")
    one = F.min(F.struct("id", "digest", F.element_at("places", 1).alias("place"), "width", "off")).alias("f")
    classes = checkpointed(several.groupBy("anchor", "class").agg(F.sum(F.size("places")).alias("n"), one))
    mixed_buckets = classes.join(_sizes(classes, "anchor"), "anchor")
    asked = F.struct("anchor", "class", "n", "hot", "f.place", "f.width", "f.off")
    by_text = checkpointed(
        mixed_buckets.groupBy("f.id", "f.digest").agg(F.collect_list(asked).alias("asked"))
    )
    fetched = checkpointed(
        docs.join(_fits(by_text, "asked"), docs.id.eqNullSafe(by_text.id) & (docs.digest == by_text.digest))
        .select(F.explode("asked").alias("c"), "text")
        .select(
            "c.anchor", "c.class", "c.n", "c.hot", "c.width", "c.off",
            F.expr(f"substring(text, CAST(c.place AS INT) + 1, c.width + {span - 1})").alias("text"),
        )
        .dropDuplicates(["anchor", "class"])
    )
    partly = stretches(fetched, span)
    whole = classes.where("n > 1").select("anchor", "class", F.lit(0).alias("first"), (F.col("f.width") - 1).alias("last"))
    again = several.join(stacked(whole, partly), ["anchor", "class"])
    alike = met.where("NOT several").select(*several.columns, F.lit(0).alias("first"), (F.col("width") - 1).alias("last"))
    covered = F.transform(
        "places", lambda p: F.struct((p + F.col("first")).alias("start"), (p + F.col("last") + span).alias("end"))
    )
    columns = [*several.columns, "first", "last"]
    return (
        stacked(alike.select(*columns), again.select(*columns))
        .select("id", "digest", F.explode(covered).alias("s"))
        .groupBy("id", "digest")
        .agg(F.collect_list("s").alias("spans"))
    )


def without_repeats(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", span: int = SPAN, gram: int = GRAM
) -> DataFrame:
    """``df`` without its text, with ``n_bytes``, ``kept`` (the remaining bytes) and ``removed``, the
    array of (start, end) byte stretches that are gone. Outputs named like columns get underscores."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b""))
    key = F.xxhash64(text)
    docs = df.select(F.col(f"`{id_column}`").alias("id"), key.alias("digest"), text.alias("text"))
    spans = checkpointed(repeated_spans(docs, span, gram))
    others = [c for c in df.columns if c != text_column]
    whole = df.select(
        F.col(f"`{id_column}`").alias("id"), key.alias("digest"), text.alias("text"),
        F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("row"),
    )
    on = whole.id.eqNullSafe(spans.id) & (whole.digest == spans.digest)
    joined = whole.join(_fits(spans, "spans"), on, "left").select("row", "text", "spans")
    stretch = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def tasks(batches):
        for batch in batches:
            for part in slices(batch):
                sizes, left, gone = [], [], []
                for data, held in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    merged: list[dict] = []
                    for s in sorted(held or [], key=lambda s: s["start"]):
                        if merged and s["start"] <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                        else:
                            merged.append(dict(s))
                    edges = [0, *(e for s in merged for e in (s["start"], s["end"])), len(data)]
                    left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    sizes.append(len(data))
                    gone.append(merged)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(sizes, pa.int64()), pa.array(left, pa.binary()),
                        pa.array(gone, pa.list_(stretch)),
                    ],
                    names=["row", "n_bytes", "kept", "removed"],
                )

    row_type = joined.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, n_bytes bigint, kept binary, removed array<struct<start:bigint,end:bigint>>"
    names = [unused(df, c) for c in ("n_bytes", "kept", "removed")]
    return joined.mapInArrow(tasks, schema).select(
        *(F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)),
        *(F.col(c).alias(n) for c, n in zip(("n_bytes", "kept", "removed"), names)),
    )


@query("op13_repeated_bytes")
def op13_repeated_bytes(spark: SparkSession, base: str) -> DataFrame:
    """Bytes of each document that strings of 400 bytes repeat anywhere, and a digest of the others."""
    docs = read(spark, base, "documents").select("doc_id", "text")
    return without_repeats(docs).select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
