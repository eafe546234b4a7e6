"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside the tasks.

The tasks cut texts into the pieces of public_tokenizers.PATTERN. Pieces that the worker has not
met go, some thousands at a time, into a recursive query: its rows are the tokens of a piece by
position, each with the merge that it and the next token would make. A step finds each piece's
leftmost pair of lowest rank, contracts it and joins the merge table again for the two pairs that
changed, until no piece has a pair left. An ordered aggregation then gives the piece's ids and,
joined with the vocabulary, its bytes; a text is its pieces one after another.

Long pieces would need a step for every contraction. In these, every occurrence of the lowest pair
that does not overlap an earlier one is contracted at once if no vocabulary entry of lower rank
begins or ends with the new token, for then no contraction in between could come first; otherwise
only the leftmost one. The result is the same.

Nulls are empty texts: no tokens, digests of no bytes. A row gives one row, repeated rows too; only
the id and the text column are read, so other columns can have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.llm.words import piece_finder, slices, worker_memory

#: Pieces that a worker remembers; beyond it starts anew.
MEMORY = 600_000
#: Bytes of the pieces of one recursive query.
QUERY_BYTES = 400_000
#: A piece with more bytes counts as long.
LONG = 64

SHORT_SQL = """
WITH RECURSIVE steps AS (
  SELECT piece, pos, token, merge
  FROM (SELECT *, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS next FROM symbols)
  LEFT JOIN merges ON pair = (token::BIGINT << 20) | next
  UNION ALL (
    WITH seen AS (
      SELECT piece, pos, token, merge,
        min((merge::BIGINT << 24) | pos) OVER (PARTITION BY piece) AS best,
        lag(pos) OVER line AS before, lead(pos) OVER line AS after,
        lead(token, 2) OVER line AS beyond
      FROM steps WHERE merge IS NULL OR merge >= 0
      WINDOW line AS (PARTITION BY piece ORDER BY pos)
    ), kept AS (
      SELECT *, (best >> 24)::INT AS made, (best & 16777215)::INT AS spot FROM seen
      WHERE best IS NULL OR before IS DISTINCT FROM (best & 16777215)::INT
    )
    SELECT piece, pos, CASE WHEN pos = spot THEN made ELSE token END,
      CASE WHEN best IS NULL THEN -1
           WHEN pos = spot OR after = spot THEN merges.merge ELSE kept.merge END
    FROM kept LEFT JOIN merges ON pair = CASE
      WHEN pos = spot THEN (made::BIGINT << 20) | beyond
      WHEN after = spot THEN (token::BIGINT << 20) | made END
  )
), tokens AS (SELECT piece, pos, token FROM steps WHERE merge = -1)
"""

LONG_SQL = """
WITH RECURSIVE steps(piece, pos, token) USING KEY (piece, pos) AS (
  SELECT piece, pos, token FROM symbols
  UNION (
    WITH pairs AS (
      SELECT piece, pos, token, merge, row_number() OVER line AS nth FROM (
        SELECT *, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS next
        FROM recurring.steps WHERE token >= 0)
      LEFT JOIN merges ON pair = (token::BIGINT << 20) | next
      WINDOW line AS (PARTITION BY piece ORDER BY pos)
    ), best AS (
      SELECT piece, min(merge) AS made FROM pairs GROUP BY piece HAVING min(merge) IS NOT NULL
    ), runs AS (
      SELECT pairs.*, made, merge IS NOT DISTINCT FROM made AS hit,
        nth - coalesce(max(CASE WHEN merge IS DISTINCT FROM made THEN nth END) OVER (
          PARTITION BY piece ORDER BY pos), 0) AS in_run,
        min(CASE WHEN merge = made THEN nth END) OVER (PARTITION BY piece) AS first
      FROM pairs JOIN best USING (piece)
    ), chosen AS (
      SELECT runs.*, hit AND in_run % 2 = 1 AND (first = nth OR closed.token IS NOT NULL) AS joins
      FROM runs LEFT JOIN closed ON closed.token = made
    ), moved AS (
      SELECT piece, pos, made, joins,
        coalesce(lag(joins) OVER (PARTITION BY piece ORDER BY pos), false) AS gone
      FROM chosen
    )
    SELECT piece, pos, CASE WHEN gone THEN -1 ELSE made END FROM moved WHERE joins OR gone
  )
), tokens AS (SELECT piece, pos, token FROM steps WHERE token >= 0)
"""

READ_SQL = """
SELECT piece, list(token ORDER BY pos) AS ids, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM tokens JOIN vocabulary USING (token) GROUP BY piece ORDER BY piece
"""

DECODE_SQL = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM tokens JOIN vocabulary USING (token) GROUP BY doc ORDER BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def rank_tables(ranks: dict[bytes, int]) -> dict[str, pa.Table]:
    """merges: each two tokens that make up a third; closed: tokens that no lower one contains at
    an end next to another token; vocabulary: each token's bytes."""
    pairs, made, open_tokens = [], [], set()
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append(left << 20 | right)
                made.append(rank)
                open_tokens.update(part for part in (left, right) if part > rank)
    closed = [rank for rank in ranks.values() if rank not in open_tokens]
    return {
        "merges": pa.table({"pair": pa.array(pairs, pa.int64()), "merge": pa.array(made, pa.int32())}),
        "closed": pa.table({"token": pa.array(closed, pa.int32())}),
        "vocabulary": pa.table(
            {
                "token": pa.array(list(ranks.values()), pa.int32()),
                "hex": [token.hex() for token in ranks],
            }
        ),
    }


def connection(tables: dict[str, pa.Table]):
    """DuckDB in memory, one thread, nothing on the worker's disk, with the vocabulary's tables."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    for name, table in tables.items():
        con.register("given", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        con.unregister("given")
    return con


def _rows(pieces: list[bytes], first_token: np.ndarray) -> pa.Table:
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(sizes) - sizes
    tokens = first_token[np.frombuffer(b"".join(pieces), np.uint8)]
    return pa.table(
        {
            "piece": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes),
            "pos": (np.arange(len(tokens)) - np.repeat(starts, sizes)).astype(np.int32),
            "token": tokens,
        }
    )


class PieceCoder:
    """Ids and decoded bytes of pieces, by the recursive queries; remembers ``memory`` pieces."""

    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY):
        self.con = connection(rank_tables(ranks))
        self.first_token = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.memory = memory
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        new = [piece for piece in set(pieces) if piece not in self.ids]
        parts: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for piece in new:
            coded = piece.encode()
            kind = len(coded) > LONG
            parts[kind].append((piece, coded))
            size[kind] += len(coded)
            if size[kind] >= QUERY_BYTES:
                self._solve(parts[kind], LONG_SQL if kind else SHORT_SQL)
                parts[kind], size[kind] = [], 0
        for kind, rest in parts.items():
            if rest:
                self._solve(rest, LONG_SQL if kind else SHORT_SQL)

    def _solve(self, pieces: list[tuple[str, bytes]], steps: str) -> None:
        self.con.register("symbols", _rows([coded for _, coded in pieces], self.first_token))
        found = self.con.sql(steps + READ_SQL).to_arrow_table().combine_chunks()
        self.con.unregister("symbols")
        ids = found.column("ids").combine_chunks()
        data = ids.values.to_numpy().astype("<u4").tobytes()
        ends = ids.offsets.to_numpy().tolist()
        texts = found.column("bytes").to_pylist()
        for at, (piece, _) in enumerate(pieces):
            own = data[4 * ends[at] : 4 * ends[at + 1]]
            self.ids[piece] = own
            self.decoded[own] = texts[at]

    def texts(self, texts: list[list[str]]) -> Iterable[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded bytes) of texts given as pieces."""
        if len(self.ids) >= self.memory:
            self.ids, self.decoded = {}, {}
        self.learn(piece for pieces in texts for piece in pieces)
        for pieces in texts:
            own = list(map(self.ids.__getitem__, pieces))
            yield b"".join(own), b"".join(map(self.decoded.__getitem__, own))


def _coder(name: str, shared) -> PieceCoder:
    return worker_memory(f"bpe {name}", lambda: PieceCoder(shared.value))


def _share(spark: SparkSession, path: str):
    """The driver reads the file and broadcasts the ranks: as large as the vocabulary, whatever
    the table."""
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    return digest, spark.sparkContext.broadcast(load_ranks(path))


def _mapped(
    df: DataFrame, path: str, columns: list[str], text_column: str, made: list[tuple], row: Callable
) -> DataFrame:
    """``columns`` of each row and what ``row`` makes of its (ids, decoded bytes)."""
    digest, shared = _share(df.sparkSession, path)
    plain = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("kept"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )

    def tasks(batches):
        coder, pieces = _coder(digest, shared), worker_memory("pieces", piece_finder)
        for batch in batches:
            for part in slices(batch):
                texts = [pieces(t) for t in part.column(1).to_pylist()]
                values = zip(*[row(ids, raw) for ids, raw in coder.texts(texts)])
                arrays = [pa.array(v, t) for v, (_, t, _) in zip(values, made)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *arrays], names=["kept", *[n for n, _, _ in made]]
                )

    kept = plain.schema["kept"].dataType.simpleString()
    schema = ", ".join([f"kept {kept}", *[f"{n} {t}" for n, _, t in made]])
    return plain.mapInArrow(tasks, schema)


def encode(
    df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, ids array<int>): the tokens of each text by the rank file at ``path``."""
    made = [("ids", pa.list_(pa.int32()), "array<int>")]
    coded = _mapped(
        df, path, [id_column], text_column, made, lambda ids, _: (np.frombuffer(ids, "<i4"),)
    )
    return coded.select(f"kept.`{id_column}`", "ids")


def decode(
    df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """(id, bytes binary): rows of ids joined with the vocabulary, aggregated in their order.

    Null ids give no bytes; an id that the vocabulary lacks is an error.
    """
    digest, shared = _share(df.sparkSession, path)
    id_type = df.schema[id_column].dataType.simpleString()

    def tasks(batches):
        coder = _coder(digest, shared)
        known = len(shared.value)
        for batch in batches:
            for part in slices(batch):
                lists = [ids or [] for ids in part.column(1).to_pylist()]
                tokens = np.fromiter((i for ids in lists for i in ids), np.int32)
                if len(tokens) and not 0 <= tokens.min() <= tokens.max() < known:
                    raise ValueError("an id is not in the vocabulary")
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                rows = {
                    "doc": np.repeat(np.arange(len(lists), dtype=np.int32), sizes),
                    "pos": np.arange(len(tokens)),
                    "token": tokens,
                }
                coder.con.register("tokens", pa.table(rows))
                found = coder.con.execute(DECODE_SQL).fetchall()
                coder.con.unregister("tokens")
                texts = [b""] * len(lists)
                for doc, text in found:
                    texts[doc] = text
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.binary())], names=[id_column, "bytes"]
                )

    return df.select(id_column, ids_column).mapInArrow(tasks, f"`{id_column}` {id_type}, bytes binary")


def digests(
    df: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",), text_column: str = "text"
) -> DataFrame:
    """``columns``, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    made = [
        ("n_tokens", pa.int64(), "bigint"),
        ("ids_sha256", pa.string(), "string"),
        ("decoded_sha256", pa.string(), "string"),
    ]

    def row(ids: bytes, raw: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()

    coded = _mapped(df, path, list(columns), text_column, made, row)
    return coded.select(*[f"kept.`{c}`" for c in columns], *[n for n, _, _ in made])


@query("op8_bpe")
def op8_bpe(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(read(spark, base, "documents"), path)
