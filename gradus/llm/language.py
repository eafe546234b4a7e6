"""Language identification by a byte convolutional network.

A lower-cased text is cut into windows of ``WINDOW`` bytes, the last one padded. Bytes are embedded,
filters of two, three and four bytes slide over a window, each keeps its maximum, and a softmax
gives the probabilities of the languages. Those of a text are the mean over all of its windows,
weighted by their bytes.

The network is trained with numpy on the driver: about ``max_rows`` labelled rows, never more than
twice as many, evenly over the languages by a hash of the id, ``WINDOWS_PER_ROW`` pieces of each. It is
a few thousand numbers, which travel with the tasks. Prediction reads nothing but the text.

Texts that are null or have no letter are ``und`` with score 0; so is every text if no row has a
label. Null ids are not learned from. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.llm.words import slices
from gradus.session import checkpointed

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled rows that the network is fitted on, and pieces of each.
MAX_ROWS = 1_200
WINDOWS_PER_ROW = 6
ROUNDS = 8
UNKNOWN = "und"
#: Languages whose shares may be broadcast; with more, texts are dealt by language.
MAX_LANGUAGES = 10_000
PAD = 256
#: Windows of one matrix product.
BLOCK = 512


def windows_of(text: str) -> np.ndarray:
    """The bytes of a text as rows of WINDOW, padded."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    rows = -(-len(data) // WINDOW)
    out = np.full(rows * WINDOW, PAD, np.int16)
    out[: len(data)] = data
    return out.reshape(rows, WINDOW)


class Network:
    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        reach = max(WIDTHS)
        self.mask = np.zeros((reach * EMBEDDING, FILTERS * len(WIDTHS)), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1

        def normal(shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.parameters = {
            "embedding": normal((PAD + 1, EMBEDDING), 0.5),
            "filters": normal(self.mask.shape, 0.25) * self.mask,
            "offset": np.zeros(self.mask.shape[1], np.float32),
            "out": normal((self.mask.shape[1], classes), 0.1),
            "bias": np.zeros(classes, np.float32),
        }
        self.parameters["embedding"][PAD] = 0

    def _spread(self, rows: np.ndarray) -> np.ndarray:
        """Embeddings of each byte and the ones after it: (windows * WINDOW, reach * EMBEDDING)."""
        reach = max(WIDTHS)
        padded = np.pad(rows, ((0, 0), (0, reach - 1)), constant_values=PAD)
        embedded = self.parameters["embedding"][padded]
        view = np.lib.stride_tricks.sliding_window_view(embedded, reach, axis=1)
        return view.transpose(0, 1, 3, 2).reshape(-1, reach * EMBEDDING)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        p = self.parameters
        out = []
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            answers = (self._spread(block) @ p["filters"]).reshape(len(block), WINDOW, -1)
            pooled = np.maximum(answers.max(1) + p["offset"], 0)
            logits = pooled @ p["out"] + p["bias"]
            grown = np.exp(logits - logits.max(1, keepdims=True))
            out.append(grown / grown.sum(1, keepdims=True))
        return np.concatenate(out)

    def _gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, count = self.parameters, len(rows)
        spread = self._spread(rows)
        answers = (spread @ p["filters"]).reshape(count, WINDOW, -1)
        best = answers.argmax(1)
        pooled = np.take_along_axis(answers, best[:, None, :], 1)[:, 0] + p["offset"]
        active = np.maximum(pooled, 0)
        logits = active @ p["out"] + p["bias"]
        grown = np.exp(logits - logits.max(1, keepdims=True))
        error = grown / grown.sum(1, keepdims=True)
        error[np.arange(count), labels] -= 1
        error /= count
        back = (error @ p["out"].T) * (pooled > 0)
        # Only the position that gave a filter's maximum passes its error on.
        places = np.arange(count)[:, None] * WINDOW + best
        chosen = spread[places]
        filters = np.einsum("nfd,nf->df", chosen, back) * self.mask
        inputs = back[:, :, None] * p["filters"].T[None]
        embedding = np.zeros_like(p["embedding"])
        padded = np.pad(rows, ((0, 0), (0, max(WIDTHS) - 1)), constant_values=PAD)
        for k in range(max(WIDTHS)):
            bytes_there = padded[np.arange(count)[:, None], best + k]
            np.add.at(embedding, bytes_there, inputs[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
        embedding[PAD] = 0
        return {
            "embedding": embedding,
            "filters": filters,
            "offset": back.sum(0),
            "out": active.T @ error,
            "bias": error.sum(0),
        }

    def fit(self, rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, rate=0.01, batch=64):
        first = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        second = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        step = 0
        for _ in range(rounds):
            order = self.rng.permutation(len(rows))
            for start in range(0, len(rows), batch):
                own = order[start : start + batch]
                step += 1
                for name, g in self._gradients(rows[own], labels[own]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    size = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                    self.parameters[name] -= (rate * first[name] / (1 - 0.9**step) / size).astype(
                        np.float32
                    )
        return self


def sample(
    df: DataFrame, allowed: Column, id_column: str, text_column: str, lang_column: str, max_rows: int
) -> DataFrame:
    """(lang, pieces): about ``max_rows`` rows, as many of each language, and pieces of their texts.

    Each language's rows are counted; then a row is taken if the hash of its id is in the share of its
    language. No text leaves its partition but the pieces of the rows taken, twice ``max_rows`` at most.
    """
    text, lang = F.col(f"`{text_column}`"), F.col(f"`{lang_column}`")
    usable = df.where(allowed & lang.isNotNull() & text.isNotNull())
    counts = usable.groupBy(lang.alias("lang")).count()
    each = F.lit(max_rows) / F.count(F.lit(1)).over(Window.partitionBy())
    shares = checkpointed(
        counts.select(F.struct("lang", (each / F.col("count")).alias("share")).alias("own"))
    )
    if shares.limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES:
        shares = F.broadcast(shares)
    draw = F.xxhash64(F.col(f"`{id_column}`"))
    narrow = usable.select(lang.alias("lang"), text.alias("text"), draw.alias("draw"))
    place = F.pmod("draw", F.lit(1 << 30)) / (1 << 30)
    fair = narrow.join(shares, (F.col("lang") == F.col("own.lang")) & (place < F.col("own.share")))
    reach = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    pieces = F.array(
        *[
            F.substring("text", F.pmod(F.xxhash64("draw", F.lit(k)), reach).cast("int") + 1, F.lit(WINDOW))
            for k in range(WINDOWS_PER_ROW)
        ]
    )
    return fair.select("lang", pieces.alias("pieces"), "draw").orderBy("draw").limit(2 * max_rows)


def train(labelled: list, seed: int = 7) -> tuple[list[str], Network | None]:
    languages = sorted({row.lang for row in labelled})
    windows, labels = [], []
    for row in labelled:
        for piece in row.pieces:
            found = windows_of(piece)[:1]
            windows.append(found)
            labels += [languages.index(row.lang)] * len(found)
    if not labels:
        return languages, None
    network = Network(len(languages), seed).fit(np.concatenate(windows), np.array(labels))
    return languages, network


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits above or below the line and numerals are none."""
    return any(map(str.isalpha, text))


def identify(
    df: DataFrame,
    allowed: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """(id, lang_pred, score) of each row; learned from the labelled rows where ``allowed``."""
    rows = sample(df, allowed, id_column, text_column, lang_column, max_rows).collect()
    languages, network = train(sorted(rows, key=lambda r: (r.lang, r.pieces)))

    def tasks(batches):
        for batch in batches:
            for part in slices(batch, 64):
                texts = part.column(1).to_pylist()
                named, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                own = [k for k, t in enumerate(texts) if network and t and has_letter(t)]
                if own:
                    windows = [windows_of(texts[k]) for k in own]
                    sizes = [len(w) for w in windows]
                    rows = np.concatenate(windows)
                    weights = (rows != PAD).sum(1, keepdims=True).astype(np.float32)
                    starts = np.cumsum([0, *sizes[:-1]])
                    shares = np.add.reduceat(network.probabilities(rows) * weights, starts)
                    shares /= shares.sum(1, keepdims=True)
                    for k, share in zip(own, shares):
                        named[k] = languages[int(share.argmax())]
                        scores[k] = float(share.max())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(named), pa.array(scores, pa.float64())],
                    names=["key", "lang_pred", "score"],
                )

    narrow = df.select(F.col(f"`{id_column}`").alias("key"), F.col(f"`{text_column}`").alias("text"))
    id_type = narrow.schema["key"].dataType.simpleString()
    found = narrow.mapInArrow(tasks, f"key {id_type}, lang_pred string, score double")
    return found.select(F.col("key").alias(id_column), "lang_pred", "score")


def fold(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 4


@query("op4_language_id")
def op4_language_id(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents")
    found = identify(docs, F.coalesce(fold() != 2, F.lit(False)))
    held_out = F.coalesce(fold() == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
