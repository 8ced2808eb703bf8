"""Quality classifier (operator 13): texts compressed with a dictionary of good and with one of bad texts.

1. A bounded sample of labelled texts is cut into pieces, and zstandard trains one dictionary on pieces
   of good texts and one on pieces of bad ones.
2. Every whole text is compressed piece by piece with either dictionary and with none. What the bad
   dictionary saves less, or more, than the good one, normalised by the two sizes together and by the
   plain size, tells which texts it resembles; the plain size by the text's length tells repetition.
3. A logistic regression on these, fitted on sampled texts that the dictionaries haven't seen, makes
   the differences a calibrated score.

Labels are learned from a sample of at most ``SAMPLE`` labelled rows, taken by a hash of the id; of their
texts at most ``PIECES`` pieces of each label go into a dictionary. Scores come from the bytes of the
text alone, and from all of them. The model is two dictionaries and a few weights.

Defined results: null counts as empty; an empty text has the score of no difference; a null id is not
held out; repeated rows get the same score; with repeated labels of an id the largest counts; without
labels, or with labels of one kind only, all scores are their share (0 if there are none); other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.scratch import workers
from gatewise.llm.text import column
from gatewise.sources.store import broadcast

#: Labelled rows learned from, and pieces of the texts of a label in its dictionary, at most.
SAMPLE, PIECES = 40_000, 8192

#: Bytes of a piece, of a dictionary at most, and bytes of samples for each byte of a dictionary at least.
PIECE, DICTIONARY, EXAMPLES = 512, 1 << 16, 8

#: Pieces of a text in the sample of a dictionary at most, spread over the text.
PER_TEXT = 16

#: Compression level, and bytes a frame has whatever it holds.
LEVEL, FRAME = 3, 4

#: A text with this score or more counts as good.
THRESHOLD = 0.7


def pieces(text: str | None) -> list[bytes]:
    """The UTF-8 bytes of a text in runs of ``PIECE``."""
    data = (text or "").encode("utf-8", "replace")
    return [data[a : a + PIECE] for a in range(0, len(data), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """What a compressor is to know beforehand; of few samples, the samples themselves."""
    total = sum(map(len, samples))
    if total >= EXAMPLES * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:  # samples too much alike to train on
            pass
    return b"".join(samples)[-DICTIONARY:]


def _compressor(known: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(known) < 8:
        return zstandard.ZstdCompressor(**options)
    given = zstandard.ZstdCompressionDict(known)
    given.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=given, **options)


@dataclass
class Model:
    """Dictionaries of good and bad texts; means, spreads and weights of the regression's inputs."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(3))
    spread: np.ndarray = field(default_factory=lambda: np.ones(3))
    _tools: list | None = field(default=None, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tools": None}

    def sizes(self, text: str | None) -> tuple[int, int, int, int]:
        """Bytes of a text, and compressed with the good dictionary, the bad one and none."""
        if self._tools is None:
            self._tools = [_compressor(known).compress for known in (self.good, self.bad, b"")]
        cut = pieces(text)
        return sum(map(len, cut)), *(sum(len(tool(piece)) - FRAME for piece in cut) for tool in self._tools)

    def signals(self, texts: pa.Array) -> np.ndarray:
        """Regression inputs of each text."""
        out = np.zeros((len(texts), 3))
        for k, text in enumerate(texts):
            size, good, bad, plain = self.sizes(text.as_py())
            out[k] = (bad - good) / max(1, bad + good), (bad - good) / (plain + 8), np.log((plain + 8) / (size + 16))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _logistic(self.weights[0] + ((self.signals(texts) - self.mean) / self.spread) @ self.weights[1:])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regress(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Logistic regression: Newton steps, halved until they help; all weights but the first are penalised."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.array([1e-6] + [penalty] * (x.shape[1] - 1))

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (ridge * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        size, now = 1.0, cost(w)
        while size > 1e-6 and cost(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def held_out(id_) -> F.Column:
    """Ids whose CRC-32 as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model:
    """Learns from the labelled texts that are not held out.

    A third of the sampled texts, told by a hash of the text, so that copies stay together, is kept from
    the dictionaries and fits the regression.
    """
    spark = docs.sparkSession
    workers(spark)
    ids = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    ids = ids.groupBy(ids[id_col].alias("key")).agg(F.max(ids[label_col]).cast("int").alias("good"))
    ids = ids.orderBy(F.xxhash64("key"), "key").limit(sample)
    # At most ``sample`` rows of an id and a label.
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("key"))
    rows = rows.select("text", "good", (F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(3)) == 0).alias("apart"))
    counted = {(r.apart, r.good): r.n for r in rows.groupBy("apart", "good").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sum(n for (_, good), n in counted.items() if good) / max(1, sum(counted.values()))
    if len({bool(good) for (apart, good) in counted if apart}) < 2:
        return Model(b"", b"", np.array([-30.0 if share == 0 else 30.0 if share == 1 else np.log(share / (1 - share)), 0, 0, 0]))

    # Pieces of a text, by label, such that no more than PIECES, or one of each sampled text, are collected.
    most = {bool(good): min(PER_TEXT, max(1, PIECES // n)) for (apart, good), n in counted.items() if not apart}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, good in zip(column(batch, "text"), column(batch, "good").to_pylist()):
                some = pieces(text.as_py())
                first = zlib.crc32(b"".join(some)) % max(1, len(some))
                some = [some[(first + k * len(some) // most[good > 0]) % len(some)] for k in range(min(most[good > 0], len(some)))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([good] * len(some), pa.int32())], ["piece", "good"])

    some = rows.where(~F.col("apart")).select("text", "good").mapInArrow(cut, "piece binary, good int").collect()
    known = []
    for label in (True, False):
        of_label = sorted((zlib.crc32(r.piece), bytes(r.piece)) for r in some if (r.good > 0) == label)  # whatever the order of tasks
        known.append(dictionary([piece for _, piece in of_label[:PIECES]]))
    model = Model(*known, np.zeros(4))
    unfit = broadcast(spark, model)

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unfit.value.signals(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), column(batch, "good")], ["a", "b", "c", "good"])

    fitted = rows.where("apart").select("text", "good").mapInArrow(signals, "a double, b double, c double, good int").collect()
    x, y = np.array([r[:3] for r in fitted], float), np.array([r.good > 0 for r in fitted], float)
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of tasks
    x, y = x[order], y[order]
    model = Model(*known, np.zeros(4), x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9))
    model.weights = regress((x - model.mean) / model.spread, y)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, held_out, score, predicted`` of each row; rows are not moved."""
    workers(docs.sparkSession)
    sent = broadcast(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(sent.value.scores(column(batch, "text")))], ["id", "score"])

    scored = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
