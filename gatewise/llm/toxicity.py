"""Toxicity (operator 4): a noisy-channel decoder restores disguised words, then a lexicon model scores them.

1. A character trigram model is counted over all texts.
2. Words that look disguised (digits or signs for letters, letters spaced out or joined by signs,
   letters repeated three times or more) become character lattices; Viterbi decoding under the
   trigram model and a channel model picks the letters meant, and where in a spaced-out run one
   word ends and the next begins. All other words are as they are.
3. Words and word beginnings that labelled toxic texts hold much more often than others, restored
   words included, make a lexicon; a logistic regression on a text's lexicon words gives its score.

Labels are learned from a sample of at most ``SAMPLE`` labelled rows, taken by a hash of the id.
Texts are scored by their characters alone. The model's size is bounded by the alphabet and by the
sample, so it can be sent to the executors.

Defined results: null counts as empty; a text without lexicon words gets the score of such texts;
a null id is not held out; repeated rows get the same score; with repeated labels of an id the
largest counts; without labels, or with labels of one kind only, all scores are their share (0 if
there are none); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.scratch import workers
from gatewise.llm.text import Block, Hashes, blocks, column, lower, mix, rows_of, words
from gatewise.sources.store import broadcast

#: Labelled rows learned from at most. It bounds the lexicon, too: its words are in several of these texts.
SAMPLE = 40_000

#: Documents that must hold a word for it to enter the lexicon, and how many times likelier it must be.
SUPPORT, ODDS = 4, 4.0

#: Characters of a word's beginning that is a feature of its own; the word must be longer.
STEM = 5

#: A text with this score or more counts as toxic.
THRESHOLD = 0.7

#: Signs that stand for letters (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}

#: Signs put between the letters of a word (fixed values).
JOINTS = ".-_*"

#: Symbols of the trigram model: 0 no letter, 1 any other letter, then these.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäãçéèêëíìîïñóòôöõúùûüß"
SYMBOLS = 64

_STEM_SALT = np.uint64(0x5851F42D4C957F2D)
_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 sign for a letter, 3 joint
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[[ord(c) for c in LEET]] = 2
_CLASS[[ord(c) for c in JOINTS]] = 3

_symbol_of = np.zeros(0x250, np.uint8)
for _code in range(0x250):
    if chr(_code).isalpha():
        _letter = chr(_code).lower()
        _symbol_of[_code] = 2 + ALPHABET.index(_letter) if len(_letter) == 1 and _letter in ALPHABET else 1


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 0x250, _symbol_of[np.minimum(codes, 0x24F)], 1).astype(np.int64)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts; a table of ``SYMBOLS ** 3`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                s = np.concatenate([[0, 0], symbols(text or ""), [0]])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(total, (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counted = docs.select(docs[text_col].alias("text")).mapInArrow(run, "at long, n long")
    rows = counted.groupBy("at").agg(F.sum("n").alias("n")).collect()  # bounded by the alphabet
    total = np.zeros(SYMBOLS**3, np.int64)
    for row in rows:
        total[row.at] = row.n
    return total


class Channel:
    """Restores disguised words: what was meant maximises channel times trigram probability."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pairs = table.sum(0)
        single = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * SYMBOLS)
        second = (pairs + 5 * single) / (pairs.sum(1, keepdims=True) + 5)
        third = (table + 5 * second) / (table.sum(2, keepdims=True) + 5)
        self.log = np.log(third).tolist()
        self.known: dict[str, str] = {}

    def restore(self, word: str) -> str:
        """The likeliest letters of a word, or words of a spaced-out run; signs at its ends that stand for nothing go."""
        if len(word) > 64:
            return self._decode(word.lower())  # not kept: long words seldom come again
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self._decode(word.lower())
        return self.known[word]

    def words(self, word: str) -> list[str]:
        """What :meth:`restore` finds, and every two neighbours as one, as trigrams may see a short word inside a longer one."""
        found = self.restore(word).split()
        return found + [a + b for a, b in pairwise(found)]

    def _decode(self, word: str) -> str:
        log = self.log
        # The lattice: at each character the letters it may stand for, "" for none, with their channel cost.
        # A path is its last letter and the path before, so that a step costs the same however long the word.
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for c in word:
            if c in LEET:
                options = [(x, -0.2) for x in LEET[c]] + [("", -5.0)]
            elif c.isalpha():
                options = [(c, 0.0)] + ([("", -0.3)] if c == before else [])
            elif c.isspace():
                options = [("", -0.1), (" ", -0.1)]
            else:
                options = [("", -0.1 if c in JOINTS else -1.0)]
            now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for x, channel in options:
                    if x:
                        s = 0 if x == " " else 2 + ALPHABET.index(x) if x in ALPHABET else 1
                        key, value = (b, s), (cost + channel + log[a][b][s], (x, path))
                    else:
                        key, value = (a, b), (cost + channel, path)
                    if key not in now or value[0] > now[key][0]:
                        now[key] = value
            best = now
            before = c
        path = max(best.items(), key=lambda kv: (kv[1][0] + log[kv[0][0]][kv[0][1]][0], kv[0]))[1][1]
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))


def disguised(block: Block, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int]]:
    """Words ``(first, last)`` of a block, given by number, that may be in disguise."""
    if not len(starts):
        return []
    kind = _CLASS[block.data]
    letter, sign, joint = kind == 1, kind == 2, kind == 3
    joins = np.zeros(len(kind), bool)
    joins[1:-1] = joint[1:-1] & letter[:-2] & letter[2:]
    # Behind a letter ! and | are punctuation more often than letters; before one they aren't.
    soft = (block.data == 33) | (block.data == 124)
    between = np.zeros(len(kind), bool)
    between[1:] = sign[1:] & letter[:-1] & ~soft[1:]
    between[:-1] |= sign[:-1] & letter[1:]
    # Letters are counted and compared by code point, not by byte.
    head = (block.data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    code = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    code[((code >= 65) & (code <= 90)) | ((code >= 0xC0) & (code <= 0xDE) & (code != 0xD7))] += 32
    alpha = letter[at] & ((code < 128) | ((code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & ((code < 0x2000) | (code > 0x2BFF))))
    triple = np.zeros(len(kind), bool)
    triple[at[2:]] = alpha[2:] & (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2])

    def per_word(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[ends] - sums[starts]

    letters, size = per_word(letter & head), per_word(head)
    odd = (per_word(between) > 0) & (letters > 0)
    odd |= (per_word(joins) >= 2) & (2 * per_word(joins) + 1 >= letters)
    odd |= per_word(triple) > 0
    out = [(int(k), int(k) + 1) for k in np.flatnonzero(odd)]
    row = rows_of(firsts)
    short = (size == 1) & (letter[starts] | sign[starts])
    change = np.flatnonzero(np.diff(np.concatenate([[0], short.astype(np.int8), [0]])))
    for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
        while a < b:
            c = min(b, int(firsts[row[a] + 1]))
            if c - a >= 3:
                out.append((a, c))
            a = c
    return out


def features(block: Block, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features (hashes) of the words of a block, their beginnings and what disguised words restore to."""
    data = lower(block.data)
    starts, ends, firsts = words(Block(0, data, block.offsets))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = rows_of(firsts)
    own_row, own = _features_of(data, starts, ends, row)
    found = disguised(block, starts, ends, firsts)
    if not found:
        return own_row, own
    raw = block.data.tobytes()
    restored = [(row[a], w.encode()) for a, b in found for w in channel.words(raw[starts[a] : ends[b - 1]].decode("utf-8", "replace"))]
    joined = np.frombuffer(b" ".join(w for _, w in restored), np.uint8)
    size = np.array([len(w) for _, w in restored], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    more_row, more = _features_of(joined, begin, begin + size, np.array([r for r, _ in restored], np.int64))
    return np.concatenate([own_row, more_row]), np.concatenate([own, more])


def _features_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of words without the signs around their letters."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(data))
    letter = _CLASS[data] == 1
    last = np.maximum.accumulate(np.where(letter, at, -1))
    first = np.minimum.accumulate(np.where(letter, at, len(data))[::-1])[::-1]
    begin, end = first[starts], last[ends - 1] + 1
    some = begin < end
    begin, end, row = begin[some], end[some], row[some]
    hashes = Hashes(data)
    heads = (data & 0xC0) != 0x80  # the first byte of each character
    place, number = np.flatnonzero(heads), np.concatenate([[0], np.cumsum(heads)])
    longer = number[end] - number[begin] > STEM
    stems = mix(hashes(begin[longer], place[number[begin[longer]] + STEM]) ^ _STEM_SALT)
    return np.concatenate([row, row[longer]]), np.concatenate([hashes(begin, end), stems])


@dataclass
class Model:
    """Trigram counts, lexicon (sorted hashes and their log odds) and the weights of the regression."""

    counts: np.ndarray
    lexicon: np.ndarray
    odds: np.ndarray
    weights: np.ndarray
    _channel: Channel | None = field(default=None, compare=False, repr=False)

    @property
    def channel(self) -> Channel:
        if self._channel is None:
            self._channel = Channel(self.counts)
        return self._channel

    def signals(self, texts: pa.Array) -> np.ndarray:
        """Regression inputs of each text: 1, summed log odds and number of its different lexicon words, both damped."""
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1
        for block in blocks(texts):
            row, found = features(block, self.channel)
            place = np.minimum(np.searchsorted(self.lexicon, found), len(self.lexicon) - 1)
            hit = self.lexicon[place] == found if len(self.lexicon) else np.zeros(len(found), bool)
            pairs = np.unique(row[hit] * len(self.lexicon) + place[hit]) if hit.any() else np.zeros(0, np.int64)
            if len(pairs):
                own, which = pairs // len(self.lexicon), pairs % len(self.lexicon)
                out[block.start : block.start + len(block), 1] = np.bincount(own, self.odds[which], len(block))
                out[block.start : block.start + len(block), 2] = np.bincount(own, minlength=len(block))
        out[:, 1:] = np.log1p(out[:, 1:])
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.signals(texts) @ self.weights, -30, 30)))


def _regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small penalty on all weights but the first."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_) -> F.Column:
    """Ids whose CRC-32 as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Learns from the labelled texts that are not held out.

    A third of the sample, told by a hash, is kept from the lexicon and fits the regression, so that
    words of the lexicon weigh as much there as in texts never seen.
    """
    spark = docs.sparkSession
    workers(spark)
    counts = trigram_counts(docs, text_col)
    ids = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    ids = ids.groupBy(ids[id_col].alias("key")).agg(F.max(ids[label_col]).cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("key"), "key").limit(sample)
    # At most ``sample`` rows of an id and a label.
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(ids), F.col("id") == F.col("key"))
    rows = rows.select("text", "toxic", (F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(3)) == 0).alias("apart"))
    sent = broadcast(spark, counts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(sent.value)
        for batch in batches:
            for block in blocks(column(batch, "text")):
                row, found = features(block, channel)
                toxic = column(batch, "toxic").slice(block.start, len(block)).to_numpy().astype(bool)
                order = np.lexsort((row, found))
                row, found = row[order], found[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
                values, at = np.unique(found[new], return_inverse=True)
                bad = np.bincount(at, toxic[row[new]], len(values)).astype(np.int64)
                all_ = np.bincount(at, minlength=len(values))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bad), pa.array(all_)], ["feature", "bad", "n"])

    sizes = {(r.apart, r.toxic): r.n for r in rows.groupBy("apart", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    share = (bad + sizes.get((True, 1), 0)) / max(1, sum(sizes.values()))
    if not bad or not good or not sizes.get((True, 1)) or not sizes.get((True, 0)):
        weight = -30.0 if share == 0 else 30.0 if share == 1 else float(np.log(share / (1 - share)))
        return Model(counts, np.zeros(0, np.uint64), np.zeros(0), np.array([weight, 0, 0]))
    seen = rows.where(~F.col("apart")).select("text", "toxic").mapInArrow(counted, "feature long, bad long, n long")
    seen = seen.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(F.col("bad") >= SUPPORT)
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (good + 1)))
    chosen = seen.withColumn("odds", odds).where(F.col("odds") >= float(np.log(ODDS)))
    chosen = chosen.select("feature", "odds").collect()
    lexicon = np.array([r.feature for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(lexicon)
    model = Model(counts, lexicon[order], np.array([r.odds for r in chosen], float)[order], np.zeros(3))
    unfit = broadcast(spark, model)

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unfit.value.signals(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), column(batch, "toxic")], ["a", "b", "c", "toxic"])

    fitted = rows.where("apart").select("text", "toxic").mapInArrow(signals, "a double, b double, c double, toxic int").collect()
    x = np.array([r[:3] for r in fitted], float)
    y = np.array([r.toxic for r in fitted], float)
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of tasks
    return Model(counts, model.lexicon, model.odds, _regress(x[order], y[order]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, held_out, score, predicted`` of each row."""
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


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, in one pass and without a shuffle."""
    workers(docs.sparkSession)
    sent = broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(column(batch, text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)
