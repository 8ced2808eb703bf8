"""Document fingerprints (operator 1): SimHash and permuted block tables.

The terms of a text are its word pairs, weighted by 1 + ln(count). Every term's hash votes with
its weight for or against each bit; the fingerprint has the bits that won. Weights are whole
numbers, so votes are exact in any order and equal texts have equal fingerprints wherever they lie.

Fingerprints within a Hamming radius are found without comparing all: cut into radius + k blocks,
two such fingerprints agree in at least k blocks, so they meet in one of the tables whose key is
a choice of k blocks; k is such that a bucket holds few fingerprints by chance. Large buckets of a
table are dealt out in pairs of blocks of rows, and links are counted where they are found, so that
no pairs are written.

Defined results: null counts as empty; a text without words has the fingerprint of zeros; a single
word is a term; null ids come after all others; rows with the same id are in the order of their
texts; an only row is its own next document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewise.llm.groups import deal, groups
from gatewise.llm.scratch import partitions, table, workers
from gatewise.llm.text import blocks, column, distinct, mix, rows_of, shingles

#: Bits of a fingerprint, words of a term, texts whose votes are counted at once, and weight of a term that occurs once.
BITS, TERM, VOTES, UNIT = 128, 2, 1 << 12, 1 << 16

#: Bits in which fingerprints of texts that are alike may differ: nearly all copies with a word in 300 changed lie
#: within it, and about half of those with a word in 100 (see the README).
RADIUS = 8

#: Rows of a bucket compared at once in memory.
MEMBERS = 2048


# For each byte, which way its bits vote.
_WAYS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1


def fingerprints(texts: pa.Array) -> np.ndarray:
    """``BITS / 8`` bytes for each text.

    The weights of a text's terms are summed by each byte of their hashes; the sums vote with the bits of the byte.
    """
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for block in blocks(texts):
        terms, firsts, counts = distinct(*shingles(block, TERM))
        weights = np.rint(UNIT * (1 + np.log(counts)))
        row = rows_of(firsts)
        for a in range(0, len(block), VOTES):
            n = min(VOTES, len(block) - a)
            some = slice(firsts[a], firsts[a + n])
            halves = np.stack([terms[some], mix(terms[some] + np.uint64(0x9E3779B97F4A7C15))], 1).view(np.uint8).reshape(-1, BITS // 8)
            place = (row[some] - a) * 256
            for k in range(BITS // 8):
                votes = np.bincount(place + halves[:, k], weights[some], n * 256).reshape(n, 256) @ _WAYS
                out[block.start + a : block.start + a + n, k] = np.packbits(votes > 0, axis=1)[:, 0]
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, row by row."""
    return np.bitwise_count(a ^ b).sum(-1).astype(np.int64)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of the text with its end replaced by the next document's beginning.

    ``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    The next document is that of the next smaller id; the last one is followed by the first.
    """
    spark = docs.sparkSession
    workers(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    order = [F.desc_nulls_last("id"), F.asc("text")]
    dealt = rows.repartitionByRange(partitions(spark), order[0]).sortWithinPartitions(*order)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compared(ids: pa.Array, texts: list[str], after: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after)]
        own = fingerprints(pa.array(texts + after[-1:], pa.large_string()))
        new = fingerprints(pa.array(edited, pa.large_string()))
        columns = [
            [len(t) for t in texts],
            [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            [x.tobytes().hex() for x in own[:-1]],
            [x.tobytes().hex() for x in new],
            1 - distance(own[:-1], new) / BITS,
            1 - distance(own[:-1], own[1:]) / BITS,
        ]
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        first = None

        def tagged(batch: pa.RecordBatch, where: str, text: str | None) -> pa.RecordBatch:
            n = len(batch)
            more = [pa.array([part] * n, pa.int32()), pa.array([where] * n), pa.array([text] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "part", "place", "text"])

        for batch in batches:
            if not len(batch):
                continue
            got = column(batch, "text").to_pylist()
            ids, texts = [*ids, *column(batch, "id").to_pylist()], [*texts, *got]
            if first is None:
                first = texts[0]
            if len(texts) > 1:
                yield tagged(compared(pa.array(ids[:-1], column(batch, "id").type), texts[:-1], texts[1:]), "row", None)
            ids, texts = ids[-1:], texts[-1:]
        if texts:
            empty = pa.nulls(2)
            ends = [pa.array([ids[0], ids[0]], column(batch, "id").type), *[empty.cast(pa.int64()), *[empty.cast(pa.string())] * 3, *[empty.cast(pa.float64())] * 2]]
            ends += [pa.array([part] * 2, pa.int32()), pa.array(["last", "first"]), pa.array([texts[0], first])]
            yield pa.RecordBatch.from_arrays(ends, [*names, "part", "place", "text"])

    found = table(dealt.mapInArrow(run, f"{schema}, part int, place string, text string"), "fingerprints")
    # The last row of a part goes on with the first of the next; there are as many as parts.
    parts = found.where("place = 'first'").select("part")
    ordered = Window.orderBy("part")
    least = F.min("part").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = parts.select("part", F.coalesce(F.lead("part").over(ordered), least).alias("then"))
    firsts = found.where("place = 'first'").select(F.col("part").alias("then"), F.col("text").alias("after"))
    lasts = found.where("place = 'last'").select("part", "id", "text")
    edges = lasts.join(follows, "part").join(firsts, "then")

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text, after = (column(batch, c)[k].as_py() for c in ("text", "after"))
                yield compared(column(batch, "id").slice(k, 1), [text], [after])

    out = found.where("place = 'row'").select(names).unionByName(edges.select("id", "text", "after").mapInArrow(at_edges, schema))
    return out.withColumnRenamed("id", id_col)


def front_blocks(prints: int, radius: int) -> int:
    """How many of ``radius + k`` blocks a key takes, so that few of so many fingerprints share a bucket by chance."""
    k = 2
    while 2.0 ** (BITS * k / (radius + k)) < 2 * prints and k < 6:
        k += 1
    return k


def block_keys(prints: np.ndarray, radius: int, front: int = 2) -> np.ndarray:
    """A key for each fingerprint and table; a table takes ``front`` of ``radius + front`` blocks to the front."""
    bits = np.unpackbits(prints, axis=1)
    cut = np.linspace(0, bits.shape[1], radius + front + 1).astype(int)
    parts = []
    for a, b in zip(cut[:-1], cut[1:]):
        packed = np.zeros((len(bits), 8), np.uint8)
        packed[:, : -(-(b - a) // 8)] = np.packbits(bits[:, a:b], axis=1)
        parts.append(packed.view(np.uint64)[:, 0] if b - a <= 64 else None)
    if any(part is None for part in parts):
        raise ValueError("a radius of at least one bit")
    keys = []
    for number, chosen in enumerate(combinations(range(radius + front), front)):
        key = np.full(len(bits), number + 1, np.uint64)
        for k in chosen:
            key = mix(key ^ parts[k]) + np.uint64(number)
        keys.append(key)
    return np.stack(keys, 1)


def _longs(prints: np.ndarray) -> np.ndarray:
    """Fingerprints as two longs each."""
    return np.ascontiguousarray(prints).view(np.int64).reshape(len(prints), 2)


def _alike(keys: np.ndarray, prints: np.ndarray, block: np.ndarray, pair: tuple[np.ndarray, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of sorted groups that are within ``radius`` bits and in the two blocks of their group, by their distance in the order."""
    words = prints.view(np.uint64)
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (pair[0][1:] != pair[0][:-1]) | (pair[1][1:] != pair[1][:-1])))
    last = np.repeat(np.append(starts[1:], len(keys)), np.diff(np.append(starts, len(keys))))
    x, apart = np.arange(len(keys)), 1
    while True:
        x = x[x + apart < last[x]]
        if not len(x):
            return
        y = x + apart
        near = np.bitwise_count(words[x] ^ words[y]).sum(1) <= radius
        same = pair[0][x] == pair[1][x]
        near &= same | (block[x] != block[y])
        if near.any():
            yield x[near], y[near]
        apart += 1


def links_within(prints: DataFrame, radius: int = RADIUS, print_col: str = "fingerprint") -> DataFrame:
    """``<print_col>, links``: for each different fingerprint (hex), how many others are within ``radius`` bits.

    Fingerprints without others are left out. Keys are made again where they are needed instead of being stored.
    Spark would size keys and buckets like the fingerprints they are made of, and broadcast tens of rows for each.
    """
    workers(prints.sparkSession)
    own = table(prints.select(F.col(print_col).alias("print")).where("print IS NOT NULL").distinct(), "prints")
    front = front_blocks(own.count(), radius)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(bytes.fromhex("".join(column(batch, "print").to_pylist())), np.uint8).reshape(-1, BITS // 8)
            keys = block_keys(raw, radius, front)
            halves = np.repeat(_longs(raw), keys.shape[1], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["key", "a", "b"])

    keys = own.mapInArrow(keyed, "key long, a long, b long")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = deal(keys.join(buckets.hint("merge"), "key"), "a", F.ceil(F.col("size") / MEMBERS)).select("key", "a", "b", "block", "block_i", "block_j")
    by = ["key", "block_i", "block_j"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in groups(batches, by):
            key, block, i, j = (some[c].to_numpy() for c in ("key", "block", "block_i", "block_j"))
            prints = np.stack([some["a"].to_numpy(), some["b"].to_numpy()], 1)
            met = [pair for pair in _alike(key, prints, block, (i, j), radius)]
            if not met:
                continue
            x, y = (np.concatenate(side) for side in zip(*met))
            # A pair that meets in several tables counts in the first of them.
            first = []
            for part in range(0, len(x), 4096):
                both = [block_keys(prints[side[part : part + 4096]].view(np.uint8).reshape(-1, BITS // 8), radius, front) for side in (x, y)]
                at = (both[0] == both[1]).argmax(1)
                first.append(both[0][np.arange(len(at)), at].view(np.int64) == key[x[part : part + 4096]])
            first = np.concatenate(first)
            links = np.bincount(np.concatenate([x[first], y[first]]), minlength=len(key))
            rows = np.flatnonzero(links)
            names = [p.tobytes().hex() for p in prints[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(links[rows])], ["print", "links"])

    found = members.repartition(*by).sortWithinPartitions(*by).mapInArrow(compared, "print string, links long")
    return found.groupBy("print").agg(F.sum("links").alias("links")).withColumnRenamed("print", print_col)


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`edited_fingerprints` and ``near_prints``: other fingerprints of the table within ``radius`` bits."""
    found = table(edited_fingerprints(docs, id_col, text_col), "edited")
    near = links_within(found, radius).withColumnRenamed("links", "near_prints")
    return found.join(near.hint("merge"), "fingerprint", "left").select(*found.columns, F.coalesce("near_prints", F.lit(0)).alias("near_prints"))
