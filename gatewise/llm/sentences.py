"""Substring dedup (operator 2): spans of consecutive sentences, hashed and joined globally.

A sentence ends behind ``.``, ``!`` or ``?`` before white space, or at a line break. From each
sentence starts one span: the shortest run of at least ``SENTENCES`` sentences and ``WORDS`` words.
Spans are alike if their words are (A-Z lower-cased, white space ignored). Of each span that
repeats, the first occurrence (least id, then place) stays; all others go, with every sentence they
cover. Spans are counted by one hash first, so that only those that repeat move with their place.

By default spans are all runs of ``SENTENCES`` sentences. Whatever longer run repeats is made of
such runs that repeat, so all of it goes, up to its last sentence. A higher ``least`` leaves out short
runs, and the last sentences of a run where they have fewer words.

Defined results: null and empty texts have no sentences; a null id comes after all others; rows with
the same id and text count as one and get the same result; texts with fewer words than a span keep
all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.scratch import table, workers
from gatewise.llm.text import BASES, Block, Hashes, blocks, column, lower, rows_of, words

#: Sentences and words of a span, at least.
SENTENCES, WORDS = 2, 1


def cut(block: Block) -> dict[str, np.ndarray]:
    """Sentences of a block: ``begin, end`` (bytes), ``first`` and ``last`` word (exclusive), and ``firsts`` of each row."""
    data = block.data
    starts, ends, row_words = words(block)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return {"begin": none, "end": none, "first": none, "last": none, "firsts": np.zeros(len(block) + 1, np.int64), "starts": none, "ends": none}
    row = rows_of(row_words)
    final = np.isin(data[ends - 1], (33, 46, 63))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    behind = np.append(starts[1:], len(data))
    last_of_row = np.append(row[1:] != row[:-1], True)
    final |= last_of_row | (breaks[behind] > breaks[ends])
    last = np.flatnonzero(final) + 1
    first = np.concatenate([[0], last[:-1]])
    firsts = np.searchsorted(first, row_words)
    begin = starts[first]
    # A sentence reaches up to the next one; the last of a row up to its end.
    end = np.where(last_of_row[last - 1], block.offsets[1:][row[first]], np.append(begin[1:], 0))
    return {"begin": begin, "end": end, "first": first, "last": last, "firsts": firsts, "starts": starts, "ends": ends}


def spans(block: Block, sentences: int, least: int) -> dict[str, np.ndarray]:
    """Spans of a block: two hashes ``h``, ``g``, ``row``, first ``sentence`` of the row and how many, ``n``."""
    got = cut(Block(block.start, lower(block.data), block.offsets))
    first, last, firsts = got["first"], got["last"], got["firsts"]
    row = rows_of(firsts)
    at = np.arange(len(first))
    to = np.maximum(at + sentences - 1, np.searchsorted(last, first + least))
    fits = to < firsts[1:][row] if len(row) else np.zeros(0, bool)
    at, to, row = at[fits], to[fits], row[fits]
    both = []
    for base in BASES:
        of_word = Hashes(lower(block.data), base)(got["starts"], got["ends"])
        both.append(Hashes(of_word, base)(first[at], last[to]).view(np.int64))
    return {"h": both[0], "g": both[1], "row": row, "sentence": at - firsts[row], "n": to - at + 1}


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, least: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans that are not the first of their kind: ``id, t (hash of the text), sentence, n, first_id``."""
    workers(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                h, n = np.unique(spans(block, sentences, least)["h"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                got = spans(block, sentences, least)
                own = pa.array(got["row"] + block.start)
                some = [pa.array(got["h"]), pa.array(got["g"]), column(batch, "id").take(own), column(batch, "t").take(own)]
                some += [pa.array(got[c].astype(np.int32)) for c in ("sentence", "n")]
                yield pa.RecordBatch.from_arrays(some, ["h", "g", "id", "t", "sentence", "n"])

    again = rows.select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    again = table(again, "span-hashes")
    places = rows.mapInArrow(placed, f"h long, g long, id {kind}, t long, sentence int, n int").join(again, "h")
    places = table(places.withColumn("place", F.struct(F.col("id").isNull().alias("no_id"), "id", "t", "sentence")), "spans")
    firsts = places.groupBy("h", "g").agg(F.min("place").alias("first"))
    later = places.join(firsts, ["h", "g"]).where("place > first")
    return later.select("id", "t", "sentence", "n", F.col("first.id").alias("first_id"))


def dedup_spans(docs: DataFrame, sentences: int = SENTENCES, least: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_sentences, n_removed, removed (sentence numbers), first_ids, kept (text), kept_sha256`` of each row.

    ``first_ids`` are the rows that hold the first occurrences of what was removed.
    """
    rows = _rows(docs, id_col, text_col)
    found = repeated_spans(docs, sentences, least, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    of_row = found.groupBy(F.col("id").alias("own"), F.col("t").alias("own_t")).agg(
        F.collect_set(F.struct("sentence", "n")).alias("gone"), F.array_sort(F.collect_set("first_id")).alias("first_ids")
    )
    joined = rows.join(of_row, rows["id"].eqNullSafe(of_row["own"]) & (rows["t"] == of_row["own_t"]), "left").select("id", "text", "gone", "first_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                got = cut(block)
                gone = column(batch, "gone").slice(block.start, len(block)).to_pylist()
                out = []
                for k, spans_ in enumerate(gone):
                    a, b = got["firsts"][k], got["firsts"][k + 1]
                    bytes_ = block.data[block.offsets[k] : block.offsets[k + 1]]
                    covered = np.zeros(b - a, bool)
                    keep = np.ones(len(bytes_), bool)
                    for s in spans_ or ():
                        covered[s["sentence"] : s["sentence"] + s["n"]] = True
                    for s in np.flatnonzero(covered):
                        keep[got["begin"][a + s] - block.offsets[k] : got["end"][a + s] - block.offsets[k]] = False
                    kept = bytes_[keep].tobytes()
                    out.append((int(b - a), int(covered.sum()), np.flatnonzero(covered).astype(np.int32), kept.decode(), hashlib.sha256(kept).hexdigest()))
                columns = [list(c) for c in zip(*out)]
                columns[2] = pa.array(columns[2], pa.list_(pa.int32()))
                ids, firsts = (column(batch, c).slice(block.start, len(block)) for c in ("id", "first_ids"))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns), firsts], ["id", "n_sentences", "n_removed", "removed", "kept", "kept_sha256", "first_ids"])

    out = joined.mapInArrow(run, f"id {kind}, n_sentences long, n_removed long, removed array<int>, kept string, kept_sha256 string, first_ids array<{kind}>")
    return out.withColumnRenamed("id", id_col)
