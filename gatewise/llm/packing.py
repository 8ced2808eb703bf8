"""Best-fit packing (operator 8): large pieces are matched in pairs, smaller ones best-fit the gaps left.

How many pieces there are of each length (at most ``capacity`` counts) is all the packing has to
know. The plan made from it says, for the n-th piece of a length, its sequence and place; pieces
learn their n from counts per task, so no rows of a length meet in one task.

Defined results: null and empty texts are the closing token alone; repeated rows are packed as
rows of their own; null ids stay null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewise.llm.scratch import table, workers
from gatewise.llm.text import column
from gatewise.sources.store import broadcast

#: Pieces over this share of the capacity are large: at most two of them fit in a sequence.
LARGE = 1 / 3

_encoders: dict[tuple, tiktoken.Encoding] = {}


def added_tokens(vocabulary: str) -> tuple[tuple[str, int], ...]:
    """Strings that the tokenizer in the JSON file of the same name takes as one token wherever they stand, and their ids."""
    path = Path(vocabulary).with_suffix(".json")
    if not path.exists():
        return ()
    added = json.loads(path.read_text("utf-8"))["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens that reach beyond their string in {path}")
    return tuple((t["content"], t["id"]) for t in added)


def encoder(key: tuple[str, str, tuple[tuple[str, int], ...]], vocabulary: bytes) -> tiktoken.Encoding:
    """The worker's own, which it keeps for its next tasks. ``key``: vocabulary, pattern and added tokens."""
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=key[1], mergeable_ranks=ranks, special_tokens=dict(key[2]))
    return _encoders[key]


def token_pieces(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of each text and ``end_id``, cut into pieces of ``capacity``, of which the first may be shorter.

    A text is cut at the strings of :func:`added_tokens`, which give their own ids; the rest is encoded part by part.
    ``id, piece, start, length, ids_crc32`` and, for the plan, the task ``part`` and the piece's
    number ``nth`` among those of its length there. Written once.
    """
    spark = docs.sparkSession
    workers(spark)
    with open(vocabulary, "rb") as f:
        sent = broadcast(spark, f.read())
    key = (vocabulary, pattern, added_tokens(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(key, sent.value).encode
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            took, rows = [], []
            for at, text in enumerate(column(batch, "text").to_pylist()):
                ids = np.array([*encode(text or "", allowed_special="all"), end_id], "<u4")
                cut = (len(ids) - 1) % capacity + 1
                for piece, to in enumerate(range(cut, len(ids) + 1, capacity)):
                    start = max(0, to - capacity) if piece else 0
                    took.append(at)
                    rows.append((piece, start, to - start, zlib.crc32(ids[start:to].tobytes()), part, int(seen[to - start])))
                    seen[to - start] += 1
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(took)), *columns], names)

    names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return table(rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of pieces: ``(length, from_nth, count, per_sequence, first_sequence, offset)``.

    Of the pieces of a length, those from ``from_nth`` on go ``per_sequence`` to a sequence, in
    consecutive sequences from ``first_sequence``, behind ``offset``. Large pieces, longest first,
    take the longest large piece that fits as partner. Smaller ones, longest first, go where the
    least room is left that takes them, and open a sequence only if none does.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece longer than the capacity, or empty")
    used: dict[int, int] = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    rooms: list[int] = []
    sequences = 0

    def put(length: int, count: int, each: int, first: int, offset: int) -> None:
        out.append((length, used[length], count, each, first, offset))
        used[length] += count
        left[length] -= count

    def room(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(rooms, gap)
            gaps[gap].append((first, n))

    large = sorted((n for n in left if n > capacity * LARGE), reverse=True)
    small = sorted((n for n in left if n <= capacity * LARGE), reverse=True)
    for length in large:
        while left[length]:
            partner = next((n for n in large if left[n] > (n == length) and n + length <= capacity), None)
            n = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, n, 1, sequences, 0)
            if partner is not None:
                put(partner, n, 1, sequences, length)
            room(capacity - length - (partner or 0), sequences, n)
            sequences += n
    for length in small:
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-left[length] // (capacity // length))
                room(capacity, sequences, n)
                sequences += n
                continue
            gap = rooms[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], rooms[at]
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, each, first, capacity - gap)
                room(gap - each * length, first, full)
            if full < n and left[length]:
                rest = left[length]
                put(length, rest, rest, first + full, capacity - gap)
                room(gap - rest * length, first + full, 1)
                full += 1
            if full < n:
                room(gap, first + full, n - full)
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of :func:`token_pieces`."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counted = table(counted, "piece-counts")
    # At most ``capacity`` rows, however many pieces there are.
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    sent = broadcast(spark, runs)  # its rows depend on the number of lengths only
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(firsts, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        top = 1 << 40
        starts = runs[:, 0] * top + runs[:, 1]
        for batch in batches:
            length, nth = (column(batch, c).to_numpy() for c in ("length", "nth"))
            row = runs[np.searchsorted(starts, length * top + nth, "right") - 1]
            place = nth - row[:, 1]
            sequence, offset = row[:, 4] + place // row[:, 3], row[:, 5] + place % row[:, 3] * length
            kept = [column(batch, c) for c in names[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names)

    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select("id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs whole texts: ``<id_col>, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = token_pieces(docs, vocabulary, pattern, capacity, end_id, id_col, text_col)
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
