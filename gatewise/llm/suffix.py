"""Suffix-array dedup (operator 3): maximal repeats from enhanced suffix arrays, with all occurrences.

Repeats of ``length`` bytes are found exactly, in parts that fit in a task:

1. Of the k-byte strings in each window of ``length`` bytes, the one of least hash is its anchor.
   Equal windows have equal anchors, so windows are dealt out by anchor: a segment is a run of
   windows of one text with the same anchor. Anchors that occur once are left out by a count.
2. Segments whose bytes are alike are one from here on, and repeat as a whole if there are several.
3. Segments with the same anchor and different bytes go through a suffix array with common prefix
   lengths. A stack scan walks its tree of prefix intervals; those of at least ``length`` bytes with
   different bytes to their left are the maximal repeats, given with all their occurrences.
4. An anchor with more segments than a task should hold is split: by the bytes that the windows of
   a narrow range around it have in common, and at last by the whole window. None is left out.

Texts are UTF-8 bytes; a text is known by its MD5, so copies of a text are worked on once.

Defined results: null and empty texts have no bytes and no spans; texts shorter than ``length`` keep
all bytes; repeated rows are occurrences of their own (a copy of a row is a repeat of its text);
null ids stay null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from gatewise.llm.groups import groups
from gatewise.llm.scratch import table, workers
from gatewise.llm.text import Block, Hashes, blocks, column, mix, runs

#: Bytes of an anchor. Shorter ones make fewer segments, longer ones are seldom alike by chance.
ANCHOR = 72

#: Bytes of texts whose windows are taken at once.
TEXT_BYTES = 1 << 20

#: Bytes of segments per suffix array, and different segments of an anchor; one with more of either is split.
ARRAY_BYTES, SEGMENTS = 1 << 20, 8192

#: Windows per part when an anchor with too many segments is split, first and at last.
WIDTHS = (16, 1)

_PLACE = np.uint64((1 << 28) - 1)


def window_runs(block: Block, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows of each text whose leftmost least k-byte string is the same one.

    ``start, n`` (windows), ``anchor`` (its position), ``h`` (its hash), ``row``; positions within the block.
    """
    data = block.data
    sizes = np.diff(block.offsets)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        return {c: np.zeros(0, np.uint64 if c == "h" else np.int64) for c in ("start", "n", "anchor", "h", "row")}
    hashes = Hashes(data)
    grams = mix((hashes.sums[k:] - hashes.sums[:-k]) * hashes.down[: len(data) - k + 1])
    least = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    span, have = length - k + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts = runs(block.offsets[:-1], windows)
    row = np.repeat(np.arange(len(windows)), windows)
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return {"start": starts[first], "n": np.diff(np.append(first, len(starts))), "anchor": anchor[first], "h": grams[anchor[first]], "row": row[first]}


def segments(block: Block, length: int, k: int) -> dict[str, np.ndarray]:
    """:func:`window_runs` with neighbours of equal anchor bytes joined; ``anchors`` counts them.

    A joined run of ``full`` windows that repeats with a period, at least twice, has all its windows
    in the first period: ``n`` is then the period. Otherwise ``n`` is ``full``.
    """
    found = window_runs(block, length, k)
    h, row = found["h"], found["row"]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    full = np.add.reduceat(found["n"], first) if len(first) else found["n"]
    anchors = np.diff(np.append(first, len(h)))
    n, start = full.copy(), found["start"][first]
    for at in np.flatnonzero(anchors > 1):
        period = int(found["anchor"][first[at] + 1] - found["anchor"][first[at]])
        some = block.data[start[at] : start[at] + full[at] + length - 1]
        if full[at] >= 2 * period and np.array_equal(some[period:], some[:-period]):
            n[at] = period
    return {"start": start, "n": n, "full": full, "h": h[first], "row": row[first], "anchors": anchors}


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their first ``depth`` symbols or more, and common prefix lengths with the one before.

    ``symbols`` are small positive integers; what lies behind the end counts as smaller. Ranks of
    prefixes of 1, 2, 4 .. symbols are kept, so that lengths are read off them.
    """
    n = len(symbols)
    one = np.append(symbols, 0).astype(np.int32)
    two = one << 9  # symbols are below 512, so pairs of them are ranks as they are
    two[:-1] += one[1:]
    levels, reach = [one, two], 2
    while True:
        rank = levels[-1]
        key = rank[:n].astype(np.uint64) << np.uint64(32)
        key[: max(0, n - reach)] |= rank[reach:n].astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        del key
        if reach * 2 >= depth or new.all():
            break
        rank = np.zeros(n + 1, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        levels.append(rank)
        reach *= 2
    common = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    at = np.zeros(n - 1, np.int64)
    for _ in range(2):  # each length up to twice the longest rank
        for level in range(len(levels) - 1, -1, -1):
            x, y = np.minimum(a + at, n), np.minimum(b + at, n)
            same = (levels[level][x] == levels[level][y]) & (x < n) & (y < n)
            at[same] += 1 << level
    common[1:] = at
    return order, common


def maximal_repeats(texts: list[bytes], windows: np.ndarray, length: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of at least ``length`` bytes that start in the first ``windows[i]`` places of text i.

    Each is ``(bytes, texts, places)`` with all occurrences.
    """
    text, place, nodes = repeat_nodes(texts, windows, length)
    return [(size, text[a:b], place[a:b]) for size, a, b in nodes]


def covered(texts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the maximal repeats cover: ``text, begin, end`` of spans that neither overlap nor touch."""
    text, place, nodes = repeat_nodes(texts, windows, length)
    longest = np.zeros(len(text), np.int64)
    for size, a, b in nodes:
        np.maximum(longest[a:b], size, out=longest[a:b])
    some = longest > 0
    text, begin, end = text[some], place[some], (place + longest)[some]
    if not len(text):
        return text, begin, end
    order = np.lexsort((begin, text))
    far = 1 << 40  # texts side by side, too far apart to touch
    text, begin, end = text[order], (begin + text * far)[order], (end + text * far)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(text), bool)
    new[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return text[first], begin[first] - text[first] * far, reach[last] - text[first] * far


def repeat_nodes(texts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Sorted suffixes (``text, place``) and the maximal repeats among them: ``(bytes, first, last)``, the last exclusive.

    A scan with a stack meets the nodes of the prefix interval tree from the leaves up; a node is
    kept if the bytes left of its occurrences differ, or one of them begins its text.
    """
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int32) + 2
    ends = begins + sizes
    symbols[ends] = 1
    order, common = suffix_array(symbols, int(sizes.max()))
    text = np.repeat(np.arange(len(texts)), sizes + 1)[order]
    place = order - begins[text]
    common = np.minimum(common, sizes[text] - place)
    starts = place < windows[text]
    # Only starts of windows; the length shared over those left out is the least in between.
    kept = np.flatnonzero(starts)
    if not len(kept):
        return text[:0], place[:0], []
    common = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
    order, text, place = order[kept], text[kept], place[kept]
    common[0] = 0
    left = np.where(place > 0, symbols[order - 1], -1 - np.arange(len(order)))
    deep = common >= length
    run = np.cumsum(~deep) - 1
    heads = np.flatnonzero(~deep)
    lo, hi = np.minimum.reduceat(left, heads), np.maximum.reduceat(left, heads)
    several = np.diff(np.append(heads, len(order))) > 1
    out = []
    for r in np.flatnonzero(several & (lo != hi)):
        begin = int(heads[r])
        end = int(heads[r + 1]) if r + 1 < len(heads) else len(order)
        shared = common[begin:end].tolist()
        side = left[begin:end].tolist()
        stack: list[list] = []  # [prefix length, first suffix, byte to the left, diverse]
        for i in range(1, len(shared) + 1):
            now = shared[i] if i < len(shared) else 0
            node = [now, i - 1, side[i - 1], False]
            while stack and stack[-1][0] > now:
                top = stack.pop()
                top[3] = top[3] or node[3] or top[2] != node[2]
                if top[3]:
                    out.append((top[0], begin + top[1], begin + i))
                node = [now, top[1], top[2], top[3]]
            if now < length:
                continue
            if stack and stack[-1][0] == now:
                stack[-1][3] = stack[-1][3] or node[3] or stack[-1][2] != node[2]
            else:
                stack.append(node)
    return text, place, out


def split_runs(snippet: bytes, n: int, length: int, k: int, width: int) -> Iterator[tuple[int, int, int]]:
    """Parts ``(key, first window, windows)`` of a segment: at most ``width`` windows about the same anchor.

    Windows that are alike get the same key, the hash of what all windows of their part share.
    """
    one = Block(0, np.frombuffer(snippet[: n + length - 1], np.uint8), np.array([0, n + length - 1]))
    found = window_runs(one, length, k)
    for start, count, anchor in zip(found["start"].tolist(), found["n"].tolist(), found["anchor"].tolist()):
        for part in range((anchor - start - count + 1) // width, (anchor - start) // width + 1):
            first, last = max(start, anchor - part * width - width + 1), min(start + count - 1, anchor - part * width)
            if first <= last:
                core = snippet[max(0, anchor - part * width) : anchor - part * width - width + 1 + length]
                yield xxhash.xxh3_64_intdigest(core, part + 1) - (1 << 63), first, last - first + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), F.unhex(F.md5(text)).alias("t"), text.alias("text"))


def _all_segments(rows: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text"), TEXT_BYTES):
                got = segments(block, length, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(got["h"].view(np.int64)),
                        column(batch, "t").take(pa.array(got["row"] + block.start)),
                        pa.array((got["start"] - block.offsets[got["row"]]).astype(np.int32)),
                        pa.array(got["n"].astype(np.int32)),
                        pa.array(got["full"].astype(np.int32)),
                        pa.array(got["anchors"] > 1),
                    ],
                    ["h", "t", "start", "n", "full", "folded"],
                )

    return rows.select("t", "text").mapInArrow(run, "h long, t binary, start int, n int, full int, folded boolean")


def _repeated_anchors(rows: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text"), TEXT_BYTES):
                got = segments(block, length, k)
                h, at = np.unique(got["h"], return_inverse=True)
                n = np.bincount(at, got["anchors"], len(h)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return rows.select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _snippets(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the ``wanted(t, segments)`` of each text, with a digest ``c`` that names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = zip(column(batch, "t").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist(), column(batch, "segments"))
            for t, text, found in some:
                found = found.values
                h, start, n = (found.field(c).to_numpy() for c in ("h", "start", "n"))
                pieces = [text[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist())]
                names = [xxhash.xxh3_128_digest(p) for p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(names, pa.binary()), pa.array([t] * len(h), pa.binary()), pa.array(start), pa.array(n), found.field("full"), found.field("folded"), pa.array(pieces, pa.binary())],
                    ["h", "c", "t", "start", "n", "full", "folded", "bytes"],
                )

    joined = rows.select("t", "text").dropDuplicates(["t"]).join(wanted, "t")
    return joined.select("t", "text", "segments").mapInArrow(run, "h long, c binary, t binary, start int, n int, full int, folded boolean, bytes binary")


def _repeats(segs: DataFrame, length: int, groups_too: bool) -> DataFrame:
    """Maximal repeats among segments ``h, c, at, n, bytes`` of the same ``h``: ``repeat, size, c, at``.

    Repeats lie within repeats, so all groups together may have many more occurrences than the texts
    have bytes; unless they are wanted, only the spans they cover are given, without ``repeat``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for some in groups(batches, ["h"]):
            waiting.append(some)
            if sum(t["bytes"].nbytes for t in waiting) >= ARRAY_BYTES:
                yield from arrays(waiting)
                waiting = []
        if waiting:
            yield from arrays(waiting)

    def arrays(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(tables)
        h = rows["h"].to_numpy()
        sizes = np.cumsum(pa.compute.binary_length(rows["bytes"]).to_numpy())
        at = 0
        while at < len(h):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ARRAY_BYTES, "right")))
            while to < len(h) and h[to] == h[to - 1]:
                to += 1
            yield from array(rows.slice(at, to - at))
            at = to

    def array(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, names = rows["bytes"].to_pylist(), rows["c"].to_pylist()
        offset = rows["at"].to_numpy()
        if not groups_too:
            text, begin, end = covered(texts, rows["n"].to_numpy(), length)
            own = pa.array([names[x] for x in text], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(text), pa.binary()), pa.array((end - begin).astype(np.int32)), own, pa.array((begin + offset[text]).astype(np.int32))],
                ["repeat", "size", "c", "at"],
            )
            return
        ids, sizes, own, places = [], [], [], []
        for size, text, place in maximal_repeats(texts, rows["n"].to_numpy(), length):
            first = texts[text[0]][place[0] : place[0] + size]
            ids += [xxhash.xxh3_128_digest(first)] * len(text)
            sizes.append(np.full(len(text), size, np.int32))
            own += [names[x] for x in text]
            places.append((place + offset[text]).astype(np.int32))
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(own, pa.binary()), pa.array(np.concatenate(places))],
                ["repeat", "size", "c", "at"],
            )

    dealt = segs.repartition("h").sortWithinPartitions("h")
    return dealt.select("h", "c", "at", "n", "bytes").mapInArrow(run, "repeat binary, size int, c binary, at int")


def _split(segs: DataFrame, length: int, k: int, width: int) -> DataFrame:
    """Segments cut into parts of at most ``width`` windows, keyed by what the windows of a part share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            some = (column(batch, c).to_pylist() for c in ("c", "at", "n", "bytes"))
            for c, at, n, snippet in zip(*some):
                for key, first, count in split_runs(snippet, n, length, k, width):
                    out.append((key, c, at + first, count, snippet[first : first + count + length - 1]))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["h", "c", "at", "n", "bytes"])

    return segs.mapInArrow(run, "h long, c binary, at int, n int, bytes binary")


def repeat_groups(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of at least ``length`` bytes: ``repeat (id of its bytes), size, t (MD5 of the text), start``.

    One row for each different text and place; repeats are maximal within their segments, so a
    longer one shows as overlapping groups that together cover it. Whole texts that occur several
    times are not listed again for each copy.
    """
    workers(docs.sparkSession)
    return _repeat_groups(_texts(docs, id_col, text_col), length, True)


def _repeat_groups(rows: DataFrame, length: int, groups_too: bool) -> DataFrame:
    k = min(ANCHOR, length)
    anchors = table(_repeated_anchors(rows, length, k), "anchors")
    wanted = _all_segments(rows, length, k).join(anchors, "h").groupBy("t").agg(F.collect_set(F.struct("h", "start", "n", "full", "folded")).alias("segments"))
    snippets = table(_snippets(rows, wanted, length), "snippets")
    alike = snippets.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.max("folded").alias("folded"))
    alike = table(alike, "segments")
    whole = alike.where("copies > 1").select(F.col("c").alias("repeat"), (F.col("n") + length - 1).alias("size"), "c", F.lit(0).alias("at"))

    mass = F.sum(F.col("n") + length - 1).alias("mass")
    differing = alike.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), mass, F.max("folded").alias("folded"))
    differing = differing.where("kinds > 1 OR folded").select("h", "kinds", "mass")
    segs = snippets.join(differing, "h").select("h", "c", F.lit(0).alias("at"), "n", "bytes", "kinds", "mass").dropDuplicates(["h", "c"])
    segs = table(segs, "different")
    fits = (F.col("kinds") <= SEGMENTS) & (F.col("mass") <= ARRAY_BYTES)
    found = [whole, _repeats(segs.where(fits), length, groups_too)]
    for width in WIDTHS:
        crowded = segs.where(~fits)
        if crowded.isEmpty():
            break
        parts = table(_split(crowded.select("c", "at", "n", "bytes").repartition(crowded.sparkSession.sparkContext.defaultParallelism * 4), length, k, width), "parts")
        # Parts with the same bytes are one repeat; one of them stands for all.
        same = parts.groupBy("h", "bytes").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("c", "at")).alias("one"), F.first("n").alias("n"))
        same = table(same, "alike-parts")
        digest = F.unhex(F.md5("bytes"))
        again = parts.join(same.where("copies > 1").select("h", "bytes"), ["h", "bytes"])
        found.append(again.select(digest.alias("repeat"), (F.col("n") + length - 1).alias("size"), "c", "at"))
        kinds = same.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), mass).where("kinds > 1")
        segs = table(same.join(kinds, "h").select("h", "one.c", "one.at", "n", "bytes", "kinds", "mass"), "different")
        found.append(_repeats_of_parts(parts, segs if width == WIDTHS[-1] else segs.where(fits), length, groups_too))
    repeats = found[0]
    for more in found[1:]:
        repeats = repeats.unionByName(more)
    repeats = repeats.join(snippets.select("c", "t", F.col("start").alias("from")), "c").select(
        "repeat", "size", "t", (F.col("from") + F.col("at")).alias("start")
    )
    periodic = snippets.where("full > n").select(F.col("c").alias("repeat"), (F.col("full") + length - 1).alias("size"), "t", "start")
    return repeats.unionByName(periodic)


def _repeats_of_parts(parts: DataFrame, segs: DataFrame, length: int, groups_too: bool) -> DataFrame:
    """Repeats among different parts, for every part that has the bytes of the one that stands for it."""
    one = _repeats(segs, length, groups_too).withColumnsRenamed({"c": "one_c", "at": "found_at"})
    stands = segs.select("h", "bytes", F.col("c").alias("one_c"), F.col("at").alias("one_at"), "n")
    within = (F.col("found_at") >= F.col("one_at")) & (F.col("found_at") < F.col("one_at") + F.col("n"))
    one = one.join(stands, "one_c").where(within).select("repeat", "size", "h", "bytes", (F.col("found_at") - F.col("one_at")).alias("add"))
    return parts.join(one, ["h", "bytes"]).select("repeat", "size", "c", (F.col("at") + F.col("add")).cast("int").alias("at"))


def spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts by MD5 ``t`` with ``pieces``, the unordered ``(start, size)`` of their repeats, and their ``copies``."""
    workers(docs.sparkSession)
    rows = _texts(docs, id_col, text_col)
    pieces = _repeat_groups(rows, length, False).groupBy("t").agg(F.collect_set(F.struct("start", "size")).alias("pieces"))
    copies = rows.groupBy("t").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return table(pieces.join(copies, "t", "full"), "spans")


def _cut(text: bytes, pieces: list[dict] | None, copies: int | None, length: int) -> tuple[bytes, int, int]:
    """What is kept, bytes removed and spans removed."""
    if copies and len(text) >= length:
        return b"", len(text), 1
    if not pieces:
        return text, 0, 0
    kept, removed, n, at = [], 0, 0, 0
    end = -1
    for a, b in sorted((p["start"], p["start"] + p["size"]) for p in pieces):
        if a > end:
            kept.append(text[at:a])
            n += 1
            removed += b - a
            at = end = b
        elif b > end:
            removed += b - end
            at = end = b
    kept.append(text[at:])
    return b"".join(kept), removed, n


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes, n_removed, n_spans, kept_sha256`` of each row.

    Every byte of a ``length``-byte string that also starts elsewhere goes, all occurrences of it.
    """
    found = spans(docs, length, id_col, text_col)
    rows = _texts(docs, id_col, text_col).join(found, "t", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary()).to_pylist()
            out = [_cut(*x, length) for x in zip(texts, column(batch, "pieces").to_pylist(), column(batch, "copies").to_pylist())]
            columns = ([len(t) for t in texts], [r for _, r, _ in out], [n for *_, n in out], [hashlib.sha256(x).hexdigest() for x, *_ in out])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *map(pa.array, columns)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select("id", "text", "pieces", "copies").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeats cut out of the text; a character that is cut in two goes whole.

    ``size_col`` (if there) is brought up to date; all other columns stay as they are.
    """
    found = spans(docs, length, id_col, text_col)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.unhex(F.md5(text)).alias("t"), F.struct("*").alias("doc"), text.alias("text")).join(found, "t", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary()).to_pylist()
            out = [_cut(*x, length)[0] for x in zip(texts, column(batch, "pieces").to_pylist(), column(batch, "copies").to_pylist())]
            kept = pa.array([x.decode("utf-8", "ignore") for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), kept], ["doc", "kept"])

    rest = F.struct(*[F.col("doc")[c].alias(c) for c in docs.columns if c != text_col] or [F.lit(0).alias("none")])
    rows = rows.select(rest.alias("doc"), "text", "pieces", "copies")
    kind = StructType([rows.schema["doc"]]).add("kept", StringType())
    cut = rows.mapInArrow(run, kind)
    made = {text_col: F.col("kept"), size_col: F.char_length("kept").cast("long")}
    return cut.select(*[made[c].alias(c) if c in made else F.col("doc")[c].alias(c) for c in docs.columns])
