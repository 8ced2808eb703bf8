"""Near-duplicates (operator 10): SuperMinHash signatures, banding, exact verification, components.

1. Each text's set of word shingles gives a SuperMinHash signature: every element walks its own
   random permutation of the slots, and a text stops as soon as no later step can lower a slot.
2. Texts with the same set are one class from here on. Bands of the signature make buckets.
3. Every bucket compares its least member with all others (a star, no pairs within the bucket).
4. Links are confirmed on full sets, and joined to components.
5. In buckets that still hold several components, members whose signatures are alike enough to one of
   another component get their sets. They are compared in full where they meet, in the first band they
   share; of what is linked only what joins two components leaves the task, so a group gives no more
   rows than it has members. Large buckets are dealt out in pairs of blocks, by members and by bytes.

Defined results: null or empty texts, and texts without words, have 0 shingles and no links; a
row without id links with nothing, has no component and is kept; repeated rows are alike and get
the same result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.components import components
from gatewise.llm.groups import deal, each_group
from gatewise.llm.scratch import table, workers
from gatewise.llm.text import Block, blocks, column, distinct, mix, rows_of, shingles

#: Bands and slots of each: of pairs at 0.8, about one in 30,000 shares no band.
BANDS, WIDTH = 26, 5

#: Signatures that agree in fewer slots than this share aren't verified; 0.8 lies over four deviations above.
LIKELY = 0.65

#: Members of a bucket, and bytes of their sets, compared at once in memory; larger buckets are dealt out in pairs of blocks.
MEMBERS, SET_BYTES = 1024, 4 << 20

GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and where each row begins."""
    return distinct(*shingles(block, size))[:2]


def signatures(hashes: np.ndarray, firsts: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each row's set, as integers: the step in the top 8 bits, then 56 random bits.

    Step j of an element's walk has a value in [j, j + 1) for one slot, so once all slots of a row
    are filled no further step can matter and its elements stop.
    """
    n = len(firsts) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * slots, none, np.uint64)
    row = rows_of(firsts)
    seed, walk = hashes, None
    for step in range(slots):
        if not len(seed):
            break
        dice = mix(seed + np.uint64(int(GOLD) * (step + 1) % (1 << 64)))
        to = step + (((dice >> np.uint64(32)) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(step) << np.uint64(56)) | (mix(dice ^ GOLD) >> np.uint64(8))
        if walk is None:
            slot = to
        else:
            every = np.arange(len(seed))
            slot = walk[every, to].astype(np.int64)
            walk[every, to] = walk[every, step]
        np.minimum.at(out, row * slots + slot, value)
        open_rows = (out.reshape(n, slots) == none).any(1)
        goes_on = open_rows[row]
        if walk is None:
            row, seed, to = row[goes_on], seed[goes_on], to[goes_on]
            walk = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(seed), slots)).copy()
            walk[np.arange(len(seed)), to] = 0
        elif not goes_on.all():
            row, seed, walk = row[goes_on], seed[goes_on], walk[goes_on]
    return out.reshape(n, slots)


def band_keys(signature: np.ndarray, bands: int, width: int) -> np.ndarray:
    parts = signature.reshape(-1, bands, width)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, parts.shape[:2]).copy()
    for k in range(width):
        keys = mix(keys ^ parts[:, :, k]) * GOLD
    return keys


def sign(docs: DataFrame, size: int = 5, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """``id, n_shingles, set_key, keys (of bands), sig (a byte per slot)`` of the rows ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                hashes, firsts = shingle_sets(block, size)
                signature = signatures(hashes, firsts, bands * width)
                keys = band_keys(signature, bands, width).astype(np.int64)
                set_keys = [xxhash.xxh3_128_digest(hashes[a:b].data) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
                offsets = pa.array(np.arange(len(block) + 1, dtype=np.int32) * bands)
                low = [x.tobytes() for x in (mix(signature) & np.uint64(255)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "id").slice(block.start, len(block)),
                        pa.array(np.diff(firsts)),
                        pa.array(set_keys, pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                        pa.array(low, pa.binary()),
                    ],
                    ["id", "n_shingles", "set_key", "keys", "sig"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_shingles long, set_key binary, keys array<long>, sig binary")


def overlap(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` per cent of their union. Empty sets share nothing."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)``, those whose full sets overlap enough. ``texts``: ``id, text``."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, np.ndarray] = {}

        def sets(texts: list[str]) -> list[np.ndarray]:
            new = [t for t in dict.fromkeys(texts) if t not in last]
            found = {}
            for block in blocks(pa.array(new, pa.large_string())):
                hashes, firsts = shingle_sets(block, size)
                found |= {new[block.start + k]: hashes[firsts[k] : firsts[k + 1]] for k in range(len(block))}
            out = [found[t] if t in found else last[t] for t in texts]
            last.clear()
            last[texts[-1]] = out[-1]
            return out

        for batch in batches:
            for at in range(0, len(batch), 16):
                piece = batch.slice(at, 16)
                both = sets(column(piece, "text_b").to_pylist() + column(piece, "text_a").to_pylist())
                linked = [overlap(x, y, percent) for x, y in zip(both[: len(piece)], both[len(piece) :])]
                yield piece.select(["a", "b"]).filter(pa.array(linked))

    kind = pairs.schema["a"].dataType.simpleString()
    return table(joined.mapInArrow(run, f"a {kind}, b {kind}").distinct(), "links")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """``id, elements`` (sorted hashes, as bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(column(batch, "text")):
                hashes, firsts = shingle_sets(block, size)
                elements = [hashes[a:b].tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(block.start, len(block)), pa.array(elements, pa.binary())], ["id", "elements"])

    return texts.mapInArrow(run, "id long, elements binary")


def _meeting(group: pa.Table, bands: int, width: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``x, ys, parts``: for each member of a group the members of other components it may be linked with, likest first.

    ``parts`` are the components, which the caller may join as it goes.
    """
    parts, n, block = (group[c].to_numpy() for c in ("component", "n_shingles", "block"))
    parts = parts.copy()
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(n), bands * width)
    keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(len(n), bands)
    i, j, number = (group[c][0].as_py() for c in ("block_i", "block_j", "number"))
    cols = np.flatnonzero(block == j)
    for x in np.flatnonzero(block == i):
        ys = cols[parts[cols] != parts[x]]
        ys = ys[ys > x] if i == j else ys
        ys = ys[100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x])]
        if not len(ys):
            continue
        alike = (sig[ys] == sig[x]).sum(1)
        # A pair that meets in several bands is compared in the first of them, told by the keys it meets by.
        chosen = np.flatnonzero((alike >= LIKELY * bands * width) & ((keys[ys] == keys[x]).argmax(1) == number))
        if len(chosen):
            yield int(x), ys[chosen[np.argsort(-alike[chosen], kind="stable")]], parts


def _dealt(members: DataFrame, *more: str) -> DataFrame:
    """Groups of a bucket or two blocks of it, one after the other in a partition."""
    place = ["band", "block_i", "block_j"]
    dealt = members.select(*place, "number", "block", "id", "component", "n_shingles", "sig", "keys", *more)
    return dealt.repartition(*place).sortWithinPartitions(*place)


def with_partners(members: DataFrame, bands: int, width: int, percent: int) -> DataFrame:
    """``band, id`` of the members that signatures give a likely partner in another component.

    ``members``: ``band, number (of the band), size, id, component, n_shingles, sig, keys (of all bands)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in each_group(batches, ["band", "block_i", "block_j"]):
            met = np.zeros(len(group), bool)
            for x, ys, _ in _meeting(group, bands, width, percent):
                met[x] = met[ys] = True
            if met.any():
                found = group.select(["band", "id"]).filter(pa.array(met))
                yield from found.to_batches()

    return _dealt(deal(members, "id", F.ceil(F.col("size") / MEMBERS))).mapInArrow(run, "band long, id long").distinct()


def cross_links(members: DataFrame, sets: DataFrame, bands: int, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between components within each bucket, as many as join them.

    Members whose signatures show no partner have gone before the sets, ``id, elements``, come in; what
    is left of a bucket is dealt out in blocks of ``SET_BYTES``.
    """
    some = table(members.join(with_partners(members, bands, width, percent), ["band", "id"]), "likely-members")
    sizes = some.groupBy("band").agg(F.sum(8 * F.col("n_shingles")).alias("bytes"))
    some = some.join(sizes, "band").join(sets.join(some.select("id").distinct(), "id", "left_semi"), "id")
    some = deal(some, "id", F.ceil(F.greatest(F.col("bytes") / SET_BYTES, F.col("size") / MEMBERS)))

    def of_group(group: pa.Table) -> list[tuple[int, int]]:
        ids, elements, out = group["id"].to_numpy(), group["elements"].combine_chunks(), []
        whole = lambda k: np.frombuffer(elements[k].as_buffer(), np.uint64)
        for x, ys, parts in _meeting(group, bands, width, percent):
            own = whole(x)
            for y in ys.tolist():
                if parts[y] != parts[x] and overlap(own, whole(y), percent):
                    out.append((int(ids[x]), int(ids[y])))
                    parts[parts == parts[y]] = parts[x]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in each_group(batches, ["band", "block_i", "block_j"]):
            if found := of_group(group):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b"])

    return _dealt(some, "elements").mapInArrow(run, "a long, b long").distinct()


def near_links(signed: DataFrame, texts: DataFrame, size: int, percent: int, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """``node, component`` of the classes of ``signed`` that have links. Class ids are longs."""
    slots = bands * width
    reps = table(
        signed.where("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sig").alias("sig")),
        "classes",
    )
    members = reps.select("id", "n_shingles", F.posexplode("keys").alias("number", "band"))
    buckets = members.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = table(members.join(buckets.hint("merge"), "band"), "bucket-members")
    sized = reps.select(F.col("id").alias("hub"), F.col("n_shingles").alias("hub_n"))
    stars = crowded.where("id <> hub").select(F.col("hub"), F.col("id").alias("b"), F.col("n_shingles").alias("n")).distinct().join(sized, "hub")
    stars = stars.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    tested = table(_likely(stars.select(F.col("hub").alias("a"), "b").distinct(), reps, slots), "pairs")
    # Texts move once, here; what follows reads those of buckets only.
    wanted = crowded.select("id").distinct()
    held = table(texts.join(wanted.hint("merge"), "id"), "candidate-texts")
    found = components(verify(tested, held, size, percent))

    several = crowded.where("size > 2").join(found.withColumnRenamed("node", "id"), "id", "left")
    several = table(several.withColumn("component", F.coalesce("component", "id")), "labelled-members")
    mixed = several.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    several = several.join(mixed, "band")
    several = several.join(reps.select("id", "sig", "keys"), "id").select("band", "number", "size", "id", "component", "n_shingles", "sig", "keys")
    more = cross_links(several, _sets(held, size), bands, width, percent)
    return merged(found, table(more, "cross-links"))


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components after ``more`` links ``a, b``: the few components they join are joined, and their members follow."""
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = more.join(label("a"), "a", "left").join(label("b"), "b", "left")
    joined = components(between.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = found.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return moved.unionByName(joined.select(F.col("component").alias("node"), F.col("least").alias("component")))


def _likely(pairs: DataFrame, reps: DataFrame, slots: int) -> DataFrame:
    """Pairs whose signatures agree in enough slots."""
    sig = reps.select("id", "sig")
    joined = pairs.join(sig.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b").join(sig.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(-1, slots) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= LIKELY * slots))

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_shingles, component_id, kept`` of each row.

    Texts are linked if the sets of their ``size``-word shingles share ``percent`` per cent of
    their union; a text with fewer words is one shingle. A component keeps its smallest id.
    """
    workers(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    signed = table(sign(rows, size), "signed")
    texts = rows.where("id IS NOT NULL AND text IS NOT NULL")
    found = near_links(signed, texts, size, percent)
    classes = signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("node"))
    classes = classes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("least"))
    linked = signed.select("id", "n_shingles", "set_key").where("n_shingles > 0 AND id IS NOT NULL").join(classes, "set_key")
    alone = signed.where("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("least"))
    out = linked.select("id", "n_shingles", "least").unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("least"), F.lit(True))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("least").cast(kind).alias("component_id"), kept.alias("kept"))


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows without id stay."""
    gone = near_dedup(docs, size, percent, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
