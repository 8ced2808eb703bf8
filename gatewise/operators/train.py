"""Training job: one replica per chunk, on rows that Spark has put in order."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator, Sequence
from hashlib import md5
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.functions import cell
from gatewise.functions.arrow import matrix
from gatewise.functions.cell import NetSpec
from gatewise.operators.batching import STEP_RULES, order_key, pass_cuts, pass_range, trainable
from gatewise.sources.store import broadcast, new_path, ship

# One tagged row type for everything a replica gives back, so that it trains once.
OUTPUT = (
    "kind string, replica bigint, step bigint, key string, layer int, part string, shape array<int>, "
    "values array<double>, metric string, value double, rows bigint, steps bigint, seconds double, state binary"
)
OUTPUT_ARROW = pa.schema(
    [
        ("kind", pa.string()),
        ("replica", pa.int64()),
        ("step", pa.int64()),
        ("key", pa.string()),
        ("layer", pa.int32()),
        ("part", pa.string()),
        ("shape", pa.list_(pa.int32())),
        ("values", pa.list_(pa.float64())),
        ("metric", pa.string()),
        ("value", pa.float64()),
        ("rows", pa.int64()),
        ("steps", pa.int64()),
        ("seconds", pa.float64()),
        ("state", pa.binary()),
    ]
)

# Rows of one batch that are multiplied at once; larger batches add up their gradients.
PIECE = 1 << 13

# Rows of one part of a pass that is put in order, and bytes of a page that its rows are packed in, about.
PART_ROWS, PAGE_BYTES = 1 << 20, 1 << 13

PAGES = "part int, chunk long, at long, n int, chunk_rows long, features binary, labels binary"

# What a row is told of its place: chunk, pass, steps of the run, rows of the chunk, rank its part of the pass begins at.
PLACE = ("chunk", "pass", "max_steps", "chunk_rows", "begins")


class Round(NamedTuple):
    """What is trained in one job: passes ``first`` to ``until``, or of one pass the ranks ``low`` to ``high`` (None: the end).

    A round of whole passes is ``resident``: its chunks are small enough to be held and put in each pass's order in the task.
    Of a whole-chunk batch ``piece`` rows are multiplied at once.
    """

    first: int
    until: int
    low: int = 0
    high: int | None = None
    resident: bool = False
    piece: int = PIECE


def rounds_of(sizes: np.ndarray, batch_size: int | None, epochs: int, step_rule: str, rows_per_round: int) -> list[Round]:
    """Rounds of at most ``rows_per_round`` rows of a chunk (in whole batches), for chunks of these sizes."""
    if step_rule not in STEP_RULES:
        raise ValueError(f"unknown step rule {step_rule!r}")
    if step_rule == "epochs_x_batch" and batch_size is None:
        raise ValueError("epochs_x_batch needs a batch size")
    unit = batch_size or PIECE
    most = max(1, rows_per_round // unit) * unit
    sizes = np.unique(sizes[sizes >= (batch_size or 1)])
    if not len(sizes):
        return [Round(0, 1, resident=True, piece=PIECE)]
    if batch_size is None:
        # A whole-chunk batch is evaluated by reading it once more after the last update.
        per_pass, needed = sizes, sizes * (epochs + 1)
    else:
        per_pass = sizes // batch_size * batch_size
        needed = per_pass * epochs if step_rule == "full_pass" else np.full(len(sizes), epochs * batch_size**2)
    passes, longest = int((-(-needed // per_pass)).max()), int(sizes.max())
    if longest <= most and (step_rule == "full_pass" or needed.max() >= longest):
        each = max(1, most // longest)
        return [Round(a, min(a + each, passes), resident=True, piece=PIECE) for a in range(0, passes, each)]
    out = []
    for n in range(passes):
        here = int(np.minimum(per_pass, needed - n * per_pass).max())
        whole = int(per_pass[needed > n * per_pass].max())
        for low in range(0, here, most):
            high = low + most if low + most < here else here if here < whole else None
            out.append(Round(n, n + 1, low, high, piece=PIECE))
    return out


def order_of(now: Round, batch_size: int | None, uneven: bool = False) -> int:
    """The pass whose order a round's rows come in: its own, or the first where a chunk is one batch, as a sum has no order.

    ``uneven`` chunks don't hold as many rows as ``chunk_rows`` says (equal rows lie on both sides of a cut), so that
    the order tells which rows are summed.
    """
    return now.first if batch_size or uneven else 0


def training_rows(
    chunked: DataFrame,
    batch_size: int | None,
    num_partitions: int,
    now: Round,
    ids: Sequence[str] = ("row_id",),
    seed: int = 42,
    epochs: int = 1,
    step_rule: str = "full_pass",
    ties: Sequence[str] = (),
    states: DataFrame | None = None,
    cuts: dict[tuple[int, int], DataFrame] | None = None,
) -> DataFrame:
    """The rows of one round, those of a chunk in one partition and in order.

    Rows are exchanged once, to the partition of their chunk's number, so chunks share a task only where
    there are more of them than partitions. In a round of whole passes a row comes once, in the order of its
    id, with the text its order keys are made from; of a part of a pass only that part's rows are exchanged,
    and come in the order of the pass. A state (``replica, state``) that a replica is to go on from comes as
    the first row of its chunk. ``cuts`` keeps the places that passes are cut at, as the next round begins
    where this one ends.
    """
    rows = trainable(chunked, batch_size or 1)
    cuts = {} if cuts is None else cuts
    max_steps, _ = pass_range(batch_size, epochs, step_rule)
    rows = rows.withColumn("max_steps", max_steps)
    if now.resident:
        key = F.concat_ws(":", F.lit(""), *[F.col(c).cast("string") for c in ids])
        rows, order = rows.withColumn("_key", key), [*ids, *ties]
    else:
        in_pass, place = F.lit(now.first), F.struct("_h", *ids, *ties)
        rows = rows.withColumn("pass", in_pass).withColumn("_h", order_key(seed, ids)).withColumn("_key", F.lit(None).cast("string"))
        order = ["_h", *ids, *ties]
        for rank in (now.low, now.high):
            if rank and (now.first, rank) not in cuts:
                cuts[now.first, rank] = pass_cuts(trainable(chunked, batch_size or 1), in_pass, lambda n: rank, ids, seed, ties, num_partitions)
        if now.high is not None:
            end = F.broadcast(cuts[now.first, now.high])
            rows = rows.join(end, "chunk", "left").where(F.col("cut").isNull() | (place < F.col("cut"))).drop("cut")
        if now.low:
            rows = rows.join(F.broadcast(cuts[now.first, now.low]), "chunk").where(place >= F.col("cut")).drop("cut")
    rows = rows.withColumn("_state", F.lit(None).cast("binary"))
    if states is not None:
        begun = states.select(F.col("replica").alias("chunk"), F.col("state").alias("_state"))
        rows = rows.unionByName(begun, allowMissingColumns=True)
    rows = rows.repartitionById(num_partitions, F.col("chunk").cast("int"))
    rows = rows.sortWithinPartitions("chunk", F.col("_state").isNull(), *order)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("max_steps", "chunk_rows")})
    place = [F.lit(now.first).alias("pass"), "max_steps", "chunk_rows", F.lit(now.low).cast("long").alias("begins")]
    return rows.select("chunk", *place, "features", "label", "_key", "_state")


class Pages(NamedTuple):
    """One pass in the order of its rows, written in ``parts`` that are runs of that order.

    ``parts`` has ``part, chunk, first, rows``: the rank, in its chunk, of the first row that a part holds of a chunk, and their number.
    """

    number: int
    path: str
    parts: list[tuple[int, int, int, int]]

    def rows(self) -> dict[int, int]:
        """Rows that each chunk holds."""
        out: dict[int, int] = {}
        for _, chunk, _, n in self.parts:
            out[chunk] = out.get(chunk, 0) + n
        return out


def ordered_pages(
    chunked: DataFrame,
    spec: NetSpec,
    in_pass: int,
    total: int,
    ids: Sequence[str] = ("row_id",),
    seed: int = 42,
    ties: Sequence[str] = (),
    cap: int | None = None,
    num_chunks: int = 256,
) -> Pages:
    """Puts a pass in order once, so that each of its rounds reads no more than its own rows.

    The whole order is cut into ranges, whatever chunks they lie in, and each is written as pages: some rows'
    features and labels as numbers. Rows of a chunk from rank ``cap`` on are left out.
    """
    rows = trainable(chunked, spec.batch_size or 1)
    if cap is not None:
        end = F.broadcast(pass_cuts(rows, F.lit(in_pass), lambda n: cap, ids, seed, ties, num_chunks))
    rows = rows.withColumn("pass", F.lit(in_pass)).withColumn("_h", order_key(seed, ids))
    if cap is not None:
        rows = rows.join(end, "chunk", "left").where(F.col("cut").isNull() | (F.struct("_h", *ids, *ties) < F.col("cut")))
    # Chunk and hash are one run of bytes, as a sort looks at whole rows only where the first eight bytes are equal.
    rows = rows.withColumn("_h", F.unhex(F.concat(F.lpad(F.hex("chunk"), 8, "0"), "_h")))
    order = ["_h", *ids, *ties]
    rows = rows.select(*dict.fromkeys([*order, "chunk", "chunk_rows", "features", "label"]))
    rows = rows.repartitionByRange(max(1, -(-total // PART_ROWS)), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, most = TaskContext.get().partitionId(), max(1, PAGE_BYTES // (8 * spec.in_features + 4))
        place, at, x, y = None, 0, None, ()

        def pages(end: int) -> Iterator[pa.RecordBatch]:
            starts = range(0, end, most)
            if starts:
                cuts = [(k, min(k + most, end)) for k in starts]
                n, whole = len(cuts), np.ones(len(cuts), np.int64)
                columns = [
                    pa.array((whole * part).astype(np.int32)), pa.array(whole * place[0]), pa.array(np.array(starts) + at),
                    pa.array(np.array([b - a for a, b in cuts], np.int32)), pa.array(whole * place[1]),
                    pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([y[a:b].tobytes() for a, b in cuts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "at", "n", "chunk_rows", "features", "labels"])

        for batch in batches:
            if not len(batch):
                continue
            features, labels = _examples(batch, spec)
            features, labels = features.astype("<f8", copy=False), labels.astype("<i4")
            for a, b, here in _runs([batch.column(c).to_numpy() for c in ("chunk", "chunk_rows")]):
                if here == place:
                    x, y = np.concatenate([x, features[a:b]]), np.concatenate([y, labels[a:b]])
                else:
                    yield from pages(len(y))
                    place, at, x, y = here, 0, features[a:b], labels[a:b]
            whole = len(y) - len(y) % most
            yield from pages(whole)
            at, x, y = at + whole, x[whole:], y[whole:]
        yield from pages(len(y))

    path, spark = new_path(chunked.sparkSession, "pass"), chunked.sparkSession
    narrow = rows.select("chunk", "chunk_rows", "features", "label")
    ship(spark)
    narrow.mapInArrow(pack, PAGES).write.partitionBy("part").parquet(path)
    counted = spark.read.schema(PAGES).parquet(path).groupBy("part", "chunk").agg(F.sum("n").alias("n")).collect()
    parts, before = [], {}
    for part, chunk, n in sorted(map(tuple, counted)):
        parts.append((part, chunk, before.get(chunk, 0), n))
        before[chunk] = before.get(chunk, 0) + n
    return Pages(in_pass, path, parts)


def page_rows(
    pages: Pages, spark, batch_size: int | None, num_partitions: int, now: Round, epochs: int = 1, step_rule: str = "full_pass",
    states: DataFrame | None = None,
) -> DataFrame:
    """The pages that hold the rows of a round, those of a chunk in one partition and in order, after its state.

    What is read are the parts that the round's ranks lie in.
    """
    parts = [p for p in pages.parts if p[2] + p[3] > now.low and (now.high is None or p[2] < now.high)]
    if parts:
        files = [f"{pages.path}/part={part}" for part in dict.fromkeys(p[0] for p in parts)]
        rows = spark.read.schema(PAGES).option("basePath", pages.path).parquet(*files)
    else:
        rows = spark.createDataFrame([], PAGES)
    first = spark.createDataFrame([p[:3] for p in parts], "part int, chunk long, first long")
    rows = rows.join(F.broadcast(first), ["part", "chunk"]).withColumn("at", F.col("at") + F.col("first"))
    rows = rows.where(F.col("at") + F.col("n") > now.low)
    if now.high is not None:
        rows = rows.where(F.col("at") < now.high)
    max_steps, _ = pass_range(batch_size, epochs, step_rule)
    rows = rows.withColumn("max_steps", max_steps).withColumn("_state", F.lit(None).cast("binary"))
    if states is not None:
        begun = states.select(F.col("replica").alias("chunk"), F.col("state").alias("_state"))
        rows = rows.unionByName(begun, allowMissingColumns=True)
    rows = rows.repartitionById(num_partitions, F.col("chunk").cast("int"))
    rows = rows.sortWithinPartitions("chunk", F.col("_state").isNull(), "at")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("max_steps", "chunk_rows", "at")})
    place = [F.lit(now.first).alias("pass"), "max_steps", "chunk_rows", F.lit(now.low).cast("long").alias("begins")]
    return rows.select("chunk", *place, "at", "n", "features", "labels", "_state")


def states_of(weights: DataFrame) -> DataFrame:
    """``replica, state`` to begin from: one model per replica, a row per replica and tensor."""
    tensors = F.collect_list(F.struct("key", "layer", "part", "shape", "values")).alias("tensors")
    models = weights.groupBy("replica").agg(tensors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[tuple(t.values()) for t in tensors] for tensors in batch.column("tensors").to_pylist()]
            states = [cloudpickle.dumps({"flat": cell.from_rows(row)[1]}) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("replica"), pa.array(states, pa.binary())], ["replica", "state"])

    return models.mapInArrow(run, "replica long, state binary")


def train_replicas(
    chunked: DataFrame,
    spec: NetSpec,
    params: np.ndarray,
    num_partitions: int,
    ids: Sequence[str] = ("row_id",),
    seed: int = 42,
    epochs: int = 1,
    step_rule: str = "full_pass",
    learning_rate: float = 1e-3,
    evaluate_every: int = 10,
    optimizer="adam",
    weight_decay: float = 0.0,
    keep_checkpoints: int | None = None,
    ties: Sequence[str] = (),
    now: Round | None = None,
    states: DataFrame | None = None,
    final: bool = True,
    cuts: dict[tuple[int, int], DataFrame] | None = None,
    pages: Pages | None = None,
) -> DataFrame:
    """Trains one replica per chunk, in the order of ``minibatches``, from ``params`` or its state.

    A task holds the net and the rows of a resident round, or, of a part of a pass, the net and one batch.
    ``keep_checkpoints`` is how many evaluated steps to keep weights of, the last one included; None keeps
    all. What ``now`` covers is trained (by default all passes); unless ``final``, each replica leaves a
    state (net, optimizer, counts, what a batch has added up so far) from which the next round goes on.
    ``pages`` are the pass that ``now`` is a part of, where it has been put in order.
    """
    now = Round(0, 1 << 30, resident=True) if now is None else now
    if pages is None:
        ordered = training_rows(chunked, spec.batch_size, num_partitions, now, ids, seed, epochs, step_rule, ties, states, cuts)
    else:
        ordered = page_rows(pages, chunked.sparkSession, spec.batch_size, num_partitions, now, epochs, step_rule, states)
    make_optimizer = cell.OPTIMIZERS.get(optimizer, optimizer)
    shared = broadcast(chunked.sparkSession, params)

    def replica(chunk: int, pieces: Iterator) -> Iterator[pa.RecordBatch]:
        began = time.perf_counter()
        piece = next(pieces)
        given = cloudpickle.loads(piece[2]) if piece[3] is None else {}
        flat = given["flat"] if given else shared.value.copy()
        grad, more = given.get("grad", np.empty_like(flat)), np.empty_like(flat)
        weights, grads, more_grads = spec.views(flat), spec.views(grad), spec.views(more)
        slots, decayed = slice(0, spec.slots), flat[: spec.decayed()]
        solver = given.get("solver") or make_optimizer(learning_rate)
        kept: deque = deque(given.get("kept", ()), maxlen=keep_checkpoints)
        rows, steps, loss, hits = (given.get(name, 0) for name in ("rows", "steps", "loss", "hits"))
        waiting = given.get("waiting")  # whole-chunk batches: the step whose metrics this pass gives
        for (_, in_pass, max_steps, chunk_rows, _), at, x, y in pieces if given else chain([piece], pieces):
            size = spec.batch_size or chunk_rows
            step = in_pass * (chunk_rows // size) + at // size
            if step >= max_steps and waiting is None:
                continue
            opens, closes = at % size == 0, at % size + len(y) == size
            logits = cell.gradients(weights, grads if opens else more_grads, spec, x, y, slots, 1 / size)
            if not opens:
                grad += more
            if waiting is not None:
                loss, hits = (a + b for a, b in zip((loss, hits), cell.loss_and_hits(logits, y)))
            if not closes:
                continue
            if waiting is not None:
                yield _metrics(chunk, waiting, loss / size, hits / size, _decay(decayed, weight_decay))
                waiting, loss, hits = None, 0, 0
            if step >= max_steps:
                continue
            if weight_decay:
                grad[: len(decayed)] += weight_decay * decayed
            solver.update(flat, grad)
            rows, steps = rows + size, steps + 1
            if step % evaluate_every == 0 or step + 1 == max_steps:
                if spec.batch_size is None:
                    waiting = step
                else:
                    logits, _ = cell.forward(weights, x, cell.states_at(weights, spec, slots))
                    loss_now, hits_now = cell.loss_and_hits(logits, y)
                    yield _metrics(chunk, step, loss_now / size, hits_now / size, _decay(decayed, weight_decay))
                if keep_checkpoints is None:
                    yield _weights(chunk, step, cell.to_rows(weights))
                elif step + 1 == max_steps or keep_checkpoints > 1:
                    kept.append((step, cell.to_rows(weights)))
        seconds = given.get("seconds", 0.0) + time.perf_counter() - began
        if not final:
            left = {"flat": flat, "grad": grad, "solver": solver, "kept": list(kept), "rows": rows, "steps": steps, "loss": loss, "hits": hits, "waiting": waiting, "seconds": seconds}
            yield _batch([{"kind": "state", "replica": chunk, "state": cloudpickle.dumps(left)}])
            return
        for step, tensors in kept:
            yield _weights(chunk, step, tensors)
        yield _batch([{"kind": "runs", "replica": chunk, "rows": rows, "steps": steps, "seconds": seconds}])

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pages is not None:
            pieces = _cut(_unpacked(batches, spec, now), spec, now.piece)
        else:
            pieces = _in_passes(batches, spec, now, seed) if now.resident else _pieces(batches, spec, now.piece)
        for chunk, of_chunk in groupby(pieces, key=lambda piece: piece[0][0]):
            yield from replica(chunk, of_chunk)

    return ordered.mapInArrow(replicas, OUTPUT)


def _examples(batch: pa.RecordBatch, spec: NetSpec) -> tuple[np.ndarray, np.ndarray]:
    if batch.column("label").null_count:
        raise ValueError("null labels; see valid_examples")
    features, labels = matrix(batch.column("features"), spec.in_features), batch.column("label").to_numpy()
    if labels.min() < 0 or labels.max() >= spec.num_classes:
        raise ValueError(f"label outside 0..{spec.num_classes - 1}")
    return features, labels


def _in_passes(batches: Iterator[pa.RecordBatch], spec: NetSpec, now: Round, seed: int):
    """Pieces of whole passes, see :func:`_pieces`: a chunk's rows are kept and put in each pass's order.

    The order is that of ``order_key`` (see :func:`order_of`); rows with equal keys stay in the order they come in.
    """

    def passes(place: tuple, held: list):
        x, y = (np.concatenate(part) for part in list(zip(*held))[:2])
        keys = [key for part in held for key in part[2]]
        chunk, _, max_steps, n, _ = place
        size = spec.batch_size or n
        per_pass = n // size
        last = -(-max_steps // per_pass) + (0 if spec.batch_size else 1)
        for k in range(now.first, min(now.until, last)):
            in_order = order_of(Round(k, k + 1), spec.batch_size, len(keys) != n)
            digests = b"".join(md5(f"{seed}:{in_order}{key}".encode()).digest() for key in keys)
            order = np.lexsort(np.frombuffer(digests, ">u8").reshape(-1, 2).T[::-1])
            unit, end = spec.batch_size or now.piece, per_pass * size
            for at in range(0, end, unit):
                rows = order[at : min(at + unit, end)]
                yield (chunk, k, max_steps, n, 0), at, x[rows], y[rows]

    place, held = None, []
    for batch in _between_states(batches):
        places = [batch.column(c).to_numpy() for c in PLACE]
        state = batch.column("_state")[0].as_py()
        if state is not None:
            if held:
                yield from passes(place, held)
            place, held = None, []
            yield tuple(int(p[0]) for p in places), 0, state, None
            continue
        features, labels = _examples(batch, spec)
        for a, b, here in _runs(places):
            if here != place:
                if held:
                    yield from passes(place, held)
                place, held = here, []
            held.append((features[a:b], labels[a:b], batch.column("_key").slice(a, b - a).to_pylist()))
    if held:
        yield from passes(place, held)


def _pieces(batches: Iterator[pa.RecordBatch], spec: NetSpec, piece: int = PIECE):
    """Cuts ordered rows into ``(place, at, x, y)``, alike for any Arrow batch size.

    ``at`` numbers the first row within its pass. A piece is one batch; rows left
    over at the end of a pass are dropped. Of a whole-chunk batch it is ``piece`` rows.
    A state is a piece of its own: ``(place, 0, state, None)``.
    """
    return _cut(_unpacked(batches, spec), spec, piece)


def _cut(runs, spec: NetSpec, piece: int):
    """Pieces of runs of rows ``(place, x, y)`` and states ``(place, state, None)``."""
    unit = spec.batch_size or piece
    place, at, x, y = None, 0, None, ()
    for here, features, labels in runs:
        if labels is None:
            if len(y) and spec.batch_size is None:
                yield place, at, x, y
            place, at, x, y = None, 0, None, ()
            yield here, 0, features, None
            continue
        if here == place and len(y):
            x, y = np.concatenate([x, features]), np.concatenate([y, labels])
        else:
            if here != place:
                if len(y) and spec.batch_size is None:
                    yield place, at, x, y
                place, at = here, here[-1]
            x, y = features, labels
        whole = len(y) - len(y) % unit
        for k in range(0, whole, unit):
            yield place, at + k, x[k : k + unit], y[k : k + unit]
        at, x, y = at + whole, x[whole:], y[whole:]
    if len(y) and spec.batch_size is None:
        yield place, at, x, y


def _unpacked(batches: Iterator[pa.RecordBatch], spec: NetSpec, paged: Round | None = None):
    """Runs of rows of one place, and states, see :func:`_cut`; ``paged`` is the round whose rows come in pages."""
    for batch in _between_states(batches):
        places = [batch.column(c).to_numpy() for c in PLACE]
        state = batch.column("_state")[0].as_py()
        if state is not None:
            yield tuple(int(p[0]) for p in places), state, None
        elif paged is None:
            features, labels = _examples(batch, spec)
            for a, b, here in _runs(places):
                yield here, features[a:b], labels[a:b]
        else:
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            for a, b, here in _runs(places):
                x = np.concatenate([np.frombuffer(v.as_buffer(), "<f8") for v in batch.column("features")[a:b]]).reshape(-1, spec.in_features)
                y = np.concatenate([np.frombuffer(v.as_buffer(), "<i4") for v in batch.column("labels")[a:b]]).astype(np.int64)
                first, end = int(at[a]), int(at[b - 1] + n[b - 1])
                if len(y) != end - first:
                    raise ValueError(f"pages of chunk {here[0]} don't follow one another")
                stop = end if paged.high is None else min(end, paged.high)
                if spec.batch_size is None:  # a batch has as many rows as the chunk is said to have
                    stop = min(stop, here[3])
                kept = slice(max(0, paged.low - first), max(0, stop - first))
                yield here, x[kept], y[kept]


def _runs(places: list[np.ndarray]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """``begin, end, place`` of the runs of rows of one chunk, which comes first in a place."""
    chunk = places[0]
    starts = np.flatnonzero(np.append(True, np.diff(chunk) != 0))
    for a, b in zip(starts, [*starts[1:], len(chunk)]):
        yield int(a), int(b), tuple(int(p[a]) for p in places)


def _between_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that are one state row, or rows without any."""
    for batch in batches:
        at = 0
        for state in [*np.flatnonzero(batch.column("_state").is_valid().to_numpy(zero_copy_only=False)).tolist(), len(batch)]:
            if state > at:
                yield batch.slice(at, state - at)
            if state < len(batch):
                yield batch.slice(state, 1)
            at = state + 1


def _decay(values: np.ndarray, weight_decay: float) -> float | None:
    return weight_decay * float(values @ values) / 2 if weight_decay else None


def _metrics(chunk, step, cross_entropy, accuracy, decay: float | None) -> pa.RecordBatch:
    values = {"cross_entropy": cross_entropy, "accuracy": accuracy}
    if decay is not None:
        values |= {"weight_decay_loss": decay, "total_loss": cross_entropy + decay}
    return _batch(
        [{"kind": "metrics", "replica": chunk, "step": step, "metric": m, "value": v} for m, v in values.items()]
    )


def _weights(chunk, step, tensors) -> pa.RecordBatch:
    names = ("key", "layer", "part", "shape", "values")
    return _batch([{"kind": "weights", "replica": chunk, "step": step, **dict(zip(names, t))} for t in tensors])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=OUTPUT_ARROW)
