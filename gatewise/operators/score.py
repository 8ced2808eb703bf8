"""Scoring of rows and of per-key sequences with broadcast weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewise.functions import cell
from gatewise.functions.arrow import lists, matrix
from gatewise.sources.store import broadcast, new_path

# A model is collected and broadcast whole; its size is set by the net, and checked.
MAX_PARAMETERS = 1 << 26

STATES = ("mean", "zero", "slot")


@dataclass(frozen=True)
class Model:
    """A net and its flat parameter vector."""

    spec: cell.NetSpec
    flat: np.ndarray

    @classmethod
    def load(cls, weights: DataFrame) -> Model:
        """Collects a weights table holding one row per tensor (see ``average_weights``)."""
        rows, doubles = weights.agg(F.count(F.lit(1)), F.sum(F.size("values"))).first()
        if not rows or doubles > MAX_PARAMETERS:
            raise ValueError(f"not one model: {rows} tensors, {doubles} values")
        tensors = weights.select("key", "layer", "part", "shape", "values").collect()
        if len({t[:3] for t in tensors}) != len(tensors):
            raise ValueError("several rows for one tensor; average or filter first")
        return cls(*cell.from_rows(tensors))

    def params(self) -> dict:
        return self.spec.views(self.flat)

    def start(self, state: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Initial ``(h, C)`` per layer: slot mean or zeros (one row), or all slots."""
        if state not in STATES:
            raise ValueError(f"unknown state policy {state!r}")
        states = cell.states_at(self.params(), self.spec, slice(None))
        if state == "mean":
            return [(h.mean(axis=0, keepdims=True), c.mean(axis=0, keepdims=True)) for h, c in states]
        return states if state == "slot" else [(0.0 * h[:1], 0.0 * c[:1]) for h, c in states]


def score(
    df: DataFrame, model: Model, keep: Sequence[str] | None = None, features: str = "features", state: str = "mean"
) -> DataFrame:
    """Adds ``logits`` and ``prediction`` to each row; rows never move between tasks.

    The learned initial state belongs to batch slots: ``state`` is ``'mean'`` over
    slots, ``'zero'``, or ``'slot'`` to look it up by the row's ``slot`` column.
    """
    keep = [c for c in df.columns if c != features] if keep is None else list(keep)
    shared = broadcast(df.sparkSession, (model, model.start(state)))
    extra = [F.col("slot").cast("long").alias("_slot")] if state == "slot" else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, start = shared.value
        params = model.params()
        for batch in batches:
            at = batch.column("_slot").to_numpy() if state == "slot" else slice(None)
            x = matrix(batch.column("_x"), model.spec.in_features)
            logits, _ = cell.forward(params, x, [(h[at], c[at]) for h, c in start])
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, lists(logits), pa.array(logits.argmax(axis=1))], [*keep, "logits", "prediction"]
            )

    source = df.select(*keep, F.col(features).alias("_x"), *extra)
    return source.mapInArrow(run, _schema(df, keep) + "logits array<double>, prediction bigint")


def score_sequences(
    df: DataFrame,
    model: Model,
    key: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str] = (),
    features: str = "features",
    advance: Column | None = None,
    emit: str = "all",
    state: str = "mean",
) -> DataFrame:
    """Runs the net along each key's rows in ``order``, carrying ``(h, C)``.

    Rows where ``advance`` is false leave the state as it is and give the last
    stored output. ``emit='last'`` gives one row per key. Adds ``t, hidden, logits,
    prediction``. Null is a key like others.

    Rows are dealt out by ranges of (key, order), so a key of any number of rows is spread over
    as many tasks as its share of the rows. A first job scores all sequences that begin inside a
    range. The rows a range begins with may go on with the key of the range before; they are scored
    in rounds, each of which takes up the states that ranges before have left. A key over n ranges
    takes n rounds, which are of those rows alone.
    """
    if emit not in ("all", "last"):
        raise ValueError(f"unknown emit rule {emit!r}")
    key, spark = list(key), df.sparkSession
    out = [*key, *[c for c in keep if c not in key]]
    rows = df.select(
        *out,
        *[c for c in order if c not in out],
        F.col(features).alias("_x"),
        (F.lit(True) if advance is None else F.coalesce(advance, F.lit(False))).alias("_advance"),
    )
    schema = _schema(df, out) + _WALKED
    shared = broadcast(spark, (model, model.start(state)))
    path = new_path(spark, "sequences")
    ranged = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).select(*out, "_x", "_advance")
    walked = ranged.mapInArrow(_first_walk(shared, key, out, emit), schema)
    walked.write.partitionBy("_kind", "_part").parquet(f"{path}/0")
    stored = spark.read.schema(schema).parquet(f"{path}/0")
    begun, edges = stored.where("_kind = 'raw'"), stored.where("_kind = 'edge'")

    # Which ranges go on with the key of the one before, and which hold one key alone; a row per range.
    first = begun.where("_seq = 0").select("_part", F.struct(*key).alias("first"))
    ends = edges.select("_part", F.struct(*key).alias("last"), F.col("_state").isNull().alias("single"))
    before = F.lag("last").over(Window.orderBy("_part"))
    ends = ends.join(first, "_part").withColumn("goes_on", F.coalesce(before.eqNullSafe(F.col("first")) & before.isNotNull(), F.lit(False)))
    ranges = sorted(map(tuple, ends.select("_part", "single", "goes_on").collect()))
    single = {part for part, alone, _ in ranges if alone}
    turns, open_ended, last = {}, set(), None
    for part, _, goes_on in ranges:
        if goes_on:
            open_ended.add(last)
        turns[part] = turns[last] + 1 if goes_on and last in single else 1
        last = part
    follows = {b[0]: a[0] for a, b in zip(ranges, ranges[1:]) if b[2]}

    states, done = edges, [stored.where("_kind = 'done'")]
    for turn in range(1, max(turns.values(), default=0) + 1):
        now = [part for part in turns if turns[part] == turn]
        given = spark.createDataFrame([(follows[part], part) for part in now if part in follows], "_before int, _now int")
        given = states.join(F.broadcast(given), states["_part"] == given["_before"]).drop("_part", "_before").withColumnRenamed("_now", "_part")
        some = begun.where(F.col("_part").isin(now)).unionByName(given.withColumn("_seq", F.lit(-1).cast("long")))
        some = some.repartition("_part").sortWithinPartitions("_part", "_seq").select(*out, "_x", "_advance", "t", "_state", "_seq", "_part")
        some.mapInArrow(_next_walk(shared, out, emit, single), schema).write.partitionBy("_kind").parquet(f"{path}/{turn}")
        stored = spark.read.schema(schema).parquet(f"{path}/{turn}")
        states = stored.where("_kind = 'edge'")
        done.append(stored.where("_kind = 'done'"))
    scored = reduce(DataFrame.unionByName, done)
    if emit == "last":
        scored = scored.where(~F.col("_tail") | ~F.col("_part").isin(sorted(open_ended)))
    return scored.select(*out, "t", "hidden", "logits", "prediction")


# What a walk gives for each row, beside the columns that are kept: scored rows ("done"), rows still to be
# scored ("raw") and the state at the end of a range ("edge").
_WALKED = (
    "t bigint, hidden array<double>, logits array<double>, prediction bigint, _x array<double>, _advance boolean, "
    "_state array<double>, _seq bigint, _tail boolean, _kind string, _part int"
)


class _Walk:
    """The net on its way along sorted rows: the state of the sequence it is in, and how many rows that had."""

    def __init__(self, shared, out: list[str], emit: str, part: int):
        self.model, self.start = shared.value
        self.params, self.out, self.emit, self.part = self.model.params(), out, emit, part
        self.reset()
        self.pending = None

    def reset(self) -> None:
        self.carried, self.t = np.concatenate([v[0] for pair in self.start for v in pair]), 0

    def rows(self, batch: pa.RecordBatch, opens: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Scores rows; ``opens`` marks those a sequence begins with."""
        if opens[0] and self.pending is not None:
            yield self.pending
        x, top, n = matrix(batch.column("_x"), self.model.spec.in_features), len(self.start), len(batch)
        moves = batch.column("_advance").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, opens[1:]))
        begin = [(np.repeat(h, len(first), axis=0), np.repeat(c, len(first), axis=0)) for h, c in self.start]
        t = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        if not opens[0]:
            _set(begin, 0, self.carried)
            t[: first[1] if len(first) > 1 else n] += self.t
        hidden, end = _walk(self.params, begin, first, x, moves)
        self.carried, self.t = np.concatenate([v[-1] for pair in end for v in pair]), int(t[-1]) + 1
        picked = np.append(opens[1:], True) if self.emit == "last" else np.ones(n, bool)
        batch, hidden, t = batch.filter(pa.array(picked)), hidden[picked], t[picked]
        logits = hidden @ self.params["wd", top] + self.params["bd", top]
        scored = _walked(batch, self.out, "done", self.part, t=pa.array(t), hidden=lists(hidden), logits=lists(logits), prediction=pa.array(logits.argmax(axis=1)))
        if self.emit == "all":
            yield scored
        else:  # whether the last row ends its sequence, the next one tells
            self.pending = scored.slice(len(scored) - 1)
            yield scored.slice(0, len(scored) - 1)

    def end(self, tail: bool) -> Iterator[pa.RecordBatch]:
        """The row held back, marked if the sequence may go on elsewhere."""
        if self.pending is not None:
            at = self.pending.schema.get_field_index("_tail")
            yield self.pending.set_column(at, "_tail", pa.array([tail]))
        self.pending = None


def _walked(batch: pa.RecordBatch, out: list[str], kind: str, part: int, **given: pa.Array) -> pa.RecordBatch:
    """Rows of one kind; columns that aren't given are null."""
    n, numbers = len(batch), pa.list_(pa.float64())
    types = {
        "t": pa.int64(), "hidden": numbers, "logits": numbers, "prediction": pa.int64(), "_x": numbers, "_advance": pa.bool_(),
        "_state": numbers, "_seq": pa.int64(),
    }
    columns = [given.get(c, pa.nulls(n, kind_)) for c, kind_ in types.items()]
    columns += [pa.array([False] * n, pa.bool_()), pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32())]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *columns], [*out, *types, "_tail", "_kind", "_part"])


def _first_walk(shared, key: list[str], out: list[str], emit: str):
    """Job over one range: scores the sequences that begin in it, hands on the rows before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(shared, out, emit, TaskContext.get().partitionId())
        before, seq, leads, last = None, 0, True, None
        for batch in batches:
            if not len(batch):
                continue
            opens = _changes(batch, key, before)
            before, last, a = batch.slice(len(batch) - 1), batch.slice(len(batch) - 1), 0
            if leads:
                found = np.flatnonzero(opens[1 if seq == 0 else 0 :]) + (seq == 0)
                a = int(found[0]) if len(found) else len(batch)
                raw = batch.slice(0, a)
                yield _walked(raw, out, "raw", walk.part, _x=raw.column("_x"), _advance=raw.column("_advance"), _seq=pa.array(np.arange(seq, seq + a)))
                seq, leads = seq + a, a == len(batch)
            if a < len(batch):
                yield from walk.rows(batch.slice(a), opens[a:])
        if last is not None:
            yield from walk.end(True)
            state = [None if leads else walk.carried]
            yield _walked(last, out, "edge", walk.part, t=pa.array([walk.t]), _state=pa.array(state, pa.list_(pa.float64())))

    return run


def _next_walk(shared, out: list[str], emit: str, single: set[int]):
    """Job over the first sequences of ranges, one after the other, each behind the state it goes on from, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = last = None

        def close() -> Iterator[pa.RecordBatch]:
            yield from walk.end(walk.part in single)
            yield _walked(last, out, "edge", walk.part, t=pa.array([walk.t]), _state=pa.array([walk.carried], pa.list_(pa.float64())))

        for batch in batches:
            part = batch.column("_part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:]):
                rows = batch.slice(a, b - a)
                if not len(rows):
                    continue
                opens = np.zeros(len(rows), bool)
                if walk is None or part[a] != walk.part:
                    if walk is not None:
                        yield from close()
                    walk, opens[0] = _Walk(shared, out, emit, int(part[a])), True
                if rows.column("_seq")[0].as_py() < 0:
                    walk.carried, walk.t = np.array(rows.column("_state")[0].as_py()), rows.column("t")[0].as_py()
                    rows, opens = rows.slice(1), np.zeros(len(rows) - 1, bool)
                    last = batch.slice(a, 1)
                if len(rows):
                    last = rows.slice(len(rows) - 1)
                    yield from walk.rows(rows, opens)
        if walk is not None:
            yield from close()

    return run


def _changes(batch: pa.RecordBatch, key: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row's key is another than that of the row before; null and NaN are like themselves."""
    out = np.zeros(len(batch), bool)
    out[0] = before is None
    for c in key:
        column = batch.column(c)
        if before is not None:
            column = pa.concat_arrays([before.column(c), column])
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            differs = np.array([x != y for x, y in zip(values, values[1:])], bool)
        else:
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            if pa.types.is_floating(column.type):
                differs = differs & ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
            differs = differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        out[len(out) - len(differs) :] |= differs
    return out


def _set(states: list, run: int, vector: np.ndarray) -> None:
    """Writes one run's state, stored as one vector ``h C h C ...``, into the arrays per layer."""
    at = 0
    for pair in states:
        for array in pair:
            array[run] = vector[at : at + array.shape[1]]
            at += array.shape[1]


def _walk(params: dict, begin: list, first: np.ndarray, x: np.ndarray, moves: np.ndarray):
    """Steps the runs that start at rows ``first`` side by side; returns top outputs and end states."""
    length = np.diff(np.append(first, len(x)))
    longest_first = np.argsort(-length, kind="stable")
    first, length = first[longest_first], length[longest_first]

    # Rows by step, then run: step d takes the first active[d] runs, rows end[d]-active[d]..end[d].
    steps = np.arange(length[0])
    active = len(length) - np.searchsorted(length[::-1], steps, side="right")
    end = np.cumsum(active)
    by_step = first[np.arange(len(x)) - np.repeat(end - active, active)] + np.repeat(steps, active)
    still = ~moves[by_step]
    waits = np.logical_or.reduceat(still, end - active).tolist()
    spans = list(zip((end - active).tolist(), end.tolist(), active.tolist(), waits))

    x, ends = x[by_step], []
    for n, (h, c) in enumerate(begin):
        h, c = h[longest_first], c[longest_first]
        z, recurrent = x @ params["wx", n] + params["b", n], params["wh", n]
        x = np.empty((len(x), h.shape[1]))
        for a, b, k, wait in spans:
            step = z[a:b]
            step += h[:k] @ recurrent
            _, cell_state, _, hidden = cell.cell_step(step, c[:k])
            if wait:
                stay = still[a:b]
                hidden[stay], cell_state[stay] = h[:k][stay], c[:k][stay]
            h[:k], c[:k] = hidden, cell_state
            x[a:b] = hidden
        back = np.argsort(longest_first)
        ends.append((h[back], c[back]))
    top = np.empty_like(x)
    top[by_step] = x
    return top, ends


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)
