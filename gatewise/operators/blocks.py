"""Wide nets as tables: weights in blocks of units, joined to the inputs and summed by aggregates.

``score`` sends the whole net to every executor. Here a net is only ever a table, so its size is not
bounded by what can be broadcast: a tensor is cut into a row per input and block of units, each row
meets the inputs of its number, and the products are added up, first within the task. Spark chooses
by size how the two sides meet; blocks are written once, so that their size is known. What all rows
share (state, bias) is a number per unit and is looked up, as a join by block would bring all rows of a
block to one task. Rows are dealt out by key before they are taken apart, so where blocks are small enough
to be sent, all sums of all layers are made where a row lies, and nothing but the rows is exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.functions.columns import argmax, sigmoid
from gatewise.operators.weights import initial_state_mean
from gatewise.sources.store import cut

# Units of a block; so many sums for each gate stay in generated code.
WIDTH = 8

# Sums of blocks that a task holds in memory, and most tasks that rows are dealt out to; with more, sums spill.
HELD, TASKS = 1 << 17, 10_000

# Gates of a layer in the order of their columns, and the letter of the dense head.
GATES, HEAD = ("f", "i", "o", "c"), ("d",)


def weight_blocks(weights: DataFrame, layer: int, gates: Sequence[str] = GATES) -> DataFrame:
    """``part, i, block`` and an array of a block's weights per gate: a row per input ``i`` and block of a layer.

    ``weights`` has one row per tensor (see :func:`gatewise.average_weights`). A bias is the weight of an
    input of its own, part ``b``.
    """
    keys = [c + g for g in gates for c in "wb"]
    tensors = weights.where((F.col("layer") == layer) & F.col("key").isin(keys) & (F.col("part") != "s"))
    units = F.element_at("shape", -1)
    inputs = F.when(F.size("shape") > 1, F.get("shape", F.lit(0))).otherwise(1)
    rows = tensors.select(F.substring("key", 2, 1).alias("gate"), "part", units.alias("units"), "values", F.explode(F.sequence(F.lit(0), inputs - 1)).alias("i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("units") / WIDTH).cast("int") - 1)).alias("block"))
    first = F.col("i") * F.col("units") + F.col("block") * WIDTH + 1
    rows = rows.select("gate", "part", "i", "block", F.slice("values", first, F.least(F.lit(WIDTH), F.col("units") - F.col("block") * WIDTH)).alias("w"))
    return cut(rows.groupBy("part", "i", "block").agg(*[F.first(F.when(F.col("gate") == g, F.col("w")), True).alias(f"w_{g}") for g in gates]), "blocks")


def products(inputs: DataFrame, blocks: DataFrame, by: Sequence[str], gates: Sequence[str] = GATES) -> DataFrame:
    """``by, block, z_<gate>``: sums over the inputs ``by, part, i, v`` of their values times their weights."""
    met = inputs.join(blocks, ["part", "i"])
    sums = [F.sum(F.col("v") * F.get(f"w_{g}", F.lit(k))).alias(f"{g}{k}") for g in gates for k in range(WIDTH)]
    added = met.groupBy(*by, "block").agg(*sums)
    return added.select(*by, "block", *[F.array_compact(F.array(*[f"{g}{k}" for k in range(WIDTH)])).alias(f"z_{g}") for g in gates])


def vector_inputs(df: DataFrame, by: Sequence[str], vector: Column, part: str) -> DataFrame:
    """A row per number of a vector: ``by, part, i, v``."""
    return df.select(*by, F.lit(part).alias("part"), F.posexplode(vector).alias("i", "v"))


def _by_block(shared: DataFrame, *columns: str) -> Column:
    """Of a table with a row per block of a layer, the columns of a row's ``block``, looked up."""
    blocks = F.map_from_entries(F.collect_list(F.struct("block", F.struct(*columns))))
    shared = shared.agg(blocks.alias("of"), F.sequence(F.lit(0), F.max("block")).alias("numbers"))
    in_order = F.transform("numbers", lambda block: F.element_at("of", block))
    return F.get(shared.select(in_order.alias("blocks")).scalar(), F.col("block"))


def _met(df: DataFrame, shared: DataFrame, *columns: str) -> DataFrame:
    """Inner join by block with what all rows of a layer share."""
    df = df.withColumn("_shared", _by_block(shared, *columns)).where("_shared IS NOT NULL")
    return df.withColumns({c: F.col(f"_shared.{c}") for c in columns}).drop("_shared")


def layer_gates(weights: DataFrame, layer: int, inputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, block, z_f, z_i, z_o, z_c``: pre-activations of a layer that starts from its learned state.

    State and bias are the same for all rows; what they add is summed once.
    """
    blocks = weight_blocks(weights, layer)
    hidden = initial_state_mean(weights.where((F.col("layer") == layer) & (F.col("key") == "h0")))
    bias = weights.sparkSession.range(1).select(F.lit("b").alias("part"), F.lit(0).alias("i"), F.lit(1.0).alias("v"))
    same = products(vector_inputs(hidden, [], F.col("state"), "h").unionByName(bias), blocks, [])
    same = same.withColumnsRenamed({f"z_{g}": f"s_{g}" for g in GATES})
    z = _met(products(inputs, blocks, by), same, *[f"s_{g}" for g in GATES])
    return z.select(*by, "block", *[F.zip_with(f"z_{g}", f"s_{g}", lambda a, b: a + b).alias(f"z_{g}") for g in GATES])


def layer_outputs(weights: DataFrame, layer: int, inputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hidden outputs of a layer as inputs of the next: ``by, part, i, v``."""
    cell = initial_state_mean(weights.where((F.col("layer") == layer) & (F.col("key") == "c0")))
    cell = vector_inputs(cell, [], F.col("state"), "s").groupBy(F.floor(F.col("i") / WIDTH).cast("int").alias("block"))
    cell = cell.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("c"))
    z = _met(layer_gates(weights, layer, inputs, by), cell, "c")
    units = F.arrays_zip("z_f", "z_i", "z_o", "z_c", "c")

    def hidden(u: Column) -> Column:
        return sigmoid(u["z_o"]) * F.tanh(sigmoid(u["z_f"]) * u["c"] + sigmoid(u["z_i"]) * F.tanh(u["z_c"]))

    out = z.select(*by, "block", F.posexplode(F.transform(units, hidden)).alias("k", "v"))
    return out.select(*by, F.lit("x").alias("part"), (F.col("block") * WIDTH + F.col("k")).alias("i"), "v")


def _dealt(df: DataFrame, weights: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows by key, as many to a task as it can hold the widest layer of."""
    widest = weights.agg(F.max(F.ceil(F.element_at("shape", -1) / WIDTH))).first()[0] or 1
    tasks = min(-(-df.count() * widest // HELD), TASKS)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *key)


def score_blocks(df: DataFrame, weights: DataFrame, key: Sequence[str], layers: int, features: str = "features") -> DataFrame:
    """``key, logits, prediction`` of each row, by joins and sums alone.

    ``key`` identifies a row, ``layers`` is the number of recurrent layers. The same net as ``score`` with
    ``state='mean'``. A row's logits are put together at the end; they are as many as there are classes.
    """
    key = list(key)
    rows = _dealt(df.select(*key, F.col(features).alias("_features")), weights, key)
    inputs = vector_inputs(rows, key, F.col("_features"), "x")
    for layer in range(layers):
        inputs = layer_outputs(weights, layer, inputs, key)
    blocks = weight_blocks(weights, layers, HEAD)
    logits = products(inputs, blocks.where("part = 'x'"), key, HEAD)
    bias = blocks.where("part = 'b'").select("block", F.col("w_d").alias("bias"))
    logits = _met(logits, bias, "bias").select(*key, "block", F.zip_with("z_d", "bias", lambda a, b: a + b).alias("z"))
    logits = logits.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "z"))), lambda e: e["z"])).alias("logits"))
    return logits.select(*key, "logits", argmax(F.col("logits")).alias("prediction"))
