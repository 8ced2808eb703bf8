"""Column functions on feature, logit and weight arrays. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(*cols: Column | str) -> Column:
    """Numeric columns as one ``array<double>``."""
    return F.array(*[_col(c).cast("double") for c in cols])


def slice_vector(values: Column | str, length: int, scale: float = 1.0) -> Column:
    """First ``length`` elements as doubles, times ``scale``."""
    return F.array(*[F.get(_col(values), F.lit(i)).cast("double") * F.lit(scale) for i in range(length)])


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_sum_exp(logits: Column) -> Column:
    """``ln(sum(exp(l)))``, shifted by the maximum so that it cannot overflow."""
    top = F.array_max(logits)
    return F.ln(F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))) + top


def class_id(logits: Column, label: Column) -> Column:
    """The label as an integer; the job stops at one that is null or no class."""
    said = F.concat(F.lit("label outside the classes: "), F.coalesce(label.cast("string"), F.lit("null")))
    known = label.isNotNull() & (label >= 0) & (label < F.size(logits))
    return F.when(known, label.cast("int")).otherwise(F.raise_error(said).cast("int"))


def softmax_xent_sparse(logits: Column, label: Column) -> Column:
    """Cross-entropy of one row against a class id."""
    return log_sum_exp(logits) - F.get(logits, class_id(logits, label))


def softmax_xent_dense(logits: Column, target: Column) -> Column:
    """Cross-entropy of one row against a probability (one-hot) vector."""
    norm = log_sum_exp(logits)
    terms = F.zip_with(target, logits, lambda y, v: y * (norm - v))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def one_hot(label: Column, num_classes: int) -> Column:
    return F.array(*[F.when(label == c, F.lit(1.0)).otherwise(F.lit(0.0)) for c in range(num_classes)])


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def l2_loss(values: Column) -> Column:
    """Half the sum of squares of one tensor."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v) / 2


# The recurrent cell as columns. Written out term by term, a small net stays in
# generated code; ``operators.score`` is the job for whole nets, ``operators.blocks``
# for layers of any width.


def affine(inputs: Sequence[Column], weights: Sequence[Sequence[float]], bias: Sequence[float]) -> list[Column]:
    """``inputs . weights + bias`` with ``weights[i][j]`` from input i to unit j, a column per unit."""
    out = []
    for j, b in enumerate(bias):
        z = F.lit(float(b))
        for x, row in zip(inputs, weights):
            z = z + x * F.lit(float(row[j]))
        out.append(z)
    return out


def gate_preactivation(x, h, wx, wh, bias, activation=None) -> list[Column]:
    """One gate: ``activation(h.Wh + x.Wx + b)``, per hidden unit."""
    z = affine([*x, *h], [*wx, *wh], bias)
    return [activation(v) for v in z] if activation else z


def lstm_gates(x, h, gates) -> dict[str, list[Column]]:
    """Forget, input, candidate and output gates, all from the old hidden state.

    ``gates`` maps ``f i c o`` to ``(wx, wh, bias)``.
    """
    return {
        q: gate_preactivation(x, h, *gates[q], activation=F.tanh if q == "c" else sigmoid)
        for q in ("f", "i", "c", "o")
    }


def lstm_cell(gate: dict[str, list[Column]], c_prev: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """New cell state ``f*C + i*g`` and hidden output ``o*tanh(C)``."""
    cell = [f * c + i * g for f, c, i, g in zip(gate["f"], c_prev, gate["i"], gate["c"])]
    return cell, [o * F.tanh(c) for o, c in zip(gate["o"], cell)]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
