"""A net whose weights follow a formula, so that SQL can compute them too."""

from __future__ import annotations

import numpy as np

from gatewise.functions.cell import GATES, NetSpec
from gatewise.operators.score import Model

# Gate numbers, and the input numbers of bias and hidden rows.
GATE_NUMBER = {"f": 0, "i": 1, "c": 2, "o": 3}
HEAD, BIAS_ROW, HIDDEN_ROW = 4, 9, 100


def weight(k: int, i: int, j: int) -> float:
    return ((31 * i + 17 * j + 7 * k) % 13 - 6) / 10


def h0(j: int) -> float:
    return (j + 1) / 10


def c0(j: int) -> float:
    return (j + 1) / 5


def formula_model(*hidden_units: int, in_features: int = 4, batch_size: int | None = None) -> Model:
    spec = NetSpec(in_features, hidden_units, 3, batch_size)
    flat = np.empty(spec.parameters())
    numbers = [GATE_NUMBER[g] for g in GATES]
    for (name, n), view in spec.views(flat).items():
        if name in ("wh", "wx"):
            first = HIDDEN_ROW if name == "wh" else 0
            units = range(view.shape[1] // 4)
            view[...] = [[weight(k, first + i, j) for k in numbers for j in units] for i in range(len(view))]
        elif name == "b":
            view[...] = [weight(k, BIAS_ROW, j) for k in numbers for j in range(len(view) // 4)]
        elif name == "wd":
            view[...] = [[weight(HEAD, i, j) for j in range(3)] for i in range(len(view))]
        elif name == "bd":
            view[...] = [weight(HEAD, BIAS_ROW, j) for j in range(3)]
        else:
            view[...] = [(h0 if name == "h0" else c0)(j) for j in range(view.shape[1])]
    return Model(spec, flat)


def column_gates(hidden: int, in_features: int = 4) -> dict:
    """One layer of the same net, as ``f i c o -> (wx, wh, bias)`` for the column form."""
    units = range(hidden)
    return {
        gate: (
            [[weight(k, i, j) for j in units] for i in range(in_features)],
            [[weight(k, HIDDEN_ROW + i, j) for j in units] for i in units],
            [weight(k, BIAS_ROW, j) for j in units],
        )
        for gate, k in GATE_NUMBER.items()
    }
