"""NumPy kernel run inside Spark tasks: LSTM stack, gradients, Adam.

A net is one flat float64 vector with named views into it. The four gates of a
layer share one matrix for the hidden state and one for the input (columns by
gate: forget, input, output, candidate), so a step is two matrix products and one
``tanh`` for all gates.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

GATES = "fioc"

# Adam's fixed values.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class NetSpec:
    """Shape of a net. ``batch_size=None`` makes each chunk one batch."""

    in_features: int = 4
    hidden_units: tuple[int, ...] = (128, 256)
    num_classes: int = 3
    batch_size: int | None = 10

    @property
    def slots(self) -> int:
        """Rows of learned initial state: one per batch slot, or one shared row."""
        return self.batch_size or 1

    def shapes(self) -> dict[tuple[str, int], tuple[int, ...]]:
        """Shape of each view, recurrent layers first, dense head last."""
        out, width = {}, self.in_features
        for n, hidden in enumerate(self.hidden_units):
            out["wh", n], out["wx", n] = (hidden, 4 * hidden), (width, 4 * hidden)
            out["b", n] = (4 * hidden,)
            out["h0", n] = out["c0", n] = (self.slots, hidden)
            width = hidden
        top = len(self.hidden_units)
        out["wd", top], out["bd", top] = (width, self.num_classes), (self.num_classes,)
        return out

    def views(self, flat: np.ndarray) -> dict:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def parameters(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())

    def decayed(self) -> int:
        """Weight decay covers the recurrent layers, that is all but the dense head."""
        return self.parameters() - (self.hidden_units[-1] + 1) * self.num_classes


def truncated_normal(rng: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normal, redrawn outside two standard deviations."""
    out = rng.standard_normal(shape)
    while (far := np.abs(out) > 2.0).any():
        out[far] = rng.standard_normal(int(far.sum()))
    return out


def init_params(spec: NetSpec, seed: int, initializer=truncated_normal) -> np.ndarray:
    """Seeded by tensor name, so the start is the same in every replica."""
    flat = np.empty(spec.parameters())
    for (name, n), view in spec.views(flat).items():
        digest = hashlib.sha256(f"{seed}:{name}:{n}".encode()).digest()
        view[...] = initializer(np.random.default_rng(int.from_bytes(digest[:8], "big")), view.shape)
    return flat


def cell_step(z: np.ndarray, c: np.ndarray):
    """Gates (in place of the pre-activations ``z [n, 4H]``), cell state, its tanh, hidden output."""
    H = c.shape[1]
    sig = z[:, : 3 * H]  # sigmoid(v) = (1 + tanh(v/2)) / 2
    sig *= 0.5
    np.tanh(z, out=z)
    sig *= 0.5
    sig += 0.5
    C = z[:, :H] * c
    C += z[:, H : 2 * H] * z[:, 3 * H :]
    tc = np.tanh(C)
    return z, C, tc, z[:, 2 * H : 3 * H] * tc


def forward(params: dict, x: np.ndarray, states: list) -> tuple[np.ndarray, list]:
    """Logits, and per layer what the backward pass needs. ``states`` holds ``(h, C)`` per layer."""
    tape = []
    for n, (h, c) in enumerate(states):
        z = x @ params["wx", n]
        z += h @ params["wh", n] + params["b", n]
        gates, _, tc, out = cell_step(z, c)
        tape.append((x, h, c, gates, tc))
        x = out
    top = len(states)
    return x @ params["wd", top] + params["bd", top], [*tape, x]


def states_at(params: dict, spec: NetSpec, slots: slice) -> list:
    return [(params["h0", n][slots], params["c0", n][slots]) for n in range(len(spec.hidden_units))]


def softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - np.maximum.reduce(logits, axis=1, keepdims=True))
    out /= np.add.reduce(out, axis=1, keepdims=True)
    return out


def loss_and_hits(logits: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """Summed cross-entropy and number of right answers (first maximum wins)."""
    top = logits.max(axis=1)
    norm = np.log(np.exp(logits - top[:, None]).sum(axis=1)) + top
    return float((norm - logits[np.arange(len(y)), y]).sum()), int((logits.argmax(axis=1) == y).sum())


def gradients(params: dict, grads: dict, spec: NetSpec, x, y, slots: slice, scale: float) -> np.ndarray:
    """Fills ``grads`` with ``scale`` times the gradient of the summed cross-entropy; returns the logits.

    State slots other than ``slots`` are left as they are.
    """
    logits, (*tape, hidden) = forward(params, x, states_at(params, spec, slots))
    top = len(tape)
    dlogits = softmax(logits)
    dlogits[np.arange(len(y)), y] -= 1.0
    dlogits *= scale
    np.matmul(hidden.T, dlogits, out=grads["wd", top])
    np.add.reduce(dlogits, axis=0, out=grads["bd", top])
    dh = dlogits @ params["wd", top].T
    for n in reversed(range(top)):
        x, h, c, gates, tc = tape[n]
        H = c.shape[1]
        f, i, o, g = gates[:, :H], gates[:, H : 2 * H], gates[:, 2 * H : 3 * H], gates[:, 3 * H :]
        slope = gates - gates * gates
        np.subtract(1.0, g * g, out=slope[:, 3 * H :])
        dC = dh * o
        dC *= 1.0 - tc * tc
        dz = np.concatenate((dC * c, dC * g, dh * tc, dC * i), axis=1)
        dz *= slope
        dc, dz_state = dC * f, dz
        if spec.slots == 1:  # one state row shared by all rows
            dc, dz_state = dc.sum(axis=0, keepdims=True), dz.sum(axis=0, keepdims=True)
        np.matmul(h.T, dz_state, out=grads["wh", n])
        np.matmul(x.T, dz, out=grads["wx", n])
        np.add.reduce(dz, axis=0, out=grads["b", n])
        np.matmul(dz_state, params["wh", n].T, out=grads["h0", n][slots])
        grads["c0", n][slots] = dc
        if n:
            dh = dz @ params["wx", n].T
    return logits


class Adam:
    def __init__(self, learning_rate: float):
        self.rate, self.t = learning_rate, 0

    def update(self, flat: np.ndarray, grad: np.ndarray) -> None:
        """Changes ``flat`` in place; ``grad`` is used up."""
        if not self.t:
            self.m, self.v, self.change = np.zeros_like(grad), np.zeros_like(grad), np.empty_like(grad)
        self.t += 1
        m, v, change = self.m, self.v, self.change
        np.multiply(grad, 1 - BETA1, out=change)
        m *= BETA1
        m += change
        grad *= grad
        grad *= 1 - BETA2
        v *= BETA2
        v += grad
        np.sqrt(v, out=grad)
        grad += EPSILON
        np.multiply(m, self.rate * (1 - BETA2**self.t) ** 0.5 / (1 - BETA1**self.t), out=change)
        change /= grad
        flat -= change


class Sgd:
    def __init__(self, learning_rate: float):
        self.rate = learning_rate

    def update(self, flat: np.ndarray, grad: np.ndarray) -> None:
        flat -= self.rate * grad


OPTIMIZERS = {"adam": Adam, "sgd": Sgd}

# Key and part, in the weights table, of tensors that are stored whole.
STORED = {"h0": ("h0", "s"), "c0": ("c0", "s"), "wd": ("wd", "x"), "bd": ("bd", "b")}
# First letter of the key and part of tensors that are stored by gate.
BY_GATE = {"wh": ("w", "h"), "wx": ("w", "x"), "b": ("b", "b")}


def to_rows(params: dict) -> list[tuple[str, int, str, list[int], np.ndarray]]:
    """``(key, layer, part, shape, values)`` per tensor of the weights table."""
    rows = []
    for (name, n), view in params.items():
        if name in STORED:
            key, part = STORED[name]
            rows.append((key, n, part, view))
        else:
            letter, part = BY_GATE[name]
            rows += [(letter + gate, n, part, v) for gate, v in zip(GATES, np.split(view, 4, axis=-1))]
    return [(key, n, part, list(v.shape), v.ravel().copy()) for key, n, part, v in rows]


def from_rows(rows) -> tuple[NetSpec, np.ndarray]:
    """Inverse of :func:`to_rows`."""
    t = {(key, n, part): np.array(v, dtype=float).reshape(shape) for key, n, part, shape, v in rows}
    depth = max(n for _, n, _ in t)
    widths = tuple(len(t["bf", n, "b"]) for n in range(depth))
    slots, classes = len(t["h0", 0, "s"]), len(t["bd", depth, "b"])
    spec = NetSpec(len(t["wf", 0, "x"]), widths, classes, slots if slots > 1 else None)
    flat = np.empty(spec.parameters())
    for (name, n), view in spec.views(flat).items():
        if name in STORED:
            key, part = STORED[name]
            view[...] = t[key, n, part]
        else:
            letter, part = BY_GATE[name]
            view[...] = np.concatenate([t[letter + gate, n, part] for gate in GATES], axis=-1)
    return spec, flat
