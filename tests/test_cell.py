import numpy as np
import pytest

from gatewise.functions import cell
from gatewise.functions.cell import NetSpec


@pytest.mark.parametrize("units, batch", [((3,), 6), ((3, 5), 4), ((4, 2), None)])
def test_gradients_match_central_differences(units, batch):
    spec, n = NetSpec(4, units, 3, batch), batch or 7
    rng = np.random.default_rng(0)
    flat, grad = cell.init_params(spec, 1), np.zeros(spec.parameters())
    x, y, slots = rng.random((n, 4)), rng.integers(0, 3, n), slice(0, spec.slots)

    def loss(p):
        logits, _ = cell.forward(spec.views(p), x, cell.states_at(spec.views(p), spec, slots))
        return cell.loss_and_hits(logits, y)[0]

    logits = cell.gradients(spec.views(flat), spec.views(grad), spec, x, y, slots, 1.0)
    assert cell.loss_and_hits(logits, y)[0] == pytest.approx(loss(flat))
    steps = 1e-5 * np.eye(len(flat))
    numeric = [(loss(flat + e) - loss(flat - e)) / 2e-5 for e in steps]
    assert np.abs(grad - numeric).max() < 1e-8


def test_cell_equations():
    z = np.array([[0.3, -0.2, 0.7, 0.9]])  # forget, input, output, candidate
    _, C, _, h = cell.cell_step(z.copy(), np.array([[0.5]]))
    f, i, o = (1 / (1 + np.exp(-v)) for v in z[0, :3])
    want = f * 0.5 + i * np.tanh(0.9)
    assert C[0, 0] == pytest.approx(want) and h[0, 0] == pytest.approx(o * np.tanh(want))


def test_large_inputs_do_not_overflow():
    _, _, _, h = cell.cell_step(np.array([[-1e4, 1e4, 1e4, -1e4]]), np.array([[1.0]]))
    assert h[0, 0] == pytest.approx(-np.tanh(1.0))
    loss, hits = cell.loss_and_hits(np.array([[1e4, 0.0, -1e4]]), np.array([0]))
    assert (loss, hits) == (0.0, 1)


def test_two_adam_steps_by_hand():
    solver, w = cell.Adam(0.1), np.array([1.0])
    solver.update(w, np.array([2.0]))
    assert w[0] == pytest.approx(1.0 - 0.1, abs=1e-6)
    solver.update(w, np.array([-1.0]))  # a fresh array: update uses it up
    m, v = 0.9 * 0.2 + 0.1 * -1.0, 0.999 * 0.004 + 0.001
    assert w[0] == pytest.approx(0.9 - 0.1 * (m / 0.19) / np.sqrt(v / 0.001999), abs=1e-6)


def test_start_is_seeded_and_truncated():
    spec = NetSpec(4, (16, 8), 3, 10)
    a = cell.init_params(spec, 5)
    assert (a == cell.init_params(spec, 5)).all() and (a != cell.init_params(spec, 6)).any()
    assert np.abs(a).max() <= 2.0 and 0.8 < a.std() < 0.95


def test_default_net_size():
    assert NetSpec().parameters() == 470_787


def test_weight_rows_round_trip():
    spec = NetSpec(4, (3, 5), 3, 10)
    flat = cell.init_params(spec, 1)
    rows = cell.to_rows(spec.views(flat))
    assert {r[0] for r in rows} == {"wf", "wi", "wo", "wc", "bf", "bi", "bo", "bc", "h0", "c0", "wd", "bd"}
    again, copy = cell.from_rows(rows[::-1])
    assert again == spec and (copy == flat).all()


def test_ties_go_to_the_first_maximum():
    assert cell.loss_and_hits(np.array([[1.0, 1.0, 0.0]]), np.array([0]))[1] == 1
