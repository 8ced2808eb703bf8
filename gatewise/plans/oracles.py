"""The same results in plain SQL, written for DuckDB.

Values that two engines may compute in another order are rounded alike on both
sides, as ``floor(v * 1e6 + 0.5) / 1e6``; all others are compared as they are.
"""

from __future__ import annotations

LINE_X = """l_quantity / 50 AS x0, l_extendedprice / 105000 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3"""
LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
FLAG = "CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS BIGINT) AS label"
XS = "x0, x1, x2, x3"

SCAN = f"SELECT {LINE_KEY}, {LINE_X}, {FLAG} FROM lineitem"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


# Rank, chunks, batches of orders

RANKED = """ranked AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS rank,
         count(*) OVER () AS n
  FROM orders)"""


# The first n % p chunks have one row more.
SPREAD = "CASE WHEN rank < (n % p) * (n // p + 1) THEN rank // (n // p + 1) ELSE (rank - n % p) // greatest(1, n // p) END"


def chunked(remainder: str, parts: int = 7) -> str:
    chunk = SPREAD if remainder == "spread" else "rank // greatest(1, n // p)"
    return f"""{RANKED}, cut AS (SELECT *, {chunk} AS chunk FROM (SELECT *, {parts} AS p FROM ranked)),
chunked AS (SELECT *, count(*) OVER (PARTITION BY chunk) AS chunk_rows FROM cut)"""


def chunk_rows(remainder: str) -> str:
    return f"""WITH {chunked(remainder)}
SELECT o_orderkey, {big('rank', 'rank')}, {big('chunk', 'chunk')}, {big('chunk_rows', 'chunk_rows')} FROM chunked"""


def assigned(remainder: str) -> str:
    return f"WITH {chunked(remainder)} SELECT o_orderkey, {big('chunk', 'chunk')}, {big('chunk_rows', 'chunk_rows')} FROM chunked"


def batches(passes: int, max_steps: str) -> str:
    return f"""WITH {chunked('spread')},
numbered AS (
  SELECT o_orderkey, chunk, chunk_rows, pass,
         row_number() OVER (PARTITION BY chunk, pass ORDER BY md5('42:' || pass || ':' || o_orderkey), o_orderkey) - 1 AS rn
  FROM chunked, (SELECT unnest(range({passes})) AS pass)),
batched AS (
  SELECT o_orderkey, {big('chunk', 'chunk')}, CAST(pass AS INTEGER) AS pass, {big('rn // 10', 'batch_id')},
         CAST(rn % 10 AS INTEGER) AS slot, {big('pass * (chunk_rows // 10) + rn // 10', 'step')},
         {big(max_steps, 'max_steps')}
  FROM numbered WHERE rn // 10 < chunk_rows // 10)"""


def batch_rows(passes: int, max_steps: str) -> str:
    return batches(passes, max_steps) + "\nSELECT * FROM batched WHERE step < max_steps"


# The formula net

PRE = f"""ex AS (SELECT row_number() OVER () AS rid, {LINE_KEY}, {LINE_X} FROM lineitem),
xs AS (SELECT rid, unnest([0, 1, 2, 3]) AS i, unnest([x0, x1, x2, x3]) AS v FROM ex),
hs AS (SELECT unnest(range(100, 103)) AS i, unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS v),
w AS (SELECT k, i, j, CAST((31 * i + 17 * j + 7 * k) % 13 - 6 AS DOUBLE) / 10 AS w
      FROM (SELECT unnest(range(5)) AS k), (SELECT unnest(range(110)) AS i), (SELECT unnest(range(3)) AS j)),
fixed AS (
  SELECT k, j, sum(w * CASE WHEN w.i = 9 THEN 1 ELSE hs.v END) AS z
  FROM w LEFT JOIN hs USING (i) WHERE w.i = 9 OR w.i BETWEEN 100 AND 102 GROUP BY k, j),
z AS (
  SELECT rid, k, j, sum(v * w) + any_value(fixed.z) AS z
  FROM xs JOIN w USING (i) JOIN fixed USING (k, j) WHERE k < 4 GROUP BY rid, k, j)"""

GATES = f"""{PRE},
gates AS (
  SELECT rid, j, 1 / (1 + exp(-max(z) FILTER (k = 0))) AS f, 1 / (1 + exp(-max(z) FILTER (k = 1))) AS i,
         tanh(max(z) FILTER (k = 2)) AS c, 1 / (1 + exp(-max(z) FILTER (k = 3))) AS o
  FROM z GROUP BY rid, j)"""

CELL = f"""{GATES},
state AS (SELECT rid, j, o, f * CAST(j + 1 AS DOUBLE) / 5 + i * c AS cell FROM gates),
cell AS (SELECT rid, j, cell AS c, o * tanh(cell) AS h FROM state)"""


def wide(source: str, names: list[tuple[str, str, str]]) -> str:
    """Row per example from one row per unit; ``names`` is (output, value, condition)."""
    columns = ", ".join(f"floor((max({v}) FILTER ({cond})) * 1e6 + 0.5) / 1e6 AS {n}" for n, v, cond in names)
    return f"SELECT {LINE_KEY}, {columns} FROM {source} JOIN ex USING (rid) GROUP BY rid, {LINE_KEY}"


GATE_NUMBER = {"f": 0, "i": 1, "c": 2, "o": 3}

SCORE = f"""WITH {CELL},
w1 AS (SELECT * FROM w WHERE j < 2),
fixed1 AS (
  SELECT k, j, sum(w * CASE i WHEN 9 THEN 1 WHEN 100 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END) AS z
  FROM w1 WHERE i IN (9, 100, 101) GROUP BY k, j),
z1 AS (
  SELECT rid, k, w1.j, sum(h * w) + any_value(fixed1.z) AS z
  FROM cell JOIN w1 ON w1.i = cell.j JOIN fixed1 USING (k) WHERE fixed1.j = w1.j AND k < 4 GROUP BY rid, k, w1.j),
gates1 AS (
  SELECT rid, j, 1 / (1 + exp(-max(z) FILTER (k = 0))) AS f, 1 / (1 + exp(-max(z) FILTER (k = 1))) AS i,
         tanh(max(z) FILTER (k = 2)) AS c, 1 / (1 + exp(-max(z) FILTER (k = 3))) AS o
  FROM z1 GROUP BY rid, j),
h1 AS (SELECT rid, j, o * tanh(f * CAST(j + 1 AS DOUBLE) / 5 + i * c) AS h FROM gates1),
bias AS (SELECT j, w AS b FROM w WHERE k = 4 AND i = 9),
logit AS (
  SELECT rid, w.j, sum(h * w) + any_value(b) AS l
  FROM h1 JOIN w ON w.i = h1.j AND w.k = 4 JOIN bias ON bias.j = w.j GROUP BY rid, w.j),
l AS (SELECT rid, max(l) FILTER (j = 0) AS l0, max(l) FILTER (j = 1) AS l1, max(l) FILTER (j = 2) AS l2 FROM logit GROUP BY rid)
SELECT {LINE_KEY}, floor((l0) * 1e6 + 0.5) / 1e6 AS logit0, floor((l1) * 1e6 + 0.5) / 1e6 AS logit1, floor((l2) * 1e6 + 0.5) / 1e6 AS logit2,
       {big('CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END', 'prediction')}
FROM l JOIN ex USING (rid)"""


def formula(k: int, i: int, j: int) -> str:
    return f"({(31 * i + 17 * j + 7 * k) % 13 - 6} / 10::DOUBLE)"


def unit_z(k: int, h: str, *xs: str) -> str:
    """Pre-activation of gate ``k`` of a net with one hidden unit."""
    terms = [f"{x} * {formula(k, i, 0)}" for i, x in enumerate(xs)]
    return "(" + " + ".join([*terms, f"{h} * {formula(k, 100, 0)}", formula(k, 9, 0)]) + ")"


def sigmoid(z: str) -> str:
    return f"(1 / (1 + exp(-{z})))"


def unit_step(h: str, c: str, *xs: str) -> tuple[str, str]:
    """SQL of the new cell state and of the output gate."""
    f, i, o = (sigmoid(unit_z(k, h, *xs)) for k in (0, 1, 3))
    return f"({f} * {c} + {i} * tanh({unit_z(2, h, *xs)}))", o


def sequences(moves: str, key: str = "user_id") -> str:
    cell, out = unit_step("h", "c", "x0", "x1")
    return f"""WITH RECURSIVE ev AS (
  SELECT {key} AS user_id, event_id, value / 100 AS x0, {moves} AS moves,
         CASE event_type WHEN 'click' THEN 1::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS x1,
         row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS t
  FROM events),
walk AS (
  SELECT user_id, NULL::BIGINT AS event_id, -1::BIGINT AS t, 0.1::DOUBLE AS h, 0.2::DOUBLE AS c
  FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT user_id, event_id, t, CASE WHEN moves THEN o * tanh(n) ELSE h END, CASE WHEN moves THEN n ELSE c END
  FROM (SELECT ev.user_id, ev.event_id, ev.t, moves, h, c, {cell} AS n, {out} AS o
        FROM walk JOIN ev ON ev.user_id = walk.user_id AND ev.t = walk.t + 1))"""


LOGIT3 = ", ".join(f"h * {formula(4, 0, j)} + {formula(4, 9, j)} AS l{j}" for j in range(3))

SEQUENCES = f"""{sequences('true')},
last AS (SELECT user_id, max(t) AS t, arg_max(h, t) AS h FROM walk WHERE t >= 0 GROUP BY user_id),
logit AS (SELECT *, {LOGIT3} FROM last)
SELECT user_id, t, floor((h) * 1e6 + 0.5) / 1e6 AS h,
       {big('CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END', 'prediction')} FROM logit"""

FROZEN = f"""{sequences("event_type <> 'error'")}
SELECT user_id, event_id, t, floor((h) * 1e6 + 0.5) / 1e6 AS h FROM walk WHERE t >= 0"""


LONG = f"""{sequences('true', 'CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END')}
SELECT CASE WHEN user_id >= 0 THEN user_id END AS user_id, event_id, t, floor((h) * 1e6 + 0.5) / 1e6 AS h FROM walk WHERE t >= 0"""


# Training of a net with one hidden unit on planted classes

BATCH, EVERY, RATE = 10, 100, "0.01::DOUBLE"

PLANTED = f"""ranked AS (
  SELECT {LINE_KEY}, l_extendedprice, l_shipdate, {LINE_X},
         CASE WHEN l_quantity / 50 <= 0.34 THEN 0 WHEN l_quantity / 50 <= 0.67 THEN 1 ELSE 2 END AS label, row_number() OVER (ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey),
           {LINE_KEY}, l_extendedprice, l_shipdate) - 1 AS rank, count(*) OVER () AS n
  FROM lineitem),
chunked AS (SELECT *, {SPREAD} AS chunk FROM (SELECT *, 4 AS p FROM ranked))"""


def unit_params(slots: int) -> dict[tuple[str, int, str, int], tuple[str, str]]:
    """Tensor element -> (start value, gradient of one row's loss), in the order of the SQL lists."""
    out = {}
    for gate, k in GATE_NUMBER.items():
        for n in range(4):
            out["w" + gate, 0, "x", n] = formula(k, n, 0), f"dz_{gate} * x{n}"
        out["w" + gate, 0, "h", 0] = formula(k, 100, 0), f"dz_{gate} * h"
        out["b" + gate, 0, "b", 0] = formula(k, 9, 0), f"dz_{gate}"
    for slot in range(slots):
        out["h0", 0, "s", slot] = "0.1::DOUBLE", f"CASE slot WHEN {slot} THEN dh0 ELSE 0 END"
        out["c0", 0, "s", slot] = "0.2::DOUBLE", f"CASE slot WHEN {slot} THEN dcell * f ELSE 0 END"
    for j in range(3):
        out["wd", 1, "x", j] = formula(4, 0, j), f"hid * d{j}"
        out["bd", 1, "b", j] = formula(4, 9, j), f"d{j}"
    return out


def w(slots: int, *name) -> str:
    return f"w[{list(unit_params(slots)).index(name) + 1}]"


def unit_forward(source: str, slots: int) -> str:
    """Adds logits, and all that the gradient needs, to rows that carry the list ``w`` and a ``slot``."""

    def z(gate: str) -> str:
        terms = [f"x{n} * {w(slots, 'w' + gate, 0, 'x', n)}" for n in range(4)]
        return " + ".join([*terms, f"h * {w(slots, 'w' + gate, 0, 'h', 0)}", w(slots, "b" + gate, 0, "b", 0)])

    h0, c0 = (list(unit_params(slots)).index((key, 0, "s", 0)) + 1 for key in ("h0", "c0"))
    logits = ", ".join(f"hid * {w(slots, 'wd', 1, 'x', j)} + {w(slots, 'bd', 1, 'b', j)} AS l{j}" for j in range(3))
    return f"""(SELECT *, {logits} FROM (
  SELECT *, o * tc AS hid FROM (
    SELECT *, tanh(f * c + i * g) AS tc FROM (
      SELECT *, {sigmoid('(' + z('f') + ')')} AS f, {sigmoid('(' + z('i') + ')')} AS i,
             tanh({z('c')}) AS g, {sigmoid('(' + z('o') + ')')} AS o FROM (
        SELECT *, w[{h0} + 2 * slot] AS h, w[{c0} + 2 * slot] AS c FROM {source})))))"""


def unit_backward(source: str, slots: int) -> str:
    soft = ", ".join(f"exp(l{j}) / (exp(l0) + exp(l1) + exp(l2)) - CAST(label = {j} AS INT) AS d{j}" for j in range(3))
    dh = " + ".join(f"d{j} * {w(slots, 'wd', 1, 'x', j)}" for j in range(3))
    dh0 = " + ".join(f"dz_{q} * {w(slots, 'w' + q, 0, 'h', 0)}" for q in GATE_NUMBER)
    return f"""(SELECT *, {dh0} AS dh0 FROM (
  SELECT *, dcell * c * f * (1 - f) AS dz_f, dcell * g * i * (1 - i) AS dz_i, dcell * i * (1 - g * g) AS dz_c,
         dh * tc * o * (1 - o) AS dz_o FROM (
    SELECT *, dh * o * (1 - tc * tc) AS dcell FROM (
      SELECT *, {dh} AS dh FROM (SELECT *, {soft} FROM {source})))))"""


def unit_elements(source: str, slots: int, *columns: str) -> str:
    """One row per tensor element of the lists ``w`` in ``source``."""
    return "\nUNION ALL ".join(
        f"SELECT {''.join(c + ', ' for c in columns)}'{key}' AS key, {layer} AS layer, '{part}' AS part, {pos} AS pos, "
        f"floor(w[{n + 1}] * 1e6 + 0.5) / 1e6 AS value FROM {source}"
        for n, (key, layer, part, pos) in enumerate(unit_params(slots))
    )


def unit_gradient(slots: int) -> str:
    return "[" + ", ".join(f"avg({g})" for _, g in unit_params(slots).values()) + "]"


def unit_start(slots: int) -> str:
    return "[" + ", ".join(v for v, _ in unit_params(slots).values()) + "]"


# The chunk as one batch: one plain gradient step, learning rate 0.5.
FULL_BATCH = f"""WITH {PLANTED},
started AS (SELECT *, 0 AS slot, {unit_start(1)} AS w FROM chunked),
steps AS (
  SELECT chunk, any_value(w) AS w, {unit_gradient(1)} AS g
  FROM {unit_backward(unit_forward('started', 1), 1)} GROUP BY chunk),
stepped AS (SELECT chunk, [w[i] - 0.5::DOUBLE * g[i] for i in range(1, {len(unit_params(1)) + 1})] AS w FROM steps)"""

FULL_BATCH_MEAN = f"""{FULL_BATCH},
mean AS (SELECT [{', '.join(f'avg(w[{n + 1}])' for n in range(len(unit_params(1))))}] AS w FROM stepped)
{unit_elements('mean', 1)}"""

LOSS = "ln(exp(l0) + exp(l1) + exp(l2)) - CASE label WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END"
HIT = "CAST(CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END = label AS INT)"

FULL_BATCH_METRICS = f"""{FULL_BATCH},
rows AS (SELECT chunked.*, 0 AS slot, w FROM chunked JOIN stepped USING (chunk)),
said AS (SELECT chunk, avg({LOSS}) AS loss, avg({HIT}) AS hit FROM {unit_forward('rows', 1)} GROUP BY chunk)
SELECT chunk AS replica, 0::BIGINT AS step, 'cross_entropy' AS metric, floor((loss) * 1e6 + 0.5) / 1e6 AS value FROM said
UNION ALL SELECT chunk, 0, 'accuracy', floor((hit) * 1e6 + 0.5) / 1e6 FROM said"""

# Adam over batches of 10, step by step.
SIZE = len(unit_params(BATCH))
RECURRENT = SIZE - 6  # elements before those of the dense head; only they decay
LINE_TEXT = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"
LINE_ORDER = f"{LINE_KEY}, l_extendedprice, l_shipdate"


def adam(source: str, key: str, order: str, passes: int = 1, decay: float = 0.0) -> str:
    """Steps of every chunk of ``chunked``, which ``source`` defines; ``key`` and ``order`` place a row in a pass."""
    g = f"(g[i] + CASE WHEN i <= {RECURRENT} THEN {decay}::DOUBLE * w[i] ELSE 0 END)" if decay else "g[i]"
    every = f"for i in range(1, {SIZE + 1})"
    return f"""WITH RECURSIVE {source},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY chunk, pass ORDER BY md5('42:' || pass || ':' || {key}), {order}) - 1 AS rn
  FROM (SELECT *, count(*) OVER (PARTITION BY chunk) // {BATCH} AS per_pass FROM chunked), (SELECT unnest(range({passes})) AS pass)),
batches AS MATERIALIZED (
  SELECT chunk, pass * per_pass + rn // {BATCH} AS step, rn % {BATCH} AS slot, x0, x1, x2, x3, label, per_pass * {passes} AS steps
  FROM numbered WHERE rn // {BATCH} < per_pass),
walk AS (
  SELECT DISTINCT chunk, 0::BIGINT AS step, {unit_start(BATCH)} AS w,
         [0::DOUBLE for i in range({SIZE})] AS m, [0::DOUBLE for i in range({SIZE})] AS v, steps
  FROM batches
  UNION ALL
  SELECT chunk, step + 1,
         [w[i] - {RATE} * sqrt(1 - pow(0.999::DOUBLE, step + 1)) / (1 - pow(0.9::DOUBLE, step + 1)) * m[i] / (sqrt(v[i]) + 1e-8) {every}],
         m, v, steps
  FROM (SELECT chunk, step, w, steps, [0.9::DOUBLE * m[i] + 0.1::DOUBLE * {g} {every}] AS m,
               [0.999::DOUBLE * v[i] + 0.001::DOUBLE * {g} * {g} {every}] AS v
        FROM (SELECT chunk, step, any_value(w) AS w, any_value(m) AS m, any_value(v) AS v, any_value(steps) AS steps,
                     {unit_gradient(BATCH)} AS g
              FROM {unit_backward(unit_forward('(SELECT batches.*, w, m, v FROM walk JOIN batches USING (chunk, step))', BATCH), BATCH)}
              GROUP BY chunk, step))),
done AS (
  SELECT chunk AS replica, chunk, step - 1 AS step, w, steps FROM walk
  WHERE step > 0 AND ((step - 1) % {EVERY} = 0 OR step = steps))"""


# Whole numbers read from lines; a row's key is the digest of its content as JSON, and its number among its copies.
LINES = f"""lines AS (
  SELECT *, '{{"features":[' || x0 || ',' || x1 || ',' || x2 || ',' || x3 || '],"label":' || label || '}}' AS json
  FROM (SELECT floor(l_quantity / 10)::DOUBLE AS x0, l_linenumber::DOUBLE AS x1, floor(l_discount * 50)::DOUBLE AS x2, floor(l_tax * 50)::DOUBLE AS x3,
               CASE WHEN l_quantity / 50 <= 0.34 THEN 0 WHEN l_quantity / 50 <= 0.67 THEN 1 ELSE 2 END AS label FROM lineitem)),
copies AS (SELECT *, md5(json) AS content, row_number() OVER (PARTITION BY json) - 1 AS copy FROM lines),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || content || ':' || copy), content, copy) - 1 AS rank, count(*) OVER () AS n FROM copies),
chunked AS (SELECT *, {SPREAD} AS chunk FROM (SELECT *, 4 AS p FROM ranked))"""


def trained(passes: int, source: str = PLANTED, key: str = LINE_TEXT, order: str = LINE_ORDER) -> str:
    return f"""{adam(source, key, order, passes)},
last AS (SELECT * FROM done WHERE step + 1 = steps)
{unit_elements('last', BATCH, 'replica', 'step')}"""


ADAM = adam(PLANTED, LINE_TEXT, LINE_ORDER)

CHECKPOINTS = f"""{ADAM},
kept AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY replica ORDER BY step DESC) <= 5)
{unit_elements('kept', BATCH, 'replica', 'step')}"""

def train_metrics(steps: str) -> str:
    return f"""{steps},
said AS (
  SELECT replica, step, avg({LOSS}) AS loss, avg({HIT}) AS hit, any_value(list_sum([u * u for u in w[1:{RECURRENT}]])) / 2 * 0.01::DOUBLE AS decay
  FROM {unit_forward('(SELECT batches.*, w, replica FROM done JOIN batches USING (chunk, step))', BATCH)} GROUP BY replica, step)
SELECT replica, step, 'cross_entropy' AS metric, floor((loss) * 1e6 + 0.5) / 1e6 AS value FROM said
UNION ALL SELECT replica, step, 'accuracy', floor((hit) * 1e6 + 0.5) / 1e6 FROM said"""


DECAYED = f"""{train_metrics(adam(PLANTED, LINE_TEXT, LINE_ORDER, decay=0.01))}
UNION ALL SELECT replica, step, 'weight_decay_loss', floor((decay) * 1e6 + 0.5) / 1e6 FROM said
UNION ALL SELECT replica, step, 'total_loss', floor((loss + decay) * 1e6 + 0.5) / 1e6 FROM said"""

# Leftover rows are a chunk of their own; a chunk trains its full batches once.
RUNS = f"""WITH sizes AS (SELECT count(*) AS n, 7 AS p FROM lineitem),
chunks AS (
  SELECT unnest(range(CAST(ceil(n / greatest(1, n // p)) AS BIGINT))) AS replica, n, greatest(1, n // p) AS bs FROM sizes),
sized AS (SELECT replica, least(bs, n - replica * bs) AS chunk_rows FROM chunks)
SELECT replica, CASE WHEN chunk_rows < {BATCH} THEN chunk_rows ELSE chunk_rows // {BATCH} * {BATCH} END AS rows,
       {big(f'chunk_rows // {BATCH}', 'steps')}, true AS timed
FROM sized"""

# Sums of the embedding's quarters; the class is the position of the largest of three.
QUARTERS = ", ".join("(" + " + ".join(f"embedding[{16 * k + i + 1}]::DOUBLE" for i in range(16)) + f") * 2.0::DOUBLE AS x{k}" for k in range(4))
VECTORS = f"""vectors AS (
  SELECT vec_id, x0, x1, x2, x3, CASE WHEN x0 >= x1 AND x0 >= x2 THEN 0 WHEN x1 >= x2 THEN 1 ELSE 2 END AS label,
         row_number() OVER (ORDER BY md5('43:' || vec_id), vec_id) - 1 AS place, count(*) OVER () AS vecs
  FROM (SELECT vec_id, {QUARTERS} FROM embeddings)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rank, count(*) OVER () AS n
  FROM vectors WHERE place < floor(0.8::DOUBLE * vecs)),
chunked AS (SELECT *, {SPREAD} AS chunk FROM (SELECT *, 4 AS p FROM ranked))"""

# The mean of the replicas; of a learned state, the mean over its slots.
SLOT_MEANS = [" + ".join(f"w[{RECURRENT - 2 * BATCH + 2 * slot + k}]" for slot in range(BATCH)) for k in (1, 2)]
MEANS = [*(f"w[{i + 1}]" for i in range(RECURRENT - 2 * BATCH)), *(f"({m}) / {BATCH}" for m in SLOT_MEANS), *(f"w[{i}]" for i in range(RECURRENT + 1, SIZE + 1))]

FLAGSHIP = f"""{adam(VECTORS, 'vec_id', 'vec_id', 30)},
mean AS (SELECT [{', '.join(f'avg({m})' for m in MEANS)}] AS w FROM walk WHERE step = steps),
held AS (SELECT vectors.*, w, 0 AS slot FROM vectors, mean WHERE place >= floor(0.8::DOUBLE * vecs))
SELECT count(*) AS n_rows, floor((avg({LOSS})) * 1e6 + 0.5) / 1e6 AS cross_entropy, floor((avg({HIT})) * 1e6 + 0.5) / 1e6 AS accuracy
FROM {unit_forward('held', 1)}"""


# Logits on orders and vectors

ORDER_LOGITS = """lg AS (
  SELECT o_orderkey % 3 AS label, ((o_orderkey * 1) % 4 - 2) / 2 AS l0, ((o_orderkey * 2) % 4 - 2) / 2 AS l1,
         ((o_orderkey * 3) % 4 - 2) / 2 AS l2 FROM orders)"""

ORDER_XENT = f"""WITH {ORDER_LOGITS}
SELECT label, count(*) AS n,
       floor((avg(ln(exp(l0) + exp(l1) + exp(l2)) - CASE label WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END)) * 1e6 + 0.5) / 1e6 AS cross_entropy
FROM lg GROUP BY label"""

ORDER_ACCURACY = f"""WITH {ORDER_LOGITS}
SELECT label, count(*) AS n,
       floor((avg(CAST(CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END = label AS INT))) * 1e6 + 0.5) / 1e6 AS accuracy
FROM lg GROUP BY label"""

SPAN_SUMS = ", ".join(" + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(c, 64, 10)) for c in range(10))
VECTOR_ROWS = f"""rows AS (
  SELECT vec_id, label, unnest(range(10)) AS c, unnest([{SPAN_SUMS}]) * 4.0::DOUBLE AS v FROM embeddings),
losses AS (
  SELECT vec_id, any_value(label) AS label,
         ln(sum(exp(v))) - max(v) FILTER (c = label) AS loss,
         CAST(max(v) = max(v) FILTER (c = label) AS INT) AS hit
  FROM rows GROUP BY vec_id)"""

CURVE = f"""WITH {VECTOR_ROWS},
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rank, count(*) OVER () AS n FROM losses),
chunked AS (SELECT *, {SPREAD} AS chunk FROM (SELECT *, 4 AS p FROM ranked)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY md5('42:0:' || vec_id), vec_id) - 1 AS rn,
         count(*) OVER (PARTITION BY chunk) AS chunk_rows
  FROM chunked)
SELECT {big('rn // 10', 'step')}, floor((avg(loss)) * 1e6 + 0.5) / 1e6 AS cross_entropy, floor((avg(hit)) * 1e6 + 0.5) / 1e6 AS accuracy
FROM numbered WHERE rn // 10 < chunk_rows // 10 GROUP BY 1"""

DECAY = f"""WITH {VECTOR_ROWS},
ce AS (SELECT CAST(label AS VARCHAR) AS run_id, avg(loss) AS loss FROM losses GROUP BY 1),
decay AS (
  SELECT CAST(label AS VARCHAR) AS run_id, sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) / 2 * 0.01::DOUBLE AS decay
  FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY 1)
SELECT run_id, floor((loss) * 1e6 + 0.5) / 1e6 AS cross_entropy, floor((decay) * 1e6 + 0.5) / 1e6 AS weight_decay_loss,
       floor((loss + decay) * 1e6 + 0.5) / 1e6 AS total_loss
FROM ce JOIN decay USING (run_id)"""

# Embeddings as weights

TENSORS = """tensors AS (
  SELECT CAST(label AS VARCHAR) AS run_id, vec_id AS replica, CAST(label % 2 AS INTEGER) AS layer,
         ['wf', 'wi', 'wc', 'wo'][vec_id % 4 + 1] AS key, 'x' AS part,
         unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""


def averaged(value: str, rows: str = "true") -> str:
    return f"""WITH {TENSORS}
SELECT key, layer, part, CAST(pos AS INTEGER) AS pos, floor(({value}) * 1e6 + 0.5) / 1e6 AS value
FROM tensors WHERE {rows} GROUP BY key, layer, part, pos"""


AVERAGED_BY_RUN = f"""WITH {TENSORS},
counted AS (SELECT *, (replica // 10 + CAST(run_id AS BIGINT)) % 7 + 1 AS rows FROM tensors)
SELECT run_id, key, layer, part, CAST(pos AS INTEGER) AS pos, floor((sum(v * rows) / sum(rows)) * 1e6 + 0.5) / 1e6 AS value
FROM counted GROUP BY run_id, key, layer, part, pos"""

LATEST = f"""WITH {TENSORS},
steps AS (SELECT run_id, replica % 5 AS replica, key, layer, part, replica // 5 AS step, pos, v FROM tensors)
SELECT run_id, replica, key, layer, part, step, CAST(pos AS INTEGER) AS pos, floor((v) * 1e6 + 0.5) / 1e6 AS value
FROM steps QUALIFY step = max(step) OVER (PARTITION BY run_id, replica, key, layer, part)"""

WIDE_WEIGHTS = """weights AS (
  SELECT k, j, list(w ORDER BY i) FILTER (i < 64) AS ws, sum(w * CASE WHEN i = 1000 THEN 1 ELSE (i - 99) / 10::DOUBLE END) FILTER (i >= 100) AS fixed
  FROM (SELECT k, i, j, CAST((31 * CASE WHEN i = 1000 THEN 9 ELSE i END + 17 * j + 7 * k) % 13 - 6 AS DOUBLE) / 10 AS w
        FROM (SELECT unnest(range(4)) AS k), (SELECT unnest(range(64)) AS i UNION ALL SELECT unnest(range(100, 228)) UNION ALL SELECT 1000),
             (SELECT unnest(range(128)) AS j))
  GROUP BY k, j)"""

WIDE_GATES = f"""WITH {WIDE_WEIGHTS},
z AS (SELECT vec_id, k, list_sum([embedding[i]::DOUBLE * ws[i] for i in range(1, 65)]) + fixed AS z FROM embeddings, weights)
SELECT vec_id, {', '.join(f"floor(({f}(z) FILTER (k = {k})) * 1e6 + 0.5) / 1e6 AS {n}_{q}" for q, k in GATE_NUMBER.items() for n, f in (('least', 'min'), ('most', 'max'), ('sum', 'sum')))}
FROM z GROUP BY vec_id"""

STATE_MEAN = f"""WITH {TENSORS}
SELECT replica, key, CAST(pos % 8 AS INTEGER) AS pos, floor((avg(v)) * 1e6 + 0.5) / 1e6 AS value
FROM tensors GROUP BY replica, key, pos % 8"""


def minmax(lo: list[str], hi: list[str], ranged: str = "true", scaled_rows: str = "true") -> str:
    ranges = ", ".join([f"{e} AS lo{i}" for i, e in enumerate(lo)] + [f"{e} AS hi{i}" for i, e in enumerate(hi)])
    scaled = ", ".join(
        f"CASE WHEN hi{i} > lo{i} THEN 1 - (hi{i} - x{i}) / (hi{i} - lo{i}) ELSE 0 END AS x{i}"
        for i in range(4)
    )
    return f"""WITH ex AS ({SCAN}), r AS (SELECT {ranges} FROM ex WHERE {ranged})
SELECT {LINE_KEY}, {scaled} FROM ex, r WHERE {scaled_rows}"""


ORACLES = {
    "scan_examples": f"SELECT {LINE_KEY}, {XS}, label FROM ({SCAN})",
    "scan_csv": f"SELECT {XS}, label FROM ({SCAN})",
    "attach_labels": "SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "label_coverage": """SELECT count(*) AS n_rows, count(*) FILTER (quality IS NULL) AS unlabelled,
       count(*) FILTER (CAST(n_chars > 1000 AS INT) <> quality) AS mismatched
FROM documents LEFT JOIN labels USING (doc_id)""",
    "valid_examples": f"""SELECT doc_id, CAST(n_chars AS DOUBLE) AS x0, {big('quality', 'label')}
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars > 1000""",
    "scan_csv_gaps": f"""SELECT CAST(o_orderkey AS DOUBLE) AS x0, CAST(o_custkey AS DOUBLE) AS x1, {big('o_orderkey % 3', 'label')}
FROM orders WHERE o_orderkey % 5 > 1""",
    "minmax_global": minmax(["min(least(x0, x1, x2, x3))"] * 4, ["max(greatest(x0, x1, x2, x3))"] * 4),
    "minmax_column": minmax([f"min(x{i})" for i in range(4)], [f"max(x{i})" for i in range(4)]),
    "minmax_apply": minmax([f"min(x{i})" for i in range(4)], [f"max(x{i})" for i in range(4)], "l_orderkey % 2 = 0", "l_orderkey % 2 <> 0"),
    "shuffle_rank": f"WITH {RANKED} SELECT o_orderkey, {big('rank', 'rank')} FROM ranked",
    "shuffle_rank_lines": f"""SELECT {LINE_KEY}, {big('''row_number() OVER (
  ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey),
           l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1''', 'rank')}
FROM lineitem""",
    "order_rank": f"SELECT o_orderkey, {big('row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1', 'rank')} FROM orders",
    "rank_copies": """WITH copies AS (
  SELECT CAST(l_quantity AS INTEGER) AS quantity, l_linestatus,
         '{"quantity":' || CAST(l_quantity AS INTEGER) || ',"l_linestatus":"' || l_linestatus || '"}' AS json,
         row_number() OVER (PARTITION BY l_quantity, l_linestatus) - 1 AS copy
  FROM lineitem)
SELECT quantity, l_linestatus, row_number() OVER (ORDER BY md5('42:' || json || ':' || copy), json, copy) - 1 AS rank, count(*) OVER () AS n_rows
FROM copies""",
    "chunk_rows": chunk_rows("extra"),
    "chunk_rows_spread": chunk_rows("spread"),
    "assign_chunks": assigned("spread"),
    "assign_chunks_extra": assigned("extra"),
    "trainable_chunks": f"""WITH {chunked('extra')}
SELECT {big('chunk', 'chunk')}, count(*) AS n, max(chunk_rows) AS chunk_rows FROM chunked WHERE chunk_rows >= 10 GROUP BY 1""",
    "skipped_chunks": """SELECT row_number() OVER () - 1 AS replica, 1::BIGINT AS rows, 0::BIGINT AS steps FROM orders""",
    "train_val_split": f"""WITH {RANKED}
SELECT o_orderkey, CASE WHEN rank < floor(0.8::DOUBLE * n) THEN 'train' ELSE 'validation' END AS part FROM ranked""",
    "minibatches": batch_rows(1, "chunk_rows // 10"),
    "minibatches_multi_pass": batch_rows(3, "3 * (chunk_rows // 10)"),
    "capped_steps": batch_rows(20, "20"),
    "capped_steps_long": batch_rows(20, "200"),
    "eval_steps": batches(1, "chunk_rows // 10")
    + "\nSELECT chunk, step, count(*) AS n FROM batched WHERE step % 10 = 0 OR step + 1 = max_steps GROUP BY chunk, step",
    "chunk_partitions": f"""WITH {chunked('spread')}
SELECT o_orderkey, {big('chunk', 'chunk')}, {big('chunk_rows', 'chunk_rows')}, CAST(chunk AS INTEGER) AS part FROM chunked""",
    "gate_preactivation": f"WITH {PRE} "
    + wide("z", [(f"z_{q}{j}", "z", f"k = {k} AND j = {j}") for q, k in GATE_NUMBER.items() for j in range(3)]),
    "gate_preactivation_wide": WIDE_GATES,
    "lstm_gates": f"WITH {GATES} " + wide("gates", [(f"{q}{j}", q, f"j = {j}") for q in "fico" for j in range(3)]),
    "lstm_cell_step": f"WITH {CELL} " + wide("cell", [(f"{q}{j}", q, f"j = {j}") for q in "ch" for j in range(3)]),
    "score_lstm": SCORE,
    "score_lstm_blocks": SCORE,
    "score_sequences": SEQUENCES,
    "score_sequences_frozen": FROZEN,
    "score_sequences_long": LONG,
    "initial_state_mean": STATE_MEAN,
    "softmax_xent_sparse": ORDER_XENT,
    "softmax_xent_dense": ORDER_XENT,
    "accuracy_sparse": ORDER_ACCURACY,
    "accuracy_dense": ORDER_ACCURACY,
    "metric_curve": CURVE,
    "weight_decay_loss": DECAY,
    "average_weights": averaged("avg(v)"),
    "average_weights_by_rows": averaged("sum(v * (replica % 7 + 1)) / sum(replica % 7 + 1)"),
    "average_weights_by_run": AVERAGED_BY_RUN,
    "average_weights_gaps": averaged("avg(v)", "replica % 6 <> 0 AND replica % 7 <> 1"),
    "latest_checkpoint": LATEST,
    "train_weights": trained(1),
    "train_two_passes": trained(2),
    "train_resumed": trained(2),
    "train_csv": trained(1, LINES, "content || ':' || copy", "content, copy"),
    "train_decay_metrics": DECAYED,
    "checkpoints": CHECKPOINTS,
    "train_metrics": train_metrics(ADAM),
    "run_report": RUNS,
    "train_full_batch": FULL_BATCH_MEAN,
    "train_full_batch_metrics": FULL_BATCH_METRICS,
    "averaged_model_accuracy": FLAGSHIP,
}
