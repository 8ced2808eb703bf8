import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gatewise import average_weights
from gatewise.operators.exact import exact_sums


def bits(v):
    return struct.pack("<d", v)


@pytest.mark.parametrize("low, high", [(-3, 3), (-60, 60), (-300, 300), (-1074, -1000), (900, 1010)])
def test_sums_are_exact_to_rounding_and_the_same_in_any_order(spark, low, high):
    r = random.Random(low)
    data = [(n % 3, r.choice([-1, 1]) * math.ldexp(r.random(), r.randint(low, high))) for n in range(900)]
    got = []
    for parts in (1, 3, 11):
        r.shuffle(data)
        df = spark.createDataFrame(data, "g int, v double").repartition(parts)
        got.append({row.g: bits(row.total) for row in exact_sums(df, ["g"], F.col("v")).collect()})
    assert got[0] == got[1] == got[2]
    for g in range(3):
        values = [v for k, v in data if k == g]
        want, size = math.fsum(values), math.fsum(map(abs, values))
        assert abs(struct.unpack("<d", got[0][g])[0] - want) <= 4e-16 * size + 1e-323


def test_powers_of_two_and_their_neighbours(spark):
    values = [s * v for k in range(-1070, 1020, 16) for v in (math.ldexp(1, k), math.nextafter(math.ldexp(1, k), 0), math.nextafter(math.ldexp(1, k), math.inf)) for s in (1, -1)]
    for v in random.Random(1).sample(values, 40) + [0.0, -0.0, 5e-324, 1.7e308]:
        row = exact_sums(spark.createDataFrame([(v,), (None,), (v / 2,)], "v double"), [], F.col("v")).first()
        assert (row.total, row.n) == (pytest.approx(v + v / 2, rel=1e-15, abs=1e-323), 2)


def test_nulls_weights_and_what_is_no_number(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1.5, 2), (1, None, 9), (1, 2.5, 3), (2, nan, 1), (3, inf, 1), (3, -inf, 1), (4, inf, 1), (4, 1.0, 1)], "g int, v double, w int")
    got = {r.g: r for r in exact_sums(df, ["g"], F.col("v") * F.col("w"), F.col("w")).collect()}
    assert tuple(got[1])[1:] == (10.5, 5.0, 2) and got[4].total == inf
    assert math.isnan(got[2].total) and math.isnan(got[3].total)
    assert exact_sums(df.limit(0), ["g"], F.col("v")).count() == 0


def test_replicas_average_to_the_same_bits(spark):
    r = random.Random(5)
    rows = [(k, "wf", 0, "x", [2, 2], [r.gauss(0, 10.0 ** r.randint(-9, 9)) for _ in range(4)]) for k in range(60)]
    runs = spark.createDataFrame([(k, r.randint(1, 1000)) for k in range(60)], "replica long, rows long")
    kind = "replica long, key string, layer int, part string, shape array<int>, values array<double>"
    for by_rows in (None, runs):
        seen = set()
        for parts in (1, 5, 9):
            r.shuffle(rows)
            mean = average_weights(spark.createDataFrame(rows, kind).repartition(parts), by_rows).first()["values"]
            seen.add(tuple(map(bits, mean)))
        assert len(seen) == 1
