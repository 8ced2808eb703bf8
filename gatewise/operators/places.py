"""Rows at given ranks of a hashed order, found by counting hash prefixes; rows are not moved or sorted for it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Prefixes that are counted at once, about; as many rows reach the driver.
COUNTED = 1 << 16

# Rows under a prefix that are fetched and sorted instead of being counted further.
FEW = 64

# Hex digits of a hash.
WHOLE = 32


class Target(NamedTuple):
    """The row at ``rank`` (0-based) of those of a group whose hash begins with ``prefix``."""

    group: str
    prefix: str
    rank: int


def prefix_counts(rows: DataFrame, digits: int, hash_col: str = "_h", group_col: str | None = None) -> list[tuple[str, str, int]]:
    """``group, prefix, rows`` in order, of the prefixes of so many digits that occur."""
    group = F.col(group_col) if group_col else F.lit("")
    counts = rows.groupBy(group.alias("g"), _prefix(hash_col, digits).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(tuple(r) for r in counts.collect())


def rows_at(
    rows: DataFrame, targets: Iterable[Target], place: Sequence[str], group_col: str | None = None, rank_in_order=None
) -> dict[Target, Row]:
    """The ``place`` columns of the row each target stands for; the order is by ``place``, whose first column is the hash.

    Each turn counts some more digits below the targets' prefixes, until few rows are left under each; these
    are fetched. Rows that share a whole hash are ranked by the rest of ``place`` (``rank_in_order``).
    """
    group = F.col(group_col) if group_col else F.lit("")
    at = {t: t for t in targets}  # what is asked for, and how far it has been followed
    sizes = dict.fromkeys(at, FEW + 1)
    while True:
        open_ = {at[t]: None for t in at if sizes[t] > FEW and len(at[t].prefix) < WHOLE}
        if not open_:
            break
        length = min(len(t.prefix) for t in open_)
        now = {t for t in open_ if len(t.prefix) == length}
        digits = 1
        while length + digits < WHOLE and len(now) * 16 ** (digits + 1) <= COUNTED:
            digits += 1
        below: dict[tuple[str, str], list[tuple[str, int]]] = {}
        within = rows.where(_under(group, place[0], {(t.group, t.prefix) for t in now}))
        for g, p, n in prefix_counts(within, length + digits, place[0], group_col):
            below.setdefault((g, p[:length]), []).append((p, n))
        for t in at:
            if at[t] in now:
                g, prefix, rank = at[t]
                for p, n in below.get((g, prefix), ()):
                    if rank < n:
                        at[t], sizes[t] = Target(g, p, rank), n
                        break
                    rank -= n
                else:
                    raise ValueError(f"no row at {t}")
    found: dict[Target, Row] = {}
    few = {t: at[t] for t in at if sizes[t] <= FEW}
    if few:
        some = rows.where(_under(group, place[0], {(t.group, t.prefix) for t in few.values()}))
        some = some.select(group.alias("_g"), *place).repartition(1).sortWithinPartitions("_g", *place).collect()
        for t, (g, prefix, rank) in few.items():
            found[t] = [r for r in some if r["_g"] == g and r[place[0]].startswith(prefix)][rank]
    many = {t: at[t] for t in at if sizes[t] > FEW}
    if many:
        some = rows.where(_under(group, place[0], {(t.group, t.prefix) for t in many.values()})).select(group.alias("_g"), *place)
        ranked = rank_in_order(some, ["_g", *place])
        before, first = 0, {}
        for g, p in sorted({(t.group, t.prefix) for t in many.values()}):
            first[g, p] = before
            before += next(sizes[t] for t in many if at[t][:2] == (g, p))
        wanted = {first[t.group, t.prefix] + t.rank for t in many.values()}
        by_rank = {r["rank"]: r for r in ranked.where(F.col("rank").isin(*wanted)).collect()}
        for t, (g, p, rank) in many.items():
            found[t] = by_rank[first[g, p] + rank]
    return {t: Row(**{c: found[t][c] for c in place}) for t in at}


def _prefix(hash_col: str, digits: int) -> Column:
    return F.coalesce(F.substring(hash_col, 1, digits), F.lit(""))


def _under(group: Column, hash_col: str, wanted: set[tuple[str, str]]) -> Column:
    """Whether a row lies under one of the prefixes, which are as many as rows are wanted."""
    by_length: dict[int, list[str]] = {}
    for g, prefix in sorted(wanted):
        by_length.setdefault(len(prefix), []).append(f"{g}/{prefix}")
    out = F.lit(False)
    for length, names in by_length.items():
        out = out | F.concat(group, F.lit("/"), _prefix(hash_col, length)).isin(*names)
    return out
