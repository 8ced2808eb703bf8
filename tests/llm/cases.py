"""Small tables that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    text = [r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n)]
    return " ".join(w + (".\n" if k % 11 == 10 else "") for k, w in enumerate(text))


def hard(spark, names: str = "doc_id long, text string, n_chars long, row long, id long, t long, size long, kept boolean, part int"):
    """Rows with extra columns whose names operators use inside."""
    same = prose(1, 80)
    near = same.replace("the", "teh", 1)
    rows = [
        (1, None), (2, ""), (3, same), (4, same), (4, same), (5, near), (6, "  \n\t "), (7, "word"), (8, prose(2, 4000)),
        (9, "é" * 300 + " ünïcode ß 日本語 😀"), (None, same), (10, "a" * 5000), (11, prose(3, 60) + same + prose(4, 60)), (12, "Word"), (None, None),
    ]
    extra = len(names.split(", ")) - 3
    return spark.createDataFrame([(i, t, len(t or ""), *[None] * extra) for i, t in rows], names)


def empty(spark):
    return hard(spark).limit(0)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=lambda r: [(v is None, str(v)) for v in r])
