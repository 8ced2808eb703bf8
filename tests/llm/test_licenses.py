import random

import numpy as np
import pyarrow as pa
import pytest

from gatewise.llm import licenses
from tests.llm.cases import empty, hard, prose

APACHE = "Licensed under the Apache License, Version 2.0."


def scan(spark, rows):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    return {r.doc_id: (r.license, r.how, r.licence_path) for r in licenses.license_scan(df).collect()}


def test_nearest_directory_wins(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."),
        ("a/LICENSE.txt", APACHE),
        ("a/b/c/x.py", prose(1, 30)),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/y.py", prose(2, 30)),
        ("z/y.py", prose(3, 30)),
        ("ab/y.py", "Licensed under CC BY-NC 4.0.\n" + prose(4, 30)),
        ("a/LICENSE2", prose(5, 30)),
        (None, prose(6, 5)),
        ("a/b/c/x.py", None),
    ]
    got = scan(spark, rows)
    assert got[2] == got[9] == ("GPL-3.0", "inherited", "a/b/COPYING")
    assert got[4] == got[7] == ("Apache-2.0", "inherited", "a/LICENSE.txt")
    assert got[5] == ("MIT", "inherited", "LICENSE")
    assert got[6] == ("CC-BY-NC-4.0", "own", None) and got[8] == (None, "none", None)
    assert [got[i][0] for i in (0, 1, 3)] == ["MIT", "Apache-2.0", "GPL-3.0"]


@pytest.mark.parametrize("text", [APACHE, APACHE.upper(), "// " + APACHE + "\n" + prose(1, 200), prose(2, 100) + "\n" + APACHE, "licensed under the apache license version 2.0"])
def test_headers_anywhere(spark, text):
    assert scan(spark, [("x", text), ("y", prose(9, 400))])[0][0] == "Apache-2.0"


@pytest.mark.parametrize("text", ["A license to kill.", "the version of the license was 2.0 in the end of it all", "Released.", "", prose(3, 100)])
def test_other_texts_have_none(spark, text):
    assert scan(spark, [("x", text), ("y", prose(9, 400))])[0][0] is None


def test_cosines_equal_dense_vectors():
    made = licenses.Templates()
    made.weigh(1000, {k: (k * 37) % 300 for k in range(len(made.terms))})
    r = np.random.default_rng(1)
    terms = np.concatenate([made.terms, r.integers(0, 1 << 62, 20, dtype=np.uint64)])
    chosen, unit = r.choice(terms, 400), r.integers(0, 30, 400)
    best, cosine = made.cosines(chosen, unit, 30)
    for u in range(30):
        own = chosen[unit == u]
        counts = np.array([(own == t).sum() for t in terms], float)
        vector = counts * np.append(made.idf, [made.rare] * 20)
        if not len(own):
            continue
        dots = np.vstack([made.matrix, np.zeros((20, len(made.names)))]).T @ vector / np.linalg.norm(vector)
        assert cosine[u] == pytest.approx(dots.max()) and dots[best[u]] == pytest.approx(dots.max())


def wrapped(text, width, sign=""):
    out, line = [], ""
    for word in text.split():
        if line and len(line) + len(word) >= width:
            out, line = [*out, sign + line], ""
        line = f"{line} {word}".strip()
    return "\n".join([*out, sign + line])


def test_units_ruled_out_are_not_near():
    """Every unit again, by its dense vector."""
    made = licenses.Templates()
    made.weigh(5000, {k: (k * 37) % 900 for k in range(len(made.terms))})
    texts = [f"{prose(k, 60)}\n\n{wrapped(made_text, 40 + k, '# ')}\n{prose(k + 9, 20)}" for k, (_, made_text) in enumerate(licenses.TEMPLATES[:42])]
    texts += ["", "...", "the the the of of", "license", licenses._MIT_GRANT * 3]
    units = licenses.Units(next(licenses.blocks(pa.array(texts))))
    near, best, cosine = made.near(units)
    every, far = made.cosines(*(lambda at, number: (units.terms[at], number))(*units.words(np.arange(len(units.first)))), len(units.first))
    assert near.tolist() == np.flatnonzero(far >= licenses.NEAR).tolist() and len(near) > 60
    assert best.tolist() == every[near].tolist() and cosine == pytest.approx(far[near])


GPL = licenses._GNU.format(":", "", ",", "3")
BSD = licenses._BSD_CONDITIONS, licenses._BSD_NO_ENDORSEMENT, licenses._BSD_NO_WARRANTY
MIT = licenses._MIT_GRANT + licenses._MIT_CONDITION, licenses._MIT_NO_WARRANTY
ISC = licenses._ISC_GRANT, licenses._ISC_NO_WARRANTY
FILES = {
    "GPL-3.0": "# Copyright (C) 2020 Ann Other\n#\n" + wrapped(GPL, 60, "# ") + "\n#\n" + wrapped(licenses._GNU_NO_WARRANTY.format(""), 60, "# ") + "\n\nimport os\n",
    "GPL-2.0": " * " + wrapped(licenses._GNU.format(";", "", ";", "2"), 50, " * ") + "\n */\nint main() { return 0; }\n",
    "LGPL-2.1": wrapped(licenses._GNU.format(";", "Lesser", ";", "2.1").replace("program", "library"), 70, "// "),
    "MIT": "MIT License\n\nCopyright (c) 2020 Ann Other\n\n" + "\n\n".join(wrapped(t, 76) for t in MIT) + "\n",
    "ISC": "ISC License\n\nCopyright (c) 2020, Ann Other\n\n" + "\n\n".join(wrapped(t, 76) for t in ISC) + "\n",
    "BSD-2-Clause": "Copyright 2020 Ann Other\n\n" + "\n\n".join(wrapped(t, 70) for t in (BSD[0], BSD[2])) + "\n",
    "BSD-3-Clause": "Copyright 2020 Ann Other\n\n" + "\n\n".join(wrapped(t, 70) for t in BSD) + "\n",
    "Apache-2.0": wrapped(licenses._APACHE, 70, "# ") + "\n#\n" + wrapped(licenses._APACHE_NO_WARRANTY, 70, "# ") + "\nimport sys\n",
    "Zlib": wrapped(licenses._ZLIB, 66),
    "MPL-2.0": "/* " + wrapped(licenses._MPL, 66, " * ") + " */",
}


@pytest.mark.parametrize("name", FILES)
def test_wrapped_headers_and_licence_files(spark, name):
    assert scan(spark, [("x", FILES[name]), ("y", prose(9, 400)), ("z", prose(3, 50) + "\n\n" + FILES[name])])[0][0] == name


@pytest.mark.parametrize("line, name", [("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), ("SPDX-License-Identifier: Nobody-Knows-1.0", None)])
def test_identifiers(spark, line, name):
    assert scan(spark, [("x", line + "\nint main() { return 0; }"), ("y", prose(9, 400))])[0][0] == name


def test_inheritance_equals_a_plain_walk(spark):
    r = random.Random(8)
    folders = [""] + ["/".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(40)]
    texts = [APACHE, "Released under the MIT License.", prose(1, 30), prose(2, 40), "SPDX-License-Identifier: ISC"]
    rows = []
    for k in range(150):
        folder, name = r.choice(folders), r.choice(["LICENSE", "COPYING.txt", "x.py", "y.py", "license_tool.py"])
        rows.append((f"{folder}/{name}".lstrip("/"), r.choice(texts)))
    own = {APACHE: "Apache-2.0", texts[1]: "MIT", texts[4]: "ISC"}
    got = scan(spark, rows)
    files: dict[str, list] = {}
    for path, text in rows:  # all licenses here are at a cosine of 1, so the first by name and path holds
        if text in own:
            files.setdefault(path.rpartition("/")[0], []).append((own[text], path))
    for k, (path, text) in enumerate(rows):
        if text in own:
            assert got[k] == (own[text], "own", None)
            continue
        folder = path.rpartition("/")[0]
        while folder and folder not in files:
            folder = folder.rpartition("/")[0]
        assert got[k] == ((min(files[folder])[0], "inherited", min(files[folder])[1]) if folder in files else (None, "none", None))


def test_hard_rows(spark):
    df = hard(spark)
    df = df.withColumn("path", df["doc_id"].cast("string"))
    got = licenses.license_scan(df)
    assert got.count() == df.count() and got.where("how <> 'none'").count() == 0
    assert licenses.license_scan(df.limit(0)).count() == 0
    assert empty(spark).count() == 0


def test_what_rows_are_made_into_is_not_broadcast(spark, monkeypatch):
    """Only directories that hold a licence file may be, and only if they are few by their own size."""
    rows = [(i, f"a/b/{i}.py", None, 0.0, 0.0) for i in range(40)] + [(k, f"{f}LICENSE", name, 1.0, 1.0) for k, f, name in ((90, "", "MIT"), (91, "a/", "ISC"))]
    scanned = spark.createDataFrame(rows, "doc_id long, path string, own_license string, cosine double, share double")
    few = licenses.inherit(scanned)
    monkeypatch.setattr(licenses, "SENT", 0)
    many = licenses.inherit(scanned)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (few, many)]
    assert [plan.count("BroadcastExchange") for plan in plans] == [1, 0]
    assert "BroadcastHashJoin [above" in plans[0] and "BuildLeft" not in plans[0]
    for df in (few, many):
        got = {r.doc_id: (r.license, r.how, r.licence_path) for r in df.collect()}
        assert got == {**{i: ("ISC", "inherited", "a/LICENSE") for i in range(40)}, 90: ("MIT", "own", None), 91: ("ISC", "own", None)}
