"""License scans (operator 5): sparse TF-IDF cosine to templates, then inheritance down directories.

Units of a whole text are its sentences, cut at line breaks or joined across them, its paragraphs and
the text itself; so a header is found wrapped or not, and a licence file as a whole. Units and templates
are vectors of their words, weighted by count and inverse document frequency over the sentences of all
texts; words that no template has weigh as if met once. Most units are ruled out by how many of their
words templates know at all, which bounds their cosine. A text's license is that of its longest unit that
is close enough to a template. Rows without one inherit from the nearest directory above them that has a
licence file: a file named like one, or a text most of whose words are in licence units, that has a license.

Only the directories' names and licenses are joined; a directory with very many rows is dealt out
by row, and has one row on the other side. Directories that hold a licence file are sent to all tasks if
they are few, by their measured size; what is made of the rows never is, as Spark sizes it by compressed
files and before directories are listed, so many times too low.

Defined results: null and empty texts have no license of their own; a null path is no licence file
and inherits nothing; of equally near templates the first by name wins, of equally long units the nearest,
of several licence files in a directory the nearest to its template, then the first by license and path; repeated rows get the
same result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.scratch import table, workers
from gatewise.llm.text import Block, Hashes, blocks, column, lower, rows_of, runs, words
from gatewise.sources.store import broadcast

#: Identifiers that a line ``SPDX-License-Identifier: <identifier>`` may give (fixed values); what follows the
#: version ("-only", "-or-later") is no part of the license reported.
IDENTIFIERS = (
    "0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 "
    "CC-BY-SA-4.0 CC0-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 OFL-1.1 Unlicense WTFPL Zlib"
).split()

# Parts of licence texts that several licenses share (fixed values).
_GNU = (
    "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published "
    "by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
)
_GNU_NO_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NO_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_NO_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_CONDITION = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software."
)
_MIT_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies."
)
_ISC_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
    "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_NO_WARRANTY = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/."
)
_BSL = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
    "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:"
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_CC0 = (
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public "
    "domain worldwide. This software is distributed without any warranty."
)

#: Header, title and licence wordings by license (fixed values).
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(":", "Affero", ",", "3")),
    ("AGPL-3.0", _GNU.format(":", "Affero", ",", "3") + " " + _GNU_NO_WARRANTY.format("Affero")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + " " + _APACHE_NO_WARRANTY),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_NO_WARRANTY),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_NO_ENDORSEMENT),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NO_ENDORSEMENT + _BSD_NO_WARRANTY),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", _BSL),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", _CC0),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(";", "", ";", "2")),
    ("GPL-2.0", _GNU.format(";", "", ";", "2") + " " + _GNU_NO_WARRANTY.format("")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(":", "", ",", "3")),
    ("GPL-3.0", _GNU.format(":", "", ",", "3") + " " + _GNU_NO_WARRANTY.format("")),
    ("ISC", _ISC_GRANT),
    ("ISC", _ISC_GRANT + " " + _ISC_NO_WARRANTY),
    ("LGPL-2.1", _GNU.format(";", "Lesser", ";", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(":", "Lesser", ",", "3")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT + _MIT_CONDITION),
    ("MIT", _MIT_GRANT + ", subject to the following conditions:"),
    ("MIT", _MIT_GRANT + _MIT_CONDITION + " " + _MIT_NO_WARRANTY),
    ("MIT-0", _MIT_GRANT + ". " + _MIT_NO_WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", _MPL),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    *((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS),
)

#: Cosine from which a unit counts as a license, and share of a text's words that makes it a licence file.
NEAR, FILE_SHARE = 0.85, 0.5

#: Bytes of directories that hold a licence file up to which all tasks are sent them.
SENT = 1 << 22

#: Names of licence files, whatever their case and ending.
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"


class Units:
    """The words of a block's texts (hashes, without signs around a word), and its units as ranges of words.

    ``first`` and ``last`` (exclusive) bound a unit, ``row`` is its text; the first ``sentences`` units are
    the sentences and lines, then come those that lie on several lines, paragraphs, and whole texts.
    """

    def __init__(self, block: Block):
        data = lower(block.data)
        starts, ends, firsts = words(Block(block.start, data, block.offsets))
        none = np.zeros(0, np.int64)
        self.terms, self.first, self.last, self.row, self.sentences = np.zeros(0, np.uint64), none, none, none, 0
        if not len(starts):
            return
        solid = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(solid, at, -1))
        first = np.minimum.accumulate(np.where(solid, at, len(data))[::-1])[::-1]
        begin, end = first[starts], last[ends - 1] + 1
        some = begin < end
        if not some.any():
            return
        # A sentence may end at a word that is only signs.
        stops = np.isin(data[ends - 1], (33, 46, 63))
        stopped = np.concatenate([[0], np.cumsum(stops)])
        own = np.flatnonzero(some)
        begin, end, row = begin[some], end[some], rows_of(firsts)[some]
        self.terms = Hashes(data)(begin, end)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        behind = np.append(begin[1:], len(data))
        lines = breaks[behind] - breaks[end]
        stop = stopped[np.append(own[1:], len(starts))] > stopped[own]
        close = np.append(row[1:] != row[:-1], True)
        kinds = [close | stop | (lines > 0), close | stop | (lines > 1), close | (lines > 1), close]
        seen, ranges = np.zeros(0, np.int64), []
        for cuts in kinds:
            to = np.flatnonzero(cuts) + 1
            of = np.concatenate([[0], to[:-1]])
            key = of * (len(row) + 1) + to
            new = ~np.isin(key, seen)
            seen = np.concatenate([seen, key[new]])
            ranges.append((of[new], to[new]))
        self.sentences = len(ranges[0][0])
        self.first, self.last = (np.concatenate(side) for side in zip(*ranges))
        self.row = row[self.first]

    def words(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words of the chosen units, and for each the number of its unit among them."""
        sizes = self.last[chosen] - self.first[chosen]
        return runs(self.first[chosen], sizes), np.repeat(np.arange(len(chosen)), sizes)


def _counted(terms: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each unit: unit, term, count."""
    order = np.lexsort((terms, unit))
    terms, unit = terms[order], unit[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (unit[1:] != unit[:-1])
    at = np.flatnonzero(new)
    return unit[at], terms[at], np.diff(np.append(at, len(terms)))


class Templates:
    """Template vectors over their own vocabulary, once the units of the corpus are counted."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [name for name, _ in templates]
        self.vectors = []
        for _, text in templates:
            data = " ".join(text.splitlines()).encode()
            units = Units(Block(0, np.frombuffer(data, np.uint8), np.array([0, len(data)])))
            self.vectors.append(np.unique(units.terms, return_counts=True))
        self.terms = np.unique(np.concatenate([t for t, _ in self.vectors])) if templates else np.zeros(0, np.uint64)
        self.idf = np.ones(len(self.terms))
        self.rare = 1.0
        self.matrix = np.zeros((len(self.terms), len(templates)))

    def weigh(self, units: int, met: dict[int, int]) -> Templates:
        df = np.array([met.get(k, 0) for k in range(len(self.terms))], float)
        self.idf = np.log((units + 1) / (df + 1)) + 1
        self.rare = float(np.log((units + 1) / 2) + 1)
        for k, (terms, counts) in enumerate(self.vectors):
            at = np.searchsorted(self.terms, terms)
            self.matrix[at, k] = counts * self.idf[at]
        self.matrix /= np.linalg.norm(self.matrix, axis=0)
        return self

    def place(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def cosines(self, terms: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
        """Best template of each unit, given by its words, and its cosine. Of equal ones the first."""
        own, term, count = _counted(terms, unit)
        at = self.place(term)
        weight = count * np.where(at >= 0, self.idf[at], self.rare)
        norm = np.sqrt(np.bincount(own, weight**2, units))
        known = at >= 0
        dots = np.zeros((units, len(self.names)))
        np.add.at(dots, own[known], self.matrix[at[known]] * weight[known, None])
        best = dots.argmax(1)
        return best, np.round(dots[np.arange(units), best] / np.maximum(norm, 1e-12), 9)  # equal ones are equal

    def near(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units within ``NEAR`` of a template: their numbers, templates and cosines.

        Of a unit, k words known to templates weigh at most k times the largest weight, and each of the n others
        at least a word met once; where that leaves the cosine below ``NEAR``, the words aren't counted.
        """
        if not len(units.first) or not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        met = np.concatenate([[0], np.cumsum(self.place(units.terms) >= 0)])
        known = met[units.last] - met[units.first]
        other = units.last - units.first - known
        most = (known * max(self.idf.max(), self.rare)) ** 2
        hopeful = np.flatnonzero((known > 0) & (most >= NEAR**2 * (most + other * self.rare**2)))
        # Next the cosine as if every unknown word were met once in its unit, a bound that needs no sorting.
        kept = []
        for a in range(0, len(hopeful), 4096):
            some = hopeful[a : a + 4096]
            at, number = units.words(some)
            place = self.place(units.terms[at])
            inside = place >= 0
            counts = np.bincount(number[inside] * len(self.terms) + place[inside], minlength=len(some) * len(self.terms))
            weight = counts.reshape(len(some), -1) * self.idf
            norm = (weight * weight).sum(1) + other[some] * self.rare**2
            kept.append(some[(weight @ self.matrix).max(1) ** 2 >= (NEAR - 1e-9) ** 2 * norm])
        kept = np.concatenate([np.zeros(0, np.int64), *kept])
        at, number = units.words(kept)
        best, cosine = self.cosines(units.terms[at], number, len(kept))
        close = cosine >= NEAR
        return kept[close], best[close], cosine[close]


def weighted_templates(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text") -> Templates:
    """Counts in how many units of all texts each template word occurs (as many numbers as template words)."""
    made = Templates(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, units = np.zeros(len(made.terms), np.int64), 0
        for batch in batches:
            for block in blocks(column(batch, "text")):
                found = Units(block)
                units += found.sentences
                at = made.place(found.terms)
                known = at >= 0
                unit = np.repeat(np.arange(found.sentences), (found.last - found.first)[: found.sentences])
                pairs = np.unique(unit[known] * len(made.terms) + at[known])
                total += np.bincount(pairs % len(made.terms), minlength=len(made.terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(total)), -1)), pa.array(np.append(total, units))], ["term", "n"])

    counted = docs.select(docs[text_col].alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    met = {r.term: r.n for r in counted.collect()}
    return made.weigh(met.pop(-1, 0), met)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``<id_col>, <path_col>, own_license, cosine, share (of words in licence units)`` of each row."""
    spark = docs.sparkSession
    workers(spark)
    sent = broadcast(spark, weighted_templates(docs, templates, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            for block in blocks(column(batch, "text")):
                units = Units(block)
                near, best, cosine = made.near(units)
                sentence = slice(0, units.sentences)
                size, row = units.last - units.first, units.row
                total = np.bincount(row[sentence], size[sentence], len(block))
                inside = np.zeros(len(units.terms) + 1, np.int64)
                np.add.at(inside, units.first[near], 1)
                np.add.at(inside, units.last[near], -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(inside[:-1]) > 0)])
                covered = np.bincount(row[sentence], (covered[units.last] - covered[units.first])[sentence], len(block))
                names: list[str | None] = [None] * len(block)
                value = np.zeros(len(block))
                # The longest unit of a text comes last, of equal ones the nearest, then the first by name.
                for k in sorted(range(len(near)), key=lambda k: (size[near[k]], cosine[k], [*(-ord(c) for c in made.names[best[k]]), 1])):
                    names[row[near[k]]], value[row[near[k]]] = made.names[best[k]], cosine[k]
                own = [column(batch, c).slice(block.start, len(block)) for c in ("id", "path")]
                share = covered / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(value), pa.array(share)], ["id", "path", "own_license", "cosine", "share"])

    rows = docs.select(docs[id_col].alias("id"), docs[path_col].alias("path"), docs[text_col].alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, path string, own_license string, cosine double, share double")
    return out.withColumnsRenamed({"id": id_col, "path": path_col})


def inherit(scanned: DataFrame, id_col: str = "doc_id", path_col: str = "path") -> DataFrame:
    """``<id_col>, <path_col>, license, how (own, inherited, none), cosine, licence_path`` of each scanned row.

    Directories above a row are joined, all at once, with those that have a licence file; the longest wins.
    """
    rows = table(
        scanned.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(path_col).alias("path"), "own_license", "cosine", "share"
        ),
        "scanned",
    )
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    is_file = F.col("path").rlike(FILE_NAME) | (F.col("share") >= FILE_SHARE)
    held = rows.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & is_file)
    held = table(held.groupBy(folder.alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("far"), "own_license", "path")).alias("held")), "held")
    size = held.agg(F.sum(F.octet_length("above") + F.octet_length("held.path") + 100)).first()[0] or 0
    parts = F.split(folder, "/")
    # "a/b/c" lies under "a/b/c", "a/b", "a" and the root, "".
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    wants = rows.where("own_license IS NULL AND path IS NOT NULL").select("row", F.explode(F.array_distinct(above)).alias("above"))
    met = wants.join(held.hint("broadcast" if size <= SENT else "merge"), "above")
    nearest = met.groupBy("row").agg(F.max(F.struct(F.length("above").alias("deep"), "held")).alias("found"))
    out = rows.join(nearest.hint("merge"), "row", "left")
    license_ = F.coalesce("own_license", "found.held.own_license")
    how = F.when(F.col("own_license").isNotNull(), "own").when(license_.isNotNull(), "inherited").otherwise("none")
    from_ = F.when(F.col("own_license").isNull(), F.col("found.held.path"))
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), license_.alias("license"), how.alias("how"), F.round("cosine", 6).alias("cosine"), from_.alias("licence_path")
    )


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Licenses of whole texts and, for rows without one, of the directories they lie in."""
    return inherit(scan(docs, templates, id_col, path_col, text_col), id_col, path_col)
