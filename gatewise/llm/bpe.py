"""Byte-level BPE (operator 6): recursive DuckDB queries in each task contract the words of its texts.

Spark deals the texts out; a task splits them into words, and each word it has not met goes once
through a recursive query whose rows are token positions: they join the merge table, each word's
leftmost pair of minimum rank is contracted, until no pair is left. Words decode by an ordered
aggregation of their tokens' bytes; a text is the sequence of its words.

A long word (text without spaces, encoded data) would take a step for each of its merges. Its query
contracts in one step all pairs that one merge after the other would come to contract in any case:

* A pair that ranks before both of its neighbours is contracted unless another merge takes one of its
  tokens first. That needs a token that grows up to the pair from outside and joins a part of it at a
  lower rank; tables name such merges by the neighbour, the part and the byte behind the neighbour.
* The token made must not join what may come beside it at a lower rank than its own, as then the
  order would matter. The same tables tell.
* In a chain of overlapping pairs of one rank, every second one is contracted, from the left.
* Of pairs of the word's least rank, those before the first that fails the second rule, and that one.

Defined results: null and empty texts have no tokens; special tokens' strings are ordinary text;
repeated rows give repeated results; null ids stay null; other columns are not read. Words of any
length are encoded whole, with about 700 bytes of memory a byte above 256 KB (a megabyte: 36 to 79 s, 0.8 GB).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gatewise.llm.scratch import workers
from gatewise.llm.text import column
from gatewise.sources.store import broadcast

#: Bytes of words given to one recursive query, and words remembered by a worker (memory only).
QUERY_BYTES, REMEMBERED = 1 << 18, 1_000_000

#: Most memory of a query, and again as much for each further :data:`QUERY_BYTES` of a word longer than that.
MEMORY_MB = 600

#: Bytes from which a word goes through the query of long words; both give the same tokens.
LONG = 512

#: Bytes of text whose words are collected before the new ones are encoded.
TEXT_BYTES = 4 << 20

MERGES = """
    CREATE TABLE merges AS
    SELECT l.id AS l, r.id AS r, t.id AS id, (l.id::BIGINT << 32) + r.id AS pair
    FROM (SELECT id, hex, unnest(range(2, length(hex), 2)) AS k FROM tokens) t
    JOIN tokens l ON l.hex = substr(t.hex, 1, t.k) JOIN tokens r ON r.hex = substr(t.hex, t.k + 1)
"""

#: ``spot`` is a token's word, and its position in the lower 32 bits.
START = """
    WITH RECURSIVE steps(spot, tok, merging) AS (
        SELECT (w.word::BIGINT << 32) + w.k, t.id::INTEGER, true
        FROM (SELECT word, hex, unnest(range(length(hex) // 2)) AS k FROM words ANTI JOIN tokens USING (hex)) w
        JOIN tokens t ON t.hex = substr(w.hex, 2 * w.k + 1, 2)
      UNION ALL
"""

ONE_PAIR = """
        (WITH pairs AS (
            SELECT spot, tok, lead(spot) OVER w AS next_spot, lead(tok) OVER w AS next_tok, lag(spot) OVER w AS last_spot
            FROM steps WHERE merging WINDOW w AS (ORDER BY spot)
        ), ranked AS (
            SELECT p.*, spot >> 32 AS word, (m.id::BIGINT << 32) + (spot & 4294967295) AS place
            FROM pairs p LEFT JOIN merges m ON m.pair = CASE WHEN next_spot >> 32 = spot >> 32 THEN (tok::BIGINT << 32) + next_tok END
        ), best AS (
            SELECT word, min(place) AS least FROM ranked GROUP BY word
        )
        SELECT spot, CASE WHEN place = least THEN (least >> 32)::INTEGER ELSE tok END, least IS NOT NULL
        FROM ranked JOIN best USING (word) WHERE least IS NULL OR last_spot IS NULL OR last_spot <> (word << 32) + (least & 4294967295))
"""

#: Tables of long words: first and last bytes of tokens; the least merge of a token that ends in (begins with) a part
#: and goes on with a byte, by the other token of the merge.
GROWING = """
    CREATE TABLE edges AS SELECT id, ('0x' || hex[1:2])::UTINYINT AS first, ('0x' || hex[-2:])::UTINYINT AS last FROM tokens;
    CREATE TABLE cuts AS
    SELECT id, hex[1:k] AS head, hex[k + 1:] AS tail, ('0x' || hex[k - 1:k])::UTINYINT AS head_byte, ('0x' || hex[k + 1:k + 2])::UTINYINT AS tail_byte
    FROM (SELECT id, hex, unnest(range(2, length(hex), 2)) AS k FROM tokens);
    CREATE TABLE from_left AS
    SELECT t.id AS l, m.r, head_byte AS byte, min(m.id) AS id
    FROM cuts c JOIN tokens t ON t.hex = c.tail JOIN merges m ON m.l = c.id GROUP BY ALL;
    CREATE TABLE from_right AS
    SELECT m.l, t.id AS r, tail_byte AS byte, min(m.id) AS id
    FROM cuts c JOIN tokens t ON t.hex = c.head JOIN merges m ON m.r = c.id GROUP BY ALL;
    DROP TABLE cuts
"""

ALL_SURE_PAIRS = """
        (WITH beside AS (
            SELECT spot >> 32 AS word, (spot & 4294967295)::INTEGER AS pos, s.tok, (row_number() OVER w)::INTEGER AS nth, lag(tok) OVER w AS x, lead(tok) OVER w AS b, lead(tok, 2) OVER w AS y,
                lag(last, 2) OVER w AS left_byte, lead(first, 3) OVER w AS right_byte
            FROM steps s JOIN edges e ON e.id = s.tok WHERE merging WINDOW w AS (PARTITION BY spot >> 32 ORDER BY spot)
        ), ranked AS (
            SELECT s.*, m.id, coalesce(m.id, 2147483647) AS own FROM beside s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.b
        ), near AS (
            SELECT *, lag(own, 1, 2147483647) OVER w AS left_own, min((own::BIGINT << 32) + pos) OVER (PARTITION BY word) AS least,
                own < 2147483647 AND own <= left_own AND own <= lead(own, 1, 2147483647) OVER w AS low
            FROM ranked WINDOW w AS (PARTITION BY word ORDER BY pos)
        ), lows AS (
            SELECT * FROM near WHERE low
        ), undisturbed AS (
            SELECT n.word, n.pos, true AS undisturbed
            FROM lows n LEFT JOIN from_left f ON f.l = n.x AND f.r = n.tok AND f.byte = n.left_byte
            LEFT JOIN from_right g ON g.l = n.b AND g.r = n.y AND g.byte = n.right_byte
            WHERE coalesce(f.id > own, true) AND coalesce(g.id > own, true)
        ), disturbing AS (
            SELECT n.word, n.pos, true AS disturbing
            FROM lows n LEFT JOIN merges m ON m.l = n.x AND m.r = n.id LEFT JOIN merges o ON o.l = n.id AND o.r = n.y
            LEFT JOIN from_left f ON f.l = n.x AND f.r = n.id AND f.byte = n.left_byte
            LEFT JOIN from_right g ON g.l = n.id AND g.r = n.y AND g.byte = n.right_byte
            WHERE least(m.id, o.id, f.id, g.id) < own
        ), told AS (
            SELECT n.* EXCLUDE (x, b, y, left_byte, right_byte), undisturbed, disturbing, min(CASE WHEN disturbing AND own = least >> 32 THEN pos END) OVER (PARTITION BY word) AS until
            FROM near n LEFT JOIN undisturbed USING (word, pos) LEFT JOIN disturbing USING (word, pos)
        ), sure AS (
            SELECT word, pos, tok, nth, id, own, left_own, least, low AND disturbing IS NULL AND (undisturbed IS NOT NULL OR (own = least >> 32 AND pos < coalesce(until, 2147483647))) AS sure FROM told
        ), chains AS (
            SELECT *, max(CASE WHEN NOT sure OR own <> left_own THEN nth * 2 + (sure AND own < left_own)::INTEGER END) OVER w AS head
            FROM sure WINDOW w AS (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING)
        ), chosen AS (
            SELECT word, pos, tok, id, least, own < 2147483647 AND ((own::BIGINT << 32) + pos = least OR (sure AND head % 2 = 1 AND (nth - head // 2) % 2 = 0)) AS joins FROM chains
        ), gone AS (
            SELECT *, lag(joins, 1, false) OVER (PARTITION BY word ORDER BY pos) AS taken FROM chosen
        )
        SELECT (word << 32) + pos, CASE WHEN joins THEN id ELSE tok END, least >> 32 < 2147483647 FROM gone WHERE NOT taken)
"""

DONE = """
    ), done AS (
        SELECT spot, tok FROM steps WHERE NOT merging
      UNION ALL
        SELECT word::BIGINT << 32, id FROM words JOIN tokens USING (hex)
    )
    SELECT spot >> 32 AS word, string_agg(tok::VARCHAR, ',' ORDER BY spot) AS ids, string_agg(hex, '' ORDER BY spot) AS bytes
    FROM done JOIN tokens ON id = tok GROUP BY word
"""


class Coder:
    """One worker's merge table and the words it remembers."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[str, str]] = {}
        self.before: dict[str, tuple[str, str]] = {}
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        rows = [line.split() for line in vocabulary.splitlines() if line]
        tokens = pa.table({"hex": [base64.b64decode(a).hex() for a, _ in rows], "id": pa.array([int(b) for _, b in rows], pa.int32())})
        self.con.register("given", tokens)
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.con.execute(MERGES)
        self.growing = False

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words in queries of a bounded size."""
        waiting: dict[str, list[str]] = {ONE_PAIR: [], ALL_SURE_PAIRS: []}
        sizes = dict.fromkeys(waiting, 0)
        for word in words:
            size = len(word.encode())
            step = ALL_SURE_PAIRS if size >= LONG else ONE_PAIR
            waiting[step].append(word)
            sizes[step] += size
            if sizes[step] >= QUERY_BYTES:
                self._query(waiting[step], step, sizes[step])
                waiting[step], sizes[step] = [], 0
        for step, some in waiting.items():
            if some:
                self._query(some, step, sizes[step])

    def _query(self, words: list[str], step: str, size: int) -> None:
        if step is ALL_SURE_PAIRS and not self.growing:
            self.con.execute(GROWING)
            self.growing = True
        self.con.execute(f"SET memory_limit = '{MEMORY_MB * (1 + size // QUERY_BYTES)}MB'")
        self.con.register("given_words", pa.table({"word": range(len(words)), "hex": [w.encode().hex() for w in words]}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE words AS SELECT * FROM given_words")
        for at, ids, hexes in self.con.execute(START + step + DONE).fetchall():
            word, decoded = words[at], bytes.fromhex(hexes).decode("utf-8", "surrogateescape")
            self.known[word] = (ids, word if decoded == word else decoded)  # one object for both

    def texts(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """Ids joined by commas, their number and the decoded bytes of each text."""
        split = [self.find(text) for text in texts]
        if len(self.known) > REMEMBERED // 2:  # words not met since the last time go
            self.before, self.known = self.known, {}
        new = dict.fromkeys(chain.from_iterable(split)).keys() - self.known.keys()
        again = self.before.keys() & new
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        self.learn(new - again)
        out = []
        for words in split:
            some, parts = zip(*map(self.known.__getitem__, words)) if words else ((), ())
            ids = ",".join(some)
            out.append((ids, ids.count(",") + 1 if ids else 0, "".join(parts).encode("utf-8", "surrogateescape")))
        return out


_coders: dict[tuple, Coder] = {}


def coder(key: tuple[str, str], vocabulary: bytes) -> Coder:
    """The worker's own, which it keeps for its next tasks."""
    if key not in _coders:
        _coders[key] = Coder(vocabulary, key[1])
    return _coders[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids (decimal, joined by commas), n_tokens, decoded (bytes)`` of each row.

    ``vocabulary`` is a file of base64 tokens and ranks; its content is sent to the executors.
    """
    return _coded(docs, vocabulary, pattern, id_col, text_col, "ids string, n_tokens long, decoded binary", lambda got: got)


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids_sha256, n_tokens, decoded_sha256``: :func:`encode`, of which only digests leave the task."""

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    fields = "ids_sha256 string, n_tokens long, decoded_sha256 string"
    return _coded(docs, vocabulary, pattern, id_col, text_col, fields, lambda got: (sha(got[0].encode()), got[1], sha(got[2])))


def _coded(docs, vocabulary, pattern, id_col, text_col, fields, made) -> DataFrame:
    spark = docs.sparkSession
    workers(spark)
    with open(vocabulary, "rb") as f:
        sent = broadcast(spark, f.read())
    key = (vocabulary, pattern)
    names = [field.split()[0] for field in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(key, sent.value)
        for ids, texts in _pieces(batches):
            columns = zip(*[made(got) for got in own.texts(texts)])
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of about :data:`TEXT_BYTES`, over batches."""
    ids: list[pa.Array] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        column_ = column(batch, "text")
        ids.append(column(batch, "id"))
        texts += [t or "" for t in column_.to_pylist()]
        size += column_.nbytes
        if size >= TEXT_BYTES:
            yield pa.concat_arrays(ids), texts
            ids, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), texts
