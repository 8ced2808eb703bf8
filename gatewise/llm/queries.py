"""Registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.llm import bpe, codes, exact, licenses, minhash, packing, quality, sentences, simhash, suffix, toolcalls, toxicity, whitening

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(read(spark, sf_dir))


@query
def op2_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of two sentences, however short: together they cover all longer runs that repeat."""
    return sentences.dedup_spans(read(spark, sf_dir)).drop("kept")


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir), length=200)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, in a tree of directories derived from its source and id; ids divisible by 10 are named as licence files."""
    folder = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.when(F.col("doc_id") % 100 != 0, F.expr("doc_id div 10")))
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.license_scan(read(spark, sf_dir).withColumn("path", F.concat_ws("/", folder, name)))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(read(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)


#: Tools that the derived calls name, and the kinds of their arguments.
TOOLS = {
    "count": {"conv": "integer", "digest": "string?", "words": "number"},
    "search": {"conv": "integer?", "digest": "string", "words": "integer"},
}


@query
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as a call that needs the assistant's last but one turn; each later user turn as a result of the turn before; all other turns as messages.

    Arguments are derived from the turn's text; by conversation some are mistyped, some lack a field, some are cut off.
    """
    turns = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    call_id = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    words = F.size(F.split("text", " ")).cast("string")
    words = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit('"'), words, F.lit('"'))).otherwise(words)
    digest = F.when(F.col("conv_id") % 11 == 0, "").otherwise(F.concat(F.lit('"digest": "'), F.md5("text"), F.lit('", ')))
    arguments = F.concat(F.lit('{"words": '), words, F.lit(", "), digest, F.lit('"conv" : '), F.col("conv_id"), F.when(F.col("conv_id") % 13 == 0, "").otherwise("}"))
    name = F.when(F.col("conv_id") % 17 == 0, "fly").when((F.col("conv_id") + F.col("turn")) % 2 == 0, "count").otherwise("search")
    own = turns.where("role = 'assistant'").select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    earlier = own.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("call_id").alias("after"))
    calls = own.join(earlier, ["conv_id", "turn"], "left")
    asked = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1)
    results = turns.where("role = 'user' AND turn > 0").select("conv_id", "turn", asked.alias("call_id"), F.col("text").alias("content"))
    other = ~F.coalesce(F.expr("role = 'assistant' OR (role = 'user' AND turn > 0)"), F.lit(False))
    messages = read(spark, sf_dir, "conversations").where(other).select("conv_id", "turn", "role", F.col("text").alias("content"))
    return toolcalls.format_calls(calls, results, TOOLS, messages)


ORACLES["op7_tool_calls"] = r"""
    WITH RECURSIVE turns AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    ), own AS (
        SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, md5(text) AS digest, len(string_split(text, ' ')) AS words,
            CASE WHEN conv_id % 17 = 0 THEN 'fly' WHEN (conv_id + turn) % 2 = 0 THEN 'count' ELSE 'search' END AS name
        FROM turns WHERE role = 'assistant'
    ), deep AS (
        SELECT conv_id, turn, 0::BIGINT AS depth FROM own WHERE (conv_id, turn - 2) NOT IN (SELECT (conv_id, turn) FROM own)
        UNION ALL
        SELECT o.conv_id, o.turn, d.depth + 1 FROM deep d JOIN own o ON o.conv_id = d.conv_id AND o.turn = d.turn + 2
    ), answers AS (
        SELECT conv_id, turn, 'c' || conv_id || '-' || (turn - 1) AS call_id, text FROM turns WHERE role = 'user' AND turn > 0
    ), checked AS (
        SELECT o.*, d.depth, a.text AS content, concat_ws('; ',
            CASE WHEN name = 'fly' THEN 'tool' WHEN o.conv_id % 13 = 0 THEN 'arguments' END,
            CASE WHEN name = 'search' AND o.conv_id % 13 <> 0 AND o.conv_id % 11 = 0 THEN 'digest: missing' END,
            CASE WHEN name <> 'fly' AND o.conv_id % 13 <> 0 AND o.conv_id % 7 = 0 THEN 'words: not ' || if(name = 'count', 'number', 'integer') END) AS errors
        FROM own o JOIN deep d USING (conv_id, turn) LEFT JOIN answers a ON a.conv_id = o.conv_id AND a.turn = o.turn + 1
    ), done AS (
        SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN content IS NULL THEN 'open' ELSE 'done' END AS status FROM checked
    )
    SELECT conv_id, turn, 'call' AS kind, call_id, depth, status, errors,
        '{"arguments":' || CASE WHEN conv_id % 13 = 0 THEN 'null' ELSE
            '{"conv":' || conv_id || CASE WHEN conv_id % 11 = 0 THEN '' ELSE ',"digest":"' || digest || '"' END
            || ',"words":' || CASE WHEN conv_id % 7 = 0 THEN '"' || words || '"' ELSE words::VARCHAR END || '}' END
        || ',"depth":' || depth || ',"id":"' || call_id || '","name":"' || name || '","result":'
        || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS json
    FROM done
    UNION ALL
    SELECT conv_id, turn, 'orphan', call_id, NULL, 'orphan', '', '{"id":"' || call_id || '","result":' || to_json(text)::VARCHAR || ',"status":"orphan"}'
    FROM answers a WHERE (conv_id, turn - 1) NOT IN (SELECT (conv_id, turn) FROM own)
    UNION ALL
    SELECT conv_id, turn, 'message', NULL, NULL, 'message', '',
        '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
    FROM conversations WHERE NOT coalesce(role = 'assistant' OR (role = 'user' AND turn > 0), false)
"""


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(read(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(read(spark, sf_dir))


ORACLES["op9_exact_dedup"] = r"""
    WITH a AS (
        SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
    ), b AS (
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM a
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM b
"""


@query
def op10_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(read(spark, sf_dir), size=4)


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """The rounds one after the other; entries and vectors as rows of part, place and value."""
    steps = [
        """kept AS MATERIALIZED (
        SELECT vec_id, label, embedding FROM embeddings
        WHERE embedding IS NOT NULL AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0
    ), vals AS MATERIALIZED (
        SELECT vec_id, (i - 1) // (n // 8) AS part, (i - 1) % (n // 8) AS place, floor(4096 * embedding[i]::DOUBLE)::BIGINT AS v
        FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
    ), first AS (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16
    ), book0 AS MATERIALIZED (
        SELECT part, entry, place, v AS c FROM vals JOIN first USING (vec_id)
    )"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
        SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
        FROM (SELECT vec_id, part, entry, sum((v - c) * (v - c))::BIGINT AS d FROM vals JOIN book{k} USING (part, place) GROUP BY vec_id, part, entry)
        GROUP BY vec_id, part
    )""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
        SELECT part, entry, place, sum(v)::BIGINT AS s, count(*) AS n FROM vals JOIN near{k} USING (vec_id, part) GROUP BY part, entry, place
    ), book{k + 1} AS MATERIALIZED (
        SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM book{k} LEFT JOIN mean{k} USING (part, entry, place)
    )""")
    return "WITH " + ", ".join(steps) + f"""
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
        (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
    FROM (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
    JOIN kept USING (vec_id)
"""


ORACLES["op12_vector_codes"] = _codes_sql()


@query
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
