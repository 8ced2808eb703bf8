import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_minhash import brute as components
from tests.llm.test_suffix import brute as repeats
from tests.oracle import difference, duck

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]


def test_every_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in NAMES if n != "pipeline") == sorted(f"op{k}" for k in range(1, 14))


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) == ""


def test_stages(spark, tmp_path):
    """Every stage against what it says of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = at = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert at.columns == docs.columns and at.schema == docs.schema
    rows = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in kept.items() if name != "packing"}
    assert 0 < len(rows["toxicity"]) <= docs.count()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    assert len(rows["exact_dedup"]) == len({plain(t) for _, t in rows["exact_dedup"]}) == len({plain(t) for _, t in rows["toxicity"]})
    want = components(rows["exact_dedup"], 5)
    assert sorted(i for i, _ in rows["near_dedup"]) == sorted(i for i, c in want.items() if i == c)
    removed = {i: b[1] for (i, _), b in zip(rows["near_dedup"], repeats(rows["near_dedup"], 200))}
    before = dict(rows["near_dedup"])
    assert sorted(removed) == sorted(i for i, _ in rows["suffix_dedup"])
    for i, text in rows["suffix_dedup"]:
        assert abs(len(before[i].encode()) - removed[i] - len(text.encode())) <= 6 * (removed[i] > 0)
    assert kept["packing"].select("doc_id").distinct().count() == len(rows["suffix_dedup"])


def test_pipeline_runs(spark):
    assert entry.queries()["pipeline"](spark, SF).where("offset + length > 2048").count() == 0
