import hashlib
import re

import pytest

from gatewise.llm import sentences
from tests.llm.cases import empty, hard, prose


def cut(text):
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    out, now = [], []
    for k, w in enumerate(words):
        now.append(w)
        then = words[k + 1].start() if k + 1 < len(words) else len(text)
        if k + 1 == len(words) or w[0][-1] in ".!?" or "\n" in text[w.end() : then]:
            out.append((now[0].start(), [re.sub("[A-Z]", lambda m: m[0].lower(), x[0]) for x in now]))
            now = []
    return [(b, out[i + 1][0] if i + 1 < len(out) else len(text), w) for i, (b, w) in enumerate(out)]


def brute(data, n_words, least=2):
    seen, out = {}, {}
    for i, text in sorted(set(data), key=lambda r: (r[0] is None, r[0] or 0)):
        cuts, gone = cut(text or ""), set()
        for a in range(len(cuts)):
            b = a
            while b < len(cuts) and (b - a < least - 1 or sum(len(w) for *_, w in cuts[a : b + 1]) < n_words):
                b += 1
            if b == len(cuts):
                continue
            key = tuple(w for *_, ws in cuts[a : b + 1] for w in ws)
            if key in seen:
                gone |= set(range(a, b + 1))
            else:
                seen[key] = (i, a)
        kept, at = "", 0
        for k, (a, b, _) in enumerate(cuts):
            if k in gone:
                kept, at = kept + text[at:a], b
        kept += (text or "")[at:]
        out[i, text or ""] = (len(cuts), sorted(gone), kept)
    return out


def check(df, least):
    want = brute([(r.doc_id, r.text) for r in df.collect()], least)
    texts = {(r.doc_id, r.text or "") for r in df.collect()}
    got = (sentences.dedup_spans(df) if least == 1 else sentences.dedup_spans(df, least=least)).collect()
    assert len(got) == df.count()
    left = sorted((str(i), n, tuple(gone), kept) for (i, t), (n, gone, kept) in want.items() if (i, t) in texts)
    assert sorted({(str(r.doc_id), r.n_sentences, tuple(r.removed), r.kept) for r in got}) == sorted(set(left))
    for r in got:
        assert r.n_removed == len(r.removed) and r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
        assert bool(r.first_ids) == bool(r.removed)


@pytest.mark.parametrize("least", [1, 16])
def test_hard_rows(spark, least):
    df = hard(spark).where("doc_id IS NOT NULL OR text IS NULL")
    check(df, least)


@pytest.mark.parametrize("seed, least", [(1, 1), (2, 1), (1, 16), (2, 16)])
def test_shared_passages(spark, seed, least):
    passage = prose(seed, 60)
    data = [(k, prose(10 * k + seed, 30) + (passage if k % 3 else passage.upper()) + prose(7 * k + seed, 20)) for k in range(12)]
    data += [(20, passage + passage), (21, "Er. Er. Er. Er."), (22, "Er. Er. Er. Er.")]
    check(spark.createDataFrame(data, "doc_id long, text string"), least)


def test_query_takes_short_runs_and_the_ends_of_passages(spark, tmp_path):
    from gatewise.llm.queries import QUERIES

    ten = "one two three four five six seven eight nine ten."
    passage = f"{ten} {ten.upper()} And so it ends."
    texts = [f"{passage} Here is text of its own that nothing else holds.", f"{passage} Other words follow in this one until it stops too."]
    texts += ["Who knows? Nobody does.", "Who knows? Nobody does.", f"First words. {passage}", "Nobody does. Who knows?"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in QUERIES["op2_sentence_span_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: [], 1: [0, 1, 2], 2: [], 3: [0, 1], 4: [1, 2, 3], 5: []}


def test_empty_table(spark):
    assert sentences.dedup_spans(empty(spark)).count() == 0
