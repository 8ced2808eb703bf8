import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gatewise.llm import toxicity
from gatewise.llm.text import blocks, words
from tests.llm.cases import WORDS, empty, hard

BAD = ["idiot", "moron", "stupid", "trash", "loser"]


def table(spark, n=600):
    r = random.Random(4)
    data = []
    for i in range(n):
        text = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        toxic = int(i % 4 == 0)
        for _ in range(r.randint(2, 5) * toxic):
            text.insert(r.randrange(len(text)), r.choice(BAD))
        data.append((i, " ".join(text), toxic))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(*table(spark))


def test_held_out_rows_are_told_apart(spark, model):
    docs, labels = table(spark)
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


@pytest.mark.parametrize("said", ["1d10t", "id1ot", "i d i o t", "i.d.i.o.t", "idiooooot", "IDIOT", "st_u_p_i_d", "$tup1d", "tr@sh", "m0r0n,", "l0oooser"])
def test_disguised_words_are_restored(model, said):
    channel = model.channel
    text = f"this was {said} to them"
    block = next(blocks(pa.array([text])))
    starts, ends, firsts = words(block)
    raw = block.data.tobytes()
    plain = [raw[a:b].decode().lower().strip(",.") for a, b in zip(starts, ends)]
    restored = [channel.restore(raw[starts[a] : ends[b - 1]].decode()) for a, b in toxicity.disguised(block, starts, ends, firsts)]
    assert set(BAD) & {*plain, *restored}


def test_plain_words_are_left_alone(model):
    block = next(blocks(pa.array(["the and of in 1999 cost $30 at 4 pm!! e.g. a-b well-known 50% ..."])))
    found = toxicity.disguised(block, *words(block))
    assert len(found) == 0


def decoded(model, text):
    block = next(blocks(pa.array([text])))
    starts, ends, firsts = words(block)
    raw = block.data.tobytes()
    return [model.channel.words(raw[starts[a] : ends[b - 1]].decode()) for a, b in toxicity.disguised(block, starts, ends, firsts)]


def test_spaced_runs_restore_to_several_words(model):
    assert decoded(model, "t h e i d i o t") == [["the", "idiot", "theidiot"]]
    long = " ".join("which not they are " * 20)  # over 200 characters in front
    assert "moron" in decoded(model, f"{long} m o r o n")[0]
    clean, bad, hidden = model.scores(pa.array(["the of and to", "the of and to stupid loser", "the of and to s t u p i d l o s e r"]))
    assert hidden == pytest.approx(bad) and hidden > clean + 0.3


@pytest.mark.parametrize("said", ["idi" + "o" * 100 + "t", "idi" + "o" * 300 + "t", "mor0" + "o" * 80 + "n"])
def test_words_of_any_length_are_restored(model, said):
    assert [w for found in decoded(model, said) for w in found][0] in BAD


@pytest.mark.parametrize("said", ["é t é s", "ñ a ñ a", "fééééé", "ÉéÉ", "é.é.é"])
def test_accented_letters_count_as_one(model, said):
    block = next(blocks(pa.array([said])))
    starts, ends, firsts = words(block)
    assert toxicity.disguised(block, starts, ends, firsts) == [(0, len(starts))]


def test_disguise_does_not_hide(spark, model):
    clean, bad, hidden = "the of and to in is", "the idiot of and moron to in is", "the 1d1ot of and m o r o n to in is"
    scores = model.scores(pa.array([clean, bad, hidden, "", None]))
    assert scores[2] == pytest.approx(scores[1]) and scores[2] > scores[0] + 0.3
    assert scores[3] == scores[4] == scores[0]


def every_path(channel, word):
    """All ways through a word's lattice: what it may mean, and the cost of that."""
    paths, before = [("", 0.0)], ""
    for c in word:
        if c in toxicity.LEET:
            options = [(x, -0.2) for x in toxicity.LEET[c]] + [("", -5.0)]
        elif c.isalpha():
            options = [(c, 0.0)] + ([("", -0.3)] if c == before else [])
        elif c.isspace():
            options = [("", -0.1), (" ", -0.1)]
        else:
            options = [("", -0.1 if c in toxicity.JOINTS else -1.0)]
        paths = [(said + x, cost + price) for said, cost in paths for x, price in options]
        before = c
    best: dict[str, float] = {}
    for said, cost in paths:
        s = [0, 0, *(0 if x == " " else 2 + toxicity.ALPHABET.index(x) if x in toxicity.ALPHABET else 1 for x in said), 0]
        total = cost + sum(channel.log[a][b][c] for a, b, c in zip(s, s[1:], s[2:]))
        best[said] = max(total, best.get(said, -np.inf))
    return best


@pytest.mark.parametrize("word", ["1d10t", "m0r0n", "l0o0ser", "$tup1d", "i d i o t", "s.t_u-p*d", "aab!|1", "tr@5h", "é t é s", "looooser", "7h3 1d", "a1!", "ñ4ñ4", "1", "...", "xx yy"])
def test_decoding_equals_enumeration_of_all_paths(model, word):
    best = every_path(model.channel, word)
    found = model.channel._decode(word)
    assert best[found] == pytest.approx(max(best.values()), abs=1e-9)


def test_the_model_is_what_plain_counting_gives(spark, model):
    """Trigrams, document counts, odds and inputs again, with dictionaries."""
    docs, labels = table(spark)
    texts, toxic = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for text in texts.values():
        s = [0, 0, *toxicity.symbols(text).tolist(), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    assert (counts == model.counts).all()
    parts = {r.doc_id: r.p for r in docs.selectExpr("doc_id", "pmod(xxhash64('part', doc_id), 3) AS p").collect()}
    inside = [i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1 and parts[i] != 0]
    bad = sum(toxic[i] for i in inside)
    seen: dict[str, list[int]] = {}
    for i in inside:
        terms = {w for word in texts[i].split() for w in ([word, word[: toxicity.STEM] + "*"] if len(word) > toxicity.STEM else [word])}
        for term in terms:
            seen.setdefault(term, [0, 0])[toxic[i]] += 1
    odds = {t: np.log(((b + 0.5) / (bad + 1)) / ((g + 0.5) / (len(inside) - bad + 1))) for t, (g, b) in seen.items() if b >= toxicity.SUPPORT}
    odds = {t: v for t, v in odds.items() if v >= np.log(toxicity.ODDS)}
    assert sorted(odds.values()) == pytest.approx(sorted(model.odds.tolist())) and len(odds) >= len(BAD)
    x = model.signals(pa.array(list(texts.values())))
    for row, text in zip(x, texts.values()):
        hits = {t for word in text.split() for t in (word, word[: toxicity.STEM] + "*" if len(word) > toxicity.STEM else word) if t in odds}
        assert row.tolist() == pytest.approx([1, np.log1p(sum(odds[t] for t in hits)), np.log1p(len(hits))])


def test_beginnings_are_cut_by_character():
    data = "éééééé ééééé éééééà aéaéaéa".encode()
    block = next(blocks(pa.array([data.decode()])))
    starts, ends, firsts = words(block)
    row, found = toxicity._features_of(block.data, starts, ends, np.arange(len(starts)))
    of = {k: found[row == k].tolist() for k in range(4)}
    assert [len(of[k]) for k in range(4)] == [2, 1, 2, 2]
    assert of[0][1] == of[2][1] and of[0][0] != of[2][0] and of[3][1] != of[0][1]


def test_hard_rows(spark, model):
    df = hard(spark)
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == df.count()
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert toxicity.score(empty(spark), model).count() == 0


def test_labels_are_learned_from_rows_not_held_out_only(spark):
    docs, labels = table(spark, 90)
    inside = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    all_, some = toxicity.train(docs, labels), toxicity.train(docs, labels.where(labels.doc_id.isin(inside)))
    assert (all_.lexicon == some.lexicon).all() and all_.weights == pytest.approx(some.weights)


@pytest.mark.parametrize("share", [0, 1, None])
def test_labels_of_one_kind_or_none(spark, share):
    docs, labels = table(spark, 30)
    given = labels.limit(0) if share is None else labels.selectExpr("doc_id", f"{share} AS toxic")
    model = toxicity.train(docs, given)
    assert model.scores(pa.array(["idiot"]))[0] == pytest.approx(share or 0, abs=1e-9)


def test_empty_documents(spark):
    docs, labels = table(spark, 10)
    assert toxicity.score(docs, toxicity.train(docs.limit(0), labels)).count() == 10
