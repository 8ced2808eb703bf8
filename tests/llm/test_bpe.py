import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from gatewise.llm import bpe
from tests.llm.cases import empty, hard

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_hard_rows_round_trip(spark):
    df = hard(spark)
    want = sorted((str(r.doc_id), ",".join(map(str, PLAIN.encode_ordinary(r.text or ""))), (r.text or "").encode()) for r in df.collect())
    got = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got.collect()) == want
    assert got.where("n_tokens <> IF(ids = '', 0, size(split(ids, ',')))").count() == 0


def test_digests(spark):
    df = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()}
    ids = ",".join(map(str, PLAIN.encode_ordinary("x <|endoftext|> y")))
    assert got[1].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[2].n_tokens == 0
    assert got[1].decoded_sha256 == hashlib.sha256(b"x <|endoftext|> y").hexdigest()


@pytest.mark.parametrize("text", ["a" * 700, "   x\n\n\n y", "'ll 've don't '''s", "\U0001f469‍\U0001f4bb ź̂", "1234567 0x00 \x00\x01", "ab" * 300, "日本語のテキスト", " " * 400 + "x", "Ωμέγα привет שלום"])
def test_words_of_all_kinds(text):
    coder = bpe._coders.setdefault("test", None) or bpe.Coder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    bpe._coders["test"] = coder
    ids, n, raw = coder.texts([text])[0]
    assert ids == ",".join(map(str, PLAIN.encode_ordinary(text))) and raw == text.encode() and n == len(ids.split(","))


def test_small_queries_give_the_same(monkeypatch):
    coder = bpe._coders.get("test") or bpe.Coder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    whole = coder.texts(["some words which repeat some words"])
    monkeypatch.setattr(bpe, "QUERY_BYTES", 5)
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert coder.texts(["some words which repeat some words"]) == whole


def of(coder, words):
    coder.known.clear()
    coder.learn(words)
    return [coder.known[w][0] for w in words]


def plain(word):
    return ",".join(map(str, PLAIN._core_bpe.encode_ordinary(word)))


@pytest.mark.parametrize("seed", range(6))
def test_all_sure_pairs_at_once_give_the_tokens_of_one_after_the_other(monkeypatch, seed):
    """Words of few letters, where chains and merges that disturb one another are many; and pieces of tokens."""
    coder = bpe._coders.get("test") or bpe.Coder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    bpe._coders["test"] = coder
    r = random.Random(seed)
    pieces = [p for p in (t.decode("utf-8", "ignore") for t in RANKS) if p.isalpha()]
    letters = [["a", "b"], list("etaoin"), list("asdfghjklASDF"), list("กขคงจนมอ"), list("的是不了人我在有"), pieces]
    words = ["".join(r.choices(some, k=r.randint(2, 60))) for some in letters for _ in range(60)]
    words = [w for w in dict.fromkeys(words) if PLAIN._core_bpe.encode_ordinary(w) and coder.find(w) == [w]]
    monkeypatch.setattr(bpe, "LONG", 1)
    assert of(coder, words) == [plain(w) for w in words]
    monkeypatch.setattr(bpe, "LONG", 1 << 30)
    assert of(coder, words) == [plain(w) for w in words]


@pytest.mark.parametrize("letters", ["a", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "กขคงจฉชซฌญดตถทธนบปผ", "的是不了人我在有他这"])
def test_very_long_words(letters):
    coder = bpe._coders.get("test") or bpe.Coder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    word = "".join(random.Random(5).choices(letters, k=100_000 // len(letters[0].encode())))
    assert coder.find(word) == [word] and of(coder, [word]) == [plain(word)]


def test_empty_table(spark):
    assert bpe.digests(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0
