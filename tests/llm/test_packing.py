import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gatewise.llm import packing
from tests.llm.cases import empty, hard, prose

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def one_by_one(counts, capacity):
    """Sequences of the same rule, piece by piece: pairs of large ones, then best fit."""
    left = Counter(counts)
    rooms = []
    large = sorted((n for n in left.elements() if n > capacity / 3), reverse=True)
    while large:
        n = large.pop(0)
        fit = next((k for k, m in enumerate(large) if n + m <= capacity), None)
        rooms.append(capacity - n - (large.pop(fit) if fit is not None else 0))
    for n in sorted((n for n in left.elements() if n <= capacity / 3), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_whole_gapless_and_of_the_rule(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 10, 64, 2048])
    counts = Counter(r.choice([r.randint(1, capacity), min(capacity, 1 + int(r.expovariate(5 / capacity)))]) for _ in range(r.randint(0, 800)))
    sequences, seen = defaultdict(list), Counter()
    for length, first, n, each, sequence, offset in sorted(packing.plan(dict(counts), capacity)):
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            sequences[sequence + k // each].append((offset + k % each * length, length))
    assert seen == counts
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == one_by_one(counts, capacity)


def test_pieces_too_long_are_refused():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def check(df, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = packing.pack_documents(df, PATH, public_tokenizers.PATTERN, capacity).collect()
    want = Counter()
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_hard_rows(spark, capacity):
    check(hard(spark).repartition(3), capacity)


def test_many_copies_of_a_length_are_numbered_across_tasks(spark):
    df = spark.createDataFrame([(k, "same text here" if k % 3 else prose(k, 30)) for k in range(300)], "doc_id long, text string")
    total = packing.token_pieces(df, PATH, public_tokenizers.PATTERN, 64).groupBy().sum("length").first()[0]
    assert check(df.repartition(7), 64) <= total / 64 * 1.1 + 1


def test_tokens_are_those_of_the_other_library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    alphabet = [*"abc XYZ'.,!-\n\t09 ", "é", "ß", "日", "😀", " ", " ", "'ll", "<|endoftext|>", "́", "\r\n", "\x0b", "\x85", "​"]
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert plain.encode_ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_are_matched_whole(spark):
    """Against the tokenizer as it is, which takes the strings of its added tokens as tokens."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    alphabet = [*"ab Z'.\n\t0 ", "  ", "é", "日", "'ll", "<|endoftext|>", "<|endoftext|", "|>", "<", "\r\n", "\x85"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a  <|endoftext|>  b"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: (r.length, r.ids_crc32) for r in packing.token_pieces(df, PATH, public_tokenizers.PATTERN).collect()}
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes())), repr(text)


def test_empty_table(spark):
    assert packing.pack_documents(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0
