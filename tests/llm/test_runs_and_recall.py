"""Runs of letters in op4, many identifiers and spoken addresses in op1, near copies of short passages in op6."""

import random
import string
import time

import numpy as np
import public_tokenizers
import pytest

from lumenlake.llm import bpe, pii, substring_dedup

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe._coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(coder, text):
    return np.frombuffer(coder.encode([text])[0], "<u4").tolist()


@pytest.mark.parametrize("units", [string.ascii_letters, ["ab", "​", "=-", "the", string.ascii_lowercase, "漢", "ñ"]], ids=["letters", "others"])
def test_runs_are_encoded_in_about_linear_time(coder, library, units):
    for unit in units:
        text = unit * (20_000 // len(unit))
        began = time.process_time()
        got = ids(coder, text)
        assert time.process_time() - began < 5, unit
        assert got == library.encode_ordinary(text), unit


def test_a_very_long_run(coder):
    began = time.process_time()
    assert b"".join(coder.decode(coder.encode(["c" * 300_000]))) == b"c" * 300_000
    assert time.process_time() - began < 30


def test_words_of_few_bytes(coder, library):
    rng = random.Random(6)
    for _ in range(150):
        some = rng.choice(["", "the", "ing", "ation"]) + "".join(rng.sample(string.ascii_lowercase + "éñ-=._", rng.randint(2, 7)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(64, 1200)))
        assert ids(coder, text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["juan arroba correo punto es", "ola at firma dot no", "jan at bedrijf dot be", "maria at web dot com", "stay at home dot org"])
def test_spoken_addresses_under_any_top_domain(text):
    assert [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text)] == [("email", text)]


@pytest.mark.parametrize("text", ["look at this dot the end", "the cat at the dot com", "we are at that dot"])
def test_words_that_are_no_address(text):
    assert pii.find_spans(text) == []


def test_very_many_identifiers():
    text = " ".join(f"user{i}@mail{i}.com" for i in range(50_000)) + " maria at web dot com"
    began = time.process_time()
    assert len(pii.find_spans(text)) == 50_001
    assert time.process_time() - began < 15


def near_copies(seed, lengths, pairs):
    """Documents in twos that share a passage but for one word, words of their own before and behind it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9)))
    docs, twos = [], []
    for n in lengths:
        for _ in range(pairs):
            one = [word() for _ in range(n)]
            other = list(one)
            other[rng.randrange(n)] = word()
            twos.append((n, len(docs), len(docs) + 1))
            docs += [(len(docs) + k, " ".join([*(word() for _ in range(60)), *p, *(word() for _ in range(60))])) for k, p in enumerate((one, other))]
    return docs, twos


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add(r.cluster_id)
    return out


def test_near_copies_of_short_passages_are_found(spark):
    docs, twos = near_copies(7, (60, 70, 100), 120)
    got = found(substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    for n, least in ((60, 0.92), (70, 0.97), (100, 0.99)):
        hits = [bool(got.get(a, set()) & got.get(b, set())) for m, a, b in twos if m == n]
        assert sum(hits) / len(hits) >= least, n
    assert all(len(c) == 1 for c in got.values())


def test_starts_with_many_classes_give_the_same_rows(spark):
    rng = random.Random(8)
    head = [f"h{i}" for i in range(20)]
    docs = []
    for i in range(40):
        tail = [f"t{i // 2}x{k}" for k in range(60)]
        if i % 2:
            tail[rng.randrange(30, 60)] = "changed"
        docs.append((i, " ".join([f"a{i}", f"b{i}", *head, *tail])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda **o: sorted(map(tuple, substring_dedup.repeated_passages(df, **o).collect()))
    assert rows() == rows(together=1) != []
