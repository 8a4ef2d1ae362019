"""Ranked search, resampling and token counts against plain definitions, on tricky rows and on long runs."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenlake.llm import ranked_search, resampling, token_counts
from tests.llm.conftest import ROWS

FILE = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked_plainly(docs, items, top=10):
    words = [(d, re.findall(ranked_search.TERM, lower(t))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(re.findall(ranked_search.TERM, lower(text)))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, w in words:
            m, tf = 10 + 90 * len(w) * n_docs // n_terms, Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


ITEMS = [(1, "The cat ran home"), (2, "w1 w2 W3, w40"), (2, "word5"), (3, ""), (4, None), (None, "dog text 文字"), (5, "nowhere")]


def test_search_on_tricky_rows(spark, tricky, clashing, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = ranked_plainly([r[:2] for r in ROWS], ITEMS)
    assert rows(ranked_search.search(tricky, items)) == want
    more = items.selectExpr("*", "1 as term", "2 as block", "3 as rank", "4 as `a.b`")
    assert rows(ranked_search.search(clashing, more)) == want
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(tricky, items.limit(0)).count() == 0


def test_search_over_segments_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", 40)
    monkeypatch.setattr(ranked_search, "ITEMS", 5)
    monkeypatch.setattr(ranked_search, "WIDTH", 8)
    rng = random.Random(5)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(300)]
    docs = [(i // 2, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    docs += [(1000 + i, "t1 t2 t3") for i in range(200)]
    items = [(f"q{i}", " ".join(rng.choice(vocabulary) for _ in range(8))) for i in range(23)]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id string, text string"))
    assert rows(got) == ranked_plainly(docs, items)


@pytest.mark.parametrize("seed", range(4))
def test_best_skips_without_loss(seed):
    rng, n = np.random.default_rng(seed), 20_000
    lists = []
    for share in (0.7, 0.5, 0.3, 0.1, 0.02, 0.01, 0.001):
        docs = np.flatnonzero(rng.random(n) < share)
        lists.append(ranked_search._List(docs, rng.integers(1, 4 if seed < 2 else 1000, len(docs)), -(-n // ranked_search.WIDTH)))
    sums = np.zeros(n, np.int64)
    for x in lists:
        sums[x.docs] += x.scores
    order = np.lexsort((np.arange(n), -sums))[:10]
    docs, got = ranked_search.best(lists, n, 10)
    assert docs.tolist() == order.tolist() and got.tolist() == sums[order].tolist()


def test_spans_have_their_crc():
    rng = random.Random(1)
    spans = [rng.randbytes(n) for n in [*range(1, 200), 255, 256, 257, 4095, 4096, 4097, 100_003, 3_000_001]]
    lengths = np.array([len(s) for s in spans])
    starts = np.cumsum(lengths + 1) - lengths - 1
    got = resampling.crc32_of_spans(np.frombuffer(b" ".join(spans), np.uint8), starts, starts + lengths)
    assert got.tolist() == [zlib.crc32(s) for s in spans]


def resampled_plainly(docs, target, percent=10, n=1, buckets=10_000, least=20):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for text in target for b in features(text)[0])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for d, f, words in found:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("n,percent,buckets", [(1, 10, 10_000), (3, 60, 10_000), (2, 100, 70_000), (1, 0, 50)])
def test_resample_on_tricky_rows(spark, tricky, clashing, n, percent, buckets):
    rng = random.Random(2)
    more = [(100 + i, " ".join(rng.choice(["der", "Die", "x", "ä", "9"]) for _ in range(rng.randint(15, 30))), "de", "a") for i in range(60)]
    more += more[:20]
    target = ["die ä X x", None, "", "w1 w2 w3"]
    docs = tricky.union(spark.createDataFrame(more, tricky.schema))
    wanted = resampled_plainly([r[:2] for r in ROWS + more], target, percent, n, buckets)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows(resampling.resample(docs, goal, percent, n, buckets)) == wanted


def test_resample_without_rows_or_target(spark, tricky, clashing, empty):
    goal = spark.createDataFrame([("the cat",)], "text string")
    assert resampling.resample(empty, goal).count() == 0
    assert rows(resampling.resample(clashing, goal)) == rows(resampling.resample(tricky, goal)) == resampled_plainly([r[:2] for r in ROWS], ["the cat"])
    assert rows(resampling.resample(tricky, empty)) == resampled_plainly([r[:2] for r in ROWS], [])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_counts_on_tricky_rows(tricky, clashing, empty, library):
    wanted = []
    for d, text, lang, source in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted.append((d, lang, source, len((text or "").encode()), n, n > 512))
    assert rows(token_counts.count_tokens(tricky, FILE)) == sorted(wanted, key=str)
    plain = token_counts.count_tokens(tricky, FILE)
    assert rows(token_counts.count_tokens(clashing, FILE).select(plain.columns)) == rows(plain)
    assert token_counts.count_tokens(empty, FILE).count() == 0


def test_counts_of_mixed_strings(library, monkeypatch):
    own, rng = token_counts.Tokenizer(token_counts.read_tokenizer(FILE)), random.Random(4)
    parts = ["a", "b", "the", "<|endoftext|>", "<|end", " ", "  ", "\n", "\t", "'s", "'ll", "é", "文字", "😀", "123", "​", "　", "...", "--", "x́", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.count(t) for t in texts] == wanted
    monkeypatch.setattr(token_counts, "CHARS", 5)
    monkeypatch.setattr(token_counts, "KEPT", 100)
    assert [own.count(t) for t in texts] == wanted


@pytest.mark.parametrize("unit", ["a", "c", "e", "ab", "​", "=-", " ", "\n", "漢"])
def test_counts_of_long_runs(unit, library):
    own, text = token_counts.Tokenizer(token_counts.read_tokenizer(FILE)), unit * 100_000
    began = time.process_time()
    n = own.count(text)
    assert time.process_time() - began < 20
    assert n == len(library.encode(text, add_special_tokens=False).ids)
