"""The pipeline's stages against brute force."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lumenlake.llm import bpe, language_id, mixing
from tests.llm.naive import naive_bundle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SAID = {"en": "the old house stands near the river and the children play there after school every day", "de": "das alte haus steht nahe am fluss und die kinder spielen dort nach der schule jeden tag",
        "fr": "la vieille maison se trouve près de la rivière et les enfants y jouent après l'école chaque jour"}


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences in three languages and three sources, exact and near copies, junk, nulls and empty texts."""
    rng = random.Random(6)
    rows = []
    for i in range(150):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(f"{w}{rng.choice(['', '', 's', 'e'])}" for _ in range(rng.choice([1, 3, 8])) for w in rng.sample(SAID[lang].split(), 12))
        rows.append((i, text, lang if i % 5 else None, "abc"[min(rng.randrange(9), 2)]))
    long = [r for r in rows if len(r[1].split()) > 90]
    rows += [(1000 + i, r[1].replace(" ", "  ", 3), r[2], "b") for i, r in enumerate(rows[:20])]
    rows += [(1100 + i, r[1].replace(r[1].split()[50], "changed", 1), r[2], "a") for i, r in enumerate(long[:10])]
    rows += [(1200 + i, "".join(rng.choice("bcdfghjkqvwxz ") for _ in range(300)), None, "c") for i in range(10)]
    rows += [(1300, None, "en", "a"), (1301, "", None, None), (1302, "12 34", "de", "b"), (1303, "文字" * 60, None, "c"), (None, "the children play near the old house", "en", "a")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def staged(spark, corpus):
    """What each stage made of what the one before kept."""
    docs, out = spark.createDataFrame(corpus, SCHEMA), [[tuple(r) for r in corpus]]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.columns == docs.columns
        out.append([tuple(r) for r in made.collect()])
        docs = spark.createDataFrame(out[-1], SCHEMA)
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    return [*out, coded.collect()]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]


def test_language_stage(spark, staged, corpus):
    """It keeps what a naive cosine with naive bundles says, sentences above all, and no letter junk."""
    given, kept = staged[0], staged[1]
    prototypes = language_id.fit(spark.createDataFrame(corpus, SCHEMA).filter(~language_id.held_out()))
    best = {}
    for r in given:
        v = naive_bundle(r[1])
        best[r[:2]] = max(float(v @ np.array(p)) / np.linalg.norm(v) for p in prototypes.values()) if v.any() else -1.0
    edge = language_id.chance_score()
    assert {r[:2] for r in kept} == {k for k, cos in best.items() if cos >= edge} or all(abs(best[k] - edge) < 1e-4 for k in {r[:2] for r in kept} ^ {k for k, cos in best.items() if cos >= edge})
    ids = {r[0] for r in kept}
    assert {r[0] for r in corpus if r[0] is not None and r[0] < 1200} <= ids and ids.isdisjoint({1300, 1301, 1302}) and len(ids & set(range(1200, 1304))) <= 1


def test_exact_stage(staged):
    groups = defaultdict(list)
    for r in staged[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    first = lambda g: max(g, key=lambda r: (len(r[1]), -(r[0] if r[0] is not None else 10**18)))
    assert sorted(staged[2], key=str) == sorted(map(first, groups.values()), key=str) and len(staged[2]) < len(staged[1])


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_stage(staged):
    """Of all documents that links of 0.8 or more join, the one with the smallest doc_id stays."""
    rows = [r for r in staged[2] if r[0] is not None]
    sets, top = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        smallest[find(i)] = min(r[0], smallest.get(find(i), r[0]))
    assert {r[0] for r in staged[3]} == {*smallest.values(), *(r[0] for r in staged[2] if r[0] is None)} and len(staged[3]) < len(staged[2])


def test_mixing_stage(staged):
    """Whole documents, three times at most, in the sources' proportions."""
    given, got = staged[3], staged[4]
    assert set(got) <= set(given) and max(Counter(got).values()) <= 3
    assert_proportions(given, got, lambda r: r[3])


def assert_proportions(given, got, source):
    size = Counter()
    largest = Counter()
    for r in given:
        n = len((r[1] or "").split())
        size[source(r)] += n
        largest[source(r)] = max(largest[source(r)], n)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size.values())
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]
        if not over:
            total = sum(weight[x] for x in free)
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3 * size[s]
            free.remove(s)
        left = sum(size.values()) - sum(target.values())
    taken = Counter()
    for r in got:
        taken[source(r)] += len(r[1].split())
    for s in names:
        # half the largest document, and blocks that are unequal by up to half
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + mixing.BLOCK_WORDS + 0.05 * target[s], (s, taken[s], target[s])


def test_mix_takes_whole_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.choice([0, 1, 7, 40, 300]))), "abc"[min(rng.randrange(9), 2)]) for i in range(240)] + [(900, "lang " * 4000, "c"), (901, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert set(got) <= set(rows) and max(Counter(got).values()) <= 3
    assert_proportions(rows, got, lambda r: r[2])
    assert sorted(got) == sorted((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs.repartition(3), "").collect())


def test_coding_stage_round_trips(spark, staged):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocab = bpe.Coder(bpe.read_ranks(path), public_tokenizers.PATTERN).vocab
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
    rows = staged[5]
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((r[0], tuple(enc.encode_ordinary(r[1]))) for r in staged[4])
    assert all(r.n_tokens == len(r.ids) for r in rows)
    coded = spark.createDataFrame([(r.doc_id, r.ids) for r in rows], "doc_id long, ids array<int>")
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(coded, path).collect()) == Counter((r[0], r[1]) for r in staged[4])


def test_coding_stage_decodes(spark):
    """The stage itself decodes what it has coded, long and odd texts too."""
    texts = [None, "", " \t\n", "über den Fluß 文字 😀", "x" * 3000, " ".join(f"word{i}" for i in range(30_000)), "the same", "the same"]
    docs = spark.createDataFrame([(i, t, None, "a", None) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    got = corpus_pipeline.byte_bpe(spark, docs, "")
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"]
    rows = got.collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in rows) == [(i, t or "") for i, t in enumerate(texts)]
    back = bpe.decode(got.select("doc_id", "ids"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {r.doc_id: bytes(r.decoded) for r in rows}


def test_last_stage_decodes_the_mix(staged):
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in staged[5]) == Counter((r[0], r[1]) for r in staged[4])


def test_run_is_the_stages_one_after_another(spark, corpus, staged, tmp_path):
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda rows: Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in rows)
    once = key(corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert once == key(staged[5]) and once == key(corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
