"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import bpe, common, embedding_dedup, exact_dedup, language_id, minhash, mixing, pii, sharding, substring_dedup, url_filter
from tests.llm.conftest import ROWS

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OPERATORS = {
    "pii": lambda d: pii.digests(pii.personal_data(d)),
    "exact": exact_dedup.exact_duplicates,
    "mix": lambda d: mixing.mix(d).drop("source"),
    "bpe": lambda d: bpe.encode(d.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, digest=True),
    "shard": sharding.shard_documents,
    "near": lambda d: minhash.near_duplicates(d, words=2),
    "language": language_id.identify,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document_and_no_clash(name, tricky, clashing, empty):
    run = OPERATORS[name]
    plain = run(tricky)
    rows = sorted(map(tuple, plain.collect()), key=str)
    assert len(rows) == len(ROWS)
    assert sorted(map(tuple, run(clashing).select(plain.columns).collect()), key=str) == rows
    assert run(empty).count() == 0


def test_exact(tricky):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(tricky).collect()}
    assert got[1] == (2, 3, False)
    twins = sorted((r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(tricky).collect() if r.doc_id == 2)
    assert twins == [(2, 3, False), (2, 3, True)]
    assert got[5] == (5, 3, True) and got[3] == got[4] == (5, 3, False)
    assert got[8] == (8, 2, True) and got[10] == (8, 2, False)


def test_exact_deals_large_groups_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPLIT", 3)
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(60)], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == 60 and {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(1, 40)}
    assert [r.doc_id for r in sorted(got) if r.kept] == sorted([1, *range(0, 60, 3)])


def test_exact_tells_collisions_apart(tricky):
    weak = lambda norm: F.unhex(F.substring(F.md5(norm), 1, 1).cast("string"))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(exact_dedup.exact_duplicates(tricky, weak)) == key(exact_dedup.exact_duplicates(tricky))


def test_exact_drop_keeps_columns_and_one_row(tricky, clashing):
    out = exact_dedup.drop_exact_duplicates(clashing)
    assert out.columns == clashing.columns
    ids = sorted((r.doc_id or -1) for r in out.collect())
    assert ids == [-1, 2, 5, 6, 7, 8, 9, 11, 12, 13, 14]


def test_near(tricky):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(tricky, words=2).collect()}
    assert got[1][1] == got[2][1] == 1 and got[8][1] == got[9][1] == got[10][1] == 8
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[11] == (1, 11, True)
    assert got[None][1] is None and got[None][2]
    left = {r.doc_id for r in minhash.drop_near_duplicates(tricky, words=2).collect()}
    assert {9, 10, 2}.isdisjoint(left) and {1, 8, None} <= left


def test_language(tricky):
    got = {r.doc_id: r for r in language_id.identify(tricky).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 6))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in language_id.keep_identified(tricky).collect()}.isdisjoint({3, 4, 5, 6})


def test_columns_that_clash_pass_through(spark, tricky, clashing, empty):
    """Operators on whole rows give the columns of their input back, whatever these are called."""
    key = lambda d: sorted(map(tuple, d.select(tricky.columns).collect()), key=str)
    for run in (language_id.keep_identified, substring_dedup.without_repeats, minhash.drop_near_duplicates, exact_dedup.drop_exact_duplicates):
        out = run(clashing)
        assert out.columns == clashing.columns and key(out) == key(run(tricky)) and run(empty).count() == 0
        more = [c for c in clashing.columns if c not in tricky.columns]
        assert {tuple(r) for r in out.select(*(f"`{c}`" for c in more)).collect()} == {tuple(range(len(more)))}
    coded = bpe.encode(clashing, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == [*(c for c in clashing.columns if c not in ("text", "n_tokens", "ids")), "n_tokens", "ids"]
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(coded.withColumn("decoded", F.lit(1)), RANKS).collect()}
    assert back == {r.doc_id: r.text or "" for r in tricky.collect()}


def test_cuts_are_removed(spark, tricky, tmp_path):
    with common.cuts_removed():
        made = common.cut(tricky)
        exact_dedup.exact_duplicates(made).write.parquet(f"{tmp_path}/out")
        assert os.path.isdir(made._cut_path)
    assert not os.path.isdir(made._cut_path) and spark.read.parquet(f"{tmp_path}/out").count() == len(ROWS)


def test_language_without_labels(tricky):
    got = language_id.identify(tricky.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in got.collect()} == {"und"}


def test_substring(spark, tricky, clashing, empty):
    got = sorted(map(tuple, substring_dedup.repeated_passages(tricky).collect()))
    assert got == sorted(map(tuple, substring_dedup.repeated_passages(clashing).collect()))
    assert {(r[0], r[6]) for r in got} >= {(13, False), (14, False), (8, True)}
    assert substring_dedup.repeated_passages(empty).count() == 0
    texts = {r.doc_id: r.text for r in substring_dedup.without_repeats(tricky).collect()}
    assert texts[14].startswith("andere zeile\n") and texts[14].endswith("\nende") and len(texts[14].split()) < 20 and texts[1].startswith("the cat") and texts[3] is None


def test_mixed_documents(spark, tricky, clashing, empty):
    got = sorted(map(tuple, mixing.mixed_documents(tricky).collect()), key=str)
    rows = {tuple(r) for r in tricky.collect()}
    assert set(got) <= rows and max(map(got.count, got)) <= 3 * 2  # one row of the table stands there twice
    assert not any(r[1] is None or not r[1].split() for r in got)
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns and sorted(map(tuple, out.select(tricky.columns).collect()), key=str) == got
    assert mixing.mixed_documents(empty).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1),
            (9, [1.0, 0.1], 1), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (1, [1.0, 0.0], 1), (13, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"rep": F.lit(1), "links": F.lit(2), "id": F.lit(3)})
    got = {}
    for r in embedding_dedup.near_vectors(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] * 2 and got[2] == [(3, 1, False)] and got[9] == [(3, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 10, 11, 12, 13)) and got[None] == [(0, None, True)]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_length_link(spark):
    """Norms that over- or underflow don't hide a direction."""
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1e200], 1), (3, [1.0, 1.0], 1), (4, [1e-200, 1e-200], 1), (5, [5e-324, 5e-324], 1), (6, [1e308, -1e308], 1), (7, [-1e-300, 1e-300], 1)]
    for kind in ("array<double>", "array<float>"):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("embedding", F.expr(f"transform(embedding, x -> x{' * 1e-190' if 'float' in kind else ''})").cast(kind))
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
        if kind == "array<double>":
            assert all(got[i] == (4, 1) for i in range(1, 6)) and got[6] == (0, 6) and got[7] == (0, 7)
        else:
            assert got[1] == got[2] == (1, 1) and got[3] == (0, 3)


def test_url_filter(spark):
    caps = [(1, "https://www.a.example.org/x", "2024-01-05"), (2, "http://u@a.example.org:80/", "2024-02-05"), (3, "ftp://a.example.org", "2024-01-05"), (4, None, "2024-01-05"), (5, "http://a.example.org", None),
            (6, "http://b.org", "2024-03-01"), (6, "http://b.org", "2024-03-01"), (7, "http://A.Example.ORG./", "2024-04-01")]
    entries = [("a.example.org", "add", "spam", "2024-01-01"), ("a.example.org", "remove", None, "2024-02-01"), ("a.example.org", "add", "adult", "2024-03-01"), ("b.org", "add", "x", "2024-03-01"),
               (None, "add", "x", "2024-01-01"), ("c.org", "add", "x", None), ("b.org", "what", "x", "2024-01-01"), ("b.org", "add", "x", "2024-03-01")]
    c = spark.createDataFrame(caps, "id long, url string, fetched string").withColumn("pattern", F.lit("clash"))
    e = spark.createDataFrame(entries, "pattern string, action string, category string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = sorted((r.id, r.blocked, r.pattern, r.category) for r in url_filter.filter_captures(c, e).collect())
    assert got == [(1, True, "a.example.org", "spam"), (2, False, None, None), (3, False, None, None), (4, False, None, None), (5, False, None, None), (6, True, "b.org", "x"), (6, True, "b.org", "x"), (7, True, "a.example.org", "adult")]
    assert not any(r.blocked for r in url_filter.filter_captures(c, e.limit(0)).collect())
    assert url_filter.filter_captures(c.limit(0), e).count() == 0


def test_url_filter_deals_large_hosts_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SPLIT", 4)
    c = spark.createDataFrame([(i, "http://a.org/x" if i % 3 else f"http://b{i}.org", "2024-01-05") for i in range(60)], "id long, url string, fetched string")
    e = spark.createDataFrame([("a.org", "add", "x", "2024-01-01")], "pattern string, action string, category string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.id: r.blocked for r in url_filter.filter_captures(c, e).collect()} == {i: i % 3 != 0 for i in range(60)}


def test_url_interval_edges(spark):
    """An entry holds from its own time and no longer at the time of the next."""
    c = spark.createDataFrame([(1, "http://a.org", "2024-01-01"), (2, "http://a.org", "2024-02-01"), (3, "http://a.org", "2023-12-31")], "id long, url string, fetched string")
    e = spark.createDataFrame([("a.org", "add", "x", "2024-01-01"), ("a.org", "remove", None, "2024-02-01")], "pattern string, action string, category string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.id: r.blocked for r in url_filter.filter_captures(c, e).collect()} == {1: True, 2: False, 3: False}


def test_passage_inside_lines(spark):
    """A passage set into running words of two documents is found in both; what is only theirs stays."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    said = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = " ".join(said(9) for _ in range(6))
    own = [[said(8) for _ in range(10)] for _ in range(3)]
    texts = [" ".join([*own[i][:4], f"und {i} dann", passage, *own[i][4:]]) for i in range(2)] + [" ".join(own[2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.end, r.kept) for r in substring_dedup.repeated_passages(docs).collect()}
    assert set(got) == {0, 1} and got[0][2] and not got[1][2]
    for i, (start, end, _) in got.items():
        at = texts[i].index(passage)
        assert at <= start and end <= at + len(passage) + 1 and end - start > 0.7 * len(passage)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert left[0] == texts[0] and left[2] == texts[2] and all(s in left[1] for s in own[1]) and passage not in left[1]
