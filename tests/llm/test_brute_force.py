"""Operators against brute force, exact round trips and held-out accuracy on the small tables."""

import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenlake.llm import bpe, components, families, language_id, minhash, mixing, pii, queries, sharding, substring_dedup
from tests.compare import database, same
from tests.llm.naive import naive_bundle

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), database(SF), queries.ORACLES[name])


def reference_encoder(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocab, special_tokens={})


def test_bpe_equals_the_library_and_round_trips():
    coder = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    enc, rng = reference_encoder(coder), random.Random(5)
    alphabet = [*"ab '\n\t  \r\x1c\x1f\x85\xa0 éß中文01٣½.,-$sdm\x00", "　", "​", "😀", "'re", "\n\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", "x" * 3000, "".join(rng.choice("abcdefgh") for _ in range(4000)), "-" * 2000, " " * 500, "\n \n \n", "x\n ", "a   b", "  a", "word " * 50_000]
    ids = coder.encode(texts)
    assert ids == [np.array(enc.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_bpe_of_many_long_pieces():
    """Unspaced runs of letters and of rare characters, many distinct, within the memory that a worker gives its database."""
    coder = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    enc, rng = reference_encoder(coder), random.Random(6)
    han = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120)) for _ in range(20_000)]
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)) for _ in range(4_000)]
    other = ["ab" * 700, "a" * 5000, "ACGT" * 300 + "".join(rng.choice("ACGT") for _ in range(3000)), "".join(rng.choice("กขคงจฉชซ") for _ in range(2000)), "=-" * 900]
    texts = ["\n".join(han), " ".join(letters), *other, " ".join(other)]
    ids = coder.encode(texts)
    assert ids == [np.array(enc.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_bpe_splits_and_learns_nothing_twice(monkeypatch):
    """What a worker has met it keeps, units of several pieces too; with room for fewer, and where nothing is kept, ids are the same."""
    coder = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    enc, rng = reference_encoder(coder), random.Random(7)
    bits = ["the", "Die", "é", "漢字", "42", "'ll", "--", "###", ".", ",", "½", "😀", "\n", "\x85", "\u1680", "x" * 70, " ", " ", "  "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(400)]
    want = [np.array(enc.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]
    for kept in (0, 40, bpe.KEPT):
        coder.kept = kept
        assert [x for at in range(0, len(texts), 50) for x in coder.encode(texts[at : at + 50])] == want
        assert [coder.encode([t]) for t in ("", " ", "\n a")] == [[b""], *([np.array(enc.encode_ordinary(t), dtype="<u4").tobytes()] for t in (" ", "\n a"))]
        assert coder.encode([]) == []
    short = [" ".join(f"{w}{end}" for w in ("", "one", "two", "thrhaou", "4") for end in ("", ".", ",###", ".\nOn")) for _ in range(3)]
    ids = coder.encode(short)
    split, learnt = [], []
    monkeypatch.setattr(coder, "_split", split.append)
    monkeypatch.setattr(coder, "_contract", learnt.append)
    assert coder.encode(short) == ids == [np.array(enc.encode_ordinary(t), dtype="<u4").tobytes() for t in short]
    assert not split and not learnt


@needs_tables
def test_bpe_digests_and_decoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    enc = reference_encoder(bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op4_byte_bpe(spark, SF).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN), RANKS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == texts


PLAIN = {k: re.compile(p) for k, p in {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()}


def plain_spans(text):
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                yield kind, *m.span()


def test_plain_identifiers():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("aZ09123..--@@+ ()%_,4111") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == list(plain_spans(text)), text


def wide(s):
    return "".join(chr(ord(c) + 0xFEE0) for c in s)


@pytest.mark.parametrize("kind,hidden", [
    ("email", "john.doe (at) example (dot) com"), ("email", "john.doe[at]example[dot]com"), ("email", "doe at example dot com"), ("email", "jоhn@exаmple.com"), ("email", "user@ex​ample.com"),
    ("email", wide("user@mail5.example.com")), ("email", "hein dot one nine at mail five dot example dot com"), ("email", "jane arroba ejemplo punto com"),
    ("phone", "plus one seven four three five five five three eight two four"), ("phone", "＋１ (743) 555-3824"), ("phone", "plus 1 743 five five five 3824"),
    ("card", "four three eight one eight nine three five five seven seven four one six zero nine"), ("card", wide("4381893557741609")), ("card", "4381 8935 5774 16O9"), ("card", "٤٣٨١٨٩٣٥٥٧٧٤١٦٠٩"),
    ("ip", "227[.]5[.]221[.]1"), ("ip", "two two seven dot five dot two two one dot one"), ("ip", "227 dot 5 dot 221 dot 1")])
def test_disguises_map_back(kind, hidden):
    text = f"éx, {hidden}, then"
    assert (kind, 4, 4 + len(hidden), False) in pii.find_spans(text)


@pytest.mark.parametrize("kind,hidden", [
    ("ip", "192 . 168 . 1 . 10"), ("ip", "192.168.one.one"), ("email", "john at example . com"), ("email", "john at mail five.com"), ("email", "jane@mail five.example.com"), ("card", "card 4381 8935 5774 l609"), ("card", "4381 8935 5774 16o9"), ("card", "4381 8935 5774 i6o9"),
    ("card", "4381  8935  5774  1609"), ("card", "fourthreeeightoneeightninethreefivefivesevensevenfouronesixzeronine"), ("phone", "+44 20 7946 O958"), ("card", "4381 8935 5774 003l"), ("phone", "+(44) 20 7946 0958"), ("phone", "+ 44 20 7946 0958")])
def test_disguises_need_no_other_hint(kind, hidden):
    start = 4 + hidden.startswith("card ") * 5
    assert (kind, start, 4 + len(hidden), False) in pii.find_spans(f"ex, {hidden}, then")


@pytest.mark.parametrize("kind,hidden", [
    ("phone", "plus 49 170 1234567"), ("card", "4381 8935 5774 I609"), ("ip", "10.0.O.1"), ("email", "n" * 130 + " at example dot com"), ("email", "jane at b.c.d.e.f.g.h.i.j.k.l.m dot com"),
    ("email", "jane  (at)   example dot com"), ("email", "user at example dot online"), ("phone", "+1 743 555 38O4"), ("email", "jane@mail.exаmple.com")])
def test_disguises_have_no_bounds(kind, hidden):
    assert (kind, 3, 3 + len(hidden), False) in pii.find_spans(f"é: {hidden}, then")


#: Ways to hide a character of an identifier: each gives what stands for it.
NAMES = {v: k for k, v in {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}.items()}


def hidden(rng, kind, plain):
    """plain in one of the disguises that the transducers undo."""
    way = rng.randrange(4)
    if way == 0:
        return "".join(chr(ord(c) + 0xFEE0) if c.isalnum() and rng.random() < 0.5 else c for c in plain)
    if way == 1:
        i = rng.randrange(1, len(plain))
        return plain[:i] + rng.choice("\u200b\u200d\u2060\ufeff") + plain[i:]
    if kind in ("email", "ip"):
        open_, shut = rng.choice([("[", "]"), ("(", ")"), (" ", " "), ("{", "}"), (" [ ", " ] ")])
        return plain.replace("@", f"{open_}at{shut}").replace(".", f"{open_}dot{shut}")
    said = " ".join(NAMES[c] for c in plain if c.isdigit())
    return ("plus " if kind == "phone" else "") + said


def test_disguised_identifiers_map_back_to_their_characters():
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    for _ in range(2000):
        kind = rng.choice(pii.KINDS)
        if kind == "email":
            plain = f"{rng.choice(['jane', 'hein.roth', 'k_7'])}@{rng.choice(['example', 'mail.example'])}.{rng.choice(['com', 'online', 'de'])}"
        elif kind == "ip":
            plain = ".".join(str(rng.randrange(1, 256)) for _ in range(4))
        elif kind == "phone":
            plain = "+" + digits(rng.randrange(9, 16))
        else:
            plain = digits(15)
            plain += next(c for c in "0123456789" if pii._luhn(plain + c))
        shown = hidden(rng, kind, plain)
        if shown == plain:
            continue
        before = rng.choice(["", "é — ", "see: ", "ñandú, "])
        got = pii.find_spans(f"{before}{shown}; then")
        assert any(s[:3] == (kind, len(before), len(before) + len(shown)) for s in got), (plain, shown, got)


def test_personal_data_columns(spark):
    """The digest columns from the spans, built by hand."""
    texts = ["a@b.co and 10.0.0.1", None, "", "plus 49 170 1234567", "4381893557741609 é jane at example dot com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digests(pii.personal_data(docs)).collect():
        spans = pii.find_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id] or "")).encode()).hexdigest()


@pytest.mark.parametrize("text", ["look at the dot of it", "a point of view at home", "one two three of us", "one of seven at nine. Dot com", "at point dot", "1 two 3.four", "at this point blank", "version 1.2 of it", "two plus two equals four", "we met at nine point five"])
def test_plain_prose_has_none(text):
    assert pii.find_spans(text) == []


@needs_tables
def test_language_is_the_nearest_prototype(spark):
    """Predictions and scores against bundles and cosines built letter by letter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = [(r.lang, r.text) for r in docs.filter(~language_id.held_out()).collect() if r.lang is not None]
    bundle = {}
    for lang, text in learn:
        bundle[lang] = bundle.get(lang, 0) + naive_bundle(text)
    bundle = {k: v / np.linalg.norm(v) for k, v in bundle.items()}
    mean = sum(bundle.values()) / len(bundle)
    bundle = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in bundle.items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op8_language_id(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        v = naive_bundle(texts[r.doc_id])
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = {k: float(v @ p) / np.linalg.norm(v) for k, p in bundle.items()}
        assert cos[r.lang_pred] > max(cos.values()) - 1e-4 and abs(r.score - max(0.0, cos[r.lang_pred])) < 1e-4


@needs_tables
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def sainte_lague(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (Fraction(weights[i], 2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportionment(spark, seed):
    rng = random.Random(seed)
    weights = [rng.choice([1, 3, 17, 400, 1000]) * rng.randrange(1, 50) for _ in range(rng.randrange(1, 30))]
    seats = rng.randrange(0, 500)
    cells = spark.createDataFrame([(0, i, w, seats) for i, w in enumerate(weights)], "g int, i int, w long, s long")
    got = [r.quota for r in mixing.sainte_lague(cells, ["g"], "w", "s", ["i"]).orderBy("i").collect()]
    assert got == sainte_lague(weights, seats)


def targets(sizes, weights, most):
    """The rule step by step: share out, cap, share what is over."""
    left, out = Fraction(sum(sizes)), {}
    free = list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            return [float(out[i]) if i in out else float(left * weights[i] / total) for i in range(len(sizes))]
        for i in over:
            out[i] = Fraction(most * sizes[i])
            free.remove(i)
        left = sum(sizes) - sum(out.values())
    return [float(out[i]) for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 100, 10_000]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))]
    df = spark.createDataFrame([(False, f"s{i:02}", n) for i, n in enumerate(sizes)], "__none boolean, __src string, source_size long")
    got = [r.target for r in mixing.source_targets(df).orderBy("rank").collect()]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert got == pytest.approx(targets(sizes, weights, 3) if sum(sizes) else [0.0] * len(sizes))


@needs_tables
def test_mix(spark):
    m = queries.op3_mix_sources(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id").source
    by = m.assign(source=m.doc_id.map(docs)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), told=("source_size", "first"))
    assert (by["size"] == by.told).all() and ((by.taken - by.target).abs() <= 64 + 0.02 * by.target).all() and (m.taken <= 3 * m["size"]).all()
    assert m.sort_values("doc_id").equals(queries.op3_mix_sources(spark, SF).toPandas().sort_values("doc_id").set_index(m.sort_values("doc_id").index))


def drawn_shard(doc_id, tree, seed=42):
    """The tree descended by hand."""
    at = ""
    for level in range(3):
        below = {}
        for region, rack, shard, weight in tree:
            path = [region, f"{region}/{rack}", f"{region}/{rack}/{shard}"]
            if ["", *path][level] == at:
                below[path[level]] = below.get(path[level], 0.0) + weight
        text = "" if doc_id is None else str(doc_id)
        draw = lambda p: -math.log((int(hashlib.md5(f"{seed}|{text}|{p}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / below[p]  # noqa: E731, B023
        at = min(below, key=lambda p: (draw(p), p))
    return int(at.rsplit("/", 1)[1])


def test_sharding_values(spark):
    """Every column against its definition, with nulls, repeated rows and other alphabets."""
    rows = [(i, rng_text) for i, rng_text in enumerate(["", "é", "文字 😀", "a" * 1000, None, "x\x00y"] * 40)] + [(3, "again"), (3, "again"), (None, "no number"), (-7, "minus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard").collect()]
    tree = sharding.base_tree()
    raw = lambda t: (t or "").encode()
    want = [(i, len(raw(t)) + 1, zlib.crc32(raw(t)), "key", drawn_shard(i, tree), drawn_shard(i, sharding.grown(tree))) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sharding_moves_only_into_the_new_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = sharding.shard_documents(docs).toPandas()
    assert set(got[got["shard"] != got.grown_shard].grown_shard) == {8}
    share = got["shard"].value_counts(normalize=True)
    assert set(share.index) == set(range(8)) and share.between(0.11, 0.14).all()
    assert (got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))).all()


def test_sharding_confines_movement(spark):
    tree = [("r0", "k0", 0, 1.0), ("r0", "k1", 1, 1.0), ("r1", "k2", 2, 1.0), ("r1", "k3", 3, 2.0)]
    heavier = [(r, k, s, 3.0 if s == 3 else w) for r, k, s, w in tree]
    docs = spark.range(20_000)
    both = docs.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavier).alias("b")).toPandas()
    share = both.a.value_counts(normalize=True)
    assert abs(share[3] - 0.4) < 0.02
    moved = both[both.a != both.b]
    assert set(moved.b) <= {2, 3} and {0, 1} >= set(moved.a) - {2}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 540)] + [(1, None)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}


def word_windows(texts, n):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        for k in range(len(w) - n + 1):
            out.setdefault(tuple(w[k : k + n]), set()).add(i)
    return out


def said(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@needs_tables
def test_passages_against_all_word_windows(spark):
    """Every document that shares 51 words in a row with another has a row; documents that share less than 40 have none."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    found = {r.doc_id for r in queries.op6_substring_dedup(spark, SF.replace("0.001", "0.01")).collect()}
    share = lambda n: {i for ids in word_windows(texts, n).values() if len(ids) > 1 for i in ids}
    assert share(51) <= found
    near = share(30)
    assert len(found - near) <= 0.02 * len(texts)


def test_passages_of_every_length_and_place(spark):
    """Planted passages: exact ones anywhere in lines, near copies, sentences that also stand alone elsewhere, copies around one passage; and short ones that don't count."""
    rng = random.Random(12)
    docs, planted, short = {}, {}, []
    for k in range(60):
        n = 51 + k % 40
        passage = said(rng, n)
        planted[k] = passage
        for j in range(2):
            docs[2 * k + j] = f"{said(rng, rng.randrange(0, 90))} {passage} {said(rng, rng.randrange(0, 90))}"
    near = {}
    for k in range(30):
        words = said(rng, 180).split()
        changed = [w if i % 60 != 30 else "changed" for i, w in enumerate(words)]
        near |= {1000 + 2 * k: words, 1001 + 2 * k: changed}
        docs |= {1000 + 2 * k: f"{said(rng, 40)} {' '.join(words)} {said(rng, 40)}", 1001 + 2 * k: f"{said(rng, 60)} {' '.join(changed)} {said(rng, 20)}"}
    sentences = [f"{said(rng, 12)}." for _ in range(8)]
    docs |= {2000: f"{said(rng, 30)} {' '.join(sentences)} {said(rng, 30)}", 2001: f"{said(rng, 10)} {' '.join(sentences)} {said(rng, 50)}", 1999: sentences[2], 2002: f"{said(rng, 40)}\n{sentences[4]}", 2003: sentences[6]}
    inner = said(rng, 80)
    whole = f"{said(rng, 120)} {inner} {said(rng, 120)}"
    docs |= {3000: whole, 3002: whole, 3001: f"{said(rng, 50)} {inner} {said(rng, 50)}"}
    for k in range(40):
        passage = said(rng, 40)
        docs |= {4000 + 2 * k: f"{said(rng, 60)} {passage} {said(rng, 60)}", 4001 + 2 * k: f"{said(rng, 60)} {passage} {said(rng, 60)}"}
        short += [4000 + 2 * k, 4001 + 2 * k]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(docs[r.doc_id][r.start : r.end])
    covered = lambda i, passage: sum(len(t.split()) for t in found.get(i, ())) / len(passage.split())
    assert all(2 * k + j in found for k in planted for j in range(2))
    assert all(0.6 < covered(2 * k + 1, planted[k]) < 1.02 for k in planted)
    assert sum(i in found for i in near) >= 0.95 * len(near)
    assert {2000, 2001, 3000, 3001, 3002} <= set(found) and {1999, 2002, 2003}.isdisjoint(found)
    assert not any(i in found for i in short)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()}
    for k in planted:
        assert left[2 * k] == docs[2 * k]
        outside = docs[2 * k + 1].replace(planted[k], "|").split("|")
        assert all(part.strip() in left[2 * k + 1] for part in outside)


def test_passages_with_a_start_that_very_many_share(spark):
    """Starts with more classes than a task compares by itself come to the same."""
    rng = random.Random(13)
    phrase = "as it was said before"
    docs = [(i, f"{said(rng, 30)} {phrase} {said(rng, 60)}") for i in range(30)]
    tail = said(rng, 70).split()
    docs += [(100 + i, f"{said(rng, 30)} {phrase} {' '.join(w if j != 50 + i else 'other' for j, w in enumerate(tail))} {said(rng, 9)}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda d: sorted(map(tuple, d.collect()))
    few, many = key(substring_dedup.repeated_passages(df)), key(substring_dedup.repeated_passages(df, together=2))
    assert few == many and {r[0] for r in few} == set(range(100, 112))


def test_near_duplicates_in_one_large_family(spark):
    """A family of near copies, beside an outsider that shares its frequent words, against pairs by hand."""
    rng = random.Random(14)
    base = said(rng, 60).split()
    rows = [(i, " ".join(w if rng.random() > 0.03 else "x" + str(rng.randrange(4)) for w in base)) for i in range(400)]
    rows += [(1000 + i, " ".join(base[: 20 + i] + said(rng, 30).split())) for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    assert got == {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [4, 1000])
def test_family_links(spark, block):
    rng = random.Random(7)
    sets = {i: sorted({rng.randrange(25) for _ in range(20)}) for i in range(40)}
    fam = spark.createDataFrame([(i, i % 3) for i in sets], "node long, family long")
    held = spark.createDataFrame([(i, len(x), x) for i, x in sets.items()], "node long, n long, held array<long>")
    edges = [(r.a, r.b) for r in families.family_links(fam, held, 60, block).collect()]
    want = [(a, b) for a in sets for b in sets if a < b and a % 3 == b % 3 and 100 * len({*sets[a]} & {*sets[b]}) >= 60 * len({*sets[a]} | {*sets[b]})]

    def groups(links):
        top = {i: i for i in sets}
        for _ in sets:
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert groups(edges) == groups(want)
