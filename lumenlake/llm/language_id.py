"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import by_place

DIM, NGRAM, SEED = 512, 3, 7
#: Symbols: 0 for what is no letter, 1 to 26 for a to z, the rest for all other letters by code point.
SYMBOLS = 64
#: Texts compared at a time.
BATCH = 128
UND = "und"


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point, case folded."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            low = low if len(low) == 1 else unicodedata.normalize("NFD", low)[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)
    return out


@cache
def _letters(dim: int, seed: int) -> np.ndarray:
    """A random vector of -1 and 1 for each symbol."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.float32), size=(SYMBOLS, dim))


def _gram_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Each n-gram's vector: its letters' vectors, rotated by their distance from the end, bound by multiplication."""
    letters = _letters(dim, seed)
    out = np.ones((len(codes), dim), dtype=np.float32)
    rest = codes.copy()
    for back in range(NGRAM):
        out *= np.roll(letters, back, axis=1)[rest % SYMBOLS]
        rest //= SYMBOLS
    return out


def _codes(text: str) -> np.ndarray:
    """The codes of all n-grams of the whole text, runs of non-letters being one space; none without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = _symbols()[np.minimum(points, 0x10FFFF)]
    if not s.any():
        return np.zeros(0, dtype=np.int64)
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    code = np.zeros(len(s) - NGRAM + 1, dtype=np.int64)
    for i in range(NGRAM):
        code = code * SYMBOLS + s[i : len(s) - NGRAM + 1 + i]
    return code


def _bundles(texts: list[str | None], dim: int, seed: int) -> np.ndarray:
    """The hypervector of each text: the sum of its n-grams' vectors; zero for a text without letters."""
    codes = [_codes(t) if t else np.zeros(0, dtype=np.int64) for t in texts]
    flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
    if not len(flat):
        return np.zeros((len(texts), dim), dtype=np.float32)
    seen = np.zeros(SYMBOLS**NGRAM, dtype=bool)
    seen[flat] = True
    grams = np.flatnonzero(seen)
    index = np.zeros(SYMBOLS**NGRAM, dtype=np.int32)
    index[grams] = np.arange(len(grams), dtype=np.int32)
    row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    counts = np.bincount(row * len(grams) + index[flat], minlength=len(texts) * len(grams)).reshape(len(texts), len(grams))
    return counts.astype(np.float32) @ _gram_vectors(grams, dim, seed)


def fit(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> dict[str, list[float]]:
    """A prototype for each non-null lang of docs: the bundle of all its documents' n-gram vectors.

    Every row of docs with a lang takes part, with its whole text. Partitions bundle what
    they hold, so a language, however common, arrives as one vector a task; the driver gets
    dim numbers a language. The prototypes' common mean is taken off, which leaves what sets
    languages apart, and each is scaled to length 1. Null or letterless texts add nothing;
    without any labelled text there is no prototype.
    """

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and len(codes := _codes(text)):
                    held = counts.setdefault(lang, np.zeros(SYMBOLS**NGRAM, dtype=np.int64))
                    if len(codes) < len(held) // 8:
                        np.add.at(held, codes, 1)
                    else:
                        held += np.bincount(codes, minlength=len(held))
        for lang, held in counts.items():
            grams = np.flatnonzero(held)
            value = sum(held[g].astype(np.float64) @ _gram_vectors(g, dim, seed) for g in np.array_split(grams, -(-len(grams) // 4096)))
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dim, "pos": np.arange(dim, dtype=np.int32), "value": value})

    labelled = docs.filter("lang is not null").select("lang", "text")
    sums = labelled.mapInArrow(bundled, "lang string, pos int, value double").groupBy("lang", "pos").agg(F.sum("value").alias("value"))
    by_lang = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "value")))["value"].alias("v"))
    found = {r["lang"]: np.array(r["v"]) for r in by_lang.collect()}
    found = {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}
    if len(found) > 1:
        mean = sum(found.values()) / len(found)
        found = {k: (v - mean) / max(np.linalg.norm(v - mean), 1e-12) for k, v in found.items()}
    return {k: v.tolist() for k, v in found.items()}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], dim: int = DIM, seed: int = SEED, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the language whose prototype has the greatest cosine with the text's vector, and that cosine.

    Texts are read whole. `und` with score 0 for a null text, one without letters, or no
    prototypes; a negative cosine scores 0; among equal cosines the first language in order
    holds. Other columns pass through; columns named like the two new ones are replaced.
    Repeated rows are judged alike; an empty table stays empty.
    """
    langs = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in langs], dtype=np.float32).reshape(len(langs), dim)
    kept = [c for c in docs.columns if c not in (lang, score)]
    at = kept.index("text")
    schema = T.StructType([*docs.select(*(f"`{c}`" for c in kept)).schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, scores = batch.column(at), [], []
            for k in range(0, len(texts), BATCH):
                v = _bundles(texts.slice(k, BATCH).to_pylist(), dim, seed)
                norm = np.linalg.norm(v, axis=1)
                if langs:
                    cos = (v @ matrix.T) / np.maximum(norm, 1e-9)[:, None]
                    best = cos.argmax(axis=1)
                for i, length in enumerate(norm):
                    known = bool(langs) and length > 0
                    names.append(langs[best[i]] if known else UND)
                    scores.append(float(min(1.0, max(0.0, cos[i, best[i]]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, lang, score])

    return by_place(docs, kept).mapInArrow(judged, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of doc_id as text, modulo 4, is 2. A null doc_id is as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Learns on the documents that are not held out and judges all: doc_id, held_out, lang_pred, score."""
    prototypes = fit(docs.filter(~held_out()).select("lang", "text"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def chance_score(dim: int = DIM, deviations: float = 3.0) -> float:
    """The cosine that a text unlike a prototype hardly reaches: such cosines are as those of random vectors, which deviate by 1 / sqrt(dim)."""
    return deviations / dim**0.5


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """docs less those without an identified language: `und`, or a cosine under min_score. All columns as they were.

    Null, empty and letterless texts go. Null langs and doc_ids don't matter: what is known
    is learnt from, and every text is judged. Repeated rows stay or go together; an empty
    table stays empty, and without any lang nothing stays. docs may have any other columns.
    """
    prototypes = fit(docs.filter(~held_out()).select("lang", "text"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = docs.select(*(docs[f"`{c}`"].alias("text" if c == "text" else n) for c, n in zip(docs.columns, names)))
    judged = predict(own, prototypes, lang="__lang_pred", score="__score").filter((F.col("__lang_pred") != UND) & (F.col("__score") >= min_score))
    return judged.select(*(F.col("text") if c == "text" else F.col(n).alias(c) for c, n in zip(docs.columns, names)))
