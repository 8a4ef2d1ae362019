"""Token counts by byte-pair merging with a heap and a linked list; no ids are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import by_place

#: A tokenizer file may be so large, as it is broadcast to every executor.
MAX_FILE_BYTES = 64 << 20
#: Pieces that a worker keeps with their counts, of so many characters at most, which only saves work; characters that are split at once.
KEPT, KEPT_CHARS, CHARS = 500_000, 48, 1 << 22
#: The pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter by which vocabularies of byte-level models write each byte: itself if it prints, else one from 256 on."""
    printing = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printing else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """The number of tokens of each piece, counted when first asked for."""

    def __init__(self, merges: list, vocabulary: dict[str, int]) -> None:
        """Symbols are the vocabulary's ids; a pair of them has the rank of its merge and the id that it gives."""
        super().__init__()
        self.symbols = [vocabulary[c] for c in byte_letters()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode())
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n

    def merged(self, piece: bytes) -> int:
        """Initial symbols less merges. The heap holds pairs by rank, then place; the list links symbols that are left.

        A heap entry is stale where one of its symbols has been merged meanwhile, which its
        symbols' ids tell. Each merge adds two entries at most, so that time is n log n.
        """
        symbol = [self.symbols[b] for b in piece]
        n = end = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(found[0], i, found[1], symbol[i], symbol[i + 1]) for i in range(n - 1) if (found := pairs.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= end or symbol[j] != right:
                continue
            n -= 1
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if found := pairs.get((new, symbol[k])):
                    heapq.heappush(heap, (found[0], i, found[1], new, symbol[k]))
            if (h := before[i]) >= 0 and (found := pairs.get((symbol[h], new))):
                heapq.heappush(heap, (found[0], h, found[1], symbol[h], new))
        return n


class Tokenizer:
    """What a tokenizer file says: special strings, the pattern of pieces and their merges."""

    def __init__(self, raw: bytes) -> None:
        told = json.loads(raw)
        model, first = told["model"], told["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or first.get("type") != "ByteLevel" or not first.get("use_regex", True) or told.get("normalizer") or odd:
            raise ValueError("only byte-level BPE files without a normalizer are counted")
        self.prefix = bool(first.get("add_prefix_space"))
        added = [t for t in told["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in white space or whole words only aren't counted")
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.pattern = regex.compile(PATTERN)
        self.counter = Counter(model["merges"], model["vocab"])

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one."""
        n = at = 0
        if self.special is not None:
            for found in self.special.finditer(text):
                n += 1 + self._plain(text, at, found.start())
                at = found.end()
        return n + self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> int:
        """Tokens from at to end, split in stretches of bounded length that end where a piece does."""
        count = self.counter
        if self.prefix and at < end and text[at] != " ":
            text, at, end = " " + text[at:end], 0, end - at + 1
        if end - at <= CHARS:
            part = text if end - at == len(text) else text[at:end]
            return sum(map(count.__getitem__, self.pattern.findall(part)))
        n, held = 0, []
        for found in self.pattern.finditer(text, at, end):
            held.append(found.group())
            if len(held) >= 1 << 16:
                n, held = n + sum(map(count.__getitem__, held)), []
        return n + sum(map(count.__getitem__, held))


@cache
def _tokenizer(raw: bytes) -> Tokenizer:
    return Tokenizer(raw)


def read_tokenizer(path: str) -> bytes:
    """A tokenizer file, which the driver has at path."""
    with open(path, "rb") as f:
        out = f.read(MAX_FILE_BYTES + 1)
    if len(out) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """docs less text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Counts are those of the public library for such files (byte-level BPE without a
    normalizer; others are an error), without begin and end tokens, truncation or padding;
    a special string inside a text is one token, as is that library's default. Whole texts
    count, a null text as empty: 0 bytes and tokens. Repeated rows count alike; an empty
    table stays empty. Other columns pass through, but for those named like a new one,
    which are replaced.

    Nothing is shuffled: texts go to Arrow batches, counts come back. Memory is a batch and
    a bounded table of counted pieces; a piece of n bytes, however long, takes n log n time.
    """
    given = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    kept = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit")]
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([*docs.select(*(f"`{c}`" for c in kept)).schema.fields, *new])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(given.value)
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(tokenizer.count(text))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[f.name for f in schema])

    return by_place(docs, ["text", *kept]).mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
