"""Byte-level BPE encoding and decoding with recursive SQL inside each partition."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenlake.llm.common import by_place

#: White space as Unicode's property has it, which the rank files' pattern means by \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A rank file may be so large, as it is broadcast to every executor.
MAX_RANKS_BYTES = 64 << 20
#: What one recursive query takes: bytes, and bytes times its longest piece, which bounds its rounds; bytes from which a piece's rounds give changed tokens alone, and from which it goes with others of the same bytes only.
BYTES, WORK, LONG, OWN = 1 << 19, 1 << 24, 64, 256
#: Pieces that a worker keeps, and half as many units that aren't letters alone, of so many characters at most, which only saves work; characters and tokens handled together.
KEPT, KEPT_CHARS, CHARS, SEGMENT, TOKENS = 700_000, 64, 8_000_000, 1 << 16, 500_000

#: Token-position rows (w, p, q, tok): a token of word w from byte p to q, with a byte left out between words. Each round
#: joins neighbours with the merge table and contracts each word's leftmost pair of least rank; words without a pair stop.
#: A pair is one number: its rank, p, below 2^23 by BYTES, and its length, below 2^8 by LONG.
CONTRACT = """
with recursive s(w, p, q, tok, it) as (
    select w, p, p + 1, tok, 0 from start
    union all (
        with least as (
            select x.w, min((g.id::bigint << 32) | (x.p << 8) | (y.q - x.p)) as pair from s x join s y on y.p = x.q join merges g on g.l = x.tok and g.r = y.tok group by x.w),
        best as (select w, (pair >> 32)::int as id, ((pair >> 8) & 16777215)::int as p, ((pair >> 8) & 16777215)::int + (pair & 255)::int as q from least)
        select s.w, s.p, case when s.p = b.p then b.q else s.q end, case when s.p = b.p then b.id else s.tok end, s.it + 1
        from s join best b on s.w = b.w where s.p <= b.p or s.p >= b.q))
select s.p, s.tok from s join (select w, max(it) as it from s group by w) using (w, it) order by s.p
"""

#: The same recursion for long pieces, whose rounds are many: rows (w, p, q, tok, id), with the rank at which a token
#: merges with the next one, if it does, and none where tok is -1. A round looks at the words that the last one changed
#: and contracts each word's leftmost pair of least rank, and further such pairs at a distance, but where the new token
#: could merge at a lesser rank yet with what the word's bytes can make. In a run of pairs that overlap, every fourth is at a distance and in step with the
#: leftmost. It gives the rows that this changes alone: the new token, the one before it and the one that is gone.
CONTRACT_LONG = """
with recursive s(w, p, q, tok, id, alone) using key (w, p) as (
    select x.w, x.p, x.p + 1, x.tok, g.id, g.alone from start x left join start y on y.w = x.w and y.p = x.p + 1 left join merges_within g on g.l = x.tok and g.r = y.tok
    union (
        with live as materialized (select * from recurring.s where tok >= 0 and w in (select w from s)),
        least as (select w, min(id) as id from live group by w),
        pairs as materialized (select x.w, x.p, x.q as mid, y.q, x.id, x.alone from live x join least using (w, id) join live y on y.w = x.w and y.p = x.q),
        runs as (select *, sum(case when before = p then 0 else 1 end) over (partition by w order by p) as run from (
            select *, lag(mid) over (partition by w order by p) as before, row_number() over (partition by w order by p) as k from pairs)),
        apart as (select * from (select *, row_number() over (partition by w, run order by p) as nth from runs) where nth % 4 = 1 and (k = 1 or not alone)),
        chains as (select *, sum(case when before = p then 0 else 1 end) over (partition by w order by p) as chain from (
            select w, p, mid, q, id, lag(q) over (partition by w order by p) as before from apart)),
        won as materialized (select * from (select *, row_number() over (partition by w, chain order by p) as nth from chains) where nth % 2 = 1)
        select x.w, x.p, x.q, x.id, g.id, g.alone from won x left join live y on y.w = x.w and y.p = x.q left join merges_within g on g.l = x.id and g.r = y.tok
        union all select y.w, y.p, y.q, y.tok, g.id, g.alone from won x join live y on y.w = x.w and y.q = x.p left join merges_within g on g.l = y.tok and g.r = x.id
        union all select w, mid, mid, -1, null, null from won))
select p, tok from s where tok >= 0 order by p
"""
MERGES = """
create table merges as
with m as (
    select a.id as l, b.id as r, t.id from (select id, h, unnest(generate_series(2, length(h) - 2, 2)) as i from vocab) t
    join vocab a on a.h = substr(t.h, 1, t.i) join vocab b on b.h = substr(t.h, t.i + 1)),
lesser as (select l as id from m where id < l union select r from m where id < r)
select m.l, m.r, m.id, lesser.id is not null as alone from m left join lesser using (id)
"""
#: With one thread, rows reach the aggregate in the order that the subquery puts them in.
DECODE = "select seg, unhex(string_agg(h, '')) as bytes from (select seg, h from ids join vocab using (id) order by p) group by seg order by seg"


def _bits(some: bytes) -> np.ndarray:
    """256 bits, those of these bytes set."""
    flags = np.zeros(256, dtype=np.uint8)
    flags[list(some)] = 1
    return np.packbits(flags).view(np.uint64)


class Coder:
    """One worker's tables and the units that it has met; what it keeps is bounded and only saves work."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.vocab = {base64.b64decode(t): int(r) for t, r in pairs}
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")).findall
        self.entangled = re.compile(rf" (?<=[{SPACE}] )(?:[{SPACE}]|\Z)").search
        self.bytes_ = np.array([self.vocab[bytes([i])] for i in range(256)], dtype=np.int32)
        self.twos, self.threes = np.zeros(1 << 16, dtype=bool), np.zeros(1 << 24, dtype=bool)
        for t in self.vocab:
            if len(t) == 2:
                self.twos[int.from_bytes(t, "big")] = True
            for i in range(len(t) - 2):
                self.threes[int.from_bytes(t[i : i + 3], "big")] = True
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        given = pa.table({"id": pa.array(self.vocab.values(), pa.int32()), "h": [t.hex() for t in self.vocab]})
        self.db.register("given", given)
        self.db.execute("create table vocab as select * from given")
        self.db.unregister("given")
        self.db.execute(MERGES)
        self.merges = self.db.execute("select l, r, id from merges").fetchnumpy()
        # For each token, one bit for each byte that it holds.
        self.held = np.zeros((1 + max(self.vocab.values()), 4), dtype=np.uint64)
        for t, i in self.vocab.items():
            self.held[i] = _bits(t)
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.kept = KEPT

    def _merges_within(self, some: np.ndarray) -> pa.Table:
        """The merges of tokens that hold none but these bytes; a token is alone where one of them, at a lesser rank, takes it in."""
        left, right, made = (self.merges[c] for c in ("l", "r", "id"))
        own = ~(self.held[made] & ~some).any(axis=1)
        left, right, made = left[own], right[own], made[own]
        least = np.full(len(self.held), np.iinfo(np.int32).max)
        np.minimum.at(least, left, made)
        np.minimum.at(least, right, made)
        return pa.table({"l": left, "r": right, "id": made, "alone": least[made] < made})

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Long words go by the bytes that they hold, what can't arise of these needn't be waited for; those whose rounds are few go together."""
        if max(map(len, words)) < LONG:
            return self._run(CONTRACT, words)
        groups: dict[frozenset[int], list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(frozenset(w if len(w) >= OWN else ()), []).append(i)
        out = [b""] * len(words)
        for some, those in groups.items():
            self.db.register("merges_within", self._merges_within(_bits(bytes(some or set().union(*(words[i] for i in those))))))
            for i, ids in zip(those, self._run(CONTRACT_LONG, [words[i] for i in those])):
                out[i] = ids
            self.db.unregister("merges_within")
        return out

    def _run(self, query: str, words: list[bytes]) -> list[bytes]:
        length = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), length)
        start = pa.table({"w": w, "p": np.arange(len(w), dtype=np.int32) + w, "tok": self.bytes_[np.frombuffer(b"".join(words), dtype=np.uint8)]})
        self.db.register("start", start)
        out = self.db.sql(query).fetchnumpy()
        self.db.unregister("start")
        ends = (4 * np.searchsorted(out["p"], np.cumsum(length) + np.arange(len(words)))).tolist()
        flat = out["tok"].astype("<u4").tobytes()
        return [flat[at:end] for at, end in zip([0, *ends], ends)]

    def _split(self, unit: str) -> list[str]:
        """The pieces of a space and a unit; letters alone are one, and so is a stop or comma behind them."""
        if unit.isalpha():
            return [f" {unit}"]
        if unit[-1:] in (".", ",") and unit[:-1].isalpha():
            return [f" {unit[:-1]}", unit[-1]]
        return self.find(f" {unit}")

    def _apart(self, raws: list[bytes]) -> list[list[bytes]]:
        """Each piece in parts that no token joins: between them stands no token of two bytes, and no three bytes that some token holds."""
        flat = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.int32)
        ends = np.cumsum([len(r) for r in raws])
        joined = self.twos[(flat[:-1] << 8) | flat[1:]]
        three = self.threes[(flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]]
        joined[:-1] |= three
        joined[1:] |= three
        joined[ends[:-1] - 1] = False
        cuts = [*(np.flatnonzero(~joined) + 1).tolist(), len(flat)]
        many = np.diff(np.searchsorted(cuts, ends, side="right"), prepend=0).tolist()
        held, out, at, k = b"".join(raws), [], 0, 0
        for n in many:
            parts = []
            for end in cuts[k : k + n]:
                parts.append(held[at:end])
                at = end
            out.append(parts)
            k += n
        return out

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces, in queries of bounded size with others about as long; long ones in parts that no token joins."""
        raws = {piece: piece.encode() for piece in pieces}
        long = {piece: raw for piece, raw in raws.items() if len(raw) >= LONG // 2 and raw not in self.vocab}
        parts = dict(zip(long, self._apart([*long.values()]))) if long else {}
        ids: dict[bytes, bytes] = {}
        todo: list[bytes] = []
        whole = self.vocab.get
        for raw in {*raws.values()}.difference(long.values()).union(*parts.values()):
            rank = whole(raw)
            if rank is None:
                todo.append(raw)
            else:
                ids[raw] = rank.to_bytes(4, "little")
        todo.sort(key=len)
        length = [len(raw) for raw in todo]
        at = 0
        while at < len(todo):
            end, size = at, 0
            while end < len(todo) and (end == at or size + length[end] <= min(BYTES, WORK // length[end]) and (length[at] < LONG) == (length[end] < LONG)):
                size += length[end]
                end += 1
            ids.update(zip(todo[at:end], self._contract(todo[at:end])))
            at = end
        joined = {piece: b"".join(map(ids.__getitem__, those)) for piece, those in parts.items()}
        return {piece: ids[raw] for piece, raw in raws.items() if piece not in joined} | joined

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A text is cut before single spaces into units, each of which splits into pieces on its
        own; where white space of one unit would run on into the next, the text's pieces are
        found in the whole text instead.
        """
        if len(self.pieces) > self.kept:
            self.pieces.clear()
        if len(self.units) > self.kept // 2:
            self.units.clear()
        # Each text as units, of which the first, or the whole text, stands for itself; equal others meet in one code.
        whole = [t if self.entangled(t) else None for t in texts]
        units = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()), " ")
        begin, flat = units.offsets.to_numpy(), units.flatten()
        first = np.zeros(len(flat), dtype=bool)
        first[begin[:-1]] = True
        loose = [self.find(u if w is None else w) for u, w in zip(flat.take(begin[:-1]).to_pylist(), whole)]
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        code = np.empty(len(flat), dtype=np.int64)
        code[~first] = rest.indices.to_numpy()
        code[first] = len(rest.dictionary) + np.arange(len(texts))
        found = pa.array(self._ids(rest.dictionary.to_numpy(zero_copy_only=False).tolist(), loose), pa.large_binary()).take(pa.array(code))
        ends, flat = np.frombuffer(found.buffers()[1], dtype=np.int64)[begin].tolist(), found.buffers()[2].to_pybytes()
        return [flat[at:end] for at, end in zip(ends, ends[1:])]

    def _ids(self, units: list[str], loose: list[list[str]]) -> list[bytes]:
        """The ids of a space and each unit, then those of each list of pieces. What isn't kept from before is split and learnt."""
        of, known = self.pieces.get, self.units.get
        ids = [of(f" {u}") if u.isalpha() else known(u) for u in units]
        split = {i: self._split(units[i]) for i, x in enumerate(ids) if x is None}
        learnt = self._learn(set().union(*split.values(), *loose).difference(self.pieces))
        self.pieces.update(learnt)
        for i, parts in split.items():
            ids[i] = b"".join(map(of, parts))
            if len(units[i]) <= KEPT_CHARS and not units[i].isalpha():
                self.units[units[i]] = ids[i]
        ids += [b"".join(map(of, parts)) for parts in loose]
        for piece in learnt:
            if len(piece) > KEPT_CHARS:
                del self.pieces[piece]
        return ids

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes that each run of ids stands for: positions join the vocabulary and are put together in order."""
        out = [b""] * len(coded)
        ids = [np.frombuffer(c, dtype="<u4").astype(np.int32) for c in coded]
        segments = [(i, part) for i, x in enumerate(ids) if len(x) for part in np.array_split(x, -(-len(x) // SEGMENT))]
        while segments:
            held, n = [], 0
            while segments and n < TOKENS:
                held.append(segments.pop())
                n += len(held[-1][1])
            held.reverse()
            flat = np.concatenate([part for _, part in held])
            table = pa.table({"seg": np.repeat(np.arange(len(held), dtype=np.int32), [len(part) for _, part in held]), "p": np.arange(len(flat), dtype=np.int32), "id": flat})
            self.db.register("ids", table)
            found = self.db.execute(DECODE).fetchall()
            self.db.unregister("ids")
            for seg, raw in reversed(found):
                out[held[seg][0]] = raw + out[held[seg][0]]
        return out


@cache
def _coder(ranks: bytes, pattern: str) -> Coder:
    return Coder(ranks, pattern)


def read_ranks(path: str) -> bytes:
    """A rank file, which each machine has at path: lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        out = f.read(MAX_RANKS_BYTES + 1)
    if len(out) > MAX_RANKS_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANKS_BYTES} bytes")
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False, kept_pieces: int = KEPT, chars: int = CHARS, decoded: bool = False) -> DataFrame:
    """docs less text, with n_tokens and ids (array of int), and the bytes that they decode to if asked for, or digests of both.

    Every whole text is split by pattern and each piece encoded by the ranks, as the public
    library for such rank files does without special tokens. With decoded, ids are decoded
    again and their bytes returned too (decoded, binary); with digest, the result has
    ids_sha256 (of ids as little-endian unsigned 32-bit integers) and decoded_sha256 instead
    of both. A null text counts as empty and has no ids. Other columns pass through, but for
    those named like a new one, which are replaced. Repeated rows are coded alike; an empty
    table stays empty.

    Nothing is shuffled. A partition's distinct pieces go through the recursive query, in
    groups of about equal length whose bytes and rounds are bounded, so that memory is; a
    single piece, however long, is a group. Documents are put together from their pieces.
    A worker keeps the ids of kept_pieces short pieces and of half as many short units, and codes
    texts of chars characters together; less of both takes less memory and more time, and gives the same ids.
    """
    given = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    real = {"ids": T.ArrayType(T.IntegerType(), False), **({"decoded": T.BinaryType()} if decoded else {})}
    new = {"n_tokens": T.LongType(), **({"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digest else real)}
    kept = [c for c in docs.columns if c not in (*new, "text")]
    schema = T.StructType([*docs.select(*(f"`{c}`" for c in kept)).schema.fields, *(T.StructField(k, v) for k, v in new.items())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(given.value, pattern)
        coder.kept = kept_pieces
        for batch in batches:
            texts = batch.column(0)
            size = np.cumsum(np.maximum(1, np.nan_to_num(np.array(pc.binary_length(texts).to_pylist(), dtype=float))))
            ends = [*(np.flatnonzero(np.diff(size // chars)) + 1).tolist(), len(texts)]
            at = 0
            for end in ends:
                part = batch.slice(at, end - at)
                ids = coder.encode([t or "" for t in part.column(0).to_pylist()])
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digest:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in those]) for those in (ids, coder.decode(ids))]
                else:
                    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))]
                    if decoded:
                        columns.append(pa.array(coder.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=[*kept, *new])
                at = end

    return by_place(docs, ["text", *kept]).mapInArrow(coded, schema)


def decode(coded: DataFrame, ranks_path: str, pattern: str = "") -> DataFrame:
    """coded less ids, with decoded (binary): the bytes that the ids of each row stand for.

    Null and empty ids give no bytes; an id that the ranks lack gives none either. Other
    columns pass through, but for one named decoded, which is replaced. Repeated rows are
    decoded alike; an empty table stays empty.
    """
    given = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [c for c in coded.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*coded.select(*(f"`{c}`" for c in kept)).schema.fields, T.StructField("decoded", T.BinaryType())])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(given.value, pattern)
        for batch in batches:
            raw = coder.decode([np.array(x or [], dtype="<u4").tobytes() for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(raw, pa.binary())], names=[*kept, "decoded"])

    return by_place(coded, ["ids", *kept]).mapInArrow(plain, schema)
