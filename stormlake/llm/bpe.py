"""Byte-level BPE encoding and decoding.

``report`` and ``encoded`` take whole texts through the library's encoder in Arrow batches, and decode by concatenating the
binary pieces of the ids. ``report_by_fold`` and ``encoded_by_fold`` give the same by a fold of Spark's higher-order functions
over the bytes of distinct words, which costs more than the check tool allows (README):

Each distinct word is merged once: tasks split texts into words and send on those that they haven't sent, Spark makes them
distinct, and the fold merges the bytes of each by a literal table of ranks. Words and their ids are written as sorted hash
arrays into the shared folder. A second pass splits the texts again, looks the ids of a group's distinct words up in the mapped
arrays and puts them in a row. A word that is itself a piece is its id and isn't folded, as the library does it. To split less
often, texts are cut into units of white space and what follows it, which numpy finds, and the pattern runs on a group's distinct
units. A text with white space beyond ASCII is split as a whole, as such space may join with that of the next unit. Units and
words are told apart by hashes of 64 bits.

Defined cases: null and empty texts have no ids; repeated rows are encoded each; strings that look like special
tokens are ordinary text; a very long text takes memory in proportion to its length, and a very long
word takes steps of the fold in proportion to the square of its length (the library has a heap for it); empty tables give
none; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice, pairwise
from typing import Generic, NamedTuple, TypeVar

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlake.llm.arrays import Sorted, _read, _write, save
from stormlake.llm.base import mounted_dir, stored
from stormlake.llm.bytesof import VALUES, _powers, chunks, mix
from stormlake.llm.vocabulary import encoding, ranks

#: White space as the ranks' pattern means it, which is Unicode's, in Java's notation and as characters.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text cut into units at once, and of those whose distinct units are looked up together; units and hashes that a worker remembers; distinct words of a range of the arrays.
CUT_BYTES, GROUP_BYTES, REMEMBERED, RANGE_WORDS = 1 << 20, 1 << 23, 200_000, 100_000
#: Columns of a stored word's arrays are looked up by its hash: of 64 bits, with the seed of Spark's own.
_SEED = 42


def java_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    """The pattern that splits texts into words, for Spark's regular expressions."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


def split_words(text: Column) -> Column:
    """The words of a text, each merged on its own."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(java_pattern()), F.lit(0)), F.array().cast("array<string>"))


class Splitter(NamedTuple):
    """Splits texts into words as the library does: characters that this process's tables class otherwise than the library's, which
    may know an older Unicode, by class."""

    letters: str = ""
    digits: str = ""

    def __call__(self, text: str) -> list[str]:
        plain, odd, exact = _patterns(self.letters, self.digits)
        return (plain if text.isascii() or odd.isdisjoint(text) else exact).findall(text)


@lru_cache(maxsize=1)
def splitter() -> Splitter:
    """What the library's classes leave out, found by asking it for every code point. Newer tables only add characters."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    out = []
    for name in "LN":
        pattern = rf"\p{{{name}}}"
        known = set(bytes(tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        own = regex.findall(pattern, every)
        if len(known - set(own)):
            raise RuntimeError("the library classes characters that aren't known here")
        out.append("".join(c for c in own if c not in known))
    return Splitter(*out)


@lru_cache(maxsize=2)
def _patterns(letters: str, digits: str) -> tuple[regex.Pattern, frozenset[str], regex.Pattern]:
    space = "".join(map(regex.escape, _SPACES))
    plain = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    less = lambda name, some: rf"[\p{{{name}}}--[{some}]]" if some else rf"\p{{{name}}}"
    exact = plain.replace(r"\p{L}", less("L", letters)).replace(r"\p{N}", less("N", digits))
    return regex.compile(plain), frozenset(letters + digits), regex.compile("(?V1)" + exact)


_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True
_HIGH = np.zeros(256, bool)
_HIGH[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _wide(data: np.ndarray) -> np.ndarray:
    """Places of bytes that may begin white space beyond ASCII."""
    at = np.flatnonzero(_HIGH[data[:-1]]) if len(data) > 1 else np.zeros(0, np.int64)
    a, b = data[at], data[at + 1]
    return at[((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of the units of all texts of a group, in order; a text with wide space is one unit."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    space = _ASCII_SPACE[data]
    first = space.copy()
    first[1:] &= ~space[:-1]
    if len(wide := _wide(data)):
        for doc in np.unique(np.searchsorted(offsets, wide, "right") - 1):
            first[offsets[doc] : offsets[doc + 1]] = False
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUES[data] * up[:n], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Group(NamedTuple):
    """Some texts: their rows, the hashes of their distinct units, a text for each by its number, which unit stands at each
    place, and the first place of each text and the end."""

    lo: int
    hi: int
    names: list[int]
    text: Callable[[int], str]
    place: np.ndarray
    cuts: np.ndarray


def groups(column: pa.Array) -> Iterator[Group]:
    held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]] = []

    def made() -> Group:
        sizes = np.cumsum([0, *(len(x[2]) for x in held)])
        names, once, place = np.unique(np.concatenate([x[4] for x in held]), return_index=True, return_inverse=True)
        part = np.searchsorted(sizes, once, "right") - 1
        first = np.concatenate([x[2] for x in held])[once].tolist()
        end = np.concatenate([x[3] for x in held])[once].tolist()
        bodies, part = [x[5] for x in held], part.tolist()
        cuts = np.concatenate([*(n + x[6][:-1] for n, x in zip(sizes, held, strict=False)), sizes[-1:]])
        return Group(held[0][0], held[-1][1], names.tolist(), lambda i: bodies[part[i]][first[i] : end[i]].decode(), place, cuts)

    size = 0
    for lo, hi, data, offsets in chunks(column, CUT_BYTES):
        starts, ends, name = units(data, offsets)
        held.append((lo, hi, starts, ends, name, data.tobytes(), np.searchsorted(starts, offsets)))
        size += len(data)
        if size >= GROUP_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


@lru_cache(maxsize=4)
def _pieces(path: str) -> list[bytes]:
    """Pieces by id."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        out[rank] = piece
    return out


def decode(ids: list[int], path: str) -> bytes:
    pieces = _pieces(path)
    return b"".join([pieces[i] for i in ids])


def distinct_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word): the distinct words of the texts that aren't pieces themselves."""
    split = splitter()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        seen: set[int] = set()
        said: set[str] = set()
        for batch in batches:
            for group in groups(batch.column(0)):
                new: set[str] = set()
                for i, h in enumerate(group.names):
                    if h not in seen:
                        seen.add(h)
                        new.update(split(group.text(i)))
                new = {w for w in new if w not in said and w.encode() not in table}
                said |= new
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], names=["word"])
                if len(seen) > REMEMBERED:
                    seen = set()
                if len(said) > REMEMBERED:
                    said = set()

    return docs.select(docs[text]).mapInArrow(each, "word string").distinct()


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def build(docs: DataFrame, path: str) -> tuple[str, int]:
    """Merge the distinct words of (text) and write them with their ids: (folder, ranges)."""
    words = stored(distinct_words(docs, path), "words")
    buckets = max(12, -(-words.count() // RANGE_WORDS))
    folder = mounted_dir(docs.sparkSession, "bpe")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        ids = table.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        name = table.column("name").to_numpy().view(np.uint64)
        order = np.argsort(name)
        offsets = ids.offsets.to_numpy()
        save(folder, bucket, name[order], np.diff(offsets)[order], offsets[:-1][order].astype(np.uint64))
        _write(f"{folder}/{bucket}-ids", [ids.values.to_numpy(zero_copy_only=False).astype(np.uint32)])
        return pa.table({"n": [len(name)]})

    named = words.withColumn("name", F.xxhash64("word")).withColumn("bucket", F.expr(f"cast(shiftrightunsigned(name, 33) % {buckets} AS int)"))
    merged = fold_words(named.repartition("bucket"), path).select("bucket", "name", "ids")
    merged.groupBy("bucket").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder, buckets


Made = TypeVar("Made")


class _Coder(Generic[Made]):
    """What ``make`` makes of the ids of units, from the arrays; remembers the units met last."""

    def __init__(self, folder: str, path: str, buckets: int, split: Splitter, make: Callable[[list[int]], Made]):
        self.folder, self.buckets, self.table, self.ranks, self.split, self.make = folder, buckets, Sorted(folder), ranks(path), split, make
        self.bodies: dict[int, np.ndarray] = {}
        self.known: dict[int, Made] = {}

    def words(self, words: list[str]) -> dict[str, list[int]]:
        out, ask = {}, []
        for w in words:
            raw = w.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[w] = [rank]
            else:
                ask.append((w, xxhash.xxh64_intdigest(raw, _SEED)))
        if not ask:
            return out
        name = np.array([h for _, h in ask], np.uint64)
        bucket = _bucket(name, self.buckets)
        count, start = self.table.find(bucket, name, 0)
        if not count.all():
            raise RuntimeError(f"no ids for {int((count == 0).sum())} words")
        for (w, _), b, n, i in zip(ask, bucket.tolist(), count.tolist(), start.tolist(), strict=True):
            if b not in self.bodies:
                if len(self.bodies) > 4096:
                    self.bodies.clear()
                self.bodies[b] = _read(f"{self.folder}/{b}-ids")[0]
            out[w] = self.bodies[b][i : i + n].tolist()
        return out

    def texts(self, column: pa.Array) -> Iterator[tuple[Group, list[Made]]]:
        """Groups of texts, and what is made of each distinct unit."""
        for group in groups(column):
            new = [i for i, h in enumerate(group.names) if h not in self.known]
            split = [self.split(group.text(i)) for i in new]
            known = self.words(list({w for some in split for w in some}))
            for i, some in zip(new, split, strict=True):
                self.known[group.names[i]] = self.make(known[some[0]] if len(some) == 1 else [x for w in some for x in known[w]])
            yield group, [self.known[h] for h in group.names]
            if len(self.known) > REMEMBERED:
                for h in list(islice(self.known, len(self.known) - REMEMBERED // 2)):
                    del self.known[h]


#: Coders of this process by what they make; a worker keeps one for the tasks that it runs of a job.
_CODERS: dict[str, _Coder] = {}


def _coder(made: str, make: Callable[[str], Callable[[list[int]], Made]], folder: str, path: str, buckets: int, split: Splitter) -> _Coder[Made]:
    if made not in _CODERS or _CODERS[made].folder != folder:
        _CODERS.clear()
        _CODERS[made] = _Coder(folder, path, buckets, split, make(path))
    return _CODERS[made]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encoded_by_fold(docs: DataFrame, path: str) -> DataFrame:
    """As ``encoded``."""
    folder, buckets = build(docs, path)
    split = splitter()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder("ids", lambda _: list, folder, path, buckets, split)
        for batch in batches:
            for group, ids in coder.texts(batch.column(1)):
                said = [[i for u in group.place[a:b].tolist() for i in ids[u]] for a, b in pairwise(group.cuts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(group.lo, group.hi - group.lo), pa.array(said, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(each, "doc_id long, ids array<int>")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = pa.array([coder.encode_ordinary(x.as_py() or "") for x in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(each, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.as_py() or [], path) for x in batch.column(1)], pa.binary())], names=["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(each, "doc_id long, bytes binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def report(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each text's ids and of the bytes that the ids decode to."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names = encoding(path), [b"%d" % i for i in range(len(_pieces(path)))]
        for batch in batches:
            held: list[list] = [[], [], []]
            for text in batch.column(1):
                ids = coder.encode_ordinary(text.as_py() or "")
                held[0].append(len(ids))
                held[1].append(hashlib.sha256(b",".join([names[i] for i in ids])).hexdigest())
                held[2].append(hashlib.sha256(decode(ids, path)).hexdigest())
            columns = [batch.column(0), pa.array(held[0], pa.int64()), *(pa.array(x, pa.string()) for x in held[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGEST.split(", ")])

    return _texts(docs).mapInArrow(each, DIGEST)


def _shown(path: str) -> Callable[[list[int]], tuple[bytes, bytes, int]]:
    """Ids in decimals joined by commas, the bytes that they decode to, and how many they are."""
    pieces = _pieces(path)
    names = [b"%d" % i for i in range(len(pieces))]
    return lambda ids: (b",".join([names[i] for i in ids]), b"".join([pieces[i] for i in ids]), len(ids))


def report_by_fold(docs: DataFrame, path: str) -> DataFrame:
    """As ``report``."""
    folder, buckets = build(docs, path)
    split = splitter()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder("shown", _shown, folder, path, buckets, split)
        for batch in batches:
            for group, made in coder.texts(batch.column(1)):
                said, back, size = (list(x) for x in zip(*made, strict=True)) if made else ([], [], [])
                size = np.append(0, np.cumsum(np.array(size, np.int64)[group.place]))
                held: list[list] = [[], []]
                for a, b in pairwise(group.cuts.tolist()):
                    own = group.place[a:b].tolist()
                    held[0].append(hashlib.sha256(b",".join([said[u] for u in own])).hexdigest())
                    held[1].append(hashlib.sha256(b"".join([back[u] for u in own])).hexdigest())
                columns = [batch.column(0).slice(group.lo, group.hi - group.lo), pa.array(size[group.cuts[1:]] - size[group.cuts[:-1]], pa.int64()), *(pa.array(x, pa.string()) for x in held)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGEST.split(", ")])

    return _texts(docs).mapInArrow(each, DIGEST)


#: Bits of an id in the table of pairs.
_ID = 21


def _pair_table(path: str, slots: int = 1 << 18, groups: int = 1 << 15) -> tuple[list[int], list[int]]:
    """A perfect hash of the pairs of pieces that make a piece: (pair and rank of each slot, -1 if none; shift of each group). A
    pair is its ids in 21 bits each, and a piece's id is its rank."""
    table = ranks(path)
    grouped: dict[int, list[tuple[int, int, int]]] = {}
    for piece, rank in table.items():
        for cut in range(1, len(piece)):
            left, right = table.get(piece[:cut]), table.get(piece[cut:])
            if left is not None and right is not None:
                pair = left << _ID | right
                code = xxhash.xxh64(pair.to_bytes(8, "little"), seed=_SEED).intdigest()
                grouped.setdefault(code % groups, []).append((code, pair, rank))
    entries, shifts = [-1] * slots, [0] * groups
    for group, held in sorted(grouped.items(), key=lambda x: (-len(x[1]), x[0])):
        for shift in range(1, 47):
            places = [(code >> shift) % slots for code, _, _ in held]
            if len(set(places)) == len(places) and all(entries[p] < 0 for p in places):
                break
        else:
            raise ValueError("no shift is free for a group of pairs")
        shifts[group] = shift
        for p, (_, pair, rank) in zip(places, held, strict=True):
            entries[p] = pair << _ID | rank
    return entries, shifts


def fold_words(words: DataFrame, path: str, column: str = "word") -> DataFrame:
    """Add ids to distinct words: the ids of their bytes are merged by rank in a fold of higher-order functions, with a literal
    table of ranks. Each step merges the first of the pairs of least rank, whose rank is the merged piece's id."""
    entries, shifts = _pair_table(path)
    literal = lambda x, kind: f"cast(split('{','.join(map(str, x))}', ',') AS array<{kind}>)"
    table = ranks(path)
    single = literal([table[bytes([b])] for b in range(256)], "int")
    # the tables are in the plan once, as values of names
    tables = {"k": literal(entries, "bigint"), "d": literal(shifts, "int"), "b": single}

    def ranked(left: str, right: str) -> str:
        """Rank of a pair, null if it makes no piece. The inner array of one names what is looked up once."""
        pair = f"(shiftleft(cast({left} AS bigint), {_ID}) + {right})"
        slot = f"cast(pmod(shiftrightunsigned(xxhash64({pair}), get(d, cast(pmod(xxhash64({pair}), {len(shifts)}) AS int))), {len(entries)}) AS int)"
        return f"aggregate(array(get(k, {slot})), cast(NULL AS int), (o, e) -> CASE WHEN shiftright(e, {_ID}) = {pair} THEN cast(e & {(1 << _ID) - 1} AS int) END)"

    # a: the ids of n pieces and, after them, the ranks of their n - 1 neighbouring pairs; m: the least rank, j: where it is first
    none = "cast(array() AS array<int>)"
    n = "cast((size(a) + 1) div 2 AS int)"
    left = f"CASE WHEN j > 1 THEN array({ranked('get(a, j - 2)', 'm')}) ELSE {none} END"
    right = f"CASE WHEN j + 1 < n THEN array({ranked('m', 'get(a, j + 1)')}) ELSE {none} END"
    merged = f"concat(slice(a, 1, j - 1), array(m), slice(a, j + 2, n - j - 1), slice(a, n + 1, greatest(j - 2, 0)), {left}, {right}, slice(a, n + j + 2, size(a)))"
    held = lambda name, value, body: f"aggregate(array({value}), a, (a, {name}) -> {body})"
    step = held("n", n, f"CASE WHEN n < 2 THEN a ELSE {held('m', 'array_min(slice(a, n + 1, n))', 'CASE WHEN m IS NULL THEN a ELSE ' + held('j', 'cast(array_position(slice(a, n + 1, n), m) AS int)', merged) + ' END')} END")
    steps = f"CASE WHEN size(p) > 1 THEN sequence(2, size(p)) ELSE {none} END"
    fold = f"aggregate({steps}, concat(p, r), (a, i) -> {step}, a -> slice(a, 1, {n}))"
    first = f"CASE WHEN size(p) < 2 THEN {none} ELSE transform(sequence(1, size(p) - 1), i -> {ranked('get(p, i - 1)', 'get(p, i)')}) END"
    byte = "cast(conv(x, 16, 10) AS int)"
    pieces = f"transform(regexp_extract_all(hex(encode({column}, 'UTF-8')), '..', 0), x -> get(b, {byte}))"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    ids = let("p", pieces, let("r", first, fold))
    for name, table in tables.items():
        ids = let(name, table, ids)
    return words.withColumn("ids", F.expr(ids))
