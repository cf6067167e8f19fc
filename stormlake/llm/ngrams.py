"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model.

Words are counted first; each gets an id, small for frequent words. N-grams are then counted in Spark: tasks send each
other packed runs of distinct n-grams of ids by hash range, and each range writes its sorted hash arrays into the
shared folder. Counts of order n are raw, those below are numbers of distinct words before; both come from one chain
of shuffles, n to 1. Workers map the arrays into memory and score texts.

An n-gram's range is its context's, so that the words after one context meet. Words of over a thousandth of all
tokens, fewer than 1000, are dealt over 64 ranges as contexts, so that one word can't fill a range. A run goes to one of at
most FANOUT groups of ranges; beyond so many ranges a second step deals each group to its own ranges, so a task never
writes more than FANOUT runs at once, whatever the size of the corpus.

Defined cases: null and empty texts have one token, the end; ids that are null count as training rows; repeated
rows count and are scored each; a very long text is tokenised alone and takes memory in proportion to its length;
without training tokens every word has the same probability; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlake.llm.arrays import Sorted, range_of, save
from stormlake.llm.base import checkpointed, mounted_dir
from stormlake.llm.bytesof import chunks, lower_table, mix, words

ORDER = 3
#: Characters of training text for each hash range; tokens packed at once by a task; bytes of text scored at once.
RANGE_CHARS, PACK_TOKENS, SCORE_BYTES = 8_000_000, 1_000_000, 1 << 21
HEAVY_SHARE, SPLIT = 1e-3, 64
#: Runs that a task writes at once, at most.
FANOUT = 4096
#: Ids: what stands before a text, and words that training never saw. The end of a text is a word.
BEGIN, UNKNOWN = np.uint64(0), np.uint64((1 << 48) - 1)
END = np.uint64(1)
_U = np.uint64


class Model(NamedTuple):
    """Where the arrays are, and what the driver holds of the model."""

    folder: str
    order: int
    buckets: int
    tokens: int
    vocabulary: int
    discounts: list[tuple[float, float, float]]  # of orders 1 to n
    bottom: tuple[int, int, int, int]  # order 1: total, and words counted once, twice, more often
    heavy: np.ndarray  # sorted words
    heavy_contexts: np.ndarray  # for each, as a context of order 2: total, followers seen once, twice, more often


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash of 48 bits) of all tokens of a group of texts, each text closed by END."""
    found = words(data, offsets, lower_table())
    n = len(offsets) - 1
    place = np.arange(len(found.doc)) + found.doc
    out = np.full(len(found.doc) + n, END, np.uint64)
    out[place] = found.hash >> _U(16)
    lengths = np.bincount(found.doc, minlength=n) + 1
    return np.repeat(np.arange(n), lengths), out


def grams(doc: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """(tokens, order): each token with the words before it in its text, BEGIN before the first."""
    out = np.full((len(word), order), BEGIN, np.uint64)
    out[:, -1] = word
    for back in range(1, order):
        same = doc[back:] == doc[:-back] if len(doc) > back else np.zeros(0, bool)
        out[back:, order - 1 - back][same] = word[:-back][same]
    return out


def _next(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from its context's."""
    return mix(key * _U(0xD6E8FEB86659FD93) + word)


def _fold(rows: np.ndarray) -> np.ndarray:
    key = np.full(len(rows), 0x51ED270B, np.uint64)
    for i in range(rows.shape[1]):
        key = _next(key, rows[:, i])
    return key


def _often(rows: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which n-grams are pairs that begin with a heavy word."""
    if rows.shape[1] != 2 or not len(heavy):
        return np.zeros(len(rows), bool)
    return heavy[np.minimum(np.searchsorted(heavy, rows[:, 0]), len(heavy) - 1)] == rows[:, 0]


def ranges(rows: np.ndarray, buckets: int, heavy: np.ndarray, top: np.ndarray | None = None) -> np.ndarray:
    """Range of each n-gram: its context's, for heavy words one of 64; a single word's own. top: hashes of the contexts, or
    of single words, where they are known."""
    if top is None:
        top = _fold(rows[:, :-1] if rows.shape[1] > 1 else rows)
    if rows.shape[1] == 1:
        # not the first bits of the hash that orders the range
        return range_of(mix(top), buckets)
    often = np.flatnonzero(_often(rows, heavy))
    if len(often):
        top = top.copy()
        top[often] = mix(top[often] + (rows[often, 1] % _U(SPLIT) + _U(1)) * _U(0x9E3779B97F4A7C15))
    return range_of(top, buckets)


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers as their bytes of equal place, compressed together."""
    parts = [np.array([len(columns[0])], "<u8").tobytes()]
    for x in columns:
        width = max(1, -(-int(x.max() if len(x) else 0).bit_length() // 8))
        parts += [bytes([width]), np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _expand(data: bytes, columns: int) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _ in range(columns):
        width = raw[at]
        held = np.zeros((n, 8), np.uint8)
        held[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(held.reshape(-1).view("<u8"))
        at += 1 + n * width
    return out


#: A run for a range; or, under a negative number, sums: of a level, or of a heavy word where one is named.
SUMS = [f"s{i}" for i in range(8)]
PACKED = "bucket int, data binary, level int, word long, " + ", ".join(f"{x} long" for x in SUMS)
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_TYPES = [pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 9]


def _rows(bucket: list, data: list, level: list, word: list, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((bucket, data, level, word, *(sums[:, i] if len(sums) else [None] * len(bucket) for i in range(len(SUMS)))), _TYPES, strict=True)], names=_NAMES)


def _distinct(rows: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, rows, counts) of distinct n-grams, by hash."""
    key = _fold(rows)
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new)
    total = np.diff(np.append(at, len(ranked))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts
    return ranked[at], rows[order[at]], total.astype(np.int64)


def _pack(rows: np.ndarray, counts: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """One packed run for each group, in an order that compresses well."""
    shift = _U(max(0, int(rows.max() if rows.size else 0).bit_length() - 25))
    order = np.argsort((group.astype(np.uint64) << _U(50)) | (rows[:, 0] >> shift << _U(25)) | (rows[:, 1 if rows.shape[1] > 1 else 0] >> shift), kind="stable")
    rows, counts, group = rows[order], counts[order], group[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    data = [_squeeze([*(rows[i:j, c] for c in range(rows.shape[1])), counts[i:j]]) for i, j in zip(starts, np.append(starts, len(group))[1:], strict=True)]
    none = [None] * len(starts)
    return _rows(group[starts].tolist(), data, none, none, np.zeros((0, 8)))


def _unpack(runs: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    rows, counts = [np.zeros((0, order), np.uint64)], [np.zeros(0, np.int64)]
    for run in runs:
        if run:
            *some, n = _expand(run, order + 1)
            rows.append(np.column_stack(some).astype(np.uint64, copy=False))
            counts.append(n.astype(np.int64))
    return np.concatenate(rows), np.concatenate(counts)


class _Dealer:
    """Where runs go: to ranges at once if these are few, else to groups of ranges and from there to ranges."""

    def __init__(self, buckets: int, heavy: np.ndarray):
        self.buckets, self.heavy, self.width = buckets, heavy, -(-buckets // FANOUT)

    def pack(self, rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return _pack(rows, counts, ranges(rows, self.buckets, self.heavy) // self.width)

    def dealt(self, runs: DataFrame, order: int) -> DataFrame:
        if self.width == 1:
            return runs

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held, size = None, [], 0

            def flush() -> pa.RecordBatch:
                _, rows, counts = _distinct(*_unpack(held, order))
                return _pack(rows, counts, ranges(rows, self.buckets, self.heavy))

            for batch in batches:
                sums = batch.filter(pc.less(batch.column(0), 0))
                if sums.num_rows:
                    yield sums
                for name, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name < 0:
                        continue
                    if held and (name != group or size >= 8 * PACK_TOKENS):
                        yield flush()
                        held, size = [], 0
                    group = name
                    held.append(run)
                    size += len(run)
            if held:
                yield flush()

        return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, PACKED)

    def grouped(self, runs: DataFrame, order: int):
        """Runs by range; every range has one, if an empty one."""
        none = ", ".join(f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in PACKED.split(", ")[1:]).replace("AS long)", "AS bigint)")
        every = runs.sparkSession.range(self.buckets, numPartitions=max(1, self.buckets // 10_000)).selectExpr("CAST(id AS int) AS bucket", *none.split(", "))
        return self.dealt(runs, order).unionByName(every).groupBy("bucket")


def _ids(vocabulary: Sorted, buckets: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, id) of words given by their hashes."""
    names, place = np.unique(word, return_inverse=True)
    rows = names[:, None]
    key = _fold(rows)
    count, ids = vocabulary.find(ranges(rows, buckets, np.zeros(0, np.uint64), key), key, int(UNKNOWN))
    return count[place], ids[place]


def _counted(texts: DataFrame, order: int, dealer: _Dealer, vocabulary: str | None) -> DataFrame:
    """Packed runs of the n-grams of a column of texts; of word hashes without a vocabulary, else of ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sorted(vocabulary) if vocabulary else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = docs = 0

        def flush() -> pa.RecordBatch:
            doc, word = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if known is not None:
                word = _ids(known, dealer.buckets, word)[1]
            return dealer.pack(*_distinct(grams(doc, word, order), None)[1:])

        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                doc, word = tokens(data, offsets)
                held.append((doc + docs, word))
                docs += hi - lo
                size += len(word)
                if size >= PACK_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return texts.mapInArrow(each, PACKED)


def _by_context(counts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, (total, once, twice, more)) of the counts under each key."""
    names, place = np.unique(key, return_inverse=True)
    of = lambda x: np.bincount(place, weights=x, minlength=len(names)).astype(np.int64)
    return names, np.stack([of(counts), of(counts == 1), of(counts == 2), of(counts > 2)], axis=1)


def _level(order: int, folder: str, dealer: _Dealer):
    """What a range does with the n-grams of one order: write its arrays, then send on the grams without first word."""

    def each(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            return table
        rows, counts = _unpack(table.column("data").to_pylist(), order)
        name, rows, counts = _distinct(rows, counts)
        save(f"{folder}/{order}", bucket, name, counts)
        held = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
        sums = [np.append(held, [counts.sum(), (counts == 1).sum(), (counts == 2).sum(), (counts > 2).sum()])]
        word: list[int | None] = [None]
        out = []
        if order > 1:
            often = _often(rows, dealer.heavy)
            heavy, of = _by_context(counts[often], rows[often, 0])
            word += heavy.astype(np.int64).tolist()
            sums += [np.append(x, [0] * 4) for x in of]
            before, of = _by_context(counts[~often], mix(_fold(rows[~often, :-1])))
            save(f"{folder}/{order}c", bucket, before, of)
            _, rest, counts = _distinct(rows[:, 1:], None)
            out.append(dealer.pack(rest, counts))
        out.append(_rows([-1 - bucket] * len(sums), [None] * len(sums), [order] * len(sums), word, np.array(sums)))
        return pa.Table.from_batches(out)

    return each


def _discounts(t1: int, t2: int, t3: int, t4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; fixed ones where a count of counts is missing."""
    if not (t1 and t2 and t3 and t4):
        return 0.5, 1.0, 1.5
    y = t1 / (t1 + 2 * t2)
    found = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3)
    return tuple(min(max(d, 0.01), k + 0.99) for k, d in enumerate(found))  # type: ignore[return-value]


def train(docs: DataFrame, usable: Column, order: int = ORDER) -> Model:
    """Count the texts of the usable rows of (doc_id, text) and write the model's arrays."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    folder = mounted_dir(spark, "ngrams")
    texts = docs.filter(usable).select(F.coalesce("text", F.lit("")).alias("text"))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(12, -(-chars // RANGE_CHARS))
    plain = _Dealer(buckets, np.zeros(0, np.uint64))

    def base(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        name, rows, counts = _distinct(*_unpack(table.column("data").to_pylist(), 1))
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((name, -counts))] = np.arange(len(counts))
        ids = (rank * buckets + bucket + 1).astype(np.uint64)
        save(f"{folder}/0", bucket, name, counts, ids)
        often = counts > counts.sum() * HEAVY_SHARE
        return pa.table({"word": pa.array([None, *ids[often].tolist()], pa.int64()), "n": [int(counts.sum()), *counts[often].tolist()], "distinct": [len(counts), *[0] * int(often.sum())]})

    found = checkpointed(plain.grouped(_counted(texts, 1, plain, None), 1).applyInArrow(base, "word long, n long, distinct long"))
    total, distinct = found.filter("word IS NULL").agg(F.sum("n"), F.sum("distinct")).first()
    # fewer than 1 / HEAVY_SHARE words
    heavy = np.array(sorted(r["word"] for r in found.filter(F.col("word").isNotNull() & (F.col("n") > HEAVY_SHARE * total)).collect()), np.uint64)
    dealer = _Dealer(buckets, np.unique(np.append(heavy, BEGIN)) if total else heavy)
    heavy = dealer.heavy
    rows = _counted(texts, order, dealer, f"{folder}/0")
    for level in range(order, 0, -1):
        rows = dealer.grouped(rows, level).applyInArrow(_level(level, folder, dealer), PACKED)
    # a row for each level and for each heavy word
    held = {(r["level"], r["word"]): [r[x] for x in SUMS] for r in rows.groupBy("level", "word").agg(*[F.sum(x).alias(x) for x in SUMS]).filter("level IS NOT NULL").collect()}
    stats = [held[level, None] for level in range(1, order + 1)]
    sums = np.array([held.get((2, int(w)), [0] * 8)[:4] for w in heavy], np.int64).reshape(-1, 4)
    return Model(folder, order, buckets, total, distinct, [_discounts(*s[:4]) for s in stats], tuple(stats[0][4:]), heavy, sums)


@lru_cache(maxsize=1)
def _opened(folder: str, order: int) -> tuple[list[Sorted], dict[int, Sorted]]:
    return [Sorted(f"{folder}/{m}") for m in range(order + 1)], {m: Sorted(f"{folder}/{m}c", 4) for m in range(2, order + 1)}


def _taken(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3)], 0)


def probabilities(model: Model, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, training count) of each token, given by its hash."""
    tables, before = _opened(model.folder, model.order)
    count, word = _ids(tables[0], model.buckets, word)
    names, place = np.unique(word, return_inverse=True)
    one = names[:, None]
    key = _fold(one)
    uniform = 1.0 / (model.vocabulary + 1)
    total, *seen = model.bottom
    if total:
        found, _ = tables[1].find(ranges(one, model.buckets, model.heavy, key), key)
        p = (_taken(found, model.discounts[0]) + np.dot(seen, model.discounts[0]) * uniform) / total
    else:
        p = np.full(len(names), uniform)
    p = p[place]
    rows = grams(doc, word, model.order)
    for m in range(2, model.order + 1):
        some = rows[:, model.order - m :]
        d = model.discounts[m - 1]
        top = _fold(some[:, :-1])
        if m == 2:
            history, once, back = np.unique(some[:, 0], return_index=True, return_inverse=True)
            sums, _ = before[2].find(range_of(top[once], model.buckets), mix(top[once]))
            if len(model.heavy):
                at = np.minimum(np.searchsorted(model.heavy, history), len(model.heavy) - 1)
                often = model.heavy[at] == history
                sums[often] = model.heavy_contexts[at[often]]
            sums = sums[back]
        else:
            sums, _ = before[m].find(range_of(top, model.buckets), mix(top))
        # a context that was never seen has no words after it
        known = np.flatnonzero(sums[:, 0])
        sums, some, top = sums[known], some[known], top[known]
        found, _ = tables[m].find(ranges(some, model.buckets, model.heavy, top), _next(top, some[:, -1]))
        p[known] = (_taken(found, d) + sums[:, 1:] @ np.array(d) * p[known]) / sums[:, 0]
    return p, count


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probabilities of every whole text of (doc_id, text): the base's and the model's."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = model.tokens + 0.5 * (model.vocabulary + 1)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), SCORE_BYTES):
                doc, word = tokens(data, offsets)
                p, count = probabilities(model, doc, word)
                of = lambda x: np.bincount(doc, weights=x, minlength=hi - lo)  # noqa: B023, E731
                columns = [of(np.ones(len(doc))).astype(np.int64), of(count > 0).astype(np.int64), np.full(hi - lo, model.tokens), of(np.log10((count + 0.5) / base)), of(np.log10(p))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, columns)], names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, SCORED)


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id modulo 5 isn't 1."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    model = train(docs, ~held, order)
    scored = score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), *[x.split()[0] for x in SCORED.split(", ")[1:]])
