"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles (five words by default), ascending. The
sketch of a union is the k smallest of both sketches, so sketches of parts merge; resemblance, containment
and the number of distinct shingles are estimated from sketches alone, exactly while a sketch isn't full.

Defined cases: a null text counts as empty; a text of one to four words has one shingle of all its words;
a text without words has an empty sketch. Two empty sketches resemble each other fully (1), an empty and
another not at all (0). Repeated rows keep their rows. A very long text is read whole, in memory in proportion to its length. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlake.llm.base import bucket_of, range_bounds
from stormlake.llm.bytesof import chunks, shingles, space_table, words

SHINGLE_WORDS = 5
SKETCH_SIZE = 256
#: Bits of a hash that a sketch keeps.
BITS = 48
#: Rows of one range of ids, and the most ranges: bounds are held by the driver.
RANGE_ROWS, MOST_RANGES = 1024, 8192


def sketch_texts(column: pa.Array | pa.ChunkedArray, k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """A sketch for each text."""
    table, out = space_table(), []
    for lo, hi, data, offsets in chunks(column):
        doc, value = shingles(words(data, offsets, table), size)
        cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
        value >>= np.uint64(64 - BITS)
        out += [np.unique(value[a:b])[:k] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated share of common shingles among the distinct shingles of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    distinct = len(both) - int(twice.sum())
    if distinct <= k:
        return int(twice.sum()) / distinct
    new = np.ones(len(both), bool)
    new[1:] = ~twice
    # the k-th distinct value bounds the sketch of the union
    top = both[np.flatnonzero(new)[k - 1]]
    return int((twice & (both[1:] <= top)).sum()) / k


def distinct_shingles(a: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Estimated share of a's distinct shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def to_string(a: np.ndarray) -> str:
    """Six bytes a hash, most significant first, in base64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    held = np.zeros((len(raw), 8), np.uint8)
    held[:, 8 - BITS // 8 :] = raw
    return held.view(">u8").reshape(-1).astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text", k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS, out: str = "fingerprint") -> DataFrame:
    """Replace the text column by its fingerprint as a string named ``out``; the other columns stay."""
    keep = [c for c in docs.columns if c not in (text, out)]
    shape = docs.select(*keep, F.lit("").alias(out)).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([to_string(x) for x in sketch_texts(batch.column(len(keep)), k, size)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, out])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(each, shape)


def merge_parts(prints: DataFrame, key: str, column: str = "fingerprint", k: int = SKETCH_SIZE) -> DataFrame:
    """One fingerprint for each key from those of its parts (key, fingerprint).

    Each task first merges what it holds of a key, so a key reaches the last step with one row of k hashes
    for each task at most, however many parts it has.
    """
    shape = prints.select(key, column).schema

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = from_string(text or "")
                held[name] = merge(held[name], new, k) if name in held else new
            yield pa.RecordBatch.from_arrays([pa.array(held, batch.schema.field(0).type), pa.array(map(to_string, held.values()), pa.string())], names=[key, column])

    def wholly(table: pa.Table) -> pa.Table:
        total = np.zeros(0, np.uint64)
        for text in table.column(1).to_pylist():
            total = merge(total, from_string(text), k)
        return pa.table({key: table.column(0).slice(0, 1), column: [to_string(total)]})

    return prints.select(key, column).mapInArrow(partly, shape).groupBy(key).applyInArrow(wholly, shape)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, next_contained double"


def compare_with_next(docs: DataFrame, k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprint each text of (doc_id, text), an edited text that borrows from the next document, and compare.

    Documents follow each other by (doc_id, text), null ids first; the last one's next is the first. The ids
    are cut into ranges, each range gets a copy of the next one's first row, and a sorted range is read as a
    stream: texts are shuffled once and a task holds one batch.
    """
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63) + 1)).alias("k"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    count = rows.count()
    bounds = range_bounds(rows, "k", min(MOST_RANGES, max(1, count // RANGE_ROWS)))
    ranged = rows.withColumn("part", bucket_of("k", bounds)).withColumn("head", F.lit(0))
    heads = ranged.filter(F.col("k").isin(bounds or [0])).withColumn("part", F.pmod(F.col("part") - 1, F.lit(max(1, len(bounds))))).withColumn("head", F.lit(1))
    dealt = ranged.unionByName(heads).repartition(max(1, len(bounds)), "part").sortWithinPartitions("part", "head", "k", "text").select("doc_id", "text", "head")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
            n = table.num_rows
            head = table.column("head").to_pylist()
            rest = table.slice(n - 1) if n and not head[-1] else None
            for lo in range(0, n - 1, 512):
                part = table.slice(lo, min(513, n - lo))
                if made := pairs(part, head[lo : lo + 513]):
                    yield made

    def pairs(part: pa.Table, head: list[int]) -> pa.RecordBatch | None:
        own = [i for i in range(part.num_rows - 1) if not head[i]]
        if not own:
            return None
        texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
        edited = []
        for i in own:
            cut = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        prints = sketch_texts(part.column("text"), k, size)
        other = sketch_texts(pa.array(edited, pa.large_string()), k, size)
        columns = [
            pa.array([ids[i] for i in own], pa.int64()),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([to_string(prints[i]) for i in own], pa.string()),
            pa.array([to_string(x) for x in other], pa.string()),
            pa.array([resemblance(prints[i], x, k) for i, x in zip(own, other, strict=True)], pa.float64()),
            pa.array([resemblance(prints[i], prints[i + 1], k) for i in own], pa.float64()),
            pa.array([distinct_shingles(prints[i], k) for i in own], pa.float64()),
            pa.array([containment(prints[i + 1], prints[i], k) for i in own], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in EDITED.split(", ")])

    return dealt.mapInArrow(each, EDITED)
