"""SimHash near-duplicates: fingerprints of 64 bits, linked where 2 bits or fewer differ, by BK-trees of bounded shards.

A text is lower-cased (A-Z), cut into words and into shingles of three words, repeats included; a shingle's hash is the
XXH64 (seed 42) of its words joined by spaces. A bit of the fingerprint is 1 if it is set in over half of the hashes. Steps:

1. Fingerprints are made in Arrow batches, and only (doc_id, fingerprint) is kept. Equal fingerprints are one node.
2. Nodes are dealt to shards. Of three blocks that share out all bits, two linked fingerprints agree on one at least, so a node
   goes to three shards, one for each block's value. A shard of over ``SHARD`` nodes is dealt anew by three blocks of the bits that are
   still free, for its nodes only. After four rounds 14 bits at most are free, so no shard holds over 16,384 nodes, however alike
   fingerprints are, and a node has at most 81 rows. Trees reach their queries by this shuffle, not by broadcast: they hold the
   fingerprints of all documents, which have no bound and mustn't pass the driver.
3. A task holds the BK-trees of some 65,536 nodes of whole shards: a node's children are keyed by their integer Hamming
   distance to it, and all nodes look for their neighbours by following only the edges within the radius of their own
   distance. Links are joined within the shard, so that a node leaves with one link at most.
4. Components by large-star and small-star rounds over tables; ids go back to all documents.

No pair is lost, and neither nodes, links nor components pass through the driver.

Defined cases: null texts count as empty; a text without words has fingerprint zero and is linked like any other; a text of one or
two words has one shingle of all of them; repeated rows and rows of one id keep their rows; a null id is never a component's
name unless all ids of the component are null, which names it null; a very long text is read whole, in memory in proportion to its length; no rows
give no rows. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlake.llm.base import checkpointed, release
from stormlake.llm.neardup import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Most nodes of a shard that isn't dealt anew, and nodes of a forest that a task holds at once.
SHARD, FOREST = 4096, 65_536
#: Rounds of dealing; walks down a forest that are taken together.
ROUNDS, WALKED = 4, 131_072
#: A hot shard's name reaches its nodes by so many salted copies.
SALTS = 32
#: Shingles whose bits are counted at once.
COUNTED = 65_536
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in pieces; bytes.split() cuts at the six ASCII separators."""
    words = text.translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    last = ends.tolist() if len(words) < size else ends[size - 1 :].tolist()
    if len(words) < size:
        starts, last = starts[:1], last[-1:]
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(last), COUNTED):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + COUNTED], last[lo : lo + COUNTED], strict=False)], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, the highest first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint_of(text: str | bytes | None, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text, unsigned."""
    raw = text.encode() if isinstance(text, str) else text or b""
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(raw, size):
        total += _bit_counts(hashes)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(x.as_py(), size) for x in batch.column(1)]
            made = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "fp"])

    return rows.mapInArrow(each, "doc_id long, fp long")


def block_masks(rounds: int = ROUNDS, blocks: int = RADIUS + 1) -> list[list[int]]:
    """For each round the bits that a shard's nodes agree on, by path; path p of a round has the next round's paths
    p * blocks to p * blocks + blocks - 1."""
    out, before = [], [0]
    for _ in range(rounds):
        now = []
        for taken in before:
            free = [b for b in range(64) if not taken >> b & 1]
            cuts = [len(free) * i // blocks for i in range(blocks + 1)]
            now += [taken | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        out.append(now)
        before = now
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, masks: list[int], path: Column, blocks: int) -> DataFrame:
    """Each node to the shards of its path's blocks."""
    table = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    rows = rows.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: (path * blocks + i).cast("int"))).alias("path"))
    return rows.select("fp", "path", F.col("fp").bitwiseAND(F.get(table, F.col("path"))).alias("shard"))


def shards(nodes: DataFrame, most: int = SHARD, rounds: int = ROUNDS, blocks: int = RADIUS + 1) -> DataFrame:
    """(fp, path, shard): the nodes of each shard that has two or more. Two nodes that differ in fewer than ``blocks`` bits share one."""
    masks = block_masks(rounds, blocks)
    out = None
    rows = _dealt(nodes.select("fp"), masks[0], F.lit(0), blocks)
    for at in range(rounds):
        # paths of different rounds have different numbers
        named = lambda df, k=at: df.select("fp", (F.col("path") + F.lit(1000 * k)).cast("int").alias("path"), "shard")
        hot = None
        if at + 1 < rounds:
            hot = checkpointed(rows.groupBy("path", "shard").agg(F.count("*").alias("n")).filter(F.col("n") > most).drop("n"))
            if not hot.limit(1).count():
                hot = None
        if hot is None:
            out = named(rows) if out is None else out.unionByName(named(rows))
            break
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("hot", F.lit(True))
        marked = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["path", "shard", "salt"], "left")
        cold = named(marked.filter("hot IS NULL"))
        out = cold if out is None else out.unionByName(cold)
        rows = checkpointed(_dealt(marked.filter("hot"), masks[at + 1], F.col("path"), blocks))
    return out


class Forest:
    """BK-trees of several shards at once, as arrays: node 0.. in the order in which levels were made, so that a node's
    children lie together, ordered by their distance to it."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """values: uint64, distinct within a group; group: ascending numbers from 0 of the shards."""
        n = len(values)
        self.order = np.empty(n, np.int64)  # place of a node in the input
        self.value = np.empty(n, np.uint64)
        keys = []  # of a child: its parent's number and its distance
        member, key = np.arange(n), group.astype(np.int64)
        parent = np.full(n, -1)
        edge = np.zeros(n, np.int64)
        made = 0
        while len(member):
            # the first member of each group is its node, the others go to its children by their distance
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(first)
            number = made + np.cumsum(first) - 1
            self.order[made : made + len(heads)] = member[heads]
            self.value[made : made + len(heads)] = values[member[heads]]
            keys.append(parent[heads] * 65 + edge[heads])
            rest = ~first
            own = number[rest]
            made += len(heads)
            member = member[rest]
            edge = np.bitwise_count(values[member] ^ self.value[own]).astype(np.int64)
            key = own * 65 + edge
            by = np.argsort(key, kind="stable")
            member, key, parent, edge = member[by], key[by], own[by], edge[by]
        self.roots = int(group[-1]) + 1 if n else 0
        # nodes of a level are made in the order of their keys, and levels in the order of their parents
        self.child = np.concatenate(keys)[self.roots :] if n else np.zeros(0, np.int64)

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place of a neighbour in the input), in pieces: neighbours of each query in the tree of its root. Walks are taken up
        ``WALKED`` at a time, the deepest first, so that their number stays bounded however many nodes are near."""
        todo = [(np.arange(len(queries)), roots)]
        while todo:
            at, node = todo.pop()
            if len(at) > WALKED:
                todo.append((at[WALKED:], node[WALKED:]))
                at, node = at[:WALKED], node[:WALKED]
            away = np.bitwise_count(queries[at] ^ self.value[node]).astype(np.int64)
            found = away <= radius
            if found.any():
                yield at[found], self.order[node[found]]
            lo = np.searchsorted(self.child, node * 65 + np.maximum(away - radius, 0))
            hi = np.searchsorted(self.child, node * 65 + np.minimum(away + radius, 64), "right")
            count = hi - lo
            if count.any():
                at = np.repeat(at, count)
                step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                todo.append((at, self.roots + np.repeat(lo, count) + step))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after nodes a and b are joined; a label is the least node of what is joined so far."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def shard_links(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as places in the input: each node that isn't the least of its component within its shard, and that one."""
    forest = Forest(values, group)
    label = np.arange(len(values))
    for query, other in forest.near(values, group, radius):
        keep = query < other
        label = _joined(label, query[keep], other[keep])
    b = np.flatnonzero(label != np.arange(len(values)))
    return label[b], b


def links(dealt: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between nodes from (fp, path, shard): as few as join what is linked within a shard."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            a, b = shard_links(rows[0].view(np.uint64), np.cumsum(new) - 1, radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[0][a]), pa.array(rows[0][b])], names=["a", "b"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([x, y.to_numpy()]) for x, y in zip(held, batch.columns, strict=True)]
            if len(held[0]) < FOREST:
                continue
            # the last shard may go on in the next batch
            inner = np.flatnonzero((held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            cut = int(inner[-1]) + 1 if len(inner) else 0
            if cut:
                yield linked([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield linked(held)

    return dealt.repartition("path", "shard").sortWithinPartitions("path", "shard", "fp").mapInArrow(each, "a long, b long")


def near_duplicates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id): the least id of all documents that are linked, over any number of links."""
    prints = checkpointed(prints.select("doc_id", "fp"))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = checkpointed(links(shards(nodes, blocks=radius + 1), radius).distinct())
    release(prints.sparkSession)
    roots = components(found)
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(checkpointed(named.join(least, "root").select("fp", "component_id")), "fp")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document; fingerprint as 16 hexadecimal digits."""
    classes = near_duplicates(fingerprints(docs.select("doc_id", "text")))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
