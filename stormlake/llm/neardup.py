"""Near-duplicate detection by consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: a shingle of five words weighs (1 + ln count) (1 + 0.25 ln((N+1)/(df+1)) / ln(N+1)),
where df counts distinct texts with the shingle and N all of them. Two texts are linked if their weighted Jaccard
similarity is 0.8 or more; classes are connected components of links. Steps:

1. Equal texts are one node; everything after works on distinct texts.
2. Exact document frequencies: texts are dealt to blocks, each block sends its distinct shingle hashes in packed
   runs to hash buckets, buckets add up and send back to each block the shingles that occur in two texts or more.
3. A text whose shared shingles (df of two or more) weigh under 0.8 of it can't be linked and is done. The others
   get improved consistent weighted samples (Ioffe's ICWS), 15 bands of 4, and keep their weighted sets.
4. A band bucket's hub is its least member. Each text is verified against the hub it shares most bands with, so n
   texts make n pairs at most. Links give components; then members of one bucket that are still in different
   components are compared exactly where they lie, in blocks of a bucket's members, and only links leave the task.
5. Components by large-star and small-star rounds on tables; class ids go back to all copies.

Nothing is capped: very common shingles, buckets and copies cost one row for each task or member. A link of
similarity 0.8 shares a band with probability 0.9996, one of 0.85 with 0.99998.

Defined cases: null texts count as empty; a text of one to four words is one shingle; texts without words are
alike only if equal; null ids are a value of their own and order first; repeated rows are copies of one another,
and of rows that are equal in id and text ``keep_one`` keeps one; texts of equal 64-bit hash count as equal; a very long
text is one weighted set like others, in memory in proportion to its length.
Extra columns pass through unless they begin with ``__d_``.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlake.llm.base import checkpointed, release, trim_memory
from stormlake.llm.bytesof import chunks, mix, shingles, space_table, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
IDF_SPREAD = 0.25
BANDS, ROWS = 15, 4
SAMPLES = BANDS * ROWS
#: Characters of a block and of what a bucket counts; members of a verified group and of a compared part.
BLOCK_CHARS, BUCKET_CHARS, GROUP, COMPARED = 4_000_000, 8_000_000, 64, 1024
#: Shingles whose samples are drawn at once, about.
DRAWN = 200_000
#: Copies of one text beyond this share of all rows are dropped before texts are dealt out; such texts are fewer than 10,000.
HOT_SHARE = 1e-4
_U = np.uint64


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), by bisection."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    lo, hi = np.zeros_like(u), np.full_like(u, 64.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        r = _gamma_quantiles(16)
        _TABLES.extend([np.log(_gamma_quantiles(18)).astype(np.float32), r.astype(np.float32), (1 / r).astype(np.float32)])
    return _TABLES


def samples(element: np.ndarray, weight: np.ndarray, starts: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """(sets, count) uint32: for each set and each k a hash of the sampled (element, level).

    Sets are consecutive, begin at ``starts`` and aren't empty. For sample k an element has r, c ~ Gamma(2, 1) and
    beta ~ U(0, 1), all from a hash of (element, k); with t = floor(ln w / r + beta) and y = exp(r (t - beta)) the
    element of least c / (y exp(r)) is taken together with t.
    """
    log_c, r_of, inverse_r = _tables()
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(starts), count), np.uint32)
    for k in range(count):
        x = mix(element + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (x >> _U(18)).astype(np.uint16)
        r = r_of[place]
        beta = (x >> _U(34)).astype(np.uint16).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_w * inverse_r[place] + beta)
        value = log_c[(x & _U(0x3FFFF)).astype(np.int32)] - r * (t - beta + np.float32(1))
        bits = value.view(np.int32)
        order = np.where(bits < 0, ~bits, bits | np.int32(-(1 << 31))).view(np.uint32)
        name = (x >> _U(32)).astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B))
        least = np.minimum.reduceat((order.astype(np.uint64) << _U(32)) | name, starts)
        out[:, k] = least.astype(np.uint32)
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """(sets, bands) int64."""
    parts = sampled.reshape(len(sampled), -1, ROWS).astype(np.uint64)
    key = np.arange(parts.shape[1], dtype=np.uint64)[None, :] + _U(1)
    for i in range(ROWS):
        key = mix(key * _U(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - common
    return common / total if total else 1.0


def _sets(table: pa.Table, size: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(nodes, their (sorted distinct shingle hashes, counts)) of a block's distinct texts."""
    node, first = np.unique(table.column("node").to_numpy(), return_index=True)
    text = table.column("text").take(pa.array(first))
    out = []
    for lo, hi, data, offsets in chunks(text):
        doc, value = shingles(words(data, offsets, space_table()), size)
        cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [np.unique(value[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return node, out


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    shape = [x.split(" ", 1) for x in schema.split(", ")]
    return pa.table({k: pa.array(columns[k], kinds[t]) for k, t in shape})


class _Packing:
    """Shingle hashes cut to ``high`` + 32 bits; a bucket is a range of high parts. A run keeps the low 32 bits of its
    sorted hashes and how many fall on each high part."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.high = max(16, (buckets - 1).bit_length() + 6)
        self.shift = _U(64 - self.high - 32)
        edges = [-(-b * (1 << self.high) // buckets) for b in range(buckets + 1)]
        self.edges = np.array(edges, np.uint64)

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> self.shift

    def runs(self, short: np.ndarray):
        """(bucket, start, end) of sorted cut hashes."""
        at = np.searchsorted(short, self.edges[:-1] << _U(32))
        ends = np.append(at[1:], len(short))
        return [(b, int(i), int(j)) for b, (i, j) in enumerate(zip(at, ends, strict=True)) if j > i]

    def pack(self, bucket: int, short: np.ndarray) -> tuple[bytes, bytes]:
        base, width = int(self.edges[bucket]), int(self.edges[bucket + 1] - self.edges[bucket])
        counts = np.bincount((short >> _U(32)).astype(np.int64) - base, minlength=width)
        return short.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes()

    def unpack(self, bucket: int, low: bytes, counts: bytes) -> np.ndarray:
        n = np.frombuffer(counts, np.uint32)
        top = np.repeat(np.arange(len(n), dtype=np.uint64) + self.edges[bucket], n)
        return (top << _U(32)) | np.frombuffer(low, np.uint32)


PACKED = "bucket int, block int, low binary, counts binary, at binary, df binary"
REPEATED = "block int, hashes binary, df binary"
ELIGIBLE = "node long, bands array<long>, hashes binary, weights binary"


def eligible_sets(texts: DataFrame, chars: int, nodes: int, size: int = SHINGLE_WORDS) -> DataFrame:
    """From (node, text) the sets and samples of texts that may have a link. chars: of all texts; nodes: distinct texts."""
    blocks, packing = max(12, -(-chars // BLOCK_CHARS)), _Packing(max(12, -(-chars // BUCKET_CHARS)))
    dealt = texts.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "node", "text")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        trim_memory()
        _, sets = _sets(table, size)
        short, df = np.unique(packing.cut(np.concatenate([x[0] for x in sets] or [np.zeros(0, np.uint64)])), return_counts=True)
        out: dict[str, list] = {x.split()[0]: [] for x in PACKED.split(", ")}
        for bucket, i, j in packing.runs(short):
            low, counts = packing.pack(bucket, short[i:j])
            at = np.flatnonzero(df[i:j] > 1)
            for k, v in zip(out, (bucket, key[0].as_py(), low, counts, at.astype(np.uint32).tobytes(), df[i:j][at].astype(np.uint32).tobytes()), strict=True):
                out[k].append(v)
        return _table(PACKED, **out)

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        trim_memory()
        runs, counts = [], []
        for low, n, at, df in zip(*(table.column(c).to_pylist() for c in ("low", "counts", "at", "df")), strict=True):
            run = packing.unpack(key[0].as_py(), low, n)
            count = np.ones(len(run), np.uint32)
            count[np.frombuffer(at, np.uint32)] = np.frombuffer(df, np.uint32)
            runs.append(run)
            counts.append(count)
        every = np.concatenate(runs)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=np.concatenate(counts)[order]).astype(np.uint32)
        df = np.empty(len(every), np.uint32)
        df[order] = total[group]
        out: dict[str, list] = {"block": table.column("block").to_pylist(), "hashes": [], "df": []}
        start = 0
        for run in runs:
            own = df[start : start + len(run)]
            often = own > 1
            out["hashes"].append(run[often].tobytes())
            out["df"].append(own[often].tobytes())
            start += len(run)
        return _table(REPEATED, **out)

    scale = IDF_SPREAD / np.log(nodes + 1) if nodes else 0.0

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        trim_memory()
        out: dict[str, list] = {x.split()[0]: [] for x in ELIGIBLE.split(", ")}
        if left.num_rows:
            node, sets = _sets(left, size)
            known = np.concatenate([np.frombuffer(x, np.uint64) for x in right.column("hashes").to_pylist()] or [np.zeros(0, np.uint64)])
            df = np.concatenate([np.frombuffer(x, np.uint32) for x in right.column("df").to_pylist()] or [np.zeros(0, np.uint32)])
            order = np.argsort(known)
            known, df = known[order], df[order]
            idf = (1 + scale * np.log((nodes + 1) / (df + 1.0))).astype(np.float32)
            alone = np.float32(1 + scale * np.log((nodes + 1) / 2.0))
            chosen: list[tuple[int, np.ndarray, np.ndarray]] = []
            for n, (hashes, tf) in zip(node, sets, strict=True):
                if not len(hashes) or not len(known):
                    continue
                short = packing.cut(hashes)
                place = np.minimum(np.searchsorted(known, short), len(known) - 1)
                shared = known[place] == short
                weight = (1 + np.log(tf)).astype(np.float32) * np.where(shared, idf[place], alone)
                if weight[shared].sum(dtype=np.float64) >= SIMILARITY * weight.sum(dtype=np.float64) * (1 - 1e-6):
                    chosen.append((int(n), hashes, weight))
            # so many sets at once that their samples take some 20 MB
            turn = np.cumsum([len(x[1]) for x in chosen]) // DRAWN
            cuts = [*np.flatnonzero(np.diff(turn, prepend=-1)).tolist(), len(chosen)]
            for lo, hi in pairwise(cuts):
                some = chosen[lo:hi]
                lengths = np.array([len(x[1]) for x in some])
                drawn = samples(np.concatenate([x[1] for x in some]), np.concatenate([x[2] for x in some]), np.cumsum(lengths) - lengths)
                out["node"] += [x[0] for x in some]
                out["bands"] += list(band_keys(drawn))
                out["hashes"] += [x[1].tobytes() for x in some]
                out["weights"] += [x[2].tobytes() for x in some]
        return _table(ELIGIBLE, **out)

    repeated = dealt.groupBy("block").applyInArrow(pack, PACKED).groupBy("bucket").applyInArrow(add_up, REPEATED)
    return dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(weigh, ELIGIBLE)


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those pairs (a, b), each once, whose sets are similar enough. A common ``a`` is dealt over groups of 64 partners."""
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    salted = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    packed = sets.select("node", "hashes", "weights")
    named = lambda n: packed.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_hashes"), F.col("weights").alias(f"{n}_weights"))
    members = salted.join(named("b"), "b")
    hubs = salted.select(F.col("a").alias("hub"), F.col("salt").alias("part")).distinct().join(named("hub"), "hub")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        trim_memory()
        out: dict[str, list] = {"a": [], "b": []}
        if left.num_rows and right.num_rows:
            unpack = lambda t, n, i: (np.frombuffer(t.column(f"{n}_hashes")[i].as_py(), np.uint64), np.frombuffer(t.column(f"{n}_weights")[i].as_py(), np.float32))
            hub, name = unpack(left, "hub", 0), left.column("hub")[0].as_py()
            for i, b in enumerate(right.column("b").to_pylist()):
                if similarity(hub, unpack(right, "b", i)) >= least:
                    out["a"].append(name)
                    out["b"].append(b)
        return _table("a long, b long", **out)

    return hubs.groupBy("hub", "part").cogroup(members.groupBy("a", "salt")).applyInArrow(each, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), root the least of its component: rounds of large-star and small-star."""
    now = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    while True:
        # large-star: a node's larger neighbours go to its least neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = now.join(least.withColumnRenamed("u", "a"), "a").select(F.col("m").alias("a"), "b").distinct()
        # small-star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("v")).filter("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        now = checkpointed(small)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def apart(bands: DataFrame, roots: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components; of several links between the same
    two components a task gives one, as it joins them at once.

    A bucket's members outside its largest component are compared with all others; those inside aren't compared with each other.
    So a large bucket is dealt into parts by the largest component's members, and only the rest is copied to each.
    """
    rows = bands.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("largest")).filter("roots > 1")
    mixed = mixed.select("key", "largest", F.ceil(F.col("n") / COMPARED).cast("int").alias("parts"))
    rows = rows.join(mixed, "key").withColumns({"own": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "rest": F.col("root") != F.col("largest")})
    rows = rows.withColumn("part", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    rows = rows.select("key", "part", "own", "rest", "node", "root").join(sets.select("node", "hashes", "weights"), "node")

    def each(table: pa.Table) -> pa.Table:
        trim_memory()
        out: dict[str, list] = {"a": [], "b": []}
        rest = table.column("rest").to_numpy(zero_copy_only=False)
        table = table.take(pa.array(np.lexsort((table.column("node").to_numpy(), ~rest))))
        node, root, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
        few, here = int(rest.sum()), table.column("part")[0].as_py()
        raw = table.column("hashes").to_pylist()
        starts = np.cumsum([0, *(len(x) // 8 for x in raw)])
        names, element = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        weight = np.frombuffer(b"".join(table.column("weights").to_pylist()), np.float32)
        total = np.add.reduceat(weight, starts[:-1], dtype=np.float64)
        mine = np.zeros(len(names), np.float32)
        label = root.copy()
        for x in range(min(few, len(node) - 1)):
            # two of the rest meet in the part of the first
            y = x + 1 if own[x] == here else few
            if y == len(node):
                continue
            a, b = starts[x], starts[x + 1]
            fits = label[y:] != label[x]
            # a set of other weight can't be similar enough
            fits &= np.minimum(total[y:], total[x]) >= least * (1 - 1e-6) * np.maximum(total[y:], total[x])
            if not fits.any():
                continue
            mine[element[a:b]] = weight[a:b]
            common = np.add.reduceat(np.minimum(mine[element[starts[y] :]], weight[starts[y] :]), starts[y:-1] - starts[y], dtype=np.float64)
            mine[element[a:b]] = 0
            near = np.flatnonzero(fits & (common >= least * (total[x] + total[y:] - common))) + y
            _, once = np.unique(label[near], return_index=True)
            out["a"] += [int(node[x])] * len(once)
            out["b"] += node[near[once]].tolist()
            label[np.isin(label, label[near])] = label[x]
        return _table("a long, b long", **out)

    return rows.groupBy("key", "part").applyInArrow(each, "a long, b long").distinct()


def _with_node(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__d_node", F.xxhash64(F.coalesce(docs["text"], F.lit(""))))


def _copies(docs: DataFrame) -> DataFrame:
    """(node, first, n, chars): each distinct text, its least id, copies and length."""
    rows = _with_node(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("id")))["id"]
    return checkpointed(rows.groupBy(F.col("__d_node").alias("node")).agg(first.alias("first"), F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("chars")))


def node_classes(docs: DataFrame) -> DataFrame:
    """(node, class_id, class_size): class_id is the least doc_id of the class, class_size counts documents."""
    copies = _copies(docs)
    rows, chars, nodes = copies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0)), F.count("*")).first()
    hot = copies.filter(F.col("n") > max(8, int(rows * HOT_SHARE))).select(F.col("node").alias("__d_hot"), F.col("first").alias("__d_first"))
    texts = _with_node(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    # at most 1 / HOT_SHARE rows
    texts = texts.join(F.broadcast(hot), F.col("__d_node") == F.col("__d_hot"), "left").filter(F.col("__d_hot").isNull() | F.col("doc_id").eqNullSafe(F.col("__d_first")))
    sets = checkpointed(eligible_sets(texts.select(F.col("__d_node").alias("node"), "text"), chars, nodes))
    release(docs.sparkSession)
    bands = sets.select("node", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = bands.join(hubs, "key").filter("node > a").groupBy("node", "a").agg(F.count("*").alias("n"))
    stars = shared.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("n", (-F.col("a")).alias("a")))["a"].alias("a")).select((-F.col("a")).alias("a"), "b")
    links = checkpointed(verified(stars, sets))
    release(docs.sparkSession)
    roots = components(links)
    more = checkpointed(apart(bands, roots, sets))
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    named = copies.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("first").isNotNull().alias("k"), F.col("first").alias("id")))["id"]
    total = named.groupBy("root").agg(first.alias("class_id"), F.sum("n").alias("class_size"))
    return named.join(total, "root").select("node", "class_id", "class_size", "first")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, is_first) of each document."""
    classes = checkpointed(node_classes(docs))
    rows = _with_node(docs.select("doc_id", "text")).select("doc_id", F.col("__d_node").alias("node"))
    return rows.join(classes, "node").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_first"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each class, with the columns of ``docs``."""
    classes = checkpointed(node_classes(docs)).filter(F.col("first").eqNullSafe(F.col("class_id"))).select(F.col("node").alias("__d_kept"), F.col("class_id").alias("__d_class"))
    # ids that stand for a class twice: equal rows, or null ids
    ids = _with_node(docs.select("doc_id", "text")).select("doc_id", "__d_node")
    twice = ids.join(classes, (ids["__d_node"] == F.col("__d_kept")) & ids["doc_id"].eqNullSafe(F.col("__d_class"))).groupBy("__d_class").agg(F.count("*").alias("n")).filter("n > 1")
    twice = checkpointed(twice.select(F.col("__d_class").alias("__d_twice"), F.lit(True).alias("__d_again")))
    rows = _with_node(docs)
    rows = rows.join(classes, (rows["__d_node"] == F.col("__d_kept")) & rows["doc_id"].eqNullSafe(F.col("__d_class")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    if not twice.limit(1).count():
        return rows.select(*own)
    rows = rows.join(twice, F.col("__d_class").eqNullSafe(F.col("__d_twice")), "left")
    again = rows.filter("__d_again").withColumn("__d_rank", F.row_number().over(Window.partitionBy("__d_class").orderBy(F.xxhash64(*own)))).filter("__d_rank = 1")
    return rows.filter("__d_again IS NULL").select(*own).unionByName(again.select(*own))
