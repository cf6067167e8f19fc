"""Mixing sources to target weights by systematic sampling.

Within a source, each document's expected number of copies is prefix-summed in a fixed order and shifted by
one offset of the source; a document is emitted once for each integer that its stretch of the sum crosses.
Sums are whole numbers of 2**-32 copies, so that neither order nor reruns change a boundary.

A source may hold a third of all rows: its documents are dealt into buckets (size class, salt), buckets'
totals are prefix-summed within the size class and size classes within the source, and each bucket continues from its
own start. Starts are decimals of 38 digits, of which only the fraction of a copy goes on to the documents, so no sum
overflows before a bucket holds 2^31 documents or a source 10^27.

Defined cases: a null source is a source of its own, last in order; a null or empty text has size 0 and
counts as a document; a null doc_id sorts first; repeated rows are taken on their own. A source of no words
takes nothing. A very long text is one document like others: its words are counted where it lies. Extra columns are
kept by ``mix`` unless their names are those of its own columns.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlake.llm.base import WORD, checkpointed

#: Weights of the sources by code point of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, and of a source's words.
MOST_COPIES = 3.0
UNIT = 1 << 32
WIDE = "decimal(38,0)"
#: Documents of a bucket, about.
BUCKET_ROWS = 100_000
SEED = 20240501
#: Sources whose table is broadcast; beyond it is joined like any other.
MOST_BROADCAST = 10_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words to take from each source: all words shared by weight, a source's share stopped at ``most`` times
    its size and the excess shared again by weight among the others until none is above."""
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    out: dict[str | None, float] = {}
    left, free = float(sum(size.values())), list(order)
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * size[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """Add __size, the number of words of the whole text, and __tie, which orders rows of one id."""
    return docs.withColumns({"__size": F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long"), "__tie": F.xxhash64(docs["text"])})


def _offset(source: str | None, seed: int) -> int:
    """The source's one random offset, in units."""
    return zlib.crc32(f"{seed}\x00{'' if source is None else 's' + source}".encode()) % UNIT


def fraction(before: Column, each: Column, offset: Column) -> Column:
    """Units of the last copy that is begun after ``before`` documents of ``each`` units; whole copies don't matter."""
    return ((before.cast(WIDE) * (each % UNIT) + offset) % F.lit(UNIT).cast(WIDE)).cast("long")


def with_copies(rows: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES, sizes: DataFrame | None = None) -> DataFrame:
    """Add __target, __source_size and __copies to rows that have doc_id, source, __size and __tie.

    sizes: the (source, doc_id, __size, __tie) of the same rows where those are cheaper to read than ``rows``. Totals
    of sources reach the driver: one row for each source.
    """
    spark = rows.sparkSession
    small = (rows if sizes is None else sizes).select("source", "doc_id", "__size", "__tie")
    per_source = small.groupBy("source").agg(F.sum("__size").alias("size"), F.count("*").alias("n")).collect()
    goal = targets([(r["source"], r["size"]) for r in per_source], weights, most)
    salts = max(1, -(-sum(r["n"] for r in per_source) // BUCKET_ROWS))
    plan = [(r["source"], r["size"], goal[r["source"]], round(goal[r["source"]] / r["size"] * UNIT) if r["size"] else 0, _offset(r["source"], seed)) for r in per_source]
    table = spark.createDataFrame(plan, "__name string, __source_size long, __target double, __each long, __offset long")

    def bucketed(df: DataFrame) -> DataFrame:
        level = F.floor(F.log2(F.col("__size") + 1) * 4).cast("int")
        return df.withColumns({"__level": level, "__salt": F.pmod(F.xxhash64("doc_id", "__size", "__tie"), F.lit(salts)).cast("int")})

    counts = bucketed(small).groupBy("source", "__level", "__salt").agg(F.count("*").alias("__n"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda n, over: F.coalesce(F.sum(n).over(over), F.lit(0)).cast(WIDE)
    levels = counts.groupBy("source", "__level").agg(F.sum("__n").alias("__n")).select(F.col("source").alias("__l_source"), F.col("__level").alias("__l_level"), sums("__n", earlier("source", "__level")).alias("__below"))
    starts = counts.withColumn("__before", sums("__n", earlier("source", "__level", "__salt")))
    starts = starts.join(levels, starts["source"].eqNullSafe(levels["__l_source"]) & (starts["__level"] == levels["__l_level"]))
    starts = starts.join(F.broadcast(table) if len(plan) <= MOST_BROADCAST else table, starts["source"].eqNullSafe(table["__name"]))
    starts = starts.select(F.col("source").alias("__b_source"), F.col("__level").alias("__b_level"), F.col("__salt").alias("__b_salt"), fraction(F.col("__before") + F.col("__below"), F.col("__each"), F.col("__offset")).alias("__from"), "__each", "__source_size", "__target")
    placed = bucketed(rows)
    # one row for each document of a bucket: a stable order by size and id
    run = Window.partitionBy("source", "__level", "__salt").orderBy("__size", "doc_id", "__tie")
    placed = placed.withColumn("__rank", F.row_number().over(run).cast("long"))
    met = placed.join(starts, placed["source"].eqNullSafe(starts["__b_source"]) & (placed["__level"] == starts["__b_level"]) & (placed["__salt"] == starts["__b_salt"]))
    whole = lambda rank: F.shiftright(F.col("__from") + rank * (F.col("__each") % UNIT), 32)  # noqa: E731  the units hold 32 bits of a copy
    copies = F.shiftright("__each", 32) + whole(F.col("__rank")) - whole(F.col("__rank") - 1)
    return met.withColumn("__copies", copies).drop("__b_source", "__b_level", "__b_salt", "__from", "__each", "__rank", "__level", "__salt", "__tie")


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """What the mix takes of each document: (doc_id, size, source_size, target, taken, copies)."""
    sizes = checkpointed(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "__size", "__tie"))
    out = with_copies(sizes, seed)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents: each as often as it is taken, with the columns of ``docs``."""
    sizes = checkpointed(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "__size", "__tie"))
    out = with_copies(sized(docs), seed, sizes=sizes)
    return out.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
