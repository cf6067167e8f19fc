"""Token counts: an exact histogram of documents by encoded length.

Tasks encode texts and add up a histogram of their own batch; only (length, documents) pairs are shuffled.
Suffix sums over the histogram answer totals, quantiles and truncated totals for every context limit.

Defined cases: null and empty texts have length 0; repeated rows count each; a very long text is encoded alone, in memory
in proportion to its length; no rows give no lengths; only the text column is read, whatever other columns are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlake.llm.base import checkpointed
from stormlake.llm.vocabulary import encoding

#: Lengths of one bucket of the suffix sums.
BUCKET = 1024


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(length, n_docs) over all whole texts, by the tiktoken ranks at ``path``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        for batch in batches:
            held = Counter(len(coder.encode_ordinary(x.as_py() or "")) for x in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(held.values(), pa.int64())], names=["length", "n_docs"])

    return docs.select(docs[text]).mapInArrow(each, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, seen as a context limit:

    n_docs, n_tokens of that length; docs_from, tokens_from: at that length or longer; total_tokens of all;
    truncated_tokens: tokens kept if every document is cut to L; docs_share: share of documents up to L.
    The histogram is cut into buckets of 1024 lengths, so no task sees it whole; it is read twice and so checkpointed.
    """
    rows = checkpointed(histogram).withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "__b": F.floor(F.col("length") / BUCKET)})
    above = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = rows.groupBy("__b").agg(F.sum("n_docs").alias("__d"), F.sum("n_tokens").alias("__t"))
    buckets = buckets.select("__b", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("__d", "__t")], *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("__d", "__t")])
    within = Window.partitionBy("__b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(buckets, "__b").withColumns({"docs_from": F.sum("n_docs").over(within) + F.col("__d_above"), "tokens_from": F.sum("n_tokens").over(within) + F.col("__t_above")})
    longer = F.col("docs_from") - F.col("n_docs")
    return rows.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from", F.col("__t_all").alias("total_tokens"),
        (F.col("__t_all") - F.col("tokens_from") + F.col("n_tokens") + F.col("length") * longer).alias("truncated_tokens"),
        ((F.col("__d_all") - longer) / F.col("__d_all")).alias("docs_share"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits from suffix sums: (limit, docs_over, total_tokens, truncated_tokens).

    Documents over a limit are those from the next length on, and are cut to it; all others keep their tokens. Limits are a few:
    one pass finds the next length of each.
    """
    spark = sums.sparkSession
    if not limits:
        return spark.createDataFrame([], "limit long, docs_over long, total_tokens long, truncated_tokens long")
    beyond = [F.min(F.when(F.col("length") > x, F.struct("length", "docs_from", "tokens_from"))).alias(f"__l{i}") for i, x in enumerate(limits)]
    found = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"), *beyond)
    each = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("limit"), F.col(f"__l{i}").alias("next")) for i, x in enumerate(limits)])).alias("a")
    over, tokens = F.coalesce("a.next.docs_from", F.lit(0)), F.coalesce("a.next.tokens_from", F.lit(0))
    return found.select("total_tokens", each).select("a.limit", over.alias("docs_over"), "total_tokens", (F.col("total_tokens") - tokens + F.col("a.limit") * over).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least the given share of documents don't exceed: (share, length)."""
    rows = sums.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    return rows.filter(F.col("docs_share") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
