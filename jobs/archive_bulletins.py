"""Archive text bulletins within a quota, equal texts once.

    python -m jobs.archive_bulletins --documents /data/documents.parquet --output /data/bulletins

Warnings, outlooks and discussions come as texts from many sources, over and over with the same words. Who keeps them beside the radar's
archive stores each text once and holds the whole within a quota, by the archive's own rule of pruning: the oldest go first, but
never a source's newest, nor one of the newest ``keep_newest`` ids.

Read: documents (doc_id, text, lang, source); ids are the order of arrival. Written, from the whole table, over what an earlier run wrote:

* ``archive/source=/lang=``: doc_id, text, bytes, sha256 of the texts that stay;
* ``manifest/outcome=``: doc_id, source, lang, bytes, sha256, first_id, n_rows, freed_before for every document: ``kept``, ``pruned`` (freed_before are the bytes
  that went before it), or ``copy`` of the text that first_id brought first.

The quota is a share of the bytes of all different texts. Defined cases: a null text is an empty one; null sources and languages are
values of their own (in the archive's paths an empty one is as a null one); rows that are equal in id, text, source and language are one document of ``n_rows``; of equal texts the
least id counts as first (by source, then language, nulls first, where ids are equal), a null id last; documents without an id are never pruned, as they have no age.
Texts are hashed once and never grouped: only names and sizes are shuffled, and the archive is written by a join on id and hash.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command
from stormlake.operators import scans
from stormlake.operators.sql import run

LOG = logging.getLogger("jobs.archive_bulletins")

MANIFEST = "doc_id bigint, source string, lang string, bytes bigint, sha256 string, first_id bigint, n_rows bigint, freed_before bigint, outcome string"
ARCHIVE = "doc_id bigint, text string, bytes bigint, sha256 string, source string, lang string"
#: Time that ids are taken apart for the pruning's day buckets, which so hold 1440 ids.
_APART_US = 60_000_000


@dataclass(frozen=True)
class Config:
    documents: str
    output: str
    quota_share: float = 0.75
    keep_newest: int = 100
    #: Bytes of texts that a file of the archive holds, about.
    file_bytes: int = 268_435_456


def named(documents: DataFrame) -> DataFrame:
    """Documents with the size and the hash of their texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", text.alias("text"))
    return rows.select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), "text")


def manifest_of(rows: DataFrame, quota_share: float, keep_newest: int) -> DataFrame:
    """What becomes of each document, from (doc_id, source, lang, bytes, sha256)."""
    each = rows.groupBy("doc_id", "source", "lang", "bytes", "sha256").agg(F.count("*").alias("n_rows"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNotNull(), F.col("source"), F.col("lang").isNotNull(), F.col("lang"))
    first = each.groupBy("sha256").agg(F.min_by(F.struct("doc_id", "source", "lang"), order).alias("f"))
    # a text with very many copies meets its first one by id and hash, which no two documents share
    firsts = first.select(F.col("f.doc_id").alias("fd"), F.col("f.source").alias("fs"), F.col("f.lang").alias("fl"), F.col("sha256").alias("fh"), F.lit(True).alias("is_first"))
    own = (F.col("sha256") == F.col("fh")) & F.col("doc_id").eqNullSafe(F.col("fd")) & F.col("source").eqNullSafe(F.col("fs")) & F.col("lang").eqNullSafe(F.col("fl"))
    marked = each.join(firsts, own, "left").drop("fd", "fs", "fl", "fh")
    total, newest = marked.filter("is_first").agg(F.sum("bytes"), F.max("doc_id")).first()
    budget, last = int((total or 0) * quota_share), -1 if newest is None else newest
    aged = marked.filter("is_first AND doc_id IS NOT NULL").select(F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit(""))).alias("site"), (F.col("doc_id") * _APART_US).alias("ts_us"), F.col("doc_id").alias("event_id"), F.col("bytes").alias("size"), "sha256")
    # texts without an id take part in the total only
    free = total - (aged.agg(F.sum("size")).first()[0] or 0) if total else 0
    gone = run(scans.quota_prune(budget - free, (last - keep_newest + 1) * _APART_US, last * _APART_US, also=("sha256",)), scans=aged)
    gone = gone.select(F.col("event_id").alias("gd"), F.col("sha256").alias("gh"), "freed_before")
    out = marked.join(gone, F.col("is_first") & (F.col("doc_id") == F.col("gd")) & (F.col("sha256") == F.col("gh")), "left")
    said = out.select("doc_id", "source", "lang", "bytes", "sha256", "n_rows", "freed_before", F.when(F.col("is_first").isNull(), "copy").when(F.col("freed_before").isNotNull(), "pruned").otherwise("kept").alias("outcome"))
    return said.join(first.select("sha256", F.col("f.doc_id").alias("first_id")), "sha256")


def archive(spark: SparkSession, config: Config) -> dict:
    """Store each text once within the quota; returns what was read and written."""
    rows = named(spark.read.parquet(config.documents))
    held = f"{config.output}/manifest"
    decided = manifest_of(rows.drop("text"), config.quota_share, config.keep_newest)
    decided.write.mode("overwrite").partitionBy("outcome").parquet(held)
    manifest = spark.read.schema(MANIFEST).parquet(held)
    said = {r["outcome"]: r.asDict() for r in manifest.groupBy("outcome").agg(F.count("*").alias("documents"), F.sum("n_rows").alias("rows"), F.sum("bytes").alias("bytes")).collect()}
    kept = manifest.filter("outcome = 'kept'").select(F.col("doc_id").alias("kd"), F.col("source").alias("ks"), F.col("lang").alias("kl"), F.col("sha256").alias("kh"))
    own = (F.col("sha256") == F.col("kh")) & F.col("doc_id").eqNullSafe(F.col("kd")) & F.col("source").eqNullSafe(F.col("ks")) & F.col("lang").eqNullSafe(F.col("kl"))
    texts = rows.join(kept, own, "left_semi")
    # a source of any size goes to as many tasks as its bytes ask for
    tasks = max(1, -(-int(said.get("kept", {}).get("bytes") or 0) // config.file_bytes))
    texts = texts.withColumn("task", F.pmod(F.xxhash64("doc_id", "sha256"), F.lit(tasks))).repartition("source", "lang", "task")
    # the manifest tells whether rows are repeated; if so, repeated ones now lie in one task
    if said.get("kept", {}).get("rows", 0) > said.get("kept", {}).get("documents", 0):
        texts = texts.dropDuplicates(["doc_id", "source", "lang", "sha256", "task"])
    texts = texts.drop("task")
    texts.write.mode("overwrite").partitionBy("source", "lang").parquet(f"{config.output}/archive")
    done = {"read": sum(x["rows"] for x in said.values()), **{k: said.get(k, {}).get("documents", 0) for k in ("kept", "pruned", "copy")}, "kept_bytes": said.get("kept", {}).get("bytes", 0)}
    LOG.info("%s: read %d rows; wrote %d texts of %d bytes; %d pruned, %d copies", config.documents, done["read"], done["kept"], done["kept_bytes"], done["pruned"], done["copy"])
    return done


def manifest(spark: SparkSession, output: str) -> DataFrame:
    """The manifest as it stands, with whether the archive holds the document's text."""
    held = spark.read.schema(ARCHIVE).parquet(f"{output}/archive").select(F.col("doc_id").alias("ad"), F.col("sha256").alias("ah"), F.lit(True).alias("stored")).dropDuplicates(["ad", "ah"])
    rows = spark.read.schema(MANIFEST).parquet(f"{output}/manifest")
    out = rows.join(held, F.col("doc_id").eqNullSafe(F.col("ad")) & (F.col("sha256") == F.col("ah")), "left")
    return out.select("doc_id", "source", "lang", "bytes", "sha256", "first_id", "n_rows", "freed_before", "outcome", F.coalesce("stored", F.lit(False)).alias("stored"))


ORACLE = """
WITH d AS (SELECT doc_id, source, lang, cast(strlen(coalesce(text, '')) AS bigint) AS bytes, sha256(coalesce(text, '')) AS sha256, count(*) AS n_rows FROM documents GROUP BY ALL),
m AS (SELECT *, first_value(doc_id) OVER w AS first_id, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY sha256 ORDER BY doc_id NULLS LAST, source NULLS FIRST, lang NULLS FIRST)),
firsts AS (SELECT *, max(doc_id) OVER (PARTITION BY source) AS newest, max(doc_id) OVER () AS last FROM m WHERE k = 1),
q AS (SELECT cast(floor(sum(bytes) * 75 / 100) AS bigint) AS quota, sum(bytes) AS total FROM firsts),
open AS (SELECT doc_id, sha256, sum(bytes) OVER (ORDER BY doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END, sha256 ROWS UNBOUNDED PRECEDING) - bytes AS before FROM firsts WHERE doc_id < newest AND doc_id <= last - 100),
gone AS (SELECT doc_id, sha256, cast(before AS bigint) AS freed_before FROM open, q WHERE total - before > quota)
SELECT m.doc_id, m.source, m.lang, m.bytes, m.sha256, m.first_id, m.n_rows, g.freed_before, CASE WHEN m.k > 1 THEN 'copy' WHEN g.doc_id IS NOT NULL THEN 'pruned' ELSE 'kept' END AS outcome, m.k = 1 AND g.doc_id IS NULL AS stored
FROM m LEFT JOIN gone g ON m.k = 1 AND g.doc_id = m.doc_id AND g.sha256 = m.sha256"""


if __name__ == "__main__":
    command(Config, archive, "archive_bulletins")
