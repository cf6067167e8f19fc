"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is the logistic of a bias and the weights of its words and of their first 4, 5 and 6
bytes, which stand for stems; a document's is the noisy-or
of its sentences, 1 - prod(1 - p). Weights are fitted to document labels alone by gradient ascent on that
likelihood, and the fitted sentence scores then locate the offending sentences.

Training reads a bounded sample of labelled documents: of each label the LABELLED_PER_CLASS ids of least hash among those
with texts of up to LONGEST_LABELLED characters, one row for each id. Scoring reads every whole text. Words are runs of ASCII
letters, digits and non-ASCII bytes, A-Z taken as a-z; sentences end at ``.``, ``!``, ``?`` and line ends.

Defined cases: null texts count as empty; a text without words scores 0; null labels are no labels, of
several labels of one document the highest counts; without labelled documents of both kinds every score is
0; repeated rows are scored each; a very long text is scored whole, in memory in proportion to its length; only doc_id, text and (of labels) doc_id, toxic are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlake.llm.bytesof import Words, chunks, letter_table, mix, words

LABELLED_PER_CLASS = 2000
LONGEST_LABELLED = 20_000
#: A word needs so many labelled documents and such a z score of its rates to get a weight.
LEAST_DOCS, LEAST_Z = 4, 4.0
PREDICT_FROM = 0.7
ROUNDS, STEP, SHRINK = 400, 0.1, 1e-5
PREFIXES = (4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class Model(NamedTuple):
    """Sorted hashes of words, their weights, and the bias of a sentence."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def sentences(data: np.ndarray, found: Words) -> np.ndarray:
    """For each word the running number of its sentence; texts don't share sentences."""
    ends = np.cumsum(_ENDS[data])
    mark = ends[found.starts] if len(found.starts) else np.zeros(0, np.int64)
    new = np.ones(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (found.doc[1:] != found.doc[:-1])
    return np.cumsum(new) - 1


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def select_words(doc: np.ndarray, word: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of words whose document rates differ between the labels. doc, word: of each occurrence."""
    _, once = np.unique(mix(word) + doc.astype(np.uint64), return_index=True)
    names, place = np.unique(word[once], return_inverse=True)
    bad = toxic[doc[once]]
    n = np.bincount(place, minlength=len(names)).astype(float)
    k = np.bincount(place, weights=bad, minlength=len(names))
    share = toxic.mean()
    z = np.abs(k - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-12))
    return names[(n >= LEAST_DOCS) & (z >= LEAST_Z)]


def fit(doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, n_sentences: np.ndarray, toxic: np.ndarray) -> Model:
    """Fit weights by gradient ascent (Adam) on the noisy-or likelihood.

    doc, sentence, word: of each word occurrence; n_sentences, toxic: of each document.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    names = select_words(doc, word, toxic)
    place = np.searchsorted(names, word)
    known = np.zeros(len(word), bool)
    if len(names):
        known = names[np.minimum(place, len(names) - 1)] == word
    feature, kept_sentence, kept_doc = place[known], sentence[known], doc[known]
    _, row = np.unique(kept_sentence, return_inverse=True)
    rows = int(row.max()) + 1 if len(row) else 0
    of = np.zeros(rows, np.int64)
    of[row] = kept_doc
    plain = n_sentences - np.bincount(of, minlength=len(toxic))
    theta = np.zeros(len(names) + 1)
    theta[-1] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        z = theta[-1] + np.bincount(row, weights=theta[feature], minlength=rows)
        none = np.bincount(of, weights=_softplus(z), minlength=len(toxic)) + plain * _softplus(theta[-1])
        with np.errstate(over="ignore"):
            pull = np.where(toxic > 0, 1 / np.maximum(np.expm1(np.minimum(none, 500)), 1e-9), -1.0)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        grad_row = p * pull[of]
        grad = np.append(np.bincount(feature, weights=grad_row[row], minlength=len(names)), grad_row.sum() + p0 * (plain * pull).sum()) / len(toxic)
        grad[:-1] -= SHRINK * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta += STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(names, theta[:-1], float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Fit from (doc_id, text) and (doc_id, toxic). usable: which labels may be learned from."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        marked = marked.filter(usable)
    # only ids with a text that is read can be drawn
    there = docs.filter(F.length(F.coalesce("text", F.lit(""))) <= LONGEST_LABELLED).select("doc_id")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(there, "doc_id", "left_semi").withColumn("draw", F.xxhash64("doc_id"))
    sample = marked.filter("toxic = 1").orderBy("draw", "doc_id").limit(LABELLED_PER_CLASS).unionByName(marked.filter("toxic = 0").orderBy("draw", "doc_id").limit(LABELLED_PER_CLASS))
    ids = {r["doc_id"]: r["toxic"] for r in sample.select("doc_id", "toxic").collect()}
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isin(list(ids)) & (F.length("text") <= LONGEST_LABELLED))
    # rows of one id: the text of least hash
    chosen = chosen.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    if not ids:
        return fit(*[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    shape = "doc_id long, n_sentences long, sentence array<int>, word array<long>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                found = words(data, offsets, table, PREFIXES)
                number = sentences(data, found)
                cuts = np.searchsorted(found.doc, np.arange(hi - lo + 1))
                out = {x: [] for x in ("n", "s", "w")}
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own = number[a:b] - (number[a] if b > a else 0)
                    out["n"].append(int(own[-1]) + 1 if b > a else 0)
                    every = np.concatenate([x[a:b] for x in (found.hash, *found.prefixes)])
                    there = every != 0
                    out["s"].append(np.tile(own, 1 + len(PREFIXES))[there].astype(np.int32))
                    out["w"].append(every[there].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out["n"], pa.int64()), pa.array(out["s"], pa.list_(pa.int32())), pa.array(out["w"], pa.list_(pa.int64()))], names=["doc_id", "n_sentences", "sentence", "word"])

    got = chosen.mapInArrow(each, shape).toArrow().combine_chunks()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    got = got.take(pa.array(order))
    toxic = np.array([ids[i] for i in got.column("doc_id").to_pylist()], float)
    count = got.column("n_sentences").to_numpy().astype(np.int64)
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in got.column(c).chunks] or [np.zeros(0, np.int64)])
    lengths = np.array([len(x) for x in got.column("word")], np.int64)
    doc = np.repeat(np.arange(len(toxic)), lengths)
    starts = np.cumsum(count) - count
    return fit(doc, flat("sentence").astype(np.int64) + starts[doc], flat("word").view(np.uint64), count, toxic)


SCORED = "score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, show_from: float = 0.5) -> DataFrame:
    """(doc_id, score, n_sentences, offending): offending holds code point spans and scores of sentences from ``show_from``."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                n = hi - lo
                found = words(data, offsets, table, PREFIXES)
                number = sentences(data, found)
                total = int(number[-1]) + 1 if len(number) else 0
                first = np.flatnonzero(np.diff(number, prepend=-1))
                of = found.doc[first]
                count = np.bincount(of, minlength=n)
                z = np.full(total, model.bias)
                if len(model.hashes) and total:
                    for names in (found.hash, *found.prefixes):
                        place = np.minimum(np.searchsorted(model.hashes, names), len(model.hashes) - 1)
                        known = np.flatnonzero(model.hashes[place] == names)
                        z += np.bincount(number[known], weights=model.weights[place[known]], minlength=total)
                none = np.bincount(of, weights=_softplus(z), minlength=n)
                bad = np.flatnonzero(z >= np.log(show_from / (1 - show_from)))
                marks: list[list[dict]] = [[] for _ in range(n)]
                if len(bad):
                    last = np.append(first[1:], len(number)) - 1
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for s in bad:
                        base = points[offsets[of[s]]]
                        marks[of[s]].append({"start": int(points[found.starts[first[s]]] - base), "end": int(points[found.ends[last[s]]] - base), "score": float(1 / (1 + np.exp(-z[s])))})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(-np.expm1(-none), pa.float64()), pa.array(count, pa.int64()), pa.array(marks, spans)], names=["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, f"doc_id long, {SCORED}")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that sees no held-out label (crc32 of the id modulo 3 is 1)."""
    held = lambda c: F.crc32(F.col(c).cast("string")) % 3 == 1
    model = train(docs, labels.select("doc_id", "toxic"), ~held("doc_id"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending"))
