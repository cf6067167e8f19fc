"""Quality rules under weak supervision, in DataFrame expressions only.

Thirteen rules look at a text and vote good (1), bad (-1) or abstain (0). They watch four faults, three or four rules each:
noise, repetition, shouting, fragments. Faults are taken to be independent; for each, expectation-maximisation over the
counts of its rules' vote patterns (3^4 at most, so the driver holds a bounded table) estimates, without labels, how many
documents have it and each rule's rates of votes on documents with and without it, which are its accuracies. A rule that
votes good on nearly everything has nearly equal rates and so little weight; a bad vote counts for much if the other rules
of its fault tend to agree with it, and can be outvoted by them. A document's quality is the posterior probability that it has
no fault, and it is kept if that reaches a threshold.

The prior weighs a fixed share of the documents, so estimates depend on the shares of patterns alone and not on how many
documents there are. Bounds are those of published filters for web text where there are such (words a document, mean word
length, symbols and letters a word, line ends, short lines, repeated lines), else round numbers.

Defined cases: a null text has no words; a text of under 20 words, or with over 30 % of its words in repeated
8-word windows, fails the base and is never kept; a very long text is split in memory of one task, in proportion to its
length; repeated rows are judged each and count each; no rows give
no patterns and the prior rates. Columns of the documents keep their names and values; the operator's own
columns begin with ``__q_`` until the caller selects them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlake.llm.base import SEPARATORS, checkpointed, stored

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT_PERCENT = 30
KEEP_FROM = 0.5
#: What EM starts from: the share of a fault, and rates of bad votes, abstentions and good votes without and with it; and
#: the share of all documents that these count for.
PRIOR_SHARE, PRIOR_RATES, PRIOR_WEIGHT = 0.05, ((0.02, 0.08, 0.9), (0.6, 0.25, 0.15)), 0.02
SYMBOLS = "[#*$%&|<>]"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words() -> Column:
    """Words that lie in an 8-word window which the text has twice or more: window hashes are sorted with their
    places, a place with an equal neighbour is marked, and the union of the marked windows is measured."""
    return F.expr(f"""
        CASE WHEN NOT __q_again THEN 0L ELSE
        aggregate(
          array_sort(filter(
            transform(__q_sorted, (x, i) -> CASE
              WHEN (i > 0 AND __q_sorted[i - 1].h = x.h) OR (i + 1 < size(__q_sorted) AND __q_sorted[i + 1].h = x.h) THEN x.p END),
            p -> p IS NOT NULL)),
          named_struct('n', 0L, 'last', -{WINDOW}),
          (b, p) -> named_struct('n', b.n + least({WINDOW}, p - b.last), 'last', p), b -> b.n)
        END""")


def with_features(docs: DataFrame) -> DataFrame:
    """Add __q_ columns: the five counts of the base and those that only rules read."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.withColumn("__q_text", text)
    rows = rows.withColumn("__q_words", F.array_remove(F.split("__q_text", SEPARATORS), ""))
    rows = rows.withColumn("__q_lines", F.filter(F.split("__q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("__q_hashes", F.transform("__q_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__q_windows", F.expr(f"CASE WHEN size(__q_hashes) >= {WINDOW} THEN transform(sequence(1, size(__q_hashes) - {WINDOW - 1}), i -> xxhash64(slice(__q_hashes, i, {WINDOW}))) ELSE cast(array() as array<bigint>) END"))
    rows = rows.withColumn("__q_again", F.size(F.array_distinct("__q_windows")) < F.size("__q_windows"))
    rows = rows.withColumn("__q_sorted", F.expr("CASE WHEN __q_again THEN array_sort(transform(__q_windows, (h, p) -> struct(h, p))) END"))
    sep = r"\x20\x09-\x0D"
    count = lambda pattern: F.regexp_count("__q_text", F.lit(pattern)).cast("long")
    rows = rows.withColumns({
        "__q_n_words": F.size("__q_words").cast("long"),
        "__q_word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
        "__q_n_symbols": count(SYMBOLS),
        "__q_n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "__q_n_repeat_words": _repeat_words().cast("long"),
        "__q_n_lines": F.size("__q_lines").cast("long"),
        "__q_n_distinct": F.size(F.array_distinct("__q_hashes")).cast("long"),
        "__q_n_upper": count(r"\p{Lu}"),
        "__q_n_ended": F.size(F.filter("__q_lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", '"', ":", ";", ")"))).cast("long"),
        "__q_n_short": F.size(F.filter("__q_lines", lambda x: F.length(x) < SHORT_LINE)).cast("long"),
        "__q_n_bare": count(rf"(?<![^{sep}])[^\p{{L}}{sep}]+(?![^{sep}])"),
        "__q_n_marks": F.length(F.regexp_replace("__q_text", rf"[\p{{L}}{sep}]+", "")).cast("long"),
        "__q_n_shouted": count(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})"),
        "__q_n_cries": count("!"),
    })
    return rows.drop("__q_text", "__q_words", "__q_lines", "__q_hashes", "__q_windows", "__q_again", "__q_sorted")


#: Characters up to which a line is short.
SHORT_LINE = 30


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")


def votes() -> dict[str, dict[str, Column]]:
    """For each fault each rule's vote from the __q_ columns."""
    words, lines, chars = (F.nullif(F.col(f"__q_{c}"), F.lit(0)) for c in ("n_words", "n_lines", "word_chars"))
    per_word = {c: F.col(f"__q_{c}") / words for c in ("word_chars", "n_symbols", "n_repeat_words", "n_distinct", "n_bare", "n_shouted", "n_cries")}
    per_line = {c: F.col(f"__q_{c}") / lines for c in ("n_dup_lines", "n_ended", "n_short")}
    per_char = {c: F.col(f"__q_{c}") / chars for c in ("n_upper", "n_marks")}
    high = lambda x, good, bad: _vote(x, x <= good, x > bad)  # noqa: E731  bad where it is high
    low = lambda x, good, bad: _vote(x, x >= good, x < bad)
    return {
        "noise": {"symbols": high(per_word["n_symbols"], 0.02, 0.1), "bare_words": high(per_word["n_bare"], 0.1, 0.2), "marks": high(per_char["n_marks"], 0.1, 0.25)},
        "repetition": {"repeated_lines": high(per_line["n_dup_lines"], 0.0, 0.3), "repeated_words": high(per_word["n_repeat_words"], 0.05, MOST_REPEAT_PERCENT / 100), "distinct_words": low(per_word["n_distinct"], 0.4, 0.2)},
        "shouting": {"upper_case": high(per_char["n_upper"], 0.1, 0.3), "shouted_words": high(per_word["n_shouted"], 0.1, 0.3), "cries": high(per_word["n_cries"], 0.02, 0.1)},
        "fragments": {
            "length": low(words, 100, 50), "line_ends": low(per_line["n_ended"], 0.5, 0.12), "short_lines": high(per_line["n_short"], 0.3, 0.67),
            "word_length": _vote(per_word["word_chars"], per_word["word_chars"].between(3.5, 9), ~per_word["word_chars"].between(3, 10)),
        },
    }


#: For documents without and with a fault, for each of its rules: rates of a bad vote, an abstention, a good vote.
Rates = list[list[tuple[float, ...]]]


def estimate(patterns: dict[tuple[int, ...], int], rules: int = 0, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, Rates]:
    """(share of documents with the fault, rates) from the number of documents of each pattern of its rules' votes."""
    m = rules or len(next(iter(patterns), ()))
    total = sum(patterns.values())
    share, rates = PRIOR_SHARE, [[r] * m for r in PRIOR_RATES]
    pseudo = PRIOR_WEIGHT * total
    for _ in range(rounds if total else 0):
        held = [(p, n, fault(p, share, rates)) for p, n in patterns.items()]
        sizes = [sum(n * (1 - q) for _, n, q in held), sum(n * q for _, n, q in held)]
        rates = [
            [tuple((sum(n * (q if k else 1 - q) for p, n, q in held if p[j] == v) + PRIOR_RATES[k][v + 1] * pseudo) / (sizes[k] + pseudo) for v in (-1, 0, 1)) for j in range(m)] for k in range(2)
        ]
        new = (sizes[1] + PRIOR_SHARE * pseudo) / (total + pseudo)
        moved, share = abs(new - share), new
        if moved < tolerance:
            break
    return share, rates


def fault(pattern: tuple[int, ...], share: float, rates: Rates) -> float:
    """Posterior probability of a fault from its rules' votes."""
    odds = math.log(share / (1 - share)) + sum(math.log(rates[1][j][v + 1] / rates[0][j][v + 1]) for j, v in enumerate(pattern))
    return 1 / (1 + math.exp(-odds))


def fitted(rows: DataFrame) -> dict[str, tuple[float, Rates]]:
    """(share, rates) of each fault from rows with features."""
    rules = votes()
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fault"), F.array(*of.values()).alias("votes")) for f, of in rules.items()])).alias("p")
    counted = rows.select(each).groupBy("p.fault", "p.votes").count().collect()
    return {f: estimate({tuple(r["votes"]): r["count"] for r in counted if r["fault"] == f}, len(of)) for f, of in rules.items()}


def _judged(rows: DataFrame) -> DataFrame:
    """Add __q_quality, __q_base_failed and __q_kept to rows with features."""
    found, quality = fitted(rows), F.lit(1.0)
    for name, rules in votes().items():
        share, (without, having) = found[name]
        odds = F.lit(math.log(share / (1 - share)))
        for vote, a, b in zip(rules.values(), without, having, strict=True):
            bad, none, good = (F.lit(math.log(y / x)) for x, y in zip(a, b, strict=True))
            odds = odds + F.when(vote == 1, good).when(vote == -1, bad).otherwise(none)
        quality = quality / (1 + F.exp(odds))
    failed = (F.col("__q_n_words") < LEAST_WORDS) | (100 * F.col("__q_n_repeat_words") > MOST_REPEAT_PERCENT * F.col("__q_n_words"))
    rows = rows.withColumns({"__q_quality": quality, "__q_base_failed": failed})
    return rows.withColumn("__q_kept", ~F.col("__q_base_failed") & (F.col("__q_quality") >= KEEP_FROM))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, quality) of each document."""
    rows = _judged(checkpointed(with_features(docs.select("doc_id", "text")).drop("text")))
    return rows.select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in (*FEATURES, "base_failed", "kept", "quality")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    rows = _judged(stored(with_features(docs), "quality"))
    return rows.filter("__q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
