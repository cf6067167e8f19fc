"""SimHash near-duplicates against brute force: fingerprints, trees, shards, components, and small tables."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stormlake.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def brute_print(text):
    said = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(said[i : i + 3]) for i in range(max(1, len(said) - 2))] if said else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    """rows: (id, print); id of each row's component by flooding."""
    prints = sorted({p for _, p in rows})
    label = {p: p for p in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius and label[a] != label[b]:
            old, new = label[b], label[a]
            label = {p: new if x == old else x for p, x in label.items()}
    least = {}
    for i, p in rows:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return sorted((-1 if i is None else i, f"{p:016x}", least.get(label[p])) for i, p in rows)


def some_rows():
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdeRSTä", k=rng.randint(1, 6))) for _ in range(n))
    base = prose(400)
    texts = [None, "", " \t\n\x0b\f\r ", "one", "One  TWO", "one two", "a b c", base, base.upper(), base, base + " tail", "\x85x  y É", "word " * 300, prose(40_000), "x" * 300_000]
    texts += [" ".join(w if rng.random() > 0.005 else "changed" for w in base.split()) for _ in range(30)]
    texts += [prose(rng.randint(1, 60)) for _ in range(80)]
    return [(i, t) for i, t in enumerate(texts)] + [(7, base), (None, base), (None, "alone without an id"), (None, "alone without an id")]


def test_fingerprints_and_components(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SHAPE).repartition(5)
    clashing = docs.withColumns({c: F.lit(1) for c in ("fp", "fingerprint", "component_id", "node", "shard", "path", "root", "first", "a", "b")})
    want = brute_components([(i, brute_print(t)) for i, t in rows])
    for table in (docs, clashing):
        got = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in simhash.report(table).collect())
        assert got == want
    assert len({r[2] for r in want}) < len(want) - 10


def test_empty_table(spark):
    out = simhash.report(spark.createDataFrame([], SHAPE))
    assert out.collect() == [] and out.columns == ["doc_id", "fingerprint", "component_id"]


def near_values(rng, n, spread):
    """Values that differ from a few centres in some of ``spread`` places."""
    centres = [rng.getrandbits(64) for _ in range(4)]
    return sorted({rng.choice(centres) ^ sum(1 << rng.randrange(spread) for _ in range(rng.randint(0, 4))) for _ in range(n)})


@pytest.mark.parametrize(("spread", "walked"), [(64, 1 << 17), (10, 1 << 17), (12, 97)])
def test_forest_finds_all(monkeypatch, spread, walked):
    monkeypatch.setattr(simhash, "WALKED", walked)
    rng = random.Random(spread)
    values = np.array([x for _ in range(3) for x in near_values(rng, 150, spread)], np.uint64)
    group = np.sort(np.array([rng.randrange(5) for _ in values]))
    group = np.unique(group, return_inverse=True)[1]
    pairs = {(g, v) for g, v in zip(group.tolist(), values.tolist(), strict=True)}
    group, values = (np.array(x, t) for x, t in zip(zip(*sorted(pairs), strict=True), (np.int64, np.uint64), strict=True))
    forest = simhash.Forest(values, group)
    got = {(int(q), int(p)) for qs, ps in forest.near(values, group) for q, p in zip(qs, ps, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= 2}
    assert got == want
    assert sorted(forest.order.tolist()) == list(range(len(values)))


@pytest.mark.parametrize("most", [4096, 20])
def test_shards_lose_no_link(spark, most):
    rng = random.Random(most)
    values = sorted({*near_values(rng, 400, 64), *near_values(rng, 300, 12), *(rng.getrandbits(64) for _ in range(200)), 0, (1 << 64) - 1, 1 << 63})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    dealt = simhash.shards(nodes, most=most).collect()
    met = {}
    for r in dealt:
        met.setdefault((r["path"], r["shard"]), []).append(r["fp"] % (1 << 64))
    together = {frozenset(p) for members in met.values() for p in itertools.combinations(members, 2)}
    assert all(frozenset((a, b)) in together for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2)
    got = sorted((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect())
    assert got == brute_components(list(enumerate(values)))


def test_masks_bound_shards():
    masks = simhash.block_masks()
    assert [len(m) for m in masks] == [3, 9, 27, 81]
    assert all(64 - m.bit_count() <= 14 for m in masks[-1])
    for before, now in zip([[0], *masks], masks, strict=False):
        for k, m in enumerate(before):
            parts = [now[3 * k + i] & ~m for i in range(3)]
            assert parts[0] | parts[1] | parts[2] == ~m & (1 << 64) - 1 and sum(p.bit_count() for p in parts) == 64 - m.bit_count()
