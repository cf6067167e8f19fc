"""Tilt selection over tables of sweeps (site, i, elev, gates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlake.functions.constants import TILT_MERGE_DEG


def _better(x: str, y: str) -> str:
    return f"({x}.gates > {y}.gates OR ({x}.gates = {y}.gates AND {x}.i > {y}.i))"


#: Elevations that are folded together: arrays are copied when they grow, so tilts are gathered by chunks.
_CHUNK = 512
_SWEEP = "struct<elev: double, i: bigint, gates: bigint>"
_BEGUN = "CASE WHEN x.first.gates IS NULL THEN x.first ELSE x.best END"
_STEP = f"""CASE WHEN a.last IS NULL THEN named_struct('last', {_BEGUN}, 'done', a.done)
        WHEN x.elev - a.last.elev < {TILT_MERGE_DEG}e0 THEN CASE WHEN {_better("x.best", "a.last")} THEN named_struct('last', x.best, 'done', a.done) ELSE a END
        ELSE named_struct('last', {_BEGUN}, 'done', concat(a.done, array(a.last))) END"""
_FOLD = f"""aggregate(sequence(0, cast(floor((size(s) - 1) / {_CHUNK}) AS int)), named_struct('last', cast(NULL AS {_SWEEP}), 'all', cast(array() AS array<array<{_SWEEP}>>)),
    (b, k) -> aggregate(slice(s, k * {_CHUNK} + 1, {_CHUNK}), named_struct('last', b.last, 'done', cast(array() AS array<{_SWEEP}>)), (a, x) -> {_STEP}, a -> named_struct('last', a.last, 'all', concat(b.all, array(a.done)))),
    b -> concat(flatten(b.all), array(b.last)))"""


def select_tilts(sweeps: DataFrame, *keys: str) -> DataFrame:
    """(keys, tilts): one sweep for each elevation, lowest first, as structs (elev, i, gates).

    A sweep within 0.2 degrees of the last one *kept*, which may itself have been replaced, only replaces it if it has more
    gates, or as many and comes later; so this is a fold over the sorted sweeps and not a comparison with the row before.

    Of the sweeps of one elevation only the best can be kept, and the first where it has no number of gates, as nothing replaces that: the fold takes one step for an
    elevation, however many sweeps have it. Tilts are gathered by chunks, so that none is copied anew at each step.
    """
    keys = keys or ("site",)
    sweep, apart = F.struct("elev", "i", "gates"), F.when(F.col("elev").isNull(), F.col("i"))
    best = F.max(F.when(F.col("gates").isNotNull(), F.struct("gates", "i")))
    levels = sweeps.groupBy(*keys, "elev", apart.alias("apart")).agg(F.min(sweep).alias("first"), best.alias("best"))
    levels = levels.select(*keys, F.struct("elev", "first", F.struct("elev", F.col("best.i").alias("i"), F.col("best.gates").alias("gates")).alias("best")).alias("level"))
    found = levels.groupBy(*keys).agg(F.array_sort(F.collect_list("level")).alias("s"))
    return found.select(*keys, F.expr(_FOLD).alias("tilts"))


def moment_names(radials: DataFrame, *keys: str) -> DataFrame:
    """(keys, fields): the names of all moments that any ray carries."""
    return radials.groupBy(*keys).agg(F.sort_array(F.collect_set("field")).alias("fields"))
