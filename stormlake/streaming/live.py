"""Live operators on Structured Streaming: growing volumes, cell tracking, sessions and hour buckets."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from stormlake.functions.constants import PRIOR_MAX_AGE_S, SEQUENCE_GAP_S, TRACK_GAP_S
from stormlake.operators import grids, volumes
from stormlake.sources import level2

PARTIAL = "icao string, volume string, n_chunks int, n_radials int, complete boolean, time_s long, content binary"


class GrowingVolume(StatefulProcessor):
    """Chunks of one site, appended in number order; each new one decodes the whole buffer again and emits it.

    A volume that was joined after its start chunk is skipped until the next start. A later stamp replaces the buffer, an
    earlier one is a rest of the previous trip round the ring and dropped. Complete once the end chunk is there and none
    before it is missing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", StructType([StructField("stamp", StringType()), StructField("last", IntegerType())]))
        self.chunks = handle.getMapState("chunks", StructType([StructField("number", IntegerType())]), StructType([StructField("kind", StringType()), StructField("content", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["stamp", "number"])
        out = []
        for stamp, part in new.groupby("stamp"):
            current = self.head.get()[0] if self.head.exists() else ""
            if stamp < current:
                continue
            if stamp > current:
                self.chunks.clear()
            self.head.update((stamp, int(part["number"].max())))
            for row in part.itertuples():
                self.chunks.updateValue((int(row.number),), (row.kind, bytes(row.content)))
            held = {k[0]: v for k, v in self.chunks.iterator()}
            if 1 not in held:
                continue
            run = [held[n] for n in range(1, len(held) + 1) if n in held]
            content = b"".join(x[1] for x in run)
            try:
                volume = level2.read_volume(content)
            except (ValueError, OSError):
                continue
            whole = len(run) == max(held) and run[-1][0] == "E"
            out.append((key[0], stamp, len(run), len(volume.radials), whole, volume.time_ms // 1000, content))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in PARTIAL.split(", ")])

    def close(self) -> None:
        pass


def chunk_rows(ring: DataFrame) -> DataFrame:
    """(site, stamp, number, kind, content) from the ring's (key, site, scan_time, content)."""
    part = F.split(F.element_at(F.split("key", "/"), -1), "-")
    return ring.select("site", F.concat_ws("-", part[0], part[1]).alias("stamp"), part[2].cast("int").alias("number"), part[3].alias("kind"), "content")


def growing_volumes(chunks: DataFrame) -> DataFrame:
    """(site, stamp, number, kind, content) to one row for each new state of a volume, with its content as far as it has come."""
    return chunks.groupBy("site").transformWithStateInPandas(GrowingVolume(), PARTIAL, "Append", "None")


TRACKS = "site string, time_s long, track_id int, x_km double, y_km double, n_frames int"


class CellTracker(StatefulProcessor):
    """Cells of one site, frame by frame; a gap of over 20 minutes starts new ids' tracks, late frames are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        cell = StructType([StructField(n, t) for n, t in (("id", IntegerType()), ("x", DoubleType()), ("y", DoubleType()), ("u", DoubleType()), ("v", DoubleType()), ("n", IntegerType()))])
        self.cells = handle.getListState("cells", cell)
        self.clock = handle.getValueState("clock", StructType([StructField("time", LongType()), StructField("next", IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["time_s", "x_km", "y_km"])
        out = []
        for time, frame in frames.groupby("time_s"):
            before, new = self.clock.get() if self.clock.exists() else (None, 1)
            if before is not None and time <= before:
                continue
            old = [{"id": c[0], "x_km": c[1], "y_km": c[2], "motion": None if c[3] != c[3] else (c[3], c[4]), "track": [(before, c[1], c[2])] * c[5]} for c in self.cells.get()] if before is not None and time - before <= TRACK_GAP_S else []
            current = [{"time_s": int(time), "x_km": r.x_km, "y_km": r.y_km} for r in frame.itertuples()]
            new = grids.link_cells(old, current, 0 if before is None else int(time) - before, new)
            known = {c["id"]: c for c in old}
            for c in current:
                p = known.get(c["id"])
                dt = int(time) - before if p else 0
                c["motion"] = ((c["x_km"] - p["x_km"]) * 1000 / dt, (c["y_km"] - p["y_km"]) * 1000 / dt) if p and dt else None
            out += [(key[0], int(time), c["id"], c["x_km"], c["y_km"], len(c["track"])) for c in current]
            self.cells.put([(c["id"], c["x_km"], c["y_km"], *(c["motion"] or (float("nan"), float("nan"))), len(c["track"])) for c in current])
            self.clock.update((int(time), new))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in TRACKS.split(", ")])

    def close(self) -> None:
        pass


def track_cells(cells: DataFrame) -> DataFrame:
    """(site, time_s, x_km, y_km) to cells with track ids."""
    return cells.groupBy("site").transformWithStateInPandas(CellTracker(), TRACKS, "Append", "None")


WINDS = "icao string, time_s long, complete boolean, chained boolean, height_m double, u_ms double, v_ms double, n int"


class VolumeChain(StatefulProcessor):
    """Volumes of one site, each unfolded against the last complete one of the session if that is at most 15 minutes old. Only
    complete volumes become priors, a partial one is reported and forgotten; the complete volume that is the prior itself, which
    comes again when a session follows a backfill, isn't reported twice."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prior = handle.getValueState("prior", StructType([StructField("time", LongType()), StructField("tilts", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values("time_s").itertuples():
            try:
                volume = level2.read_volume(bytes(row.content))._replace(complete=bool(row.complete))
            except (ValueError, OSError, EOFError):
                continue
            now = volume.time_ms // 1000
            then, held = self.prior.get() if self.prior.exists() else (None, b"")
            if volume.complete and then == now:
                continue
            fresh = then is not None and 0 < now - then <= PRIOR_MAX_AGE_S
            sweeps = volumes.sweeps_of(volumes.rays_of(volume))
            wind = volumes.unfold(sweeps, _tilts_from(bytes(held)) if fresh else None)
            if volume.complete:
                self.prior.update((now, _tilts_to(sweeps)))
            out += [(key[0], now, volume.complete, fresh, float(h), float(u), float(v), int(n)) for h, u, v, n in wind]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in WINDS.split(", ")])

    def close(self) -> None:
        pass


def _tilts_to(sweeps: list[dict]) -> bytes:
    """Unfolded velocity of a volume's tilts as bytes."""
    tilts = volumes._tilts(sweeps, "DVEL")
    out = BytesIO()
    np.savez_compressed(out, places=np.array([(t["elevation"], *t["geometry"]["DVEL"]) for t in tilts]).reshape(-1, 3), **{f"t{i}": t["fields"]["DVEL"].astype(np.float16) for i, t in enumerate(tilts)})
    return out.getvalue()


def _tilts_from(raw: bytes) -> list[dict]:
    held = np.load(BytesIO(raw))
    return [{"elevation": e, "geometry": {"DVEL": (f, s)}, "fields": {"DVEL": held[f"t{i}"].astype(np.float32)}} for i, (e, f, s) in enumerate(held["places"])]


def chain_volumes(files: DataFrame) -> DataFrame:
    """(site, time_s, complete, content) of volumes, each whole or as far as it has come, to wind profiles of a site's chain."""
    return files.groupBy("site").transformWithStateInPandas(VolumeChain(), WINDS, "Append", "None")


MOVES = "site string, name string, time_s long, change string"


class RollingWindow(StatefulProcessor):
    """Scans of one site that lie in the last ``span_s`` of the clock: each is reported as it comes in, and as it goes out when the clock has passed it.

    A timer is set for the oldest scan held, so a site that sends nothing more is emptied all the same. A scan that comes again isn't reported
    again, and one that comes too late isn't at all.
    """

    def __init__(self, span_s: int):
        self.span_s = span_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", StructType([StructField("name", StringType())]), StructType([StructField("time", LongType())]))

    def _watch(self, times: list[int]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if times:
            self.handle.registerTimer((min(times) + self.span_s) * 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs() / 1000, []
        for row in pd.concat(list(rows)).sort_values(["time_s", "name"]).itertuples():
            if row.time_s + self.span_s >= now and not self.held.containsKey((row.name,)):
                self.held.updateValue((row.name,), (int(row.time_s),))
                out.append((key[0], row.name, int(row.time_s), "in"))
        self._watch([v[0] for _, v in self.held.iterator()])
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MOVES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, kept = timerValues.getCurrentProcessingTimeInMs() / 1000, [], []
        for name, value in list(self.held.iterator()):
            if value[0] + self.span_s < now:
                out.append((key[0], name[0], int(value[0]), "out"))
                self.held.removeKey(name)
            else:
                kept.append(value[0])
        self._watch(kept)
        yield pd.DataFrame(sorted(out, key=lambda x: x[2]), columns=[x.split()[0] for x in MOVES.split(", ")])

    def close(self) -> None:
        pass


def rolling_window(scans: DataFrame, minutes: float) -> DataFrame:
    """(site, name, time_s) of scans to what comes into a live window of so many minutes and what goes out of it."""
    return scans.groupBy("site").transformWithStateInPandas(RollingWindow(int(minutes * 60)), MOVES, "Append", "ProcessingTime")


def sessions(scans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Loops of a site: session windows with a gap of 30 minutes. The last scan, not the window's end, is reported."""
    timed = scans.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("site", F.session_window("ts", f"{SEQUENCE_GAP_S} seconds").alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n_scans")).drop("w")


def hour_buckets(scans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Tumbling hours of each site."""
    timed = scans.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("site", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n_scans")).select("site", F.col("w.start").alias("hour"), "n_scans")


def replace_volumes(stream: DataFrame, root: str, checkpoint: str):
    """Write each batch by partition overwrite, so that a volume written twice replaces its provisional state."""
    from stormlake.sources.store import scan_rows, write_volumes

    return stream.writeStream.foreachBatch(lambda batch, _: write_volumes(batch, scan_rows(batch), root)).option("checkpointLocation", checkpoint)
