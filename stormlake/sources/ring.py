"""The real-time ring as a stream source: chunks of growing volumes, read on executors, none lost.

A site's chunks lie in ring slots 1 to 999, ``SITE/slot/stamp-number-kind``, the last with kind E; slots may hold an earlier trip's rest. The source's
offset has a place for each site: the slot it is in, that volume's stamp, and the last chunk of it up to which none is missing.

* A site that has no place yet starts with its newest volume, found by ring search (at most 20 listings).
* A poll looks for the newest volume forward from the site's own slot (at most 8 listings). A site stays with its volume until the end chunk is there and
  none before it is missing, or until two newer volumes are there, when what came of it is all there will be. Then it goes on, and the volumes between are read whole.
* A batch has a partition for each volume; executors list its slot and fetch its chunks. What a batch holds follows from its offsets, so a
  restart from a checkpoint reads the same again and then goes on from there, however many volumes have passed.

Chunks that arrive late or out of order, and sites that grow side by side, change nothing: places are by site, and a gap is waited for.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from stormlake.functions.constants import RING_SIZE
from stormlake.sources import bucket as b


class Volume(InputPartition):
    """Chunks of a slot with numbers in (after, upto]: those of ``stamp``, else of the newest stamp if it is later than ``since``."""

    def __init__(self, site: str, slot: int, stamp: str = "", since: str = "", after: int = 0, upto: int | None = None):
        self.site, self.slot, self.stamp, self.since, self.after, self.upto = site, slot, stamp, since, after, upto


def whole_upto(keys: list[str]) -> tuple[int, bool]:
    """(number, ended) of a volume's chunks in order: the last one before which none is missing from the first, and whether it ends the volume."""
    if not keys or b.chunk_number(keys[0]) != 1:
        return 0, False
    last = keys[0]
    for key in keys[1:]:
        if b.chunk_number(key) > b.chunk_number(last) + 1:
            break
        last = key
    return b.chunk_number(last), last.endswith("-E")


class RingReader(DataSourceStreamReader):
    """Options: path or url of the bucket, sites (a list with commas; all that the bucket has if it isn't given)."""

    def __init__(self, options: dict[str, str]):
        self.bucket = b.bucket_of(options)
        self.sites = [s.strip().upper() for s in options.get("sites", "").split(",") if s.strip()] or sorted({k.split("/")[0] for k in self.bucket.list("") if b.chunk_time(k)})
        self.at: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def _newest(self, site: str, held: dict | None) -> int | None:
        if held is not None:
            known = datetime.strptime(held["stamp"], "%Y%m%d-%H%M%S").replace(tzinfo=UTC)
            found = b.find_latest_volume_from(self.bucket, site, held["slot"], known, datetime.now(UTC))
            if found is not None:
                return found
        return b.find_latest_volume(self.bucket, site)

    def _place(self, site: str, held: dict | None) -> dict | None:
        slot = self._newest(site, held)
        if slot is None:
            return held
        if held is not None and slot != held["slot"] and (slot - held["slot"]) % RING_SIZE == 1:
            # the next volume has begun: this one is left once it is whole
            keys = b.list_chunks(self.bucket, site, held["slot"])
            if keys and b.chunk_stamp(keys[0]) == held["stamp"] and not (found := whole_upto(keys))[1]:
                return {**held, "chunk": max(found[0], held["chunk"])}
        keys = b.list_chunks(self.bucket, site, slot)
        if not keys:
            return held
        place = {"slot": slot, "stamp": b.chunk_stamp(keys[0]), "chunk": whole_upto(keys)[0]}
        if held is not None and (place["slot"], place["stamp"]) == (held["slot"], held["stamp"]):
            place["chunk"] = max(place["chunk"], held["chunk"])
        return place

    def latestOffset(self) -> dict:
        for site in self.sites:
            if (place := self._place(site, self.at.get(site))) is not None:
                self.at[site] = place
        return {site: dict(place) for site, place in sorted(self.at.items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for site, now in sorted(end.items()):
            then = start.get(site)
            if then is not None and (then["slot"], then["stamp"]) == (now["slot"], now["stamp"]):
                if now["chunk"] > then["chunk"]:
                    out.append(Volume(site, now["slot"], now["stamp"], after=then["chunk"], upto=now["chunk"]))
                continue
            if then is not None:
                out.append(Volume(site, then["slot"], then["stamp"], after=then["chunk"]))
                slot = b.next_volume(then["slot"])
                while slot != now["slot"] and slot != then["slot"]:
                    out.append(Volume(site, slot, since=then["stamp"]))
                    slot = b.next_volume(slot)
            out.append(Volume(site, now["slot"], now["stamp"], upto=now["chunk"]))
        # a place that a restart found behind a checkpoint's is none to go back to
        self.at = {**self.at, **{s: dict(p) for s, p in end.items() if s not in self.at}}
        return out

    def read(self, partition: Volume) -> Iterator[tuple]:
        keys = [k for k in self.bucket.list(f"{partition.site}/{partition.slot}/") if b.chunk_time(k)]
        stamp = partition.stamp or max((b.chunk_stamp(k) for k in keys), default="")
        if not partition.stamp and stamp <= partition.since:
            return
        for key in sorted((k for k in keys if b.chunk_stamp(k) == stamp), key=b.chunk_number):
            if partition.after < b.chunk_number(key) and (partition.upto is None or b.chunk_number(key) <= partition.upto):
                yield key, partition.site, b.chunk_time(key), self.bucket.get(key)
