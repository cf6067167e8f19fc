"""Buckets of raw files: listings, key selection, downloads, the real-time ring, and Spark data sources over them.

A bucket has ``list(prefix)``, sorted keys, and ``get(key)``. ``FolderBucket`` serves a mounted folder, ``HttpBucket`` an
object store over HTTP; another store needs only these two methods.
"""

from __future__ import annotations

import os
import re
import urllib.parse
import urllib.request
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stormlake.functions.constants import LIVE_MIN, RING_SIZE, RING_SPACING_S

_STAMP = re.compile(r"([A-Z][A-Z0-9]{3})(\d{8}_\d{6})")


class Bucket(Protocol):
    def list(self, prefix: str) -> list[str]: ...
    def get(self, key: str) -> bytes: ...


class FolderBucket:
    def __init__(self, root: str):
        self.root = Path(root)

    def list(self, prefix: str) -> list[str]:
        folder = self.root / prefix.rpartition("/")[0]
        found = (str(p.relative_to(self.root)) for p in folder.rglob("*") if p.is_file()) if folder.is_dir() else ()
        return sorted(k for k in found if k.startswith(prefix))

    def get(self, key: str) -> bytes:
        return (self.root / key).read_bytes()


class HttpBucket:
    """An object store that lists by XML and serves keys by name over HTTP."""

    def __init__(self, url: str, timeout_s: float = 30.0):
        self.url, self.timeout_s = url.rstrip("/"), timeout_s

    def _fetch(self, path: str) -> bytes:
        with urllib.request.urlopen(f"{self.url}/{path}", timeout=self.timeout_s) as answer:
            return answer.read()

    def list(self, prefix: str) -> list[str]:
        found: list[str] = []
        more: dict[str, str] = {}
        while True:
            text = self._fetch("?" + urllib.parse.urlencode({"list-type": "2", "prefix": prefix, **more})).decode()
            found += parse_listing(text)
            token = [e.text for e in ET.fromstring(text).iter() if e.tag.rpartition("}")[2] == "NextContinuationToken"]
            if not token or not token[0]:
                return sorted(found)
            more = {"continuation-token": token[0]}

    def get(self, key: str) -> bytes:
        return self._fetch(urllib.parse.quote(key))


def bucket_of(options: dict[str, str]) -> Bucket:
    """The bucket that a source's options name: ``url`` of a store over HTTP, else ``path`` of a mounted folder."""
    return HttpBucket(options["url"]) if options.get("url") else FolderBucket(options["path"])


def parse_listing(text: str) -> list[str]:
    """Keys of an XML listing, entities decoded; namespaces don't matter."""
    return [e.text for e in ET.fromstring(text).iter() if e.tag.rpartition("}")[2] == "Key" and e.text]


def key_time(key: str) -> datetime | None:
    """Time of the first site and stamp anywhere in a key."""
    found = _STAMP.search(key)
    try:
        return datetime.strptime(found[2], "%Y%m%d_%H%M%S").replace(tzinfo=UTC) if found else None
    except ValueError:
        return None


def list_keys(bucket: Bucket, site: str, day: datetime) -> list[str]:
    """A day's volumes in order: no metadata files, only names with a time."""
    keys = bucket.list(f"{day:%Y/%m/%d}/{site}/")
    return sorted((k for k in keys if not k.endswith("_MDM") and key_time(k)), key=lambda k: (key_time(k), k))


def latest_key(bucket: Bucket, site: str, now: datetime) -> str | None:
    for day in (now, now - timedelta(days=1)):
        if found := list_keys(bucket, site, day):
            return found[-1]
    return None


def key_at(bucket: Bucket, site: str, at: datetime) -> str | None:
    """Newest at or before an instant, of its day, else of the day before only."""
    for day in (at, at - timedelta(days=1)):
        if found := [k for k in list_keys(bucket, site, day) if key_time(k) <= at]:
            return found[-1]
    return None


def keys_between(bucket: Bucket, site: str, start: datetime, end: datetime) -> list[str]:
    day, out = start.replace(hour=0, minute=0, second=0, microsecond=0), []
    while day <= end:
        out += [k for k in list_keys(bucket, site, day) if start <= key_time(k) <= end]
        day += timedelta(days=1)
    return out


def keys_since(bucket: Bucket, site: str, now: datetime, minutes: int = LIVE_MIN) -> list[str]:
    return keys_between(bucket, site, now - timedelta(minutes=minutes), now)


def resolve_keys(bucket: Bucket, site: str, now: datetime, at: datetime | None = None, start: datetime | None = None, end: datetime | None = None) -> list[str]:
    """A range wins over an instant, an instant over the newest; half a range is an error."""
    if (start is None) != (end is None):
        raise ValueError("a range needs both ends")
    if start is not None:
        return keys_between(bucket, site, start, end)
    found = key_at(bucket, site, at) if at else latest_key(bucket, site, now)
    return [found] if found else []


def download(bucket: Bucket, key: str, folder: str) -> Path:
    """Fetch a key into a folder unless it is there; the file appears whole."""
    target = Path(folder) / key.rpartition("/")[2]
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        held = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
        held.write_bytes(bucket.get(key))
        os.replace(held, target)
    return target


def fetched(spark: SparkSession, bucket: Bucket, keys: list[str], folder: str, per_part: int = 4) -> DataFrame:
    """(key, content) of the keys that can be fetched; executors fetch them, a few files a partition, and keep them in a folder of theirs, which
    needn't be shared."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key in batch["key"]:
                try:
                    content = download(bucket, key, folder).read_bytes()
                except OSError:
                    continue
                yield pd.DataFrame({"key": [key], "content": [content]})

    named = spark.createDataFrame([(k,) for k in keys], "key string").repartition(max(1, -(-len(keys) // per_part)))
    return named.mapInPandas(each, "key string, content binary")


def chunk_stamp(key: str) -> str:
    """Stamp of a chunk named ``stamp-number-kind`` (kind S, I or E)."""
    return key.rpartition("/")[2][:15]


def chunk_number(key: str) -> int:
    parts = key.rpartition("/")[2].split("-")
    return int(parts[2]) if len(parts) > 2 and parts[2].isdigit() else 0


def chunk_time(key: str) -> datetime | None:
    try:
        return datetime.strptime(chunk_stamp(key), "%Y%m%d-%H%M%S").replace(tzinfo=UTC)
    except ValueError:
        return None


def list_chunks(bucket: Bucket, site: str, volume: int, newer_than: datetime | None = None) -> list[str]:
    """Chunks of a ring slot in number order: those of the newest stamp only, as a slot may hold an earlier trip's rest."""
    keys = [k for k in bucket.list(f"{site}/{volume}/") if chunk_time(k)]
    if not keys:
        return []
    newest = max(map(chunk_stamp, keys))
    found = sorted((k for k in keys if chunk_stamp(k) == newest), key=chunk_number)
    return found if newer_than is None or chunk_time(found[0]) > newer_than else []


def volume_time(bucket: Bucket, site: str, volume: int) -> datetime | None:
    found = list_chunks(bucket, site, volume)
    return chunk_time(found[0]) if found else None


def next_volume(volume: int) -> int:
    return volume % RING_SIZE + 1


def find_latest_volume(bucket: Bucket, site: str, step: int = 111) -> int | None:
    """The ring slot of the newest volume: coarse probes, then bisection of the arc where times fall back."""
    seen: dict[int, datetime | None] = {}

    def at(slot: int) -> datetime | None:
        slot = (slot - 1) % RING_SIZE + 1
        if slot not in seen:
            seen[slot] = volume_time(bucket, site, slot)
        return seen[slot]

    probes = [(t, s) for s in range(1, RING_SIZE + 1, step) if (t := at(s))]
    if not probes:
        return next((s for s in range(1, RING_SIZE + 1) if at(s)), None)
    best, low = max(probes)
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        t = at(middle)
        if t is not None and t >= best:
            low = middle
        else:
            high = middle
    return (low - 1) % RING_SIZE + 1


def find_latest_volume_from(bucket: Bucket, site: str, known: int, known_time: datetime, now: datetime) -> int | None:
    """The newest slot, searched forward from a remembered one: at most one volume in 150 seconds can have come since."""
    reach = min(RING_SIZE - 1, int((now - known_time).total_seconds() // RING_SPACING_S) + 1)
    low, high = 0, reach + 1
    if volume_time(bucket, site, known) is None:
        return None
    while high - low > 1:
        middle = (low + high) // 2
        t = volume_time(bucket, site, (known + middle - 1) % RING_SIZE + 1)
        if t is not None and t >= known_time:
            low = middle
        else:
            high = middle
    return (known + low - 1) % RING_SIZE + 1


KEYS = "key string, site string, scan_time timestamp, content binary"


class _Part(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class _ArchiveReader(DataSourceReader):
    """Volumes of a site's day, or of the whole bucket; executors fetch them, a few files a partition."""

    def __init__(self, options: dict[str, str]):
        self.bucket, self.site = bucket_of(options), options.get("site", "")
        self.day = options.get("day", "")
        self.per_part = int(options.get("filesPerPartition", "4"))

    def partitions(self) -> list[InputPartition]:
        keys = list_keys(self.bucket, self.site, datetime.strptime(self.day, "%Y-%m-%d")) if self.site and self.day else [k for k in self.bucket.list("") if not k.endswith("_MDM") and key_time(k)]
        return [_Part(keys[i : i + self.per_part]) for i in range(0, len(keys), self.per_part)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for key in partition.keys:
            yield key, _STAMP.search(key)[1], key_time(key), self.bucket.get(key)


class RadarBucket(DataSource):
    """``spark.read.format("radar_bucket").option("path", ...)``, or ``url`` of a store over HTTP; as a stream, the chunks of a ring."""

    @classmethod
    def name(cls) -> str:
        return "radar_bucket"

    def schema(self) -> str:
        return KEYS

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        from stormlake.sources.ring import RingReader

        return RingReader(self.options)
