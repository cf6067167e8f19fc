"""Names, instants and windows of scans."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormlake.functions.constants import AROUND_S, LIVE_MAX_MIN, LIVE_MIN, WINDOW_STALE_MS

_STAMP = r"([A-Z][A-Z0-9]{3})(\d{8}_\d{6})"


def base_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def compact(text: Column) -> Column:
    """yyyyMMdd_HHmmss as an instant; null if it isn't one, impossible dates included."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd_HHmmss"))


def key_site(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, _STAMP, 1), F.lit(""))


def key_time(key: Column) -> Column:
    """Time of the first site and stamp anywhere in an archive key."""
    return compact(F.nullif(F.regexp_extract(key, _STAMP, 2), F.lit("")))


def name_site(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^([A-Z0-9]{4})_\d{8}_\d{6}$", 1), F.lit(""))


def name_time(name: Column) -> Column:
    return compact(F.nullif(F.regexp_extract(name, r"^[A-Z0-9]{4}_(\d{8}_\d{6})$", 1), F.lit("")))


def volume_name(icao: Column, at: Column) -> Column:
    return F.concat_ws("_", icao, F.date_format(at, "yyyyMMdd_HHmmss"))


def day_prefix(day: Column, icao: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit("/"), icao, F.lit("/"))


def iso(at: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only where there are any."""
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    return F.when(micros == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def julian_time(days: Column, millis: Column) -> Column:
    """Radar day (1 is 1970-01-01) and milliseconds of day."""
    return F.timestamp_millis((days.cast("long") - 1) * 86_400_000 + millis.cast("long"))


_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?\s*(Z|[+-]\d\d:?\d\d)?)?")


def parse_iso(text: str) -> datetime | None:
    """An instant from ISO text; without offset it is UTC. None for anything else, impossible dates included."""
    found = _ISO.fullmatch(text.strip())
    if not found:
        return None
    year, month, day, hour, minute, second, part, zone = found.groups()
    try:
        at = datetime(int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0), int(((part or "") + "000000")[:6]), UTC)
    except ValueError:
        return None
    if zone and zone != "Z":
        sign = -1 if zone[0] == "-" else 1
        at -= sign * timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
    return at


def instant_us(text: Column) -> Column:
    """What ``parse_iso`` accepts, as microseconds since 1970 whatever the session's time zone; null for anything else."""
    part = lambda k: F.regexp_extract(text, rf"^\s*{_ISO.pattern}\s*$", k)
    or_zero = lambda k: F.coalesce(F.nullif(part(k), F.lit("")), F.lit("00"))
    civil = F.try_to_timestamp(F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), or_zero(4), F.lit(":"), or_zero(5), F.lit(":"), or_zero(6), F.lit("+0000")), F.lit("yyyy-MM-dd HH:mm:ssxx"))
    zone = part(8)
    minutes = F.when(zone.isin("", "Z"), F.lit(0)).otherwise(F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int"))
    away = F.when(zone.startswith("-"), -minutes).otherwise(minutes).cast("long") * 60_000_000
    return F.when(part(1) != "0000", F.unix_micros(civil)) + F.rpad(F.substring(part(7), 1, 6), 6, "0").cast("long") - away


def window_in_force(text: Column, now_us: Column) -> Column:
    """struct(from_us, to_us) of a window file's JSON at an instant, both ends included, to_us null where it is open; null where the file isn't valid or was written
    more than 24 hours before or after.

    The file has from, to and written as ISO text and live, a boolean that may be missing or null. A live window keeps its length, ends open and begins that long before now.
    """
    doc = F.from_json(text, "from string, to string, written string, live boolean, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    start, end, written = (instant_us(doc[k]) for k in ("from", "to", "written"))
    live = F.coalesce(doc["live"], F.lit(False))
    valid = doc["_corrupt_record"].isNull() & (start <= end) & (F.abs(now_us - written) <= WINDOW_STALE_MS * 1000)
    return F.when(valid, F.struct(F.when(live, now_us - (end - start)).otherwise(start).alias("from_us"), F.when(~live, end).alias("to_us")))


@dataclass(frozen=True)
class TimeWindow:
    """[start, end] in unix seconds; without end it is live and rolls with the clock over ``minutes``."""

    start: int
    end: int | None = None
    minutes: int = 0

    @classmethod
    def fixed(cls, start: int, end: int) -> TimeWindow:
        return cls(min(start, end), max(start, end))

    @classmethod
    def around(cls, at: int, half: int = AROUND_S) -> TimeWindow:
        return cls(at - half, at + half)

    @classmethod
    def live(cls, now: int, minutes: int = LIVE_MIN) -> TimeWindow:
        minutes = max(1, min(minutes, LIVE_MAX_MIN))
        return cls(now - minutes * 60, None, minutes)

    def tick(self, now: int) -> TimeWindow:
        return TimeWindow.live(now, self.minutes) if self.end is None else self

    def freeze(self, now: int) -> TimeWindow:
        return TimeWindow(self.start, now) if self.end is None else self

    def upper(self, now: int) -> int:
        return now if self.end is None else self.end

    def clip(self, other: TimeWindow) -> TimeWindow | None:
        ends = [x for x in (self.end, other.end) if x is not None]
        start, end = max(self.start, other.start), min(ends) if ends else None
        return None if end is not None and end < start else TimeWindow(start, end, self.minutes if end is None else 0)

    def contains(self, unix: Column | int) -> Column | bool:
        if isinstance(unix, Column):
            return unix.between(self.start, self.end) if self.end is not None else unix >= self.start
        return unix >= self.start and (self.end is None or unix <= self.end)

    def option(self) -> str:
        if self.end is None:
            return f"live:{self.minutes}"
        return "/".join(datetime.fromtimestamp(x, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for x in (self.start, self.end))

    @classmethod
    def parse(cls, text: str, now: int) -> TimeWindow | None:
        """``live``, ``live:MINUTES``, one instant (around it) or ``from/to``."""
        if text == "live":
            return cls.live(now)
        if text.startswith("live:"):
            return cls.live(now, int(text[5:])) if text[5:].isdigit() and int(text[5:]) > 0 else None
        ends = [parse_iso(x) for x in text.split("/")]
        if None in ends or len(ends) > 2:
            return None
        unix = [int(x.timestamp()) for x in ends]
        return cls.around(unix[0]) if len(unix) == 1 else cls.fixed(*unix) if unix[0] <= unix[1] else None

    @classmethod
    def of_request(cls, now: int, at: str = "", start: str = "", end: str = "", minutes: int = LIVE_MIN) -> TimeWindow | None:
        """A range wins over an instant, an instant over live; half a range is none."""
        if bool(start) != bool(end):
            return None
        return cls.parse(f"{start}/{end}", now) if start else cls.parse(at, now) if at else cls.live(now, minutes)


def request_key(kind: str, site: str, at: str = "", start: str = "", end: str = "") -> str:
    """Equal for requests of equal instants, however written."""
    said = [str(int(x.timestamp())) if (x := parse_iso(t)) else t for t in (at, start, end)]
    return "|".join([kind, site.upper(), *said])


def window_is_stale(written_ms: int, now_ms: int) -> bool:
    return abs(now_ms - written_ms) > WINDOW_STALE_MS
