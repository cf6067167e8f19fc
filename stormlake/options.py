"""Options of the jobs: which scans to fetch, which sites to follow."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from datetime import datetime
from typing import NamedTuple, NoReturn

from stormlake.functions.constants import LIVE_MAX_MIN, LIVE_MIN
from stormlake.functions.times import parse_iso


class Selection(NamedTuple):
    site: str
    at: datetime | None
    start: datetime | None
    end: datetime | None


class Following(NamedTuple):
    sites: list[str]
    interval_s: float
    since_minutes: int


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> NoReturn:
        raise ValueError(message)


def _instant(text: str) -> datetime:
    found = parse_iso(text)
    if found is None:
        raise argparse.ArgumentTypeError(f"{text} isn't an instant")
    return found


def _minutes(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError("not a whole number of minutes")
    return min(int(text), LIVE_MAX_MIN)


def _parser(add: Callable[[argparse.ArgumentParser], None]) -> argparse.ArgumentParser:
    made = _Parser(add_help=False, allow_abbrev=False)
    add(made)
    return made


def selection(args: Sequence[str]) -> Selection:
    """``SITE [--at T] [--from T --to T]``."""

    def add(p: argparse.ArgumentParser) -> None:
        p.add_argument("site", type=str.upper)
        for name, target in (("--at", "at"), ("--from", "start"), ("--to", "end")):
            p.add_argument(name, dest=target, type=_instant)

    held = _parser(add).parse_args(args)
    return Selection(held.site, held.at, held.start, held.end)


def following(args: Sequence[str]) -> Following:
    """``SITE... [--interval SECONDS] [--since-minutes MINUTES]``."""

    def add(p: argparse.ArgumentParser) -> None:
        p.add_argument("sites", nargs="+", type=str.upper)
        p.add_argument("--interval", type=float, default=5.0)
        p.add_argument("--since-minutes", dest="since", type=_minutes, default=LIVE_MIN)

    held = _parser(add).parse_args(args)
    return Following(held.sites, held.interval, held.since)
