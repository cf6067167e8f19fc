"""Level II volumes: a reader for archive files and a writer for fixtures (public interface control document).

A file is a 24-byte header and either compressed records (a 4-byte length and a bzip2 block each) or, after gzip, plain
messages. Messages of type 31 have their own length, all others a slot of 2432 bytes. Damaged input gives what was
decoded before the damage.
"""

from __future__ import annotations

import bz2
import gzip
import struct
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from stormlake.functions.constants import MISSING, RANGE_FOLDED

SLOT, HEADER, CTM = 2432, 16, 12
MS_DAY = 86_400_000


class Moment(NamedTuple):
    name: str
    first_gate_m: float
    spacing_m: float
    values: np.ndarray


class Radial(NamedTuple):
    azimuth: float
    elevation: float
    elevation_number: int
    resolution: float
    time_ms: int
    nyquist: float
    unambiguous_km: float
    moments: tuple[Moment, ...]


class Volume(NamedTuple):
    icao: str
    time_ms: int
    lat: float | None
    lon: float | None
    height_m: float | None
    vcp: int | None
    radials: tuple[Radial, ...]
    complete: bool


def _julian(days: int, ms: int) -> int:
    return (days - 1) * MS_DAY + ms


def scale_words(raw: np.ndarray, scale: float, offset: float) -> np.ndarray:
    """Words to float32 values: 0 is missing, 1 range folded."""
    raw = raw.astype(np.float32)
    value = (raw - np.float32(offset)) / np.float32(scale or 1.0)
    return np.where(raw == 0, np.float32(MISSING), np.where(raw == 1, np.float32(RANGE_FOLDED), value)).astype(np.float32)


def _records(raw: bytes) -> list[bytes]:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at, out = 24, []
    if raw[28:30] != b"BZ":
        return [raw[24:]]
    while at + 4 <= len(raw):
        size = abs(struct.unpack_from(">i", raw, at)[0])
        block = raw[at + 4 : at + 4 + size]
        decoder = bz2.BZ2Decompressor()
        try:
            out.append(decoder.decompress(block))
        except (OSError, ValueError, EOFError):
            break
        at += 4 + size
    return out


def _message_31(body: bytes) -> tuple[Radial, dict] | None:
    if len(body) < 68:
        return None
    ms, days, _, azimuth, _, _, _, spacing, _, number, _, elevation, _, _, blocks = struct.unpack_from(">IHHfBBHBBBBfBBH", body, 4)
    about: dict = {}
    nyquist = unambiguous = 0.0
    moments = []
    for at in struct.unpack_from(f">{min(blocks, 10)}I", body, 32) if len(body) >= 32 + 4 * min(blocks, 10) else ():
        kind = body[at : at + 4]
        if kind == b"RVOL" and at + 44 <= len(body):
            lat, lon, height = struct.unpack_from(">ffh", body, at + 8)
            about = {"lat": lat, "lon": lon, "height_m": float(height), "vcp": struct.unpack_from(">H", body, at + 40)[0]}
        elif kind == b"RRAD" and at + 18 <= len(body):
            unambiguous = struct.unpack_from(">H", body, at + 6)[0] / 10.0
            nyquist = struct.unpack_from(">H", body, at + 16)[0] / 100.0
        elif kind[:1] == b"D" and at + 28 <= len(body):
            gates, first, step = struct.unpack_from(">HHH", body, at + 8)
            bits, scale, offset = struct.unpack_from(">Bff", body, at + 19)
            width = bits // 8
            if width not in (1, 2) or at + 28 + gates * width > len(body):
                continue
            raw = np.frombuffer(body, f">u{width}", gates, at + 28)
            moments.append(Moment(kind[1:].decode("ascii", "replace").strip(), float(first), float(step), scale_words(raw, scale, offset)))
    return Radial(azimuth % 360.0, elevation, number, 0.5 if spacing == 1 else 1.0, _julian(days, ms), nyquist, unambiguous, tuple(moments)), about


def message_1_angle(code: int) -> float:
    return code * 180.0 / 32768.0


def _message_1(body: bytes) -> tuple[Radial, dict] | None:
    if len(body) < 100:
        return None
    ms, days, reach, az, _, _, elev, number = struct.unpack_from(">IHHHHHHH", body)
    first_z, first_v, step_z, step_v, n_z, n_v = struct.unpack_from(">hhHHHH", body, 18)
    at_z, at_v, at_w, resolution, vcp = struct.unpack_from(">HHHHH", body, 36)
    nyquist = struct.unpack_from(">H", body, 60)[0] / 100.0
    step = 0.5 if resolution == 2 else 1.0
    moments = []
    for name, at, n, first, spacing, slope, base in (("REF", at_z, n_z, first_z, step_z, 0.5, -32.0), ("VEL", at_v, n_v, first_v, step_v, step, -63.5 if step == 0.5 else -127.0), ("SW", at_w, n_v, first_v, step_v, 0.5, -63.5)):
        if not at or not n or at + n > len(body) or not spacing:
            continue
        raw = np.frombuffer(body, ">u1", n, at).astype(np.float32)
        value = np.where(raw == 0, np.float32(MISSING), np.where(raw == 1, np.float32(RANGE_FOLDED), (raw - 2) * np.float32(slope) + np.float32(base))).astype(np.float32)
        behind = max(0, -(first // spacing)) if first < 0 else 0
        moments.append(Moment(name, float(first + behind * spacing), float(spacing), value[behind:]))
    return Radial(message_1_angle(az), message_1_angle(elev), number, 1.0, _julian(days, ms), nyquist, reach / 10.0, tuple(moments)), {"vcp": vcp}


def read_volume(raw: bytes, name: str = "") -> Volume:
    """Decode a file. A blank site is taken from the name; ValueError for what isn't an archive. Archives count as complete: that a
    volume is still growing is known to whoever puts its chunks together."""
    plain = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    if len(plain) < 24 or plain[:4] not in (b"AR2V", b"ARCH"):
        raise ValueError("no archive header")
    days, ms = struct.unpack_from(">II", plain, 12)
    icao = plain[20:24].decode("ascii", "replace").strip("\x00 ") or name[:4].upper()
    radials, about = [], {}
    for record in _records(plain):
        at = 0
        while at + CTM + HEADER <= len(record):
            size, _, kind = struct.unpack_from(">HBB", record, at + CTM)
            if size == 65535:  # length in the two words that otherwise count segments
                size = struct.unpack_from(">I", record, at + CTM + 12)[0] // 2
            length = CTM + size * 2 if kind == 31 else SLOT
            if kind == 31 and (size * 2 < HEADER or at + length > len(record)):
                break
            body = record[at + CTM + HEADER : at + length]
            found = _message_31(body) if kind == 31 else _message_1(body) if kind == 1 else None
            if found:
                radials.append(found[0])
                about |= {k: v for k, v in found[1].items() if v is not None}
            at += length
    return Volume(icao, _julian(days, ms), about.get("lat"), about.get("lon"), about.get("height_m"), about.get("vcp"), tuple(radials), True)


#: Word width, scale and offset of each moment.
ENCODING = {"REF": (8, 2.0, 66.0), "VEL": (8, 2.0, 129.0), "SW": (8, 2.0, 129.0), "ZDR": (8, 16.0, 128.0), "PHI": (16, 2.8361, 2.0), "RHO": (8, 300.0, -60.5)}


def quantise(name: str, values: np.ndarray) -> np.ndarray:
    """Values to words; missing 0, folded 1."""
    bits, scale, offset = ENCODING[name]
    word = np.clip(np.rint(values * scale + offset), 2, 2**bits - 1)
    return np.where(values < -1500, 1, np.where(values < -900, 0, word)).astype(f">u{bits // 8}")


def _message(kind: int, body: bytes, ms: int, sequence: int) -> bytes:
    size = (HEADER + len(body) + 1) // 2
    head = struct.pack(">HBBHHIHH", size, 0, kind, sequence, ms // MS_DAY + 1, ms % MS_DAY, 1, 1)
    return b"\0" * CTM + head + body + b"\0" * (len(body) % 2)


def message_31(volume: Volume, radial: Radial, number: int, status: int) -> bytes:
    blocks = [
        b"RVOL" + struct.pack(">HBBffhHfffffHH", 44, 1, 0, volume.lat or 0.0, volume.lon or 0.0, int(volume.height_m or 0), 0, 0.0, 0.0, 0.0, 0.0, 0.0, volume.vcp or 0, 0),
        b"RRAD" + struct.pack(">HHffHH", 20, round(radial.unambiguous_km * 10), 0.0, 0.0, round(radial.nyquist * 100), 0),
    ]
    for m in radial.moments:
        bits, scale, offset = ENCODING[m.name]
        blocks.append(b"D" + m.name.ljust(3).encode() + struct.pack(">IHHHHhBBff", 0, len(m.values), int(m.first_gate_m), int(m.spacing_m), 0, 0, 0, bits, scale, offset) + quantise(m.name, m.values).tobytes())
    at, places = 32 + 4 * len(blocks), []
    for block in blocks:
        places.append(at)
        at += len(block)
    head = volume.icao.encode().ljust(4)[:4] + struct.pack(">IHHfBBHBBBBfBBH", radial.time_ms % MS_DAY, radial.time_ms // MS_DAY + 1, number, radial.azimuth, 0, 0, at, 1 if radial.resolution == 0.5 else 2, status, radial.elevation_number, 0, radial.elevation, 0, 0, len(blocks))
    return _message(31, head + struct.pack(f">{len(blocks)}I", *places) + b"".join(blocks), radial.time_ms, number)


def write_volume(volume: Volume, layout: str = "bzip2", record: int = 120) -> bytes:
    """Encode a volume: ``bzip2`` records of so many radials, or one ``gzip`` stream."""
    head = b"AR2V0006.001" + struct.pack(">II", volume.time_ms // MS_DAY + 1, volume.time_ms % MS_DAY) + volume.icao.encode().ljust(4)[:4]
    n = len(volume.radials)
    messages = [message_31(volume, r, i + 1, 3 if i == 0 else 4 if i == n - 1 and volume.complete else 1) for i, r in enumerate(volume.radials)]
    if layout == "gzip":
        return gzip.compress(head + b"".join(messages))
    out = [head]
    for lo in range(0, n, record):
        block = bz2.compress(b"".join(messages[lo : lo + record]))
        out.append(struct.pack(">i", len(block)) + block)
    return b"".join(out)


def storm_scene(icao: str = "KTST", time_ms: int = 1_714_600_800_000, sweeps: tuple[float, ...] = (0.5, 0.5, 1.5, 3.0, 5.0, 7.5, 11.0), gates: int = 48, nyquist: float = 20.0, seed: int = 7, spacing_m: float = 1000.0, dual_gates: int | None = None) -> Volume:
    """A deterministic volume: one core with a rotating couplet in a wind that veers with height, velocities folded. All but
    reflectivity may have fewer gates."""
    rng = np.random.default_rng([seed, time_ms // 1000, sum(icao.encode())])
    minutes = (time_ms - 1_714_600_800_000) / 60_000
    cx, cy = 18 + 0.6 * minutes, 14 + 0.36 * minutes
    radials = []
    for number, elev in enumerate(sweeps, 1):
        n = 720 if elev < 1 else 360
        r = 1 + np.arange(gates) * spacing_m / 1000
        for i in range(n):
            az = (i + 0.5) * 360 / n
            s, c = np.sin(np.radians(az)), np.cos(np.radians(az))
            ground = r * np.cos(np.radians(elev))
            x, y = ground * s, ground * c
            h = r * np.sin(np.radians(elev)) + ground**2 / (2 * 8494.67)
            d = np.hypot(x - cx, y - cy)
            ref = 58 * np.exp(-((d / 7) ** 2)) * np.clip((12 - h) / 9, 0, 1) + rng.normal(0, 0.3, gates)
            ref = np.where(ref > 5, ref, 8.0 + 2 * np.sin(az / 30)).astype(np.float32)
            turn = np.radians(180 + 90 * np.clip(h / 6, 0, 1))
            speed = 10 + 20 * np.clip(h / 6, 0, 1)
            u, v = -speed * np.sin(turn), -speed * np.cos(turn)
            spin = np.where(d < 2, 25 * d / 2, 25 * 2 / np.maximum(d, 1e-6) * np.exp(-((d - 2) / 2)))
            u, v = u - spin * (y - cy) / np.maximum(d, 1e-6), v + spin * (x - cx) / np.maximum(d, 1e-6)
            vel = (u * s + v * c) * np.cos(np.radians(elev)) + rng.normal(0, 0.2, gates)
            vel = np.mod(vel + nyquist, 2 * nyquist) - nyquist
            rho = np.where(ref > 20, 0.985, 0.97).astype(np.float32)
            phase = 60 + np.cumsum(np.where(ref > 45, 3.0, 0.05) * spacing_m / 1000)
            moments = [Moment(name, 1000.0, spacing_m, x[: gates if name == "REF" else dual_gates].astype(np.float32)) for name, x in (("REF", ref), ("VEL", vel), ("ZDR", 0.02 * ref), ("PHI", phase), ("RHO", rho))]
            radials.append(Radial(az, elev, number, 360 / n, time_ms + number * 15_000 + i * 20, nyquist, 466.0, tuple(moments)))
    return Volume(icao, time_ms, 35.3331, -97.2778, 370.0, 212, tuple(radials), True)


def plain_scene(icao: str, time_ms: int, sweeps: tuple[float, ...], gates: int, spacing_m: float, fields: dict[str, Callable[[np.ndarray, np.ndarray, float], np.ndarray]], nyquist: float = 20.0, rays: int = 360) -> Volume:
    """A volume whose gates are given by functions of azimuth (degrees), range (km) and elevation; velocities are folded."""
    r = 1 + np.arange(gates) * spacing_m / 1000
    out = []
    for number, elev in enumerate(sweeps, 1):
        for i in range(rays):
            az = (i + 0.5) * 360 / rays
            held = {k: np.broadcast_to(f(np.float64(az), r, elev), r.shape) for k, f in fields.items()}
            if "VEL" in held:
                held["VEL"] = np.mod(held["VEL"] + nyquist, 2 * nyquist) - nyquist
            out.append(Radial(az, elev, number, 360 / rays, time_ms + number * 15_000 + i * 20, nyquist, 466.0, tuple(Moment(k, 1000.0, spacing_m, v.astype(np.float32)) for k, v in held.items())))
    return Volume(icao, time_ms, 35.3331, -97.2778, 370.0, 212, tuple(out), True)
