"""Ranks of public byte-level BPE vocabularies, read where they are installed."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import tiktoken


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path.rpartition("/")[2], pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
