"""Byte-level BPE of public vocabularies inside Spark tasks."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken


def _byte_of() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: a printable Latin-1 character is its own byte, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """Of a .tiktoken file of ranks, or of a tokenizers .json whose ids are in the order of its merges; once in each Python worker."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    vocab = {k: v for k, v in model["model"]["vocab"].items() if k not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if merged != list(range(merged[0], merged[0] + len(merged))):
        raise ValueError("its ids are not in the order of its merges, so they are no ranks")
    table = _byte_of()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(table[c] for c in k): v for k, v in vocab.items()}, special_tokens=special)


def encode(path: str, text: str | None) -> list[int]:
    """The ids that the file's own library gives; the strings of a .json's special tokens are those tokens, as there by default."""
    own = encoder(path)
    text = text or ""
    if any(s in text for s in own.special_tokens_set):
        return own.encode(text, allowed_special="all")
    return own.encode_ordinary(text)


def id_type(path: str) -> np.dtype:
    """Little-endian unsigned integers that hold every id of the vocabulary: of 16 bits where they suffice, else of 32."""
    return np.dtype("<u2" if encoder(path).max_token_value < 1 << 16 else "<u4")
