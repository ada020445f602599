"""Vocabulary files of public tokenizers."""

from __future__ import annotations

import base64

#: Largest vocabulary file, in bytes: it is broadcast.
MAX_VOCABULARY = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a tiktoken file."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary over {MAX_VOCABULARY} bytes: {path}")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
