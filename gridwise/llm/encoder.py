"""Exact byte-level BPE ids of whole texts inside Spark tasks.

The public vocabulary comes twice: as a `tokenizers` file and, for `tiktoken`, as ranks.  Both give the same
ids (tests hold them against each other); the second is several times faster, so it encodes ordinary texts.  A text that
holds the string of an added token goes to the `tokenizers` library, which treats that string as one token.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file is, on whichever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary denotes: printable bytes denote
    themselves, the others are numbered from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def token_table(path: str | None = None) -> list[bytes]:
    """The bytes of each id, added tokens included, from a byte-level `tokenizers` file."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    symbols = byte_of_symbol()
    by_id = {i: bytes(symbols[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in symbols for c in token)}
    by_id |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


class Encoder:
    """Ids of whole texts, equal to those of the `tokenizers` library."""

    def __init__(self):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path())
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ordinary = fast.encode_ordinary
        self.n_ids = self.library.get_vocab_size()

    def encode(self, text: str | None) -> np.ndarray:
        """Null and empty texts have no ids."""
        if not text:
            return np.zeros(0, "<u4")
        if any(a in text for a in self.added):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.ordinary(text), dtype="<u4")


@lru_cache(maxsize=1)
def shared_encoder() -> Encoder:
    """One encoder for each worker process."""
    return Encoder()
