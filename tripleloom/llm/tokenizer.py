"""Byte-level BPE from a rank file of public vocabulary; the path is a parameter, its default the installed copy."""

from __future__ import annotations

import base64
from functools import lru_cache

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str = DEFAULT):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECE = 100_000


def pieces(text: str):
    """A long text in parts of about PIECE characters. A part ends before a blank whose neighbours aren't white space, where the pre-tokenizer splits in any case, so the tokens are those of the whole."""
    at = 0
    while len(text) - at > PIECE:
        k = at + PIECE
        while k < len(text) and not (text[k] == " " and not text[k - 1].isspace() and k + 1 < len(text) and not text[k + 1].isspace()):
            k += 1
        yield text[at:k]
        at = k
    yield text[at:]


def encode(text: str | None, path: str = DEFAULT) -> list[int]:
    """Token ids of a text; none for null. Strings that look like special tokens are ordinary text."""
    if not text:
        return []
    enc = encoding(path)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [t for p in pieces(text) for t in enc.encode_ordinary(p)]
