"""Token ids of a public byte-level BPE vocabulary, inside tasks.

In this kind of vocabulary a space followed by anything but white space always begins a new pre-token, so the ids of
` word` depend on nothing around it. A text is split at its spaces; each distinct piece is encoded once and kept in a
bounded table. Texts with runs of white space are encoded whole, and texts with characters beyond the common blocks by
the reference tokenizer, as pattern engines can differ about new characters.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

#: Pieces kept in a Python worker at most; beyond that the table starts anew.
KEPT = 250_000
#: Characters on whose classes all pattern engines agree: Latin blocks, general punctuation, currency signs.
UNCOMMON = "[^\\x00-\\u024F\\u2000-\\u206F\\u20A0-\\u20BF]"
#: A space before other white space or at the end of the text.
LOOSE = "[ ](?:[\\s\\x1c-\\x1f\\x85]|$)"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Kept(dict):
    """Piece of text after a space, to the ids of the space and the piece as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        found = self[piece] = self.encode(" " + piece)
        return found


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids as bytes (4 for each id). `path` names the tokenizer's file; the same
    vocabulary as ranks, which a faster library reads, lies beside it under the same name."""
    import os
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    whole = lambda text: packed(fast.encode_ordinary(text))
    kept, uncommon, loose = _Kept(whole), re.compile(UNCOMMON).search, re.compile(LOOSE).search

    def common(text: str) -> bool:
        try:
            text.encode("latin-1")  # much faster than the pattern
        except UnicodeEncodeError:
            return not uncommon(text)
        return True

    def encode(text: str) -> bytes:
        if not common(text):
            return packed(reference.encode(text, add_special_tokens=False).ids)
        if loose(text):
            return whole(text)
        first, *rest = text.split(" ")
        return whole(first) + b"".join(map(kept.__getitem__, rest))

    return encode


def encoded(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text (null: none), without special tokens."""
    encode = encoder(path)
    for text in texts:
        yield encode(text) if text else b""
