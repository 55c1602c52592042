"""Token ids of whole texts by a public tokenizer, with a cache of its pieces.

The tokenizer's own normalisation and splitting rules are applied first; each
distinct piece is encoded once per Python worker by the ``tokenizers`` library.
Texts with characters for which these rules could differ between libraries, or
with a special token's string, are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The splitting pattern of word_bpe_49k.json with its letters and numbers below U+0300, and the
#: strings of its special tokens.
_LETTER, _NUMBER = ("".join(c for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == k) for k in "LN")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Below U+0300 every character is in composed form; controls, U+0130 and no-break spaces are left to the library.
_OTHER = re.compile("[^\t-\r -~\xa1-\u012f\u0131-\u02ff]")
CACHE_PIECES = 600_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Encodes lists of texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces as one text with spaces between them, which leaves each a word of its own."""
        e = self.model.encode(" ".join(pieces), add_special_tokens=False)
        ids, words = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
        cuts = np.searchsorted(words, np.arange(len(pieces) + 1))
        raw = ids.tobytes()
        for i, piece in enumerate(pieces):
            self.cache[piece] = raw[4 * cuts[i] : 4 * cuts[i + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for text in texts:
            plain = (text.isascii() and text.isprintable() or _OTHER.search(text) is None) and not ("<|" in text and any(s in text for s in _SPECIAL))
            split.append(_PIECE.findall(text.lower()) if plain else None)
        new = [p for p in set().union(*(s for s in split if s)) if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = list(set().union(*(s for s in split if s)))
        for i in range(0, len(new), 256):
            self._learn(new[i : i + 256])
        out, get = [], self.cache.__getitem__
        for text, pieces in zip(texts, split):
            out.append(self._encode([text])[0] if pieces is None else b"".join(map(get, pieces)))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that its cache outlives a task."""
    return WordTokenizer(path)


def token_count(text: Column, tokenizer_path: str | None = None) -> Column:
    """Number of tokens of each whole text; 0 for null."""
    path = tokenizer_path or default_path()

    def count(texts: pa.Array) -> pa.Array:
        encode, counts = tokenizer(path).encode, []
        for lo in range(0, len(texts), 500):
            counts += [len(x) // 4 for x in encode([t or "" for t in texts.slice(lo, 500).to_pylist()])]
        return pa.array(counts, pa.int64())

    return F.arrow_udf(count, "bigint")(text)
