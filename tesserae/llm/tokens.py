"""Encoding of whole texts by public vocabularies, with bounded caches of what has been encoded before.

A text is cut at single spaces, where no token of these vocabularies can run on; the pieces repeat so often that most
of them come out of a dictionary. Pieces that are not in it go through the library. The caches hold a fixed number of
entries of at most ``CACHE_CHARS`` characters, so memory does not grow with the input; a piece that was dropped or is
longer is only encoded again.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tesserae.llm.common import released_by_others

#: Entries of one generation of a worker's cache, and characters of an entry at most.
CACHE_LIMIT, CACHE_CHARS = 300_000, 64

#: Up to here, letters, digits and cases are the same in every Unicode version; other text goes to the library whole.
_PLAIN = "ɐ"


class Cache(dict):
    """A dictionary that makes what it lacks. When it is full, its entries become the old generation, from which only those used again come back."""

    def __init__(self, make, limit: int = CACHE_LIMIT):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if isinstance(key, str) and len(key) > CACHE_CHARS:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@functools.cache
def byte_map() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def mapped(piece: str, table: dict[int, str] | None = None) -> str:
    """The UTF-8 bytes of a piece, each as its printable character."""
    return piece.encode("utf-8", "replace").decode("latin-1").translate(table or byte_map())


#: Characters that split off the end of a word as a pre-token of their own.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class SpacedEncoder:
    """Byte-level vocabularies whose pre-tokens are the matches of a pattern in which only a white-space run may hold a space after its start.

    ``encode_piece`` turns one pre-token into little-endian ids. A space that has a non-space on either side starts a
    pre-token, so a text is cut there; a text with a space amid white space is matched whole.
    """

    def __init__(self, pattern: str, encode_piece, encode_text=None, dtype: str = "<u2"):
        self.dtype = dtype
        self.find, self.encode_piece, self.encode_text = regex.compile(pattern).findall, encode_piece, encode_text
        self.pieces = Cache(encode_piece)
        self.chunks = Cache(self._chunk)

    def _whole(self, text: str) -> bytes:
        if self.encode_text is not None and text and max(text) >= _PLAIN:
            return self.encode_text(text)
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _chunk(self, chunk: str) -> bytes | None:
        """What stands between two spaces, with the space before it."""
        if not chunk or chunk[0].isspace():
            return None
        if max(chunk) < _PLAIN:
            if chunk.isalpha():
                return self.encode_piece(" " + chunk)
            word = chunk.rstrip(_MARKS)
            if word.isalpha():
                return self.chunks[word] + self.pieces[chunk[len(word) :]]
        return self._whole(" " + chunk)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return self._whole(first) + b"".join(map(self.chunks.__getitem__, rest))
        except TypeError:
            return self._whole(text)

    def many(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text. What stands between two spaces is looked up once for all texts."""
        texts = texts.fill_null("")
        parts = pc.split_pattern(texts, " ")
        at, values, ends, odd = _lookup(parts, self.chunks, self.dtype, skip_first=True)
        odd = np.logical_or.reduceat(odd, at[:-1]) if len(texts) else odd
        out = []
        for k, text in enumerate(texts.to_pylist()):
            if odd[k]:
                out.append(self(text))
            else:
                out.append(self._whole(text.partition(" ")[0]) + values[ends[at[k]] : ends[at[k + 1]]].tobytes())
        return out


def _lookup(parts: pa.ListArray, chunks: Cache, dtype: str, skip_first: bool):
    """Of a list of strings for each text: offsets of the lists, the ids of all strings one after another, where those of each string begin, and which strings the cache has None for. skip_first: a text's first string gives nothing."""
    at = parts.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    found = [chunks[w] for w in coded.dictionary.to_pylist()]
    none = np.array([x is None for x in found], dtype=bool)
    found = [x or b"" for x in found]
    ids, size = np.frombuffer(b"".join(found), dtype=dtype), np.dtype(dtype).itemsize
    n_of = np.array([len(x) // size for x in found], dtype=np.int64)
    n, odd = n_of[codes], none[codes]
    if skip_first:
        n[at[:-1]], odd[at[:-1]] = 0, False
    ends = np.concatenate([[0], np.cumsum(n)])
    values = ids[np.repeat((np.cumsum(n_of) - n_of)[codes] - ends[:-1], n) + np.arange(ends[-1])]
    return at, values, ends, odd


class WordEncoder:
    """The vocabulary with word ends: white space falls away, so spaces and line ends cut the text."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, tokenizer):
        self.find = regex.compile(self.PATTERN).findall
        self.tokenizer, self.model, self.table = tokenizer, tokenizer.model, byte_map()
        self.pieces = Cache(self._piece)
        self.chunks = Cache(self._chunk)

    def _piece(self, piece: str) -> bytes:
        return packed([t.id for t in self.model.tokenize(mapped(piece, self.table))])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if max(chunk) >= _PLAIN:
            return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        lower = chunk.lower()
        if lower.isalpha():
            return self._piece(lower) if lower == chunk else self.chunks[lower]
        word = lower.rstrip(_MARKS)
        if word.isalpha():
            return self.chunks[word] + self.pieces[lower[len(word) :]]
        return b"".join(map(self.pieces.__getitem__, self.find(unicodedata.normalize("NFC", lower))))

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def many(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text; every string between spaces is looked up once for all of them."""
        parts = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        at, values, ends, _ = _lookup(parts, self.chunks, "<u2", skip_first=False)
        return [values[ends[a] : ends[b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def packed(ids: list[int]) -> bytes:
    return array("H", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u2").tobytes()


def _load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids of this vocabulary do not fit 16 bits")
    return tokenizer


@functools.lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> SpacedEncoder:
    """Encoder to 16-bit ids by a byte-level file of the tokenizers library; one per Python worker."""
    tokenizer = _load(path)
    model, table = tokenizer.model, byte_map()
    return SpacedEncoder(pattern, lambda p: packed([t.id for t in model.tokenize(mapped(p, table))]), lambda s: packed(tokenizer.encode(s, add_special_tokens=False).ids))


@functools.lru_cache(maxsize=2)
def word_level(path: str) -> WordEncoder:
    return WordEncoder(_load(path))


released_by_others(byte_level.cache_clear)
released_by_others(word_level.cache_clear)
