"""Operator 9: language identification by compression.

Each language has a zstandard raw-content dictionary of sample text. All of a text is compressed with every dictionary,
in parts of ``PART_BYTES`` that know nothing of each other; the language whose dictionary gives the smallest sum is
chosen, and the result is rejected when the runner-up comes too close. Without parts a long text's own history would
take the dictionary's place, and the lead over the runner-up would stop growing with the text. Sizes that tie, as those of a
few words often do, are told apart by fractions of a byte: the text's code length under the sequences of up to four
characters in each dictionary. Texts of any length are rejected by the same rule. Case, digits and ASCII marks are taken out first, since they say nothing of a language.

The dictionaries are fitted on a bounded sample of the labelled rows: ``rows_per_lang`` rows of each language, chosen by
a hash of the id, ``chars_per_row`` characters of each and ``dictionary_bytes`` in all. The number of languages is
assumed to be small: their names and counts are gathered on the driver. Prediction looks at nothing but the whole text
and needs no shuffle.

Null text and text without a letter is ``und`` with score 0 and rejected. Where the fractions tie too, the first
language by name is named, with an even score, and rejected. Rows of a null lang are not learned from, nor is a language whose sample has no letter; one word is enough. Without any labelled row everything is ``und``. Empty tables
give empty results; repeated rows are predicted each; other columns are not carried.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import active, record_batch, released_by_others, slices

OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
_LETTERS = bytes.maketrans(bytes(range(128)), bytes(b if chr(b).isalpha() else 32 for b in range(128)))
LEVEL = 6
PART_BYTES = 1 << 18
#: A text is rejected when the next language needs less than this share more, or less than a bit.
NARROW_MARGIN, NARROW_BYTES = 0.003, 1 / 8
#: Longest sequence of characters that is counted for the code lengths.
ORDER = 4


def normalized(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def dictionaries(docs: DataFrame, learn_from, rows_per_lang: int = 2000, chars_per_row: int = 2000, dictionary_bytes: int = 256_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Sample text of each language from the rows for which the column ``learn_from`` holds."""
    rows = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = functools.reduce(lambda c, kv: c.when(F.col("lang") == kv[0], min(1.0, 1.2 * rows_per_lang / kv[1])), sorted(counts.items()), F.when(F.lit(False), 0.0))
    # the middle of a text, where it says more than at its start
    start = F.greatest(F.lit(1), (F.length("text") / 2 - chars_per_row / 2).cast("int"))
    sample = rows.filter(F.col("u") < share).select("lang", "u", F.substring(F.col("text"), start, F.lit(chars_per_row)).alias("text"))
    texts: dict[str, list] = {}
    for r in sample.toLocalIterator():
        texts.setdefault(r["lang"], []).append((r["u"], r["text"]))
    out = {}
    for lang in sorted(texts):
        held, size = [], 0
        for _, text in sorted(texts[lang])[:rows_per_lang]:
            held.append(normalized(text))
            size += len(held[-1]) + 1
            if size >= dictionary_bytes:
                break
        out[lang] = b" ".join(held)[:dictionary_bytes].strip()
    # zstandard takes no notice of a dictionary of less than 8 bytes
    return {lang: b" ".join([text] * -(-8 // len(text))) for lang, text in out.items() if text}


class _Coder:
    """Sizes of texts under one dictionary."""

    def __init__(self, text: bytes):
        content = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        self._text = text
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, plain: bytes) -> int:
        return sum(len(self._zstd.compress(plain[k : k + PART_BYTES])) for k in range(0, len(plain), PART_BYTES))

    @functools.cached_property
    def _counts(self) -> list[Counter]:
        """Of the sequences of 0 to ORDER characters; made when first needed."""
        known = " " + self._text.decode("utf-8", "replace")
        return [Counter({"": len(known)}), *(Counter(known[k : k + n] for k in range(len(known) - n + 1)) for n in range(1, ORDER + 1))]

    def bits(self, plain: bytes) -> float:
        """Code length, each character after up to ORDER - 1 others, shorter sequences standing in for longer ones."""
        counts, framed, out = self._counts, f" {plain.decode('utf-8', 'replace')} ", 0.0
        for k in range(1, len(framed)):
            p = 1 / 256
            for n in range(min(ORDER - 1, k) + 1):
                p = (counts[n + 1][framed[k - n : k + 1]] + 2 * p) / (counts[n][framed[k - n : k]] + 2)
            out -= math.log2(p)
        return out


@functools.lru_cache(maxsize=4)
def _compressors(texts: tuple[tuple[str, bytes], ...]) -> list:
    return [(lang, _Coder(text)) for lang, text in texts]


released_by_others(_compressors.cache_clear)


def classify(text: str | None, compressors: list) -> tuple[str, float, bool]:
    """Language, score and whether it is accepted."""
    if not text or not compressors or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    plain = normalized(text) or text.encode("utf-8", "replace")
    sizes = sorted((c.size(plain), lang) for lang, c in compressors)
    best = sizes[0][0]
    tied = [lang for s, lang in sizes if s == best]
    # beyond that size a fraction of a byte could not lift the rejection
    if len(tied) > 1 and NARROW_MARGIN * best < 1:
        bits = {lang: c.bits(plain) for lang, c in compressors if lang in tied}
        least = min(bits.values())
        sizes = sorted((s + min(0.99, (bits[lang] - least) / 8) if lang in bits else s, lang) for s, lang in sizes)
    score = 1 / sum(math.exp(-100 * (s - best) / best) for s, _ in sizes)
    narrow = len(sizes) > 1 and sizes[1][0] - best < max(NARROW_MARGIN * best, NARROW_BYTES)
    return sizes[0][1], score, not narrow


def identify(docs: DataFrame, texts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and accepted for every row."""
    fixed = tuple(sorted(texts.items()))

    def run(batches):
        active("language")
        compressors = _compressors(fixed)
        for part in slices(batches):
            rows = [classify(t, compressors) for t in part.column(1).to_pylist()]
            yield record_batch(OUT, part.column(0), *([r[k] for r in rows] for k in range(3)))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
