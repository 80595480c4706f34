"""The two classifiers against plain versions that share nothing with them but their fixed numbers: every row of the smallest tables."""

import math
import re
import struct
import zlib

import numpy as np
import xxhash
import zstandard

from tesserae.llm import quality, queries
from tesserae.llm.common import held_out

SF = "/root/testdata/sf0.001"


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def spark_hash(i, seed=42):
    """Of a long, as a number without sign."""
    return xxhash.xxh64(struct.pack("<q", i), seed=seed).intdigest()


# languages


def letters(text):
    low = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower())
    return " ".join(x for x in re.split("[ ]+", low) if x)


def code_length(text, known):
    """Bits of a text, character by character, from the sequences of up to four characters in the known text."""
    known, text, bits = " " + known, " " + text + " ", 0.0
    for k in range(1, len(text)):
        p = 1 / 256
        for n in range(min(3, k) + 1):
            after, before = text[k - n : k + 1], text[k - n : k]
            count = lambda s: sum(known.startswith(s, j) for j in range(len(known) - len(s) + 1)) if s else len(known)
            p = (count(after) + 2 * p) / (count(before) + 2)
        bits -= math.log2(p)
    return bits


def test_language_of_every_row(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    samples = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and not is_held_out(i):
            start = max(1, int(len(text) / 2 - 1000))
            u = spark_hash(i) % (1 << 64)
            u = (u - (1 << 64) if u >> 63 else u) % (1 << 30)
            samples.setdefault(lang, []).append((u, text[start - 1 : start + 1999]))
    known = {lang: b" ".join(letters(t).encode() for _, t in sorted(texts))[:256_000].strip() for lang, texts in samples.items()}
    coders = {lang: zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(k, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for lang, k in known.items()}
    got, ties = {r["doc_id"]: r for r in queries.op9_language(spark, SF).collect()}, 0
    assert len(got) == len(rows)
    for i, text, _ in rows:
        plain = letters(text or "").encode()
        assert got[i]["held_out"] == is_held_out(i)
        if not plain:
            assert got[i]["lang_pred"] == "und"
            continue
        sizes = {lang: sum(len(c.compress(plain[k : k + 262_144])) for k in range(0, len(plain), 262_144)) for lang, c in coders.items()}
        best = min(sizes.values())
        tied = [lang for lang in sizes if sizes[lang] == best]
        if len(tied) > 1:
            ties += 1
            bits = {lang: code_length(plain.decode(), known[lang].decode("utf-8", "replace")) for lang in tied}
            sizes |= {lang: best + min(0.99, (bits[lang] - min(bits.values())) / 8) for lang in tied}
        first, second = sorted((s, lang) for lang, s in sizes.items())[:2]
        assert got[i]["lang_pred"] == first[1]
        assert math.isclose(got[i]["score"], 1 / sum(math.exp(-100 * (s - best) / best) for s in sizes.values()), rel_tol=1e-6)
        assert got[i]["accepted"] == (second[0] - best >= max(0.003 * best, 1 / 8))
    assert ties < 5


# quality


def tokens_of(text):
    return re.findall(r"\w+|[^\w\s]+|\n", text)


def kind(token):
    if not (token[0].isalnum() or token[0] == "_"):
        return f"\0mark{token[0]}{min(len(token), 4)}"
    name = "digit" if re.search(r"\d", token) or any(c.isdigit() for c in token) else "upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower"
    return f"\0{name}{min(len(token) // 4, 4)}"


def about(tokens):
    n, again = len(tokens), sum(a == b for a, b in zip(tokens, tokens[1:]))
    size = n.bit_length()
    return [f"\0length{size}", f"\0again{int(20 * again / n) if n else 0}", f"\0distinct{min(size, 8)}:{int(12 * len(set(tokens)) / n) if n else 0}"]


def index_vector(word):
    out = np.zeros(96)
    for k in range(1, 7):
        h = (zlib.crc32(word.encode()) + (k << 33)) % 2**64
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * odd % 2**64
        h ^= h >> 31
        out[h % 96] += (1 if h >> 63 else -1) / 6**0.5
    return out


def test_quality_of_every_row(spark):
    """Vectors by counting neighbours word for word, documents by averaging, scores by the network's two layers one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_on_tables(docs, labels, ~held_out())
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    learned = [r["doc_id"] for r in labels.filter("quality in (0, 1)").select("doc_id").distinct().collect() if not is_held_out(r["doc_id"]) and texts.get(r["doc_id"]) is not None]
    streams, counts = [], {}
    for i in learned:
        tokens = tokens_of(texts[i])
        for stream, near in (([t.lower() for t in tokens], True), ([kind(t) for t in tokens], True), (about(tokens), False)):
            for w in stream:
                counts[w] = counts.get(w, 0) + 1
            if near:
                streams.append(stream)
    known = {w for w, n in counts.items() if n >= 4}
    assert set(model.rows) == known
    own = {w: index_vector(w) for w in known}
    sums = {w: np.zeros(96) for w in known}
    for stream in streams:
        for k, w in enumerate(stream):
            if w in known:
                for other in stream[max(0, k - 2) : k] + stream[k + 1 : k + 3]:
                    if other in known:
                        sums[w] += own[other]
    vectors = {w: own[w] + sums[w] / max(np.linalg.norm(sums[w]), 1e-6) for w in known}
    assert all(np.allclose(model.vectors[k], vectors[w], atol=1e-3) for w, k in model.rows.items())
    none = np.zeros(96)
    w1, b1, w2, b2, mean, scale = model.layers
    for r in quality.score(docs, model).collect():
        tokens = tokens_of(texts[r["doc_id"]] or "")
        parts = [np.mean([vectors.get(f(t), none) for t in tokens], axis=0) if tokens else none for f in (str.lower, kind)]
        x = np.concatenate([*parts, sum(vectors.get(w, none) for w in about(tokens))])
        hidden = [max(0.0, float(((x - mean) / scale) @ w1[:, j] + b1[j])) for j in range(len(b1))]
        z = (sum(h * w for h, w in zip(hidden, w2)) + b2[0]) / model.temperature
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-60, min(60, z)))), abs_tol=2e-3)
