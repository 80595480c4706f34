"""Operator 3: suffix-array removal of repeated byte strings.

Every byte that lies in a string of ``length`` bytes which also starts earlier (in a smaller doc_id, or before in the
same document) is removed, strings being judged on the input. Texts are UTF-8 bytes; strings never cross documents.

Not every suffix has to be sorted. Each window of ``length`` bytes has an anchor, the place of the smallest hash of
``ANCHOR`` bytes in it, leftmost on ties, so equal windows have equal anchors. Consecutive windows with one anchor are a
run. Runs are shuffled as hashes only, by the anchor's hash: of equal runs all but the first are repeats, and a run whose
anchor occurs nowhere else has none. Where different runs have the same anchor, the suffixes from their anchors on are
sorted in each task and exchanged front-coded (the length of the prefix common with the suffix before, and the rest), in
ranges by splitters from a bounded sample. Each range merges its runs with a loser tree that holds common prefix lengths,
so that no known prefix is compared again. In the merged suffix array the runs of an anchor are neighbours, and the prefix
each has in common with its neighbours tells which of its windows can occur in them at all; those are looked up in the
order of the documents.

Equal runs are folded within each batch before anything is shuffled, so a passage that a third of all documents holds is
sent a few times, not for each of them. What is kept of a document's repeats is bounded by its own length, and what a merge
keeps by ``GROUP`` runs: windows of anchors with more different surroundings are compared by their hashes instead, and
anchors that fill more than one range are dealt to several.

Null and empty texts have no bytes and no repeats. Rows with a null doc_id are left out. Rows that repeat whole are one
document and have the same result; rows of one doc_id and different texts are documents of their own, in the order of a
hash of the text. Empty tables give empty results; other columns are not
carried.
"""

from __future__ import annotations

import functools
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import active, record_batch, released_by_others, shuffle_partitions, slices, written
from tesserae.operators.order import with_position

#: The longest strings for which sizes of suffixes, 2 * length - ANCHOR at most, fit a byte.
LONGEST = 141
#: Bytes whose hash makes an anchor, bytes hashed at once, suffixes of one sorted run, suffixes sampled for splitters, and runs of one anchor that are held at once.
ANCHOR, BLOCK, RUN, SAMPLE, GROUP = 28, 2 << 20, 100_000, 20_000, 20_000
_RANDOM = np.random.default_rng(33)
_BYTE = _RANDOM.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: spot: start << 17 | windows << 9 | anchor's place in the run << 1 | whether it is a repeat
RUNS = pa.schema([("key", pa.int64()), ("text_hash", pa.int64()), ("doc_id", pa.int64()), ("spot", pa.int64())])
MARKS = pa.schema([("doc_id", pa.int64()), ("spot", pa.int64())])
#: n repeats from start; with a hash, one window that is to be compared with others by it.
REPEATS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("window", pa.int64())])
PARTS = pa.schema([("part", pa.int32()), ("common", pa.binary()), ("sizes", pa.binary()), ("rest", pa.binary()), ("left_sizes", pa.binary()), ("lefts", pa.binary()), ("doc_ids", pa.binary()), ("starts", pa.binary())])


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_INVERSE, _BASE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


released_by_others(_powers.cache_clear)


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` bytes."""
    down, up = _powers(1 << max(16, (len(data) - 1).bit_length()))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * down[: len(data)], out=total[1:])
    h = (total[width:] - total[:-width]) * up[: len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values: of each stretch of that length from the left and from the right."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, window counts, anchors and their hashes of the runs; valid: the places where a window may start."""
    if len(data) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = _hashes(data, ANCHOR)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    anchor = (_sliding_min((h & ~low) | place, length - ANCHOR + 1) & low).astype(np.int64)
    ok = valid[: len(anchor)]
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])) + 1
    begin = np.concatenate([[0], edge])
    count = np.diff(np.concatenate([begin, [len(anchor)]]))
    kept = ok[begin]
    begin, count = begin[kept], count[kept]
    return begin, count, anchor[begin], h[anchor[begin]]


def _first(doc: np.ndarray, start: np.ndarray, *groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by groups, then document and start; where a group begins in it; and which rows are later than their group's first."""
    order = np.lexsort((start, doc, *groups[::-1]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([g[order][1:] != g[order][:-1] for g in groups]) if len(order) > 1 else False
    heads = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    return order, new, (doc[order] != doc[heads]) | (start[order] != start[heads])


def _text_runs(docs: DataFrame, length: int) -> DataFrame:
    def batch_runs(ids: list, texts: list, shift: int):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        joined = b"".join(texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        valid = np.arange(len(data)) <= np.repeat(begins[1:] - length, sizes)
        begin, count, anchor, key = runs(data, valid, length)
        at = np.searchsorted(begins, begin, side="right") - 1
        view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
        text_hash = np.fromiter((digest(view[s:e]) for s, e in zip(begin.tolist(), (begin + count + (length - 1)).tolist(), strict=True)), dtype=np.uint64, count=len(begin)).view(np.int64)
        doc, start, key = np.array(ids, dtype=np.int64)[at], begin - begins[at] + shift, key.view(np.int64)
        spot = start << 17 | count << 9 | (anchor - begin) << 1
        order, new, later = _first(doc, start, key, text_hash)
        kept = new | later
        order, later = order[kept], later[kept]
        key, spot = key[order], spot[order] | later
        key[later] = doc[order][later] * 0x5851F42D + start[order][later]  # these only pass through, so they go anywhere
        return record_batch(RUNS, *map(pa.array, (key, text_hash[order], doc[order], spot)))

    def pieces(ids, texts):
        """Batches of at most BLOCK bytes; a longer text goes in parts that overlap, so that every window is in one part. Runs may break there."""
        held_ids, held, size = [], [], 0
        for i, t in zip(ids, texts, strict=True):
            t = (t or "").encode("utf-8", "replace")
            if len(t) < length:
                continue
            if size + len(t) > BLOCK and held:
                yield held_ids, held, 0
                held_ids, held, size = [], [], 0
            if len(t) > 4 * BLOCK:
                for s in range(0, len(t) - length + 1, 4 * BLOCK - length + 1):
                    yield [i], [t[s : s + 4 * BLOCK]], s
                continue
            held_ids.append(i)
            held.append(t)
            size += len(t)
        if held:
            yield held_ids, held, 0

    def run(batches):
        active("suffixes")
        for part in slices(batches, BLOCK):
            for ids, texts, shift in pieces(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield batch_runs(ids, texts, shift)

    return docs.select("doc_id", "text").mapInArrow(run, "key long, text_hash long, doc_id long, spot long")


def _judge(batches):
    """Rows in the order of key, text_hash, doc_id and spot: repeats, and the first of equal runs where other runs have its key."""
    active("suffix judge")
    waiting = None  # the last first row: key, doc, spot, whether another run has its key
    seen = None  # the last row's key and text_hash, and its first row's doc and spot
    for batch in batches:
        key, text_hash, doc, spot = (c.to_numpy() for c in batch.columns)
        repeat = (spot & 1).astype(bool)
        out_doc, out_spot = [doc[repeat]], [spot[repeat]]
        if not repeat.all():
            key, text_hash, doc, spot = (x[~repeat] for x in (key, text_hash, doc, spot))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (text_hash[1:] != text_hash[:-1])
            if seen and seen[0] == key[0] and seen[1] == text_hash[0]:
                new[0] = False
            heads = np.flatnonzero(new)
            at = np.cumsum(new) - 1
            head_doc, head_spot = np.append(doc[heads], 0)[at], np.append(spot[heads], 0)[at]
            if not new[0]:
                head_doc[at < 0], head_spot[at < 0] = seen[2], seen[3]
            later = ~new & ((doc != head_doc) | (spot != head_spot))
            out_doc.append(doc[later]), out_spot.append(spot[later] | 1)
            seen = (key[-1], text_hash[-1], head_doc[-1], head_spot[-1])
            if len(heads):
                k, d, s = (x[heads] for x in (key, doc, spot))
                shared = np.zeros(len(k), dtype=bool)
                shared[:-1] |= k[1:] == k[:-1]
                shared[1:] |= k[1:] == k[:-1]
                if waiting is not None:
                    shared[0] |= waiting[0] == k[0]
                    if waiting[3] or waiting[0] == k[0]:
                        out_doc.append(np.array([waiting[1]])), out_spot.append(np.array([waiting[2]]))
                waiting = (k[-1], d[-1], s[-1], bool(shared[-1]))
                shared[-1] = False
                out_doc.append(d[shared]), out_spot.append(s[shared])
        yield record_batch(MARKS, pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_spot)))
    if waiting is not None and waiting[3]:
        yield record_batch(MARKS, [int(waiting[1])], [int(waiting[2])])


def common_prefix(s: bytes, t: bytes, known: int = 0) -> int:
    """Bytes in common at the start, of which ``known`` are not looked at."""
    n = min(len(s), len(t))
    differ = int.from_bytes(s[known:n]) ^ int.from_bytes(t[known:n])
    return n - (differ.bit_length() + 7) // 8


def _sorted_runs(length: int, splitters: list[bytes]):
    """(doc_id, text, spots) to sorted, front-coded runs of suffixes, a row for each range."""

    def emit(held: list):
        held.sort()
        a = 0
        while a < len(held):
            part = bisect_right(splitters, held[a][0])
            b = bisect_left(held, (splitters[part],), lo=a) if part < len(splitters) else len(held)
            rows = held[a:b]
            common = [0, *(common_prefix(s[0], t[0]) for s, t in pairwise(rows))]
            yield record_batch(
                PARTS, [part], [bytes(common)], [bytes(len(r[0]) for r in rows)], [b"".join(r[0][c:] for r, c in zip(rows, common, strict=True))],
                [bytes(len(r[1]) for r in rows)], [b"".join(r[1] for r in rows)], [array("q", [r[2] for r in rows]).tobytes()], [array("i", [r[3] for r in rows]).tobytes()],
            )
            a = b

    def run(batches):
        active("suffix runs")
        held = []
        for part in slices(batches, BLOCK):
            for doc, text, spots in zip(*(c.to_pylist() for c in part.columns[:3]), strict=True):
                text = text.encode("utf-8", "replace")
                for spot in spots:
                    start, n, place = spot >> 17, spot >> 9 & 255, spot >> 1 & 255
                    held.append((text[start + place : start + n + length - 1], text[start : start + place], doc, start))
                if len(held) >= RUN:
                    yield from emit(held)
                    held = []
        if held:
            yield from emit(held)

    return run


def _decoded(common: bytes, sizes: bytes, rest: bytes, left_sizes: bytes, lefts: bytes, docs: array, starts: array):
    """The suffixes of a front-coded run: (common with the one before, suffix, what stands before it, doc, start)."""
    text, at, left = b"", 0, 0
    for c, n, m, d, s in zip(common, sizes, left_sizes, docs, starts, strict=True):
        text = text[:c] + rest[at : at + n - c]
        at += n - c
        yield c, text, lefts[left : left + m], d, s
        left += m


def merge(sources: list):
    """Merges sorted sources of (common with the one before, suffix, ...) by a loser tree with common prefix lengths.

    Yields (common with the one yielded before, item). A node holds the source that lost there and how many bytes
    it has in common with the winner that passed; two that have different counts in common with the last winner are told
    apart by these alone, and equal counts are compared from there on.
    """
    k = 1
    while k < len(sources):
        k *= 2
    nexts = [iter(s).__next__ for s in sources] + [None] * (k - len(sources))
    current: list = [None] * k

    def advance(i):
        try:
            current[i] = nexts[i]() if nexts[i] else None
        except StopIteration:
            current[i] = None

    for i in range(k):
        advance(i)
    shared = [0] * k  # bytes in common with the last suffix yielded
    losers, node_shared = [0] * k, [0] * k

    def play(a, b):
        """(winner, loser), after which shared[loser] is what it has in common with the winner."""
        x, y = current[a], current[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        h = shared[a]
        s, t = x[1], y[1]
        common = common_prefix(s, t, h)
        if common == len(s) or common < len(t) and s[common] < t[common]:
            shared[b] = common
            return a, b
        shared[a] = common
        return b, a

    def build(node):
        if node >= k:
            return node - k
        winner, loser = play(build(2 * node), build(2 * node + 1))
        losers[node], node_shared[node] = loser, shared[loser]
        return winner

    winner = build(1) if k > 1 else 0
    last = 0
    while current[winner] is not None:
        yield last, current[winner]
        advance(winner)
        # a suffix that follows in its own source has in common with the last one what the source says
        shared[winner] = current[winner][0] if current[winner] is not None else 0
        node = (winner + k) // 2
        while node >= 1:
            other = losers[node]
            shared[other] = node_shared[node]
            winner, loser = play(winner, other)
            losers[node], node_shared[node] = loser, shared[loser]
            node //= 2
        last = shared[winner]


def window_repeats(group: list, length: int):
    """Of the runs of one anchor, (suffix, left, doc, start, longest prefix in common with a neighbour): repeats as (doc, start, n)."""
    seen: set[int] = set()
    digest = xxhash.xxh3_64_intdigest
    before = None
    for suffix, left, doc, start, common in sorted(group, key=lambda r: (r[2], r[3])):
        if (doc, start) == before:  # a row that repeats whole
            continue
        before, text, begin = (doc, start), left + suffix, -1
        # a window that takes more of the suffix than any neighbour shares is nowhere else
        last = min(len(text) - length, len(left) + common - length)
        for k in range(last + 1):
            h = digest(text[k : k + length])
            if h in seen:
                if begin < 0:
                    begin = k
            else:
                seen.add(h)
                if begin >= 0:
                    yield doc, start + begin, k - begin
                    begin = -1
        if begin >= 0:
            yield doc, start + begin, last + 1 - begin


def open_windows(suffix: bytes, left: bytes, doc: int, start: int, common: int, length: int):
    """The windows of one run that can be elsewhere, as (doc, start, 1, hash): those that take no more of the suffix than ``common``, what a neighbour shares."""
    text = left + suffix
    for k in range(min(len(text) - length, len(left) + common - length) + 1):
        yield doc, start + k, 1, xxhash.xxh3_64_intdigest(text[k : k + length]) - (1 << 63)


def _merge_range(length: int, frequent: frozenset[bytes]):
    """Merges the sorted runs of a range and compares the runs of each anchor with each other.

    Runs of ``frequent`` anchors, which lie in several ranges, and of those with more than GROUP runs are not held: their
    windows go on to be compared by hash. A range's first and last suffix may share more with one of another range.
    """

    def run(batches):
        active("suffix merge")
        sources, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                sources.append(_decoded(*row[:5], array("q", row[5]), array("i", row[6])))
        group: list = []  # runs of one anchor, each with the longest prefix in common with a neighbour
        passing, first = False, True

        def let_go(n):
            for g in group[:n]:
                out.extend(open_windows(*g, length))
            del group[:n]

        def close(last):
            if passing:
                if last:
                    group[-1] = (*group[-1][:4], 2 * length)
                let_go(len(group))
            elif len(group) > 1:
                out.extend((*r, None) for r in window_repeats(group, length))
            group.clear()

        for common, (_, suffix, left, doc, start) in merge(sources):
            if common < ANCHOR or not group:
                if group:
                    close(False)
                passing, common = suffix[:ANCHOR] in frequent, 2 * length if first else 0
            elif common > group[-1][4]:
                group[-1] = (*group[-1][:4], common)
            first = False
            group.append((suffix, left, doc, start, common))
            passing = passing or len(group) > GROUP
            if passing:
                let_go(len(group) - 1)  # the last one's next neighbour is to come
            if len(out) >= 65536:
                yield record_batch(REPEATS, *map(list, zip(*out, strict=True)))
                out.clear()
        if group:
            close(True)
        if out:
            yield record_batch(REPEATS, *map(list, zip(*out, strict=True)))

    return run


def covered(places: list, length: int) -> np.ndarray:
    """Maximal intervals (begin, end) that windows starting at (start, n) cover."""
    begin = np.array([p["start"] for p in places], dtype=np.int64)
    end = begin + np.array([p["n"] for p in places], dtype=np.int64) + length - 1
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return np.stack([begin[first], reach[np.concatenate([first[1:] - 1, [len(begin) - 1]])]], axis=1)


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs (doc_id, text; in partitions by doc_id) to (doc_id, start, n): a window that repeats an earlier one starts at each of n places from start."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    sorted_runs = _text_runs(docs, length).repartition(parts, "key").sortWithinPartitions("key", "text_hash", "doc_id", "spot")
    marks = written(sorted_runs.mapInArrow(_judge, "doc_id long, spot long"))
    is_repeat = F.col("spot").bitwiseAND(F.lit(1)) == 1
    open_runs = marks.filter(~is_repeat)
    total = open_runs.count()
    done = marks.filter(is_repeat).select("doc_id", F.shiftright("spot", 17).cast("int").alias("start"), F.shiftright("spot", 9).bitwiseAND(F.lit(255)).cast("int").alias("n"))
    if not total:
        return done
    share = min(1.0, SAMPLE / total)
    sample = open_runs.filter(F.pmod(F.xxhash64("doc_id", "spot"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE)
    texts = docs.join(F.broadcast(sample), "doc_id")

    def heads(batches):
        for batch in batches:
            out = []
            for text, spot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = (spot >> 17) + (spot >> 1 & 255)
                out.append(text.encode("utf-8", "replace")[at : at + length])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["head"])

    found = sorted(r["head"] for r in texts.select("text", "spot").mapInArrow(heads, "head binary").toLocalIterator())
    return done.union(compared(docs.repartition(parts, "doc_id"), open_runs, *ranges(found, parts, total), length))


def ranges(heads: list[bytes], parts: int, total: int) -> tuple[list[bytes], frozenset[bytes]]:
    """Splitters of about so many ranges by sorted heads of some of ``total`` suffixes, and the anchors that lie in several ranges: those that fill more than one and have more than GROUP suffixes. All others are in one."""
    picked = [heads[k * len(heads) // parts] for k in range(1, parts)] if heads else []
    times = Counter(h[:ANCHOR] for h in picked)
    frequent = frozenset(a for a, n in times.items() if n > 1 and n * total > GROUP * parts)
    return sorted({h if h[:ANCHOR] in frequent else h[:ANCHOR] for h in picked}), frequent


def compared(docs: DataFrame, open_runs: DataFrame, splitters: list[bytes], frequent: frozenset[bytes], length: int) -> DataFrame:
    """(doc_id, start, n) of the repeats among runs that have their anchors in common."""
    spots = open_runs.groupBy("doc_id").agg(F.collect_list("spot").alias("spots"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]  # read as well, so that the exchange is that of the last join
    coded = docs.join(spots, "doc_id").select("doc_id", "text", "spots", *rest).mapInArrow(_sorted_runs(length, splitters), "part int, common binary, sizes binary, rest binary, left_sizes binary, lefts binary, doc_ids binary, starts binary")
    found = written(coded.repartitionById(len(splitters) + 1, F.coalesce("part", F.lit(0))).mapInArrow(_merge_range(length, frequent), "doc_id long, start int, n int, window long"))
    windows = found.filter("window is not null").select("window", F.struct("doc_id", "start").alias("at"))
    first = windows.groupBy("window").agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1")
    later = windows.join(first, "window").filter("at <> first").select("at.doc_id", "at.start", F.lit(1).alias("n"))
    return found.filter("window is null").select("doc_id", "start", "n").union(later)


def repeated_places(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, places (array of start and n: a window that repeats an earlier one starts at each of n bytes from start; null if there is none) and carried (struct of these columns, where there are some) of every row with an id. length: ANCHOR to LONGEST bytes."""
    if not ANCHOR <= length <= LONGEST:
        raise ValueError(f"length must be from {ANCHOR} to {LONGEST}")
    carried = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *carried).filter("doc_id is not null")
    marked = docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    if marked.groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("a <> b").isEmpty():
        return _placed(docs, length)
    numbered = written(with_position(marked.select("doc_id", "mark").distinct(), "doc_id", "mark"))
    placed = _placed(marked.join(numbered, ["doc_id", "mark"]).withColumn("doc_id", F.col("position")).select(docs.columns), length)
    return placed.withColumnRenamed("doc_id", "position").join(numbered, "position").select(*docs.columns, "places")


def _placed(docs: DataFrame, length: int) -> DataFrame:
    dealt = docs.repartition(shuffle_partitions(docs.sparkSession), "doc_id")  # the same exchange as that of compared()
    places = repeats(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    return dealt.join(places, "doc_id", "left")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of begin and end, in bytes) and kept (binary: the remaining bytes) of every row with an id; see repeated_places()."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def cut(batches):
        active("suffix cut")
        for part in slices(batches):
            sizes, spans, kept = [], [], []
            for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                at, out, mine = 0, [], []
                for begin, end in covered(found, length).tolist() if found else []:
                    out.append(data[at:begin])
                    mine.append({"begin": begin, "end": end})
                    at = end
                sizes.append(len(data)), spans.append(mine), kept.append(b"".join([*out, data[at:]]))
            yield record_batch(schema, part.column(0), sizes, spans, kept)

    return repeated_places(docs, length, id_col, text_col).select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
