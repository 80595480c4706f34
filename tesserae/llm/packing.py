"""Operator 5: cost-balanced packing of tokenised documents into sequences of a fixed capacity.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``, as attention within a document costs. Documents
go in descending length to the sequence of the lowest cost among those with room for them. Whole sequences are cut off
documents that are longer than a sequence; when no sequence has room for a whole remainder, the cheapest one with
remaining room takes as much as it holds and the rest queues again. The sequences of a window hold exactly its tokens:
as many full ones as fit, and powers of two for what is left, so nothing is padded.

Windows are runs of documents of one partition, bounded in documents and tokens, so nothing is shuffled and memory does
not grow with the input; a rerun of a lost task gives the same sequences. Sequence ids are unique: the partition in the
upper bits, a counter in the lower ones.

Null text counts as empty: such a document is its end id alone. Repeated rows are documents of their own. Ties go to
the earlier document and the lower sequence. Empty tables give empty results; other columns are not carried.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tesserae.llm import tokens
from tesserae.llm.common import active, record_batch, slices

OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Bounds of a window.
WINDOW_DOCS, WINDOW_TOKENS = 4096, 8 << 20


def pack(lengths, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024):
    """Pieces (document's index, start, length, sequence, offset) of documents of these lengths; every sequence is full."""
    lengths = np.asarray(lengths, dtype=np.int64)
    full, rest = np.divmod(lengths, capacity)
    whole = np.repeat(np.arange(len(lengths)), full)
    starts = (np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)) * capacity
    pieces = [(int(d), int(s), capacity, k, 0) for k, (d, s) in enumerate(zip(whole, starts, strict=True))]
    total, base = int(rest.sum()), len(pieces)
    sizes = [capacity] * (total // capacity)
    left = total % capacity
    sizes += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    room, cost = np.array(sizes, dtype=np.int64), np.zeros(len(sizes))
    used = np.zeros(len(sizes), dtype=np.int64)
    queue = [(-int(n), int(d), int(lengths[d] - n)) for d, n in enumerate(rest) if n]
    heapq.heapify(queue)
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        at = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[at] < n:  # it fits nowhere whole
            at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            heapq.heappush(queue, (int(room[at]) - n, d, start + int(room[at])))
            n = int(room[at])
        pieces.append((d, start, n, base + at, int(used[at])))
        room[at] -= n
        used[at] += n
        cost[at] += linear * n + quadratic * n * n
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 0, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises by a byte-level vocabulary file, appends ``end_id`` to each document and packs; a row per piece, with its ids (binary, little-endian unsigned 32-bit)."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches):
        active("packing")
        encode = tokens.byte_level(vocabulary, pattern)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        ids, docs, held = [], [], 0

        def flush():
            nonlocal sequence
            pieces = pack([len(x) // 2 for x in ids], capacity, linear, quadratic)
            for k in range(0, len(pieces), 8192):
                rows = pieces[k : k + 8192]
                yield record_batch(
                    OUT, [docs[d] for d, *_ in rows], [r[1] for r in rows], [r[2] for r in rows],
                    [np.frombuffer(ids[d], "<u2")[s : s + n].astype("<u4").tobytes() for d, s, n, *_ in rows],
                    [len(ids[d]) // 2 for d, *_ in rows], [sequence + r[3] for r in rows], [r[4] for r in rows],
                )
            sequence += 1 + max((r[3] for r in pieces), default=-1)

        for part in slices(batches):
            for doc, coded in zip(part.column(0).to_pylist(), encode.many(part.column(1)), strict=True):
                ids.append(coded + end)
                docs.append(doc)
                held += len(ids[-1]) // 2
                if len(ids) >= WINDOW_DOCS or held >= WINDOW_TOKENS:
                    yield from flush()
                    ids, docs, held = [], [], 0
        if ids:
            yield from flush()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, DDL)
