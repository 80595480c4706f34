"""Operator 6: near duplicates by an inverted join on signature coordinates.

A document's set is its distinct word shingles, hashed to 64 bits. Equal sets are folded into one representative first.
Each representative is posted under its ``COORDINATES`` (coordinate, minimum) pairs. Two sets of the wanted similarity
share at least ``matches`` pairs, a number that follows from the similarity, but for a chance of ``LOSS`` at most (from
58 % on; below, one pair is wanted and the chance is (1 - similarity)^24). The pairs of a document are ordered
from rare to frequent; pairs that nobody shares are skipped, a document with fewer shared ones than wanted falls out, and
the rest need to be posted only under the prefix of that order which two documents with so many common pairs must meet in.

The documents of a posting list meet its first one, the hub, and those above the match threshold are confirmed on the
full sets. That connects what most groups of copies have, at one comparison for each document and list. Lists whose
documents are connected are then skipped, and so are all but one of equal lists. In what is left the collisions of
documents of different groups are counted, each pair in the one of its common lists that has the smallest key, and skipped
in the others; further coordinates of a byte each, as ``matches`` of FINE, tell most pairs that are not similar enough, and the
rest are confirmed on the full sets unless they are connected already. Large lists go in pairs of blocks of bounded size,
first with signatures only, and a pair of blocks returns a forest of its links, never all pairs of a group. Where more than
a block of a list is outside its largest connected group, as of documents that share a passage and no more, all documents of
the list are posted under bands of further coordinates instead, of which a pair of the wanted similarity shares one but for a
chance of LOSS at most; few others do. The lists of bands are treated as the others are, whatever their size.

Null text, empty text and text without a word has an empty set and is linked with nothing; a text with fewer words than a
shingle has its whole sequence as its only shingle. Repeated rows and ties of any kind are settled by the smallest doc_id;
rows with a null doc_id are left out. Texts count whole, however long. Empty tables give empty results; other columns are not carried.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import active, record_batch, shared_dir, shuffle_partitions, slices, written
from tesserae.llm.graph import components

COORDINATES, LOSS = 24, 1e-9
#: Documents and shingles of one block at most, and documents that meet a hub in one part (in the mean: they are dealt by a hash).
BLOCK_DOCS, BLOCK_SHINGLES, HUB_PART = 512, 2_000_000, 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Further coordinates, of a byte each, by which pairs that collide are judged before their sets are compared.
FINE = 256
_RANDOM = np.random.default_rng(20)
_SALT = _RANDOM.integers(0, 1 << 63, COORDINATES).astype(np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, COORDINATES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_SALT = _RANDOM.integers(0, 1 << 63, FINE).astype(np.uint64)
_FINE_ODD = _RANDOM.integers(0, 1 << 63, FINE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("signature", pa.list_(pa.int64()))])
SETS = pa.schema([("doc_id", pa.int64()), ("items", pa.binary()), ("fine", pa.binary())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def matches(percent: int, of: int = COORDINATES) -> int:
    """The most coordinates, of so many, that two sets of this similarity share but for a chance of LOSS; at least one."""
    p, lost = percent / 100, 0.0
    for n in range(of):
        lost += math.comb(of, n) * p**n * (1 - p) ** (of - n)
        if lost > LOSS:
            return max(1, n)
    return of


#: At the 85 % of the query.
MATCHES = matches(85)


def bands(percent: int) -> tuple[int, int]:
    """How many bands, of how many further coordinates: the widest of which two sets of this similarity share one, but for a chance of LOSS at most. (0, 0): there are too few coordinates."""
    p = min(percent, 99) / 100
    for width in range(FINE, 0, -1):
        n = FINE // width
        if n * math.log1p(-(p**width)) <= math.log(LOSS):
            return math.ceil(math.log(LOSS) / math.log1p(-(p**width))), width
    return 0, 0


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set's hashes, ascending. A-Z are lower-cased; words are cut at space and U+0009 to U+000D."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)  # shorter sequences are other shingles
    for k in range(width):
        out = _mixed(out + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    if len(items) <= 4096:  # all coordinates at once
        return ((items[None] ^ _SALT[:, None]) * _ODD[:, None]).min(1)
    return np.array([((items ^ s) * a).min() for s, a in zip(_SALT, _ODD, strict=True)], dtype=np.uint64)


def fine_signature(items: np.ndarray) -> np.ndarray:
    """The top byte of the mixed minimum of each further coordinate: equal for two sets with their similarity, and by chance for one in 256 of the rest."""
    least = np.full(FINE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(items), 2048):
        least = np.minimum(least, ((items[None, k : k + 2048] ^ _FINE_SALT[:, None]) * _FINE_ODD[:, None]).min(1))
    return (_mixed(least) >> np.uint64(56)).astype(np.uint8)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("doc_id is not null")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        active("minhash")
        for part in slices(batches):
            sets = [shingles(t, words) for t in part.column(1).to_pylist()]
            yield record_batch(SIGNED, part.column(0), [len(s) for s in sets], [xxhash.xxh128_digest(s.tobytes()) for s in sets], [signature(s).view(np.int64) if len(s) else None for s in sets])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int, folder: str) -> DataFrame:
    """(doc_id, items, fine) of the documents with these ids; written, with the ids, so that few ids are sent to the texts instead of the texts to them."""

    def run(batches):
        active("minhash sets")
        for part in slices(batches):
            sets = [shingles(t, words) for t in part.column(1).to_pylist()]
            yield record_batch(SETS, part.column(0), [s.tobytes() for s in sets], [fine_signature(s).tobytes() for s in sets])

    return written(docs.join(written(ids.distinct(), folder), "doc_id", "left_semi").mapInArrow(run, "doc_id long, items binary, fine binary"), folder)


def _prefixes(reps: DataFrame, wanted: int, folder: str) -> DataFrame:
    """(doc_id, n_shingles, signature, keys): the prefix of each document that can have a link, its rarest shared coordinate-value pairs."""
    posts = reps.select("doc_id", F.posexplode("signature").alias("at", "value")).select("doc_id", F.xxhash64("at", "value").alias("key"))
    # read from files, so that adaptive execution can split a frequent pair between tasks
    counts = written(posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), folder)
    shared = posts.join(counts, "key").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    prefix = F.transform(F.slice("keys", F.lit(1), F.size("keys") - (wanted - 1)), lambda k: k["key"])
    return written(shared.filter(F.size("keys") >= wanted).select("doc_id", prefix.alias("keys")).join(reps.select("doc_id", "n_shingles", "signature"), "doc_id"), folder)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the similarity of two sets, of ascending hashes, is at least this."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """The links (u, v) among pairs (hub, part, doc_id) by their full sets. The members of a part stream past its hub."""
    pairs = written(pairs, folder)
    sets = _sets(docs, pairs.select("doc_id").union(pairs.select("hub")), words, folder)
    members = pairs.select("hub", "part", F.lit(1).alias("side"), "doc_id").join(sets, "doc_id")
    firsts = pairs.select("hub", "part").distinct().select("hub", "part", F.lit(0).alias("side"), F.col("hub").alias("doc_id")).join(sets, "doc_id")
    dealt = members.unionByName(firsts).select("hub", "part", "side", "doc_id", "items")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "side")

    def run(batches):
        active("minhash hubs")
        first = None
        for batch in slices(batches, column=4):
            out = ([], [])
            for hub, _, side, doc, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items = np.frombuffer(items, dtype=np.uint64)
                if not side:
                    first = items
                elif _linked(items, first, percent):
                    out[0].append(doc)
                    out[1].append(hub)
            if out[0]:
                yield record_batch(LINKS, *out)

    return dealt.mapInArrow(run, "u long, v long")


def _hub_pairs(prefixes: DataFrame, percent: int, folder: str) -> DataFrame:
    """(hub, part, doc_id): the documents of each posting list that collide often enough with the list's first one, its hub. They stream past the hub's signature, in parts of bounded size."""
    wanted, posts = matches(percent), prefixes.select("doc_id", F.explode("keys").alias("key"))
    hubs = written(posts.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1"), folder)
    parts = lambda n: F.ceil(n / HUB_PART).cast("int")
    marks = prefixes.select("doc_id", "n_shingles", "signature")
    pairs = posts.join(hubs, "key").filter("doc_id <> hub").groupBy("hub", "doc_id").agg(F.max("n").alias("n"))
    members = pairs.select("hub", F.pmod(F.xxhash64("doc_id"), parts(F.col("n"))).cast("int").alias("part"), F.lit(1).alias("side"), "doc_id").join(marks, "doc_id")
    firsts = hubs.groupBy("hub").agg(F.max("n").alias("n")).select("hub", F.explode(F.sequence(F.lit(0), parts(F.col("n")) - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("doc_id")).join(marks, "doc_id")
    dealt = members.unionByName(firsts).select("hub", "part", "side", "doc_id", "n_shingles", "signature")
    dealt = dealt.repartition(shuffle_partitions(prefixes.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "side")

    def run(batches):
        active("minhash hubs")
        first = None  # signature and size of the hub
        for batch in batches:
            if not batch.num_rows:
                continue
            side, sizes, signs = batch.column(2).to_numpy(), batch.column(4).to_numpy(), _signs(batch.column(5))
            # the hub of each row is the last one before it
            at = np.maximum.accumulate(np.where(side == 0, np.arange(1, len(side) + 1), 0))
            if first is None:
                first = signs[:1], sizes[:1]
            signs_of, sizes_of = np.concatenate([first[0], signs])[at], np.concatenate([first[1], sizes])[at]
            near = (side == 1) & ((signs == signs_of).sum(1) >= wanted) & (100 * np.minimum(sizes, sizes_of) >= percent * np.maximum(sizes, sizes_of))
            first = signs_of[-1:], sizes_of[-1:]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1, 3)], names=["hub", "part", "doc_id"])

    return dealt.mapInArrow(run, "hub long, part int, doc_id long")


def _signs(column) -> np.ndarray:
    """Signatures of an Arrow list column as rows."""
    return column.flatten().to_numpy().reshape(len(column), COORDINATES)


def _share(keys: np.ndarray) -> np.ndarray:
    """Which rows have a value in common that is not the greatest of all."""
    n, values = len(keys), np.unique(keys, return_inverse=True)
    at = values[1].reshape(keys.shape)
    common = np.flatnonzero(np.bincount(at.ravel(), minlength=len(values[0]))[:-1] > 1)  # in a row each value is there once
    column = np.full(len(values[0]), -1)
    column[common] = np.arange(len(common))
    out = np.zeros((n, n), dtype=bool)
    for k in range(0, len(common), 1024):
        held = (column[at] >= k) & (column[at] < k + 1024)
        has = np.zeros((n, min(1024, len(common) - k)), dtype=np.float32)
        has[np.nonzero(held)[0], column[at][held] - k] = 1
        out |= has @ has.T > 0
    return out


def _keys(column) -> np.ndarray:
    """Key lists as rows, filled up with the greatest number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), sizes.max(initial=1)), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _collisions(percent: int, key: int, marks, sizes, labels, side, inside: bool, keys):
    """For each document of a posting list's pair of blocks that has some, the earlier ones that it collides with often enough: (place, places).

    Pairs are skipped that are connected, of sizes too different, or met in a list of a smaller key: every pair is counted
    in one list. (Of a pair of different blocks only those of different sides are looked at.)
    """
    wanted = matches(percent)
    met = (labels[:, None] != labels) & (100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes))
    if not inside:
        met &= side[:, None] != side
    if met.any():
        met &= ~_share(np.where(keys < key, keys, key))
    for i in np.flatnonzero(met.any(1)):
        of = np.flatnonzero(met[i, :i])
        of = of[(marks[of] == marks[i]).sum(1) >= wanted]
        if len(of):
            yield i, of


def _colliding(percent: int):
    """Of the rows of pairs of blocks, in their order, those that collide often enough with one of another group."""

    def run(batches):
        active("minhash lists")
        held = []  # of the last group, which may go on
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            of = np.stack([table.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist()]
            whole = table.slice(0, cuts[-1])
            held = table.slice(cuts[-1]).to_batches()
            if whole.num_rows:
                yield from judged(whole, cuts)
        if held:
            table = pa.Table.from_batches(held)
            yield from judged(table, [0, table.num_rows])

    def judged(table, cuts):
        table = table.combine_chunks()
        marks, keys, key = _signs(table.column("signature").chunk(0)), _keys(table.column("keys").chunk(0)), table.column("key").to_numpy()
        sizes, labels, side, inside = (table.column(c).to_numpy() for c in ("n_shingles", "label", "side", "inside"))
        kept = np.zeros(len(key), dtype=bool)
        for a, b in pairwise(cuts):
            for i, of in _collisions(percent, key[a], marks[a:b], sizes[a:b], labels[a:b], side[a:b], inside[a], keys[a:b]):
                kept[a + i] = kept[a + of] = True
        yield from table.filter(pa.array(kept)).to_batches()

    return run


def _forest(percent: int):
    """Links between documents of different groups in a pair of blocks, as few as connect what they connect."""
    fine_wanted = matches(percent, FINE)

    def links(table: pa.Table) -> pa.Table:
        active("minhash links")
        table = table.sort_by("doc_id")
        ids, sizes, side, group = (table.column(c).to_numpy() for c in ("doc_id", "n_shingles", "side", "label"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("items").to_pylist()]
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), dtype=np.uint8).reshape(-1, FINE)
        marks, keys = _signs(table.column("signature").combine_chunks()), _keys(table.column("keys"))
        first = np.unique(group, return_index=True, return_inverse=True)
        parent = first[1][first[2]].tolist()

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        found = ([], [])
        for i, near in _collisions(percent, table.column("key")[0].as_py(), marks, sizes, group, side, table.column("inside")[0].as_py(), keys):
            same = (fine[near] == fine[i]).sum(1)
            near, same = near[same >= fine_wanted], same[same >= fine_wanted]
            for j in near[np.argsort(-same, kind="stable")].tolist():
                if root(i) != root(j) and _linked(sets[i], sets[j], percent):
                    parent[root(i)] = root(j)
                    found[0].append(ids[i])
                    found[1].append(ids[j])
        return pa.table([pa.array(x, pa.int64()) for x in found], schema=LINKS)

    return links


def _lists(prefixes: DataFrame, known: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, n_shingles, label): what posting lists hold; and (key, main, mains, others): the lists to be compared, their largest connected group and the blocks of it and of the rest.

    A list whose documents ``known`` (node, component) connects is skipped, and so is one of the same documents as another.
    """
    posts = prefixes.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    held = posts.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("label"))
    held = written(held, folder)
    groups = held.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    lists = groups.groupBy("key").agg(F.max(F.struct("n", "label", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("labels"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("labels > 1")
    lists = lists.groupBy("n", "x", "y").agg(F.min(F.struct("key", "main", "s")).alias("l")).select("n", "l.*")
    count = lambda n, s: F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    lists = lists.select("key", F.col("main.label").alias("main"), count(F.col("main.n"), F.col("main.s")).alias("mains"), count(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("others"))
    return held, written(lists, folder)


def _places(held: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, doc_id, label, a, c, cross, side, inside): the pairs of blocks of each document. The rest of a list meets its largest connected group and itself."""
    placed = held.join(lists, "key").withColumn("is_main", F.col("label") == F.col("main"))
    b = F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    place = lambda a, c, cross, side: F.struct(a.cast("int").alias("a"), c.cast("int").alias("c"), F.lit(cross).alias("cross"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    met = F.transform(upto(F.col("others")), lambda o: place(o, b, True, F.lit(1)))
    meets = F.transform(upto(F.col("mains")), lambda m: place(b, m, True, F.lit(0)))
    own = F.transform(upto(F.col("others")), lambda o: place(F.least(b, o), F.greatest(b, o), False, F.when(b <= o, 0).otherwise(1)))
    places = placed.select("key", "doc_id", "label", F.explode(F.when(F.col("is_main"), met).otherwise(F.concat(meets, own))).alias("p")).select("key", "doc_id", "label", "p.*")
    return places.withColumn("inside", ~F.col("cross") & (F.col("a") == F.col("c")))


def _block_links(places: DataFrame, prefixes: DataFrame, docs: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """Confirmed links between documents of different labels that meet in a pair of blocks."""
    dealt = places.join(prefixes, "doc_id").select("key", "a", "c", "cross", "doc_id", "label", "side", "inside", "n_shingles", "signature", "keys")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "key", "a", "c", "cross").sortWithinPartitions("key", "a", "c", "cross", "doc_id")
    # signatures first, so that only sets of documents that collide are sent
    met = written(dealt.mapInArrow(_colliding(percent), dealt.schema), folder)
    sets = _sets(docs, met.select("doc_id"), words, folder)
    return met.join(sets, "doc_id").groupBy("key", "a", "c", "cross").applyInArrow(_forest(percent), "u long, v long")


def _banded(prefixes: DataFrame, ids: DataFrame, docs: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """prefixes of the documents with these ids, their keys being their bands of further coordinates."""
    n, width = bands(percent)
    band = lambda k: F.xxhash64(F.lit(k), F.substring("fine", k * width + 1, width))
    keys = _sets(docs, ids, words, folder).select("doc_id", F.array(*map(band, range(n))).alias("keys"))
    return written(prefixes.drop("keys").join(keys, "doc_id"), folder)


def _list_links(prefixes: DataFrame, docs: DataFrame, known: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """Confirmed links between documents that a posting list holds and ``known`` (node, component) does not connect yet.

    Lists whose rest is more than a block would be sent as often as it has blocks. Their documents meet in bands instead.
    """
    held, lists = _lists(prefixes, known, folder)
    large = F.lit(bands(percent)[0] > 0) & (F.col("others") > 1)
    links = _block_links(_places(held, lists.filter(~large)), prefixes, docs, words, percent, folder)
    many = written(held.join(lists.filter(large).select("key"), "key").select("doc_id").distinct(), folder)
    if many.isEmpty():
        return links
    banded = _banded(prefixes, many, docs, words, percent, folder)
    return links.union(_block_links(_places(*_lists(banded, known, folder)), banded, docs, words, percent, folder))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links of at least this similarity) of every row with an id."""
    docs = _plain(docs, id_col, text_col)
    folder = shared_dir(docs.sparkSession)
    signed = written(signatures(docs, words), folder)
    reps = signed.filter("n_shingles > 0").groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r")).select("set_hash", "r.*")
    reps = written(reps, folder)
    prefixes = _prefixes(reps, matches(percent), folder)
    known = components(_confirmed(_hub_pairs(prefixes, percent, folder), docs, words, percent, folder))
    more = written(_list_links(prefixes, docs, known, words, percent, folder), folder)
    linked = components(more.union(known.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    named = reps.select("set_hash", F.col("doc_id").alias("node")).join(linked, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
