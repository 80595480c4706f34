"""Repair of the turns of conversations by the cheapest edits.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its edits are an optimal path through a graph whose nodes are
(rows read, state of that pattern): Keep 0, Rerole to user or assistant 2, Delete 3 (all that is left to blank rows and
duplicates), Insert a user or assistant row without text 2, and 1 more for a truncated row that stays. Minimum costs from the start and
to the end tell which arcs are tight, that is, on some optimal path; from the start on, the set of nodes that are reached
takes the least letter of its tight arcs at each step, which gives the ASCII-least of the cheapest edits.

Scale: equal rows of a turn are one row with a number of copies, combined before they are shuffled. A conversation is cut into
segments of SEGMENT rows, and segments, not conversations, are dealt out. The costs over a segment are a matrix of four by
four states, and the frontier behind it a map of sets of states, so a long conversation is first summed up
segment by segment; what then meets in one place is a few numbers for each of its segments. Texts are
shuffled twice, and only of rows that stay: to their edits, and by conversation for the hash of the result. That hash is a chain over the whole
conversation by its definition, so a conversation's result streams through one task; nothing of it is held.

Nulls: a null role or text is one space; rows without turn come first; rows without conversation are one conversation.
Rows of one turn are in the order of role and SHA-256 of the text. Empty tables give empty results; a conversation none
of whose rows is left has zeros, no edits and the hash of no text. Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import record_batch, shared_dir, shuffle_partitions, written
from tesserae.llm.positions import placed

#: Rows of a segment.
SEGMENT = 1 << 16
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
INF = 1 << 60
#: States: nothing yet, after the system's row, after the user's, after the assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (NONE, ASSISTANT)
#: The state after an inserted or reroled row, by the state before.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def _row_arcs(initial: str, late: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, from, to) of a row that may stay; late: 1 if it is truncated."""
    arcs = [(DELETE, COST[DELETE], q, q) for q in STATES] + [(REROLE, COST[REROLE] + late, q, NEXT[q]) for q in STATES]
    return arcs + [(KEEP, COST[KEEP] + late, q, p) for q, p in _KEPT.get(initial, {}).items()]


_ARCS = {(c, late): _row_arcs(c, late) for c in ("s", "u", "a", "") for late in (0, 1)}


def arcs_of(initial: str, late: bool) -> list[tuple[str, int, int, int]]:
    return _ARCS[initial if initial in _KEPT else "", int(late)]


def _with_inserts(cost: list[int], ahead: bool) -> list[int]:
    """Costs when rows may be inserted here: of reaching each state, or (ahead) of going on from it. Two in a row are the most that can help."""
    cost = list(cost)
    for _ in range(2):
        for q in STATES:
            a, b = (NEXT[q], q) if ahead else (q, NEXT[q])
            cost[b] = min(cost[b], cost[a] + COST[INSERT])
    return cost


def forward(rows, start: list[int]) -> list[list[int]]:
    """Least costs of reaching the states before each row (inserted ones included) and, last, behind all. rows: (initial, late, stays, more): more copies are deleted."""
    out, cost = [], start
    for initial, late, stays, more in rows:
        cost = _with_inserts(cost, False)
        out.append(cost)
        if stays:
            new = [INF] * 4
            for _, w, a, b in arcs_of(initial, late):
                new[b] = min(new[b], cost[a] + w)
            cost = new
        if more:
            cost = [min(INF, x + more * COST[DELETE]) for x in cost]
    return [*out, cost]


def backward(rows, end: list[int]) -> list[list[int]]:
    """Least costs from the states before each row to the end, and last those behind all."""
    out, cost = [end], end
    for initial, late, stays, more in reversed(rows):
        if more:
            cost = [min(INF, x + more * COST[DELETE]) for x in cost]
        if stays:
            new = [INF] * 4
            for _, w, a, b in arcs_of(initial, late):
                new[a] = min(new[a], cost[b] + w)
            cost = new
        cost = _with_inserts(cost, True)
        out.append(cost)
    return out[::-1]


#: Costs to the end behind the last row.
AT_END = _with_inserts([0 if q in ENDS else INF for q in STATES], True)
AT_START = [0, INF, INF, INF]


def traverse(rows, before: list[int], after: list[int], frontier: frozenset[int], last: bool):
    """Edits of each row and the frontier behind: ([(inserted before: letters, roles), letter, role or None], inserted at the end, frontier).

    before, after: least costs of reaching the first row and from behind the last one; frontier: states that are reached.
    """
    reach, left = forward(rows, before), backward(rows, after)
    total = min(reach[0][q] + left[0][q] for q in STATES)
    out = []

    def inserts(f, i, arcs):
        """Inserts until an arc of this row, or the end, is the least tight one."""
        added = []
        while True:
            cost = reach[i] if i < len(rows) else _with_inserts(reach[i], False)
            tight = {}
            for letter, w, a, b in arcs:
                if a in f and cost[a] + w + _behind(i, b) == total:
                    tight.setdefault(letter, set()).add(b)
            more = {NEXT[q] for q in f if cost[q] + COST[INSERT] + left[i][NEXT[q]] == total}
            if more and min(tight, default="Z") > INSERT and not (i == len(rows) and any(q in ENDS and cost[q] == total for q in f)):
                f = frozenset(more)
                added.append(ROLE[next(iter(f))])
            else:
                return added, f, tight

    def _behind(i, q):
        """Least cost from behind the row that may stay, before its further copies."""
        return left[i + 1][q] + rows[i][3] * COST[DELETE]

    for i, (initial, late, stays, more) in enumerate(rows):
        added, letter, role = [], "", None
        if stays:
            added, frontier, tight = inserts(frontier, i, arcs_of(initial, late))
            letter = min(tight)
            frontier = frozenset(tight[letter])
            if letter == REROLE:
                role = ROLE[next(iter(frontier))]
        out.append((added, letter, role))
    at_end = []
    if last:
        at_end, frontier, _ = inserts(frontier, len(rows), [])
    return out, at_end, frontier


def _segments(batches, key: int = 2):
    """(key values, rows as tuples) of the segments of sorted batches; one segment is held."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for k, group in groupby(rows, lambda row: row[:key]):
        yield k, list(group)


def _steps(group):
    return [(r[3], r[4], r[5], r[6]) for r in group]


_STEP = ["tree", "segment", "pos", "initial", "late", "stays", "more"]


def _by_segment(rows: DataFrame) -> DataFrame:
    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, "tree", "segment").sortWithinPartitions("tree", "segment", "pos")


def _boundaries(long: DataFrame) -> DataFrame:
    """(tree, segment, before, after, frontier) of the segments of conversations that have several."""
    schema = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("costs", pa.list_(pa.int64()))])

    def matrices(batches):
        for (tree, segment), group in _segments(batches):
            steps, costs = _steps(group), []
            for q in STATES:
                costs += forward(steps, [0 if p == q else INF for p in STATES])[-1]
            yield record_batch(schema, [tree], [segment], [costs])

    out = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("segment")
        m = [[c[4 * q : 4 * q + 4] for q in STATES] for c in group.column("costs").to_pylist()]
        before, after = [AT_START], [AT_END]
        for x in m[:-1]:
            before.append([min(min(before[-1][p] + x[p][q] for p in STATES), INF) for q in STATES])
        for x in m[:0:-1]:
            after.append([min(min(x[p][q] + after[-1][q] for q in STATES), INF) for p in STATES])
        return pa.table([group.column("tree"), group.column("segment"), before, after[::-1]], schema=out)

    costs = _by_segment(long.select(*_STEP)).mapInArrow(matrices, "tree string, segment long, costs array<long>")
    ends = costs.groupBy("tree").applyInArrow(chain, "tree string, segment long, before array<long>, after array<long>")
    ends = written(ends, shared_dir(long.sparkSession))

    sets = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("sets", pa.list_(pa.int64()))])

    def maps(batches):
        """The frontier behind a segment for every set of states that optimal paths can be in before it, as bits."""
        for (tree, segment), group in _segments(batches):
            before, after, steps = group[0][7], group[0][8], _steps(group)
            at = forward(steps, before)[0], backward(steps, after)[0]
            total = min(a + b for a, b in zip(*at, strict=True))
            tight = sum(1 << q for q in STATES if before[q] + at[1][q] == total)
            found = [sum(1 << q for q in traverse(steps, before, after, frozenset(q for q in STATES if s >> q & 1), False)[2]) if s and s & tight == s else 0 for s in range(16)]
            yield record_batch(sets, [tree], [segment], [found])

    known = long.select(*_STEP).join(ends, ["tree", "segment"]).select(*_STEP, "before", "after")
    moved = _by_segment(known).mapInArrow(maps, "tree string, segment long, sets array<long>")
    last = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("frontier", pa.int64())])

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by("segment")
        frontier = [1 << NONE]
        for s in group.column("sets").to_pylist()[:-1]:
            frontier.append(s[frontier[-1]])
        return pa.table([group.column("tree"), group.column("segment"), frontier], schema=last)

    return ends.join(moved.groupBy("tree").applyInArrow(follow, "tree string, segment long, frontier long"), ["tree", "segment"])


_EDITS = "tree string, segment long, pos long, letters string, cost long, before string, said string, after string"


def _edited(rows: DataFrame) -> DataFrame:
    """The edits of each row: letters, their cost, lines inserted before it, its role if it stays, lines inserted behind the last."""
    names = [x.split(" ")[0] for x in _EDITS.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("segment", "pos", "cost") else pa.string()) for n in names])

    def run(batches):
        for (tree, segment), group in _segments(batches):
            n, role, before, after, frontier = group[0][7:]
            steps = _steps(group)
            last = group[-1][2] == n - 1
            states = frozenset(q for q in STATES if frontier >> q & 1)
            found, at_end, _ = traverse(steps, before, after, states, last)
            out = []
            for row, (added, letter, new), (initial, late, stays, more) in zip(group, found, steps, strict=True):
                letters = INSERT * len(added) + letter + DELETE * more
                cost = sum(COST[x] for x in letters) + (late and letter in (KEEP, REROLE))
                said = (new or row[8]) if stays and letter != DELETE else None
                out.append([tree, segment, row[2], letters, int(cost), "\n".join(f"{r}:" for r in added) or None, said, None])
            if at_end:
                out[-1][3] += INSERT * len(at_end)
                out[-1][4] += COST[INSERT] * len(at_end)
                out[-1][7] = "\n".join(f"{r}:" for r in at_end)
            yield record_batch(schema, *zip(*out, strict=True))

    return _by_segment(rows.select(*_STEP, "n", "role", "before", "after", "frontier")).mapInArrow(run, _EDITS)


def _hashed(lines: DataFrame) -> DataFrame:
    """(tree, repaired_sha256) of lines (tree, pos, before, said, text, after), streamed through one hash per conversation."""
    schema = pa.schema([("tree", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        now, digest, none, out = None, None, True, []
        for batch in batches:
            for tree, _, before, said, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tree != now:
                    if digest:
                        out.append((now, digest.hexdigest()))
                    now, digest, none = tree, hashlib.sha256(), True
                for line in (before, None if said is None else f"{said}:{text}", after):
                    if line is not None:
                        digest.update(("" if none else "\n").encode() + line.encode())
                        none = False
            if len(out) >= 10_000:
                yield record_batch(schema, *zip(*out, strict=True))
                out = []
        if digest:
            out.append((now, digest.hexdigest()))
        if out:
            yield record_batch(schema, *zip(*out, strict=True))

    lines = lines.select("tree", "pos", "before", "said", "text", "after")
    return lines.repartition(shuffle_partitions(lines.sparkSession), "tree").sortWithinPartitions("tree", "pos").mapInArrow(run, "tree string, repaired_sha256 string")


_BLANK = r"[^\x20\x09-\x0D]"
_WHOLE = r"[.!?][\x20\x09-\x0D]*\z"


def _named(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(tree, turn, slot, role, digest, text): tree and slot are the conversation and the turn without nulls."""
    said, words = F.coalesce(F.col(role).cast("string"), F.lit(" ")), F.coalesce(F.col(text).cast("string"), F.lit(" "))
    tree, slot = F.coalesce(F.concat(F.lit("1"), F.col(conv).cast("string")), F.lit("0")), F.coalesce(F.col(turn).cast("string"), F.lit(""))
    return rows.select(tree.alias("tree"), F.col(turn).cast("long").alias("turn"), slot.alias("slot"), said.alias("role"), F.sha2(words, 256).alias("digest"), words.alias("text"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, lines) of conversations.

    report: (tree, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation; tree: see tree_of(). lines: (tree, pos, before,
    said, text, after): what is said in the repaired conversations, in the order of pos, with the lines inserted before and after a row.
    """
    folder, size = shared_dir(rows.sparkSession), segment or SEGMENT
    named = _named(rows, conv, turn, role, text)
    flags = named.select("tree", "turn", "slot", "role", "digest", (~F.col("text").rlike(_BLANK)).alias("blank"), (~F.col("text").rlike(_WHOLE)).alias("open"))
    one = flags.groupBy("tree", "turn", "slot", "role", "digest", "blank", "open").agg(F.count("*").alias("copies"))
    seen = one.filter("not blank").groupBy("tree", "role", "digest").agg(F.min(F.struct("turn")).alias("_first"))
    one = one.join(seen.hint("merge"), ["tree", "role", "digest"], "left")
    again = F.when(F.col("blank"), 0).when(F.col("turn").eqNullSafe(F.col("_first.turn")), F.col("copies") - 1).otherwise(F.col("copies"))
    one = one.withColumn("again", again).withColumn("stays", ~F.col("blank") & (F.col("again") < F.col("copies")))
    one = one.select("tree", "turn", "slot", "role", "digest", "blank", "copies", "again", "stays", (F.col("open") & F.col("stays")).alias("late"), F.substring("role", 1, 1).alias("initial"))
    at = written(placed(written(one, folder), folder, "turn", "role", "digest").withColumn("segment", F.floor(F.col("pos") / size)), folder)

    steps = at.withColumn("more", F.col("copies") - F.col("stays").cast("long"))
    short = steps.filter(F.col("n") <= size)
    numbers = [F.array(*[F.lit(x).cast("long") for x in c]).alias(n) for n, c in (("before", AT_START), ("after", AT_END))]
    short = short.select(*_STEP, "n", "role", *numbers, F.lit(1 << NONE).cast("long").alias("frontier"))
    long = steps.filter(F.col("n") > size)
    known = short
    if not long.isEmpty():
        known = short.unionByName(long.join(_boundaries(long), ["tree", "segment"]).select(*short.columns))
    edits = written(_edited(known), folder)

    # written tables are far smaller than their rows, so that their size says little about a broadcast
    kept = edits.filter("said is not null or before is not null or after is not null").join(at.select("tree", "pos", "slot", "role", "digest").hint("merge"), ["tree", "pos"])
    words = named.dropDuplicates(["tree", "slot", "role", "digest"]).select("tree", "slot", "role", "digest", "text")
    lines = kept.join(words.hint("merge"), ["tree", "slot", "role", "digest"]).select("tree", "pos", "before", "said", "text", "after")

    def pairs(first: Column, second: Column) -> Column:
        return (~F.concat(first, F.lit(" "), second).isin("s u", "u a", "a u")).cast("long")

    follows = at.select("tree", (F.col("pos") + 1).alias("pos"), F.col("initial").alias("_initial")).join(at.select("tree", "pos", "initial").hint("merge"), ["tree", "pos"])
    zero = F.lit(0).cast("long")
    counted = at.select(
        "tree", (F.col("blank").cast("long") * F.col("copies")).alias("blank"), F.col("again").cast("long").alias("duplicate"), F.col("late").cast("long").alias("truncated"), (F.col("copies") - 1).alias("illegal"), zero.alias("cost"),
    ).unionByName(follows.select("tree", zero.alias("blank"), zero.alias("duplicate"), zero.alias("truncated"), pairs(F.col("_initial"), F.col("initial")).alias("illegal"), zero.alias("cost")))
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    counted = counted.unionByName(edits.select("tree", *[zero.alias(c) for c in sums[:-1]], "cost"))
    counted = counted.groupBy("tree").agg(*[F.sum(c).alias(c) for c in sums])
    turns = at.filter("turn is not null").groupBy("tree", "turn").agg(F.lit(1).alias("one")).groupBy("tree")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))

    def joined(column: str, key: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, column))), lambda x: x[column]), "").alias(column)

    audit = edits.groupBy("tree", "segment").agg(joined("letters", "pos")).groupBy("tree").agg(joined("letters", "segment")).withColumnRenamed("letters", "audit")
    parts = [gaps, counted, audit, _hashed(lines)]
    types = {"gaps": "long", **dict.fromkeys(sums, "long"), "audit": "string", "repaired_sha256": "string"}
    union = None
    for part in parts:
        wide = part.select("tree", *[(F.col(c) if c in part.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        union = wide if union is None else union.unionByName(wide)
    report = union.groupBy("tree").agg(*[F.max(c).alias(c) for c in types])
    return report, lines


def tree_of(conv: str = "conv_id") -> Column:
    """The name of a conversation in the results of repair()."""
    return F.coalesce(F.concat(F.lit("1"), F.col(conv).cast("string")), F.lit("0"))


def report_of(conversations: DataFrame, rows: DataFrame, conv: str = "conv_id", **how) -> DataFrame:
    """The report on ``rows`` for every conversation of the original table, those of which no row is left included."""
    report, _ = repair(rows, conv, **how)
    all_of = conversations.select(tree_of(conv).alias("tree"), F.col(conv).alias("_conv")).distinct()
    out = all_of.join(report.hint("merge"), "tree", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_conv").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults put in, by a checksum of conversation and turn modulo 20: 0 drops a row, 1 empties its text, 2 takes
    its full stops, exclamation and question marks away, 3 repeats it, 4 makes it the user's. Nulls are one space in all of this."""
    space = F.lit(" ")
    some = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")) % 20
    words = F.coalesce(F.col(text).cast("string"), space)
    rows = conversations.select(conv, turn, F.when(some == 4, "user").otherwise(F.coalesce(F.col(role).cast("string"), space)).alias(role), F.when(some == 1, "").when(some == 2, F.translate(words, ".!?", "")).otherwise(words).alias(text), some.alias("_some"))
    rows = rows.filter("_some <> 0")
    return rows.select(conv, turn, role, text, F.explode(F.when(F.col("_some") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")
