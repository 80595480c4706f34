"""Exact duplicates by snapshots, repaired conversations and Merkle manifests, against plain versions."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import conversation, exact_dedup, merkle, queries

SF = "/root/testdata/sf0.001"
LONG = "a very long text. " * 20_000


# exact duplicates


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000, 40_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    held = exact_dedup.fuse(np.concatenate([keys, keys]))
    assert exact_dedup.may_hold(keys, *held).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert exact_dedup.may_hold(others, *held).mean() < 0.02 or n == 0
    assert len(held[2]) < 1.5 * n + 100 and held == exact_dedup.fuse(keys)


def kept_rows(rows):
    """(id, keep_id, group_size, kept) as a multiset."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out[(i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


ROWS = [(0, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, " "), (None, "a"), (None, "only null"), (None, "only null"), (6, "A"), (7, "é"), (8, "é"), (9, LONG), (10, LONG), (11, LONG + "x"), *[(i, f"text {i % 40}") for i in range(12, 140)]]


@pytest.mark.parametrize(("batches", "digest"), [(1, None), (2, None), (3, None), (3, "weak"), (2, "one")])
def test_exact_duplicates(spark, batches, digest):
    rows = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in ROWS], "doc_id long, text string, digest string, row int, kept int").repartition(3)
    how = {"weak": {"digest": lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1))}, "one": {"digest": lambda t: F.lit(b"")}}.get(digest, {})
    got = exact_dedup.exact_duplicates(rows, batches, **how)
    assert Counter(r[:4] for r in got.collect()) == Counter(k[:4] for k in kept_rows(ROWS).elements())
    if digest is None:
        assert Counter((r["id"], r["digest"].hex()) for r in got.collect()) == Counter((k[0], k[4]) for k in kept_rows(ROWS).elements())


def test_exact_duplicates_under_a_normal_form(spark):
    rows = spark.createDataFrame([(0, " One "), (1, "one"), (2, "two"), (3, None)], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(rows, normalise=lambda t: F.lower(F.trim(t)))
    assert {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()} == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 3: (3, 1, True)}
    assert exact_dedup.exact_duplicates(rows.filter("doc_id < 0")).count() == 0


def test_snapshots_screen_what_is_new(spark):
    """Only digests that an earlier snapshot may know meet its texts, texts of a snapshot are not shuffled for it, and no snapshot changes."""
    a = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    b = spark.createDataFrame([(i, f"text {i}") for i in range(2900, 6000)], "doc_id long, text string")
    store = exact_dedup.Snapshots(spark)
    first = store.add(a)
    before = first.classes.orderBy("digest").collect()
    second = store.add(b)
    maybe = exact_dedup.screened(spark.table(second.texts).select("digest"), first.filters, first.cells).count()
    assert 100 <= maybe <= 160
    assert second.classes.filter("home = 0").count() == 100 and second.classes.filter("home = 1").count() == 3000
    assert first.classes.orderBy("digest").collect() == before
    old, new = (spark.table(s.texts) for s in (first, second))
    plan = new.hint("merge").join(old.select("digest", F.col("texts").alias("others")), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_exact_dedup_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_exact_dedup(spark, SF).collect()
    assert Counter(tuple(r) for r in got) == kept_rows([tuple(r) for r in docs])


# conversations


def repaired(rows):
    """A plain version: rows (turn, role, text) of one conversation to (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum((a, b) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    def after(said, role):
        """Whether the pattern goes on with this initial."""
        return re.fullmatch(r"(s|s?(ua)*u|s?(ua)+)?", said + role) is not None

    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, lines = heapq.heappop(queue)
        state = said[-1:] or "-"
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "-a":
            break
        said = {"-": "", "s": "s", "u": "u", "a": "ua"}[state]
        for role in ("user", "assistant"):
            if after(said, role[0]):
                heapq.heappush(queue, (cost + 2, audit + "I", i, said + role[0], (*lines, f"{role}:")))
        if i < len(rows):
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, said, lines))
            if kinds[i] in ("", "truncated"):
                late = kinds[i] == "truncated"
                if initials[i] in ("s", "u", "a") and after(said, initials[i]):
                    heapq.heappush(queue, (cost + late, audit + "K", i + 1, said + initials[i], (*lines, f"{rows[i][1]}:{rows[i][2]}")))
                for role in ("user", "assistant"):
                    if after(said, role[0]):
                        heapq.heappush(queue, (cost + 2 + late, audit + "R", i + 1, said + role[0], (*lines, f"{role}:{rows[i][2]}")))
    return (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        if k:
            out += [(conv, turn, "user" if k == 4 else role, text)] * (1 + (k == 3))
    return out


def of_conversations(rows):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    return by


def awkward(seed, n=400):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "sys"]
    texts = ["Yes.", "No!", "open", "", " \n", None, " ", "Done. \n", "a b c?", "é", ".", "x" * 3000]
    rows = []
    for _ in range(n):
        conv = int(rng.integers(0, 40))
        rows.append((None if conv == 39 else conv, None if rng.random() < 0.1 else int(rng.integers(-3, 12)), roles[rng.choice(8, p=[0.3, 0.3, 0.12, 0.08, 0.05, 0.05, 0.05, 0.05])], texts[rng.integers(0, 12)]))
    rows += [(100, 5, "user", "Same.")] * 30 + [(101, None, None, None)] * 4 + [(102, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(200)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "segment"), [(0, None), (1, 1), (2, 2), (3, 5)])
def test_repair(spark, seed, segment):
    rows = awkward(seed)
    given_rows = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA + ", tree string, pos int, cost string").repartition(3)
    got = conversation.report_of(given_rows, given_rows, segment=segment).collect()
    want = {conv: repaired(turns) for conv, turns in of_conversations(rows).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_repaired_lines_are_a_conversation(spark):
    rows = spark.createDataFrame(awkward(7), SCHEMA)
    report, lines = conversation.repair(rows)
    said = defaultdict(list)
    for r in lines.orderBy("tree", "pos").collect():
        said[r["tree"]] += [x[:1] for x in (r["before"] or "").split("\n") if x] + ([r["said"][:1]] if r["said"] is not None else []) + [x[:1] for x in (r["after"] or "").split("\n") if x]
    assert said and all(re.fullmatch("s?(ua)+", "".join(x)) for x in said.values())
    assert {r["tree"] for r in report.filter("audit like '%K%' or audit like '%R%' or audit like '%I%'").collect()} == set(said)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.booleans(), st.booleans(), st.integers(0, 2)), max_size=9), st.integers(1, 4))
def test_segments_compose(rows, cut):
    """Costs and edits of parts, each seen by itself, are those of the whole."""
    steps = [(c, late and stays, stays, more) for c, late, stays, more in rows]
    whole = conversation.traverse(steps, conversation.AT_START, conversation.AT_END, frozenset([conversation.NONE]), True)
    parts = [steps[i : i + cut] for i in range(0, len(steps), cut)] or [[]]
    before, after = [conversation.AT_START], [conversation.AT_END]
    for p in parts:
        before.append(conversation.forward(p, before[-1])[-1])
    for p in reversed(parts):
        after.append(conversation.backward(p, after[-1])[0])
    frontier, out = frozenset([conversation.NONE]), []
    for k, p in enumerate(parts):
        found, end, frontier = conversation.traverse(p, before[k], after[len(parts) - 1 - k], frontier, k == len(parts) - 1)
        out += found
    assert (out, end) == whole[:2]


def test_conversations_that_vanish(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 0, "user", "Hi."), (None, 0, "user", "Hi.")], SCHEMA)
    assert conversation.report_of(empty, empty).count() == 0
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {tuple(r) for r in conversation.report_of(some, empty).collect()} == {(1, *none), (None, *none)}


def test_damage(spark):
    rows = awkward(11) + [(c, t, "user", "One. Two!") for c in range(200, 230) for t in range(6)]
    got = conversation.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == Counter(damage(rows))


def test_conversation_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = of_conversations(damage(rows))
    want = {conv: repaired(left.get(conv, [])) for conv in of_conversations(rows)}
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SF).collect()} == want


# manifests


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def row_hash(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """(root, for each leaf its (left, right) siblings level by level)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for p, i in zip(paths, at):
            a = i - i % 8
            p.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        level, at = [h(*level[a : a + 8]) for a in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def manifest(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text); tampered: the text that is claimed."""
    out = Counter()
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((row_hash(*r), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[name] = tree([x[0] for x in by[name]])
    root, above = tree([trees[n][0] for n in names])
    for name, top in zip(names, above):
        for (leaf, r), path in zip(by[name], trees[name][1]):
            path = path + top
            folded = row_hash(*r[:4], tampered(r[0], r[4]))
            for left, right in path:
                folded = h(left, folded, right)
            out[(r[0], leaf, trees[name][0], root, h(*[x for p in path for x in p]), folded, folded == root)] += 1
    return out


def lowered(doc_id, text):
    if doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 or text is None:
        return text
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest(spark, monkeypatch):
    rows = [(i, "s", ("en", "de", None, "é", "")[i % 5] if i < 60 else "en", i, f"Text {i} É") for i in range(200)]
    rows += [(1000, None, "lone", None, None), (None, "s", "en", 1, "null id"), (7, "s", "en", 3, "again"), (7, "s", "en", 3, "again"), (8, "", "", 0, ""), (1001, "s", "de", 1, "X" + LONG)]
    table = spark.createDataFrame([(*r, "clash", 5) for r in rows], DOCS + ", leaf string, pos int").repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: table)
    assert Counter(tuple(r) for r in queries.op13_merkle(spark, SF).collect()) == manifest(rows, lowered)
    for few in (rows[:1], rows[:9], [r for r in rows if r[2] == "en"][:8]):
        some = spark.createDataFrame(few, DOCS)
        monkeypatch.setattr(queries, "table", lambda *_, some=some: some)
        assert Counter(tuple(r) for r in queries.op13_merkle(spark, SF).collect()) == manifest(few, lowered)
    monkeypatch.setattr(queries, "table", lambda *_: table.limit(0))
    assert queries.op13_merkle(spark, SF).count() == 0


def test_proofs_lead_to_the_root(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = merkle.manifest(docs, ["doc_id", "text"], "lang", "doc_id")
    assert got.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert got.filter(merkle.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0 and got.select("root").distinct().count() == 1


def test_manifest_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_merkle(spark, SF).collect()) == manifest(rows, lowered)
