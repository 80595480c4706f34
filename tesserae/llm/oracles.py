"""DuckDB SQL of the queries whose SQL is put together from parts."""

from __future__ import annotations


def _folding(name: str, start: str, runs: str, tree: str) -> str:
    """A recursion that takes each row of ``start`` (id, pos, n, h, c, sib, tree) up its tree: c is folded from the claimed leaf, sib gathers the siblings."""
    return f"""{name} AS (SELECT *, 0 AS level FROM ({start}) UNION ALL
        SELECT id, pos // 8, (n + 7) // 8, up, sha256(l || c || r), sib || l || r, tree, level + 1
        FROM (SELECT f.* EXCLUDE (pos, n), f.pos, f.n, array_to_string(kids[1:CAST(f.pos % 8 AS INT)], '') AS l, array_to_string(kids[CAST(f.pos % 8 AS INT) + 2:], '') AS r, g.up
              FROM {name} f JOIN {runs} g ON f.n > 1 AND g.tree = f.tree AND g.level = f.level AND g.pos = f.pos // 8))"""


def _levels(name: str, start: str) -> str:
    return f"""{name} AS (SELECT 0 AS level, tree, pos, n, h FROM ({start}) UNION ALL
        SELECT level + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY level, tree, n, pos // 8)"""


def _runs(name: str, levels: str) -> str:
    return f"{name} AS (SELECT tree, level, pos // 8 AS pos, list(h ORDER BY pos) AS kids, sha256(string_agg(h, '' ORDER BY pos)) AS up FROM {levels} WHERE n > 1 GROUP BY tree, level, pos // 8)"


def _field(name: str, value: str = "") -> str:
    text = value or f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def merkle(tampered: str) -> str:
    """tampered: a condition on doc_id; DuckDB has no CRC-32, so it comes as SQL."""
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({_FIELDS} || {_field("text")}) AS h, sha256({_FIELDS} || CASE WHEN {tampered} THEN {_field("text", _LOWER)} ELSE {_field("text")} END) AS c FROM documents),
        leaf AS (SELECT doc_id, tree, h, c, row_number() OVER (ORDER BY doc_id) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
        {_levels("low", "SELECT tree, pos, n, h FROM leaf")}, {_runs("low_runs", "low")},
        sub AS (SELECT tree AS part, 'all' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
        {_levels("high", "SELECT tree, pos, n, h FROM sub")}, {_runs("high_runs", "high")},
        {_folding("f", "SELECT id, pos, n, h, c, '' AS sib, tree FROM leaf", "low_runs", "tree")},
        {_folding("g", "SELECT f.id, sub.pos, sub.n, sub.h, f.c, f.sib, sub.tree FROM f JOIN sub ON f.n = 1 AND sub.part = f.tree", "high_runs", "tree")}
        SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, g.h AS root, sha256(g.sib) AS proof_sha256, g.c AS folded_root, g.c = g.h AS verified
        FROM leaf JOIN sub ON sub.part = leaf.tree JOIN g ON g.id = leaf.id AND g.n = 1
    """


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit, as DuckDB has none."""
    bit = "CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END"
    byte = "list_reduce(list_prepend(xor(x, ascii(z)), range(8)), lambda y, k: " + bit + ")"
    # a list of numbers: the state, then the characters' codes; each step takes one in
    byte = byte.replace("xor(x, ascii(z))", "xor(x, z)")
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda x, z: {byte}), 4294967295)"


def _option(state: str, cost: str, letter: str, line: str = "") -> str:
    said = f" || chr(10) || {line}" if line else ""
    return f"{{'c': {state}.c + {cost}, 'w': {state}.w || '{letter}', 't': {state}.t{said}}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _insert(*states: str, role: str) -> list[str]:
    return [_option(s, "2", "I", f"'{role}:'") for s in states]


def conversation_repair() -> str:
    far, start = "{'c': 1000000000, 'w': '', 't': ''}", "{'c': 0, 'w': '', 't': ''}"
    own, free = "x.role || ':' || x.text", "CASE WHEN x.stays THEN {} ELSE 1000000000 END"
    keep = {c: f"CASE WHEN x.stays AND x.initial = '{c}' THEN x.late ELSE 1000000000 END" for c in "sua"}
    role = free.format("2 + x.late")
    users = ("y.n", "y.s", "y.a")
    step = {
        "n": _least(_option("y.n", "3", "D")),
        "s": _least(_option("y.s", "3", "D"), _option("y.n", keep["s"], "K", own)),
        "u": _least(_option("y.u", "3", "D"), *[_option(s, role, "R", "'user:' || x.text") for s in users], *[_option(s, keep["u"], "K", own) for s in users]),
        "a": _least(_option("y.a", "3", "D"), _option("y.u", role, "R", "'assistant:' || x.text"), _option("y.u", keep["a"], "K", own)),
    }
    return rf"""
        WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM b WHERE k <> 0),
        o AS (SELECT *, coalesce('1' || CAST(conv_id AS VARCHAR), '0') AS tree, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
        p AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY tree, role, text ORDER BY i) > 1 AS again, substr(role, 1, 1) AS initial FROM o),
        x AS (SELECT *, NOT (blank OR again) AS stays, CASE WHEN NOT (blank OR again) AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS late, coalesce(lag(initial) OVER (PARTITION BY tree ORDER BY i) || ' ' || initial NOT IN ('s u', 'u a', 'a u'), false) AS illegal FROM p),
        r AS (
            SELECT tree, 0 AS i, {start} AS n, {far} AS s, {far} AS u, {far} AS a FROM (SELECT DISTINCT tree FROM x)
            UNION ALL
            SELECT y.tree, x.i, {", ".join(f"{v} AS {k}" for k, v in step.items())}
            FROM (SELECT tree, i, n, s, u, {_least("a", *_insert("u", role="assistant"))} AS a FROM (SELECT tree, i, n, s, {_least("u", *_insert("n", "s", "a", role="user"))} AS u, a FROM r)) y JOIN x ON x.tree = y.tree AND x.i = y.i + 1
        ),
        e AS (SELECT tree, {_least("n", "a", *_insert("u", role="assistant"))} AS best FROM (SELECT tree, n, {_least("u", *_insert("n", "s", "a", role="user"))} AS u, a FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY tree ORDER BY i DESC) = 1))),
        g AS (SELECT tree, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS INT)) AS blank, sum(CAST(again AS INT)) AS duplicate, sum(late) AS truncated, sum(CAST(illegal AS INT)) AS illegal FROM x GROUP BY tree)
        SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
        CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.w, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce('1' || CAST(conv_id AS VARCHAR), '0') AS tree FROM conversations) LEFT JOIN g USING (tree) LEFT JOIN e USING (tree)
    """


MERKLE = merkle(f"{_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0")
CONVERSATION_REPAIR = conversation_repair()
