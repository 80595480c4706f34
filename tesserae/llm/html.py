"""Operator 10: the main text of web pages, by structure and by a suffix array over each host.

A page is cut into blocks of text at its block-level tags; each block is main (inside ``<article>`` or ``<main>``, or,
where a page has neither, inside a container named like one), chrome (menus, headers, footers, side bars, notices,
adverts, forms, comments and the like, by tag, role, class or id), or other. The token streams of a host's pages outside
their main blocks are put one after another and their suffixes sorted; prefixes of at least ``TOKENS`` tokens that
neighbours from distinct pages have in common are boilerplate, and the tokens they cover are removed. What is unique stays.

Articles hold passages that other articles hold too, and all of an article belongs to the result, so what repeats is not
cut out of main blocks. A main block goes only where all its tokens lie in runs of TOKENS tokens that at least SHARE of a
host's distinct main texts have, of hosts with PAGES of them: a notice without a name of its own. If all blocks of a page
are such, all stay. For pages without main blocks the other blocks' unique runs are the text.

So that not every suffix of an article is sent, the main texts of a host that have a run are counted first by its hash, in
SLOTS counters. A counter is never less than what it counts, so no run is lost; only runs whose counter is high enough are
sent and counted one by one.

The suffix array is distributed: each batch sorts its own suffixes and folds equal ones, so that a footer that stands on a
third of all pages is sent once a batch; suffixes are then dealt by host and first TOKENS tokens, which no repeat of that
length crosses, and sorted there. Memory is bounded by a batch.

Null html is empty; pages without text give ''. Null urls are a host of their own. Rows that share a page_id are one page
for what repeats, and each gives its row. Pages are read whole, however long. Empty tables give empty results; other columns are not carried.
"""

from __future__ import annotations

import html as references
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import record_batch, shared_dir, shuffle_partitions, slices, written

#: Tokens that a repeat must have, and tokens of a suffix that are sorted.
TOKENS, DEPTH = 6, 24
#: What makes a run of main blocks boilerplate: the share of its host's distinct main texts that have it, and how many of these the host has at least; counters of a host.
SHARE, PAGES, SLOTS = 0.8, 10, 8192

# fixed values: names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object noembed noframes".split())
HEAD = frozenset("title meta link base script style noscript template".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog button select option fieldset input canvas audio video head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "nav navbar navigation menu submenu sidebar footer masthead ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager toolbar widget widgets skip hidden".split()
)
MAIN_NAMES = frozenset("article content main post entry story".split())
#: Parts of a name that say nothing by themselves: "comment-list" and "site-footer" are chrome, "public-notice" and "related-post" are not.
PLAIN_NAMES = frozenset("area bar block body bottom box container global inner item items left list outer page primary right secondary section site text top wrap wrapper".split())
#: A class or id never makes chrome of these.
WHOLE = frozenset("html body main article".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAME = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)

OTHER, CHROME, WEAK, MAIN = range(4)
PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("main", pa.list_(pa.string())), ("roles", pa.list_(pa.int32())), ("blocks", pa.list_(pa.string()))])


def _kind(tag: str, attributes: str, inside: bool) -> int | None:
    """What an element makes of its content; None: nothing."""
    named: list[set[str]] = []  # the parts of each class and id
    role = ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                named += [set(_NAME.findall(x)) for x in value.split()]
            elif key == "role":
                role = value
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return CHROME
    is_named = lambda names: any(parts & names and parts <= names | PLAIN_NAMES for parts in named)
    header = tag == "header" or tag not in WHOLE and is_named({"header"}) or role == "banner"
    if tag in CHROME_TAGS or role in CHROME_ROLES - {"banner"} or tag not in WHOLE and is_named(CHROME_NAMES) or header and not inside:
        return CHROME
    if tag in ("article", "main") or role in ("main", "article"):
        return MAIN
    return WEAK if tag in ("div", "section", "td") and is_named(MAIN_NAMES) else None


def parse(page: str | None) -> list[tuple[int, str]]:
    """The blocks of a page in their order: what they are and their text, white space as single spaces.

    One pass, in time that is linear in the page however it is broken: open elements are found by name and by level, a tag
    without its ``>`` is text, and no end tag is looked for again that was not found once. Scripts and styles without an end
    take the rest of the page with them; other elements whose content is left out are ordinary ones without it.
    """
    page = page or ""
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int | None]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name
    outer: list[int] = []  # places of open elements that are not inline
    depth = [0, 0, 0, 0]
    role = OTHER

    def flush():
        if held:
            if in_head() and not "".join(held).isspace():
                leave_head()
            text = " ".join(references.unescape("".join(held)).split())
            if text:
                blocks.append((role, text))
            held.clear()

    def now() -> int:
        return CHROME if depth[CHROME] else MAIN if depth[MAIN] else WEAK if depth[WEAK] else OTHER

    def push(tag: str, kind: int | None):
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append((tag, kind))

    def drop() -> int | None:
        tag, kind = stack.pop()
        places[tag].pop()
        if tag not in INLINE:
            outer.pop()
        return kind

    def pop(to: int):
        nonlocal role
        changed = False
        while len(stack) > to:
            kind = drop()
            if kind is not None:
                depth[kind] -= 1
                changed = True
        if changed:
            flush()
            role = now()

    def in_head() -> bool:
        return bool(places.get("head"))

    def leave_head():
        nonlocal role
        to = places["head"][-1]
        while len(stack) > to:
            kind = drop()
            if kind is not None:
                depth[kind] -= 1
        role = now()

    at, end, last, unclosed = 0, len(page), page.rfind(">") + 1, set()
    while at < end:
        m = _TAG.search(page, at, last) if at < last else None
        if not m:  # only a comment that never ends can follow
            comment = page.find("<!--", at)
            held.append(page[at : comment if comment >= 0 else end])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # it does not end within the last tag, so it never does
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if not (m[1] or m[4]) and tag not in HEAD and tag != "head" and in_head():
            leave_head()  # its end tag may be left out
        if m[1] or m[4]:
            known = places.get(tag)
            if known and not (tag in INLINE and outer and outer[-1] > known[-1]):
                pop(known[-1])
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            close = None if tag in unclosed else _END[tag].search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                at = end
            else:
                unclosed.add(tag)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:  # an open paragraph ends here, and an item at the next
            if outer and (stack[outer[-1]][0] == "p" or stack[outer[-1]][0] == tag == "li"):
                pop(outer[-1])
        kind = _kind(tag, attributes, bool(depth[MAIN] or depth[WEAK]))
        if kind is not None:
            flush()
            depth[kind] += 1
        push(tag, kind)
        if kind is not None:
            role = now()
    flush()
    return blocks


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _parsed(batches):
    for part in slices(batches, column=2):
        rows = []
        for page_id, url, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
            blocks = parse(page)
            best = MAIN if any(r == MAIN for r, _ in blocks) else WEAK if any(r == WEAK for r, _ in blocks) else None
            main = None if best is None else [t for r, t in blocks if r == best]
            rest = [(r, t) for r, t in blocks if r != best]
            rows.append((page_id, url, host(url), main, [r for r, _ in rest], [t for _, t in rest]))
        yield record_batch(PARSED, *(list(c) for c in zip(*rows, strict=True)))


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) | 1 for t in tokens), dtype=np.uint64, count=len(tokens))


def runs(blocks: list[str]) -> np.ndarray:
    """A hash of each run of TOKENS tokens of the blocks, in their order."""
    h = _hashes(" ".join(blocks).split(" "))
    n = max(0, len(h) - TOKENS + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(TOKENS):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slots(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(32)) % np.uint64(SLOTS)


COUNTS = pa.schema([("host", pa.string()), ("counts", pa.binary())])


def _counted(batches):
    """Of the main texts of a task: how many have a run of each counter, by host; some hosts at a time."""
    held: dict[str, np.ndarray] = {}
    for part in slices(batches):
        for name, blocks in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if name not in held:
                if len(held) == 256:
                    yield record_batch(COUNTS, list(held), [zlib.compress(c.tobytes(), 1) for c in held.values()])
                    held.clear()
                held[name] = np.zeros(SLOTS, dtype=np.int64)
            held[name][np.unique(_slots(runs(blocks)))] += 1
    if held:
        yield record_batch(COUNTS, list(held), [zlib.compress(c.tobytes(), 1) for c in held.values()])


HIGH = pa.schema([("host", pa.string()), ("wanted", pa.int64()), ("slots", pa.binary())])


def _high(batches):
    """Of rows of counts sorted by host: the counters that are high enough, of hosts that have some."""
    name, least, total = None, 0, None

    def done():
        high = np.flatnonzero(total >= least)
        if len(high):
            yield record_batch(HIGH, [name], [least], [high.tobytes()])

    for part in slices(batches):
        for of, wanted, counts in zip(*(part.column(c).to_pylist() for c in ("host", "wanted", "counts")), strict=True):
            counts = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            if total is not None and of == name:
                total = total + counts
            else:
                if total is not None:
                    yield from done()
                name, least, total = of, wanted, counts
    if total is not None:
        yield from done()


PLACED = pa.schema([("host", pa.string()), ("content", pa.int64()), ("wanted", pa.int64()), ("run", pa.int64()), ("place", pa.int32())])


def _placed(batches):
    """The runs of main texts whose counters are high enough."""
    for part in slices(batches, 1 << 20, column=2):
        for name, content, blocks, wanted, slots in zip(*(c.to_pylist() for c in part.columns), strict=True):
            found = runs(blocks)
            at = np.flatnonzero(np.isin(_slots(found), np.frombuffer(slots, dtype=np.int64).astype(np.uint64)))
            if len(at):
                yield record_batch(PLACED, [name] * len(at), [content] * len(at), [wanted] * len(at), found[at].view(np.int64), at.astype(np.int32))


def own_blocks(blocks: list[str], places: list[int] | None) -> str:
    """The main blocks that runs at these places do not cover whole; all, if they cover every one."""
    if not places:
        return " ".join(blocks)
    ends = np.cumsum([b.count(" ") + 1 for b in blocks])
    covered = np.zeros(ends[-1], dtype=bool)
    for start in places:
        covered[start : start + TOKENS] = True
    kept = [b for b, x in zip(blocks, np.split(covered, ends[:-1]), strict=True) if not x.all()]
    return " ".join(kept or blocks)


def _main_runs(mains: DataFrame, folder: str) -> DataFrame:
    """(host, content, places): where main texts have runs that are boilerplate of their host. mains: host, content, main."""
    spark = mains.sparkSession
    hosts = mains.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= PAGES)
    hosts = written(hosts.select("host", F.ceil(F.col("n") * SHARE).cast("long").alias("wanted")), folder)
    counts = mains.join(hosts, "host", "left_semi").select("host", "main").mapInArrow(_counted, "host string, counts binary").join(hosts, "host")
    high = written(counts.repartition(shuffle_partitions(spark), "host").sortWithinPartitions("host").mapInArrow(_high, "host string, wanted long, slots binary"), folder)
    placed = mains.join(high, "host").select("host", "content", "main", "wanted", "slots").mapInArrow(_placed, "host string, content long, wanted long, run long, place int")
    placed = written(placed, folder)
    frequent = written(placed.select("host", "run", "wanted", "content").distinct().groupBy("host", "run", "wanted").agg(F.count("*").alias("n")).filter("n >= wanted").select("host", "run"), folder)
    return placed.join(frequent, ["host", "run"]).groupBy("host", "content").agg(F.collect_set("place").alias("places"))


def suffixes(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of token streams put one after another: the suffixes with at least TOKENS tokens left in their stream, sorted by their first DEPTH tokens (hashes, zero beyond the stream's end); the stream and the place of each."""
    hashes = [_hashes(s) for s in streams]
    rows = [np.lib.stride_tricks.sliding_window_view(np.concatenate([h, np.zeros(DEPTH - TOKENS, dtype=np.uint64)]), DEPTH) for h in hashes if len(h) >= TOKENS]
    stream = np.concatenate([np.full(len(h) - TOKENS + 1, k) for k, h in enumerate(hashes) if len(h) >= TOKENS] or [np.zeros(0, dtype=np.int64)])
    place = np.concatenate([np.arange(len(h) - TOKENS + 1) for h in hashes if len(h) >= TOKENS] or [np.zeros(0, dtype=np.int64)])
    heads = np.concatenate(rows) if rows else np.zeros((0, DEPTH), dtype=np.uint64)
    order = np.lexsort([place, stream, *(heads[:, c] for c in range(DEPTH - 1, -1, -1))])
    return heads[order], stream[order].astype(np.int64), place[order].astype(np.int64)


SUFFIX = pa.schema([("host", pa.string()), ("head", pa.binary()), ("rest", pa.binary()), ("pages", pa.binary()), ("places", pa.binary())])


def _suffix_rows(batches):
    """A row for each distinct suffix of a host in the batch, with where it stands."""
    for part in slices(batches, 4 << 20, column=2):
        by_host: dict[str, list] = {}
        for page_id, name, blocks in zip(*(c.to_pylist() for c in part.columns), strict=True):
            by_host.setdefault(name, []).append((page_id, " ".join(blocks).split(" ")))
        for name, pages in by_host.items():
            heads, stream, place = suffixes([s for _, s in pages])
            if not len(heads):
                continue
            page = np.array([p for p, _ in pages], dtype=np.int64)[stream]
            new = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]).any(1)]))
            raw = heads.astype(">u8")
            cuts = np.append(new, len(heads))
            for k in range(0, len(new), 4096):
                some = range(k, min(k + 4096, len(new)))
                yield record_batch(
                    SUFFIX, [name] * len(some), [raw[new[i], :TOKENS].tobytes() for i in some], [raw[new[i], TOKENS:].tobytes() for i in some],
                    [page[cuts[i] : cuts[i + 1]].tobytes() for i in some], [place[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in some],
                )


MARKED = pa.schema([("page_id", pa.int64()), ("place", pa.int32()), ("n", pa.int32())])


def _repeated(batches):
    """Sorted suffixes of hosts: places of those that have at least TOKENS tokens in common with one of another page, and how many, up to DEPTH.

    The longest prefix that a suffix has in common with one of another page it has with the next such one before or after
    it. Suffixes between which no other page stands wait for the one after; they are of one page.
    """
    key, tokens, page, above, waiting = None, None, None, 0, []
    out: tuple[list, list, list] = ([], [], [])

    def put(pages, places, n):
        if n >= TOKENS:
            out[0].append(pages), out[1].append(places), out[2].append(np.full(len(pages), n, dtype=np.int32))

    def settle(common):
        """The waiting suffixes, the last one having so many tokens in common with a suffix of another page that follows."""
        for pages, places, before, after in reversed(waiting):
            put(pages, places, max(before, common))
            common = min(common, after)
        waiting.clear()

    for batch in batches:
        for name, head, rest, pages, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pages, places, row = np.frombuffer(pages, dtype=np.int64), np.frombuffer(places, dtype=np.int32), np.frombuffer(head + rest, dtype=">u8")
            same = (name, head) == key
            common = int(np.append(np.flatnonzero(row != tokens), DEPTH)[0]) if same else 0
            one = pages[0] if (pages == pages[0]).all() else None  # None: of several pages
            if not same:
                settle(0)
                above = 0
            elif one is None or one != page:  # the one before is, or is also, of another page
                settle(common)
                above = common
            else:
                above = min(above, common)
            if one is None:
                put(pages, places, DEPTH)
            else:
                # "after": what the one waiting before this has in common with it
                waiting.append((pages, places, above, common))
            key, tokens, page = (name, head), row, one
        if out[0]:
            yield record_batch(MARKED, *(pa.array(np.concatenate(c)) for c in out))
            out = ([], [], [])
    settle(0)
    if out[0]:
        yield record_batch(MARKED, *(pa.array(np.concatenate(c)) for c in out))


def unique_runs(roles: list[int], blocks: list[str], places: list | None) -> str:
    """The other blocks' tokens that no repeat covers. places: where repeats start in the stream of all blocks, and their tokens."""
    tokens = [(r, t) for r, b in zip(roles, blocks, strict=True) for t in b.split(" ")]
    covered = np.zeros(len(tokens), dtype=bool)
    for start, n in places or []:
        covered[start : start + n] = True
    return " ".join(t for (r, t), c in zip(tokens, covered, strict=True) if r == OTHER and not c)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every row."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    plain = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    parsed = written(plain.mapInArrow(_parsed, "page_id long, url string, host string, main array<string>, roles array<int>, blocks array<string>"), folder)
    streams = parsed.filter("page_id is not null and size(blocks) > 0").select("page_id", "host", "blocks")
    rows = streams.mapInArrow(_suffix_rows, "host string, head binary, rest binary, pages binary, places binary")
    array = rows.repartition(shuffle_partitions(spark), "host", "head").sortWithinPartitions("host", "head", "rest")
    marked = array.mapInArrow(_repeated, "page_id long, place int, n int")
    mains = parsed.filter("main is not null").select("page_id", "url", "host", F.xxhash64("main").alias("content"), "main")
    open_pages = parsed.filter("main is null").select("page_id", "url", "roles", "blocks")
    places = marked.join(open_pages.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.collect_list(F.array("place", "n")).alias("places"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def uncovered(batches):
        for batch in batches:
            page_id, url, *rest = batch.columns
            yield record_batch(schema, page_id, url, [unique_runs(*x) for x in zip(*(c.to_pylist() for c in rest), strict=True)])

    def own(batches):
        for batch in batches:
            page_id, url, *rest = batch.columns
            yield record_batch(schema, page_id, url, [own_blocks(*x) for x in zip(*(c.to_pylist() for c in rest), strict=True)])

    whole = mains.join(written(_main_runs(mains, folder), folder), ["host", "content"], "left").select("page_id", "url", "main", "places").mapInArrow(own, "page_id long, url string, text string")
    decided = open_pages.join(places, "page_id", "left").select("page_id", "url", "roles", "blocks", "places").mapInArrow(uncovered, "page_id long, url string, text string")
    return whole.union(decided)
