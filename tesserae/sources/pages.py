"""Listing and body pages: HTML to rows. Only the parser runs in Python; rows are filtered and stopped in plans.

Fetching is left to the caller, who brings a table (page, html).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.batches import in_ranges
from tesserae.operators import images as I
from tesserae.operators.order import before_stop, checkpointed
from tesserae.operators.rules import infer_category

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(frozen=True)
class Board:
    """How a board marks up its listing. pinned: 'own' class of the row, or a 'descendant' with the class; labels: words that it puts in front of titles."""

    title: str = "td-title"
    date: str = "td-date"
    pinned: str = "own"
    pinned_class: str = "notice"
    host: str = ""
    labels: tuple[str, ...] = ()


class _Listing(HTMLParser):
    def __init__(self, board: Board):
        super().__init__(convert_charrefs=True)
        self.board, self.rows, self.row, self.cell, self.link = board, [], None, None, False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        if tag == "tr":
            self.row = {"cells": 0, "pinned": self.board.pinned == "own" and self.board.pinned_class in classes, "title": None, "date": None, "href": None}
            self.rows.append(self.row)
            self.cell = None
            return
        if self.row is None:
            return
        if self.board.pinned == "descendant" and self.board.pinned_class in classes:
            self.row["pinned"] = True
        if tag == "td":
            self.row["cells"] += 1
            self.cell = None
        if self.board.date in classes and self.row["date"] is None:
            self.cell, self.row["date"] = "date", ""
        elif self.board.title in classes:
            self.cell = "title"
        elif tag == "a" and self.cell == "title" and self.row["title"] is None:
            self.link, self.row["title"], self.row["href"] = True, "", attrs.get("href") or ""

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag == "td":
            self.cell = None
        elif tag == "tr":
            self.row = self.cell = None

    def handle_data(self, data):
        if self.row is None:
            return
        if self.cell == "date":
            self.row["date"] += data
        elif self.link:
            self.row["title"] += data


class _Text(HTMLParser):
    """Text of the first element of a class, the images and links in it; without a class, of the whole page. An end tag closes what is open inside its element."""

    def __init__(self, wanted: str | None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.done, self.skip = wanted, None if wanted else [], False, 0
        self.parts, self.images, self.links, self.anchor = [], [], [], None

    def inside(self) -> bool:
        return self.open is not None and not self.done

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if self.open is None:
            if self.wanted in (attrs.get("class") or "").split() and tag not in VOID:
                self.open = [tag]
            return
        if self.inside():
            if tag == "img":
                self.images.append(attrs.get("src") or "")
            if tag == "a":
                self.anchor = [attrs.get("href") or "", ""]
                self.links.append(self.anchor)
            if self.wanted and tag not in VOID:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "a":
            self.anchor = None
        if self.wanted and self.inside() and tag in self.open:
            while self.open.pop() != tag:
                pass
            self.done = not self.open

    def handle_data(self, data):
        if self.inside() and not self.skip:
            if data.strip():
                self.parts.append(data.strip())
            if self.anchor:
                self.anchor[1] += data


def listing_rows(pages: DataFrame, board: Board = Board()) -> DataFrame:
    """(page, position, cells, pinned, title, date, href) of every table row; titles and dates as they stand."""
    schema = pa.schema([("page", pa.int64()), ("position", pa.int32()), ("cells", pa.int32()), ("pinned", pa.bool_()), ("title", pa.string()), ("date", pa.string()), ("href", pa.string())])

    def run(batches):
        for batch in in_ranges(batches):
            out = []
            for page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser = _Listing(board)
                parser.feed(html or "")
                out += [(page, k, r["cells"], r["pinned"], r["title"], r["date"], r["href"]) for k, r in enumerate(parser.rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, schema, strict=True)], schema=schema)

    return pages.select(F.col("page").cast("long"), "html").mapInArrow(run, "page long, position int, cells int, pinned boolean, title string, date string, href string")


def listing_items(pages: DataFrame, board: Board = Board(), clean: bool = True) -> DataFrame:
    """(page, position, title, url, date) of the listed items: no pinned, header or incomplete rows."""
    rows = listing_rows(pages, board).filter("cells > 0 and not pinned and title is not null and date is not null")
    url = T.absolute("href", board.host)
    title, url = (T.clean_title("title", board.labels), T.clean_url(url)) if clean else (T.strip("title"), url)
    return rows.select("page", "position", title.alias("title"), url.alias("url"), T.strip("date").alias("date"))


def of_year(items: DataFrame, year: str, grace_pages: int = 5) -> DataFrame:
    """Items of a year in listing order. Other years are skipped on the first pages; from page ``grace_pages`` on, the first one ends the list."""
    same = F.col("date").startswith(year)
    return before_stop(items, ~same & (F.col("page") >= grace_pages), "page", "position").filter(same)


def until_older(items: DataFrame, year: str, *order: str) -> DataFrame:
    """Items of a year: newer ones are skipped, the first older one ends the list. Years are compared as strings."""
    of = F.substring("date", 1, 4)
    return before_stop(items, of < year, *(order or ("page", "position"))).filter(of == year)


def crawl_all(listing: DataFrame, posts: DataFrame, year: str, rules, board: Board = Board(), element: str | None = None, grace_pages: int = 5) -> DataFrame:
    """(title, url, date, body, category) of a year's items on listing pages (page, html) whose posts (url, html) have been fetched.

    The list ends at the first page that gives no item of the year, and from page ``grace_pages`` on at the first item of
    another year. Items without a post have an empty body. Of several posts of a URL any one is taken.
    """
    items = of_year(checkpointed(listing_items(listing, board)), year, grace_pages)  # used four times, parsed once
    kept = items.groupBy("page").agg(F.count("*").alias("n"))
    # of_year() has none of a page behind its stop, so that such pages end the list, too
    end = listing.select(F.col("page").cast("long").alias("page")).distinct().join(kept, "page", "left").filter("n is null").agg(F.min("page").alias("end"))  # one row
    items = items.join(F.broadcast(end), F.col("end").isNull() | (F.col("page") < F.col("end"))).drop("end")
    body = bodies(posts, element, board.host).groupBy("url").agg(F.max("text").alias("body"))
    found = items.join(body, "url", "left").withColumn("body", F.coalesce("body", F.lit("")))
    return found.select("title", "url", "date", "body", infer_category(rules, "title", "body").alias("category"))


def counted_crawl(items: DataFrame, done: DataFrame, write, key: str = "url", body: str = "body") -> dict[str, int]:
    """Gives the items that were not seen before to write(rows), and counts {new, skipped, empty} on the way: one job, whatever write() is.

    See crawl_counts() for the counts; write() has to use all its rows once, as a save does.
    """
    marked = items.join(done.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    new, seen = F.col("_seen").isNull(), Observation(f"crawl-{uuid.uuid4().hex}")
    counts = [F.count_if(new).alias("new"), F.count_if(~new).alias("skipped"), F.count_if(new & (T.strip(F.coalesce(body, F.lit(""))) == "")).alias("empty")]
    write(marked.observe(seen, *counts).filter(new).select(items.columns))
    return {k: seen.get[k] or 0 for k in ("new", "skipped", "empty")}


def crawl_counts(items: DataFrame, done: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """One row (new, skipped, empty): items not seen before, items that were, and new ones without a body."""
    marked = items.join(done.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    new = F.col("_seen").isNull()
    return marked.agg(F.count_if(new).alias("new"), F.count_if(~new).alias("skipped"), F.count_if(new & (T.strip(F.coalesce(body, F.lit(""))) == "")).alias("empty"))


def bodies(pages: DataFrame, element: str | None = None, host: str = "") -> DataFrame:
    """(url, text, images, pdfs): text joined by spaces, images worth OCR and PDF links in the order of the page."""
    schema = pa.schema([("url", pa.string()), ("text", pa.string()), ("images", pa.list_(pa.string())), ("links", pa.list_(pa.list_(pa.string())))])

    def run(batches):
        for batch in in_ranges(batches):
            out = []
            for url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser = _Text(element)
                parser.feed(html or "")
                out.append((url, " ".join(parser.parts), parser.images, parser.links))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)

    raw = pages.select("url", "html").mapInArrow(run, "url string, text string, images array<string>, links array<array<string>>")
    images = F.transform(F.filter("images", T.is_text_image), lambda s: T.absolute(s, host))
    pdf: Column = F.filter("links", lambda a: a[0].contains("download") & F.lower(T.strip(a[1])).endswith(".pdf"))
    return raw.select("url", "text", images.alias("images"), F.transform(pdf, lambda a: T.absolute(a[0], host)).alias("pdfs"))


def full_body(parts: DataFrame) -> DataFrame:
    """(url, body) of parts (url, ordinal, kind: text, ocr or pdf, text): non-blank parts in order, OCR and PDF parts marked."""
    marked = F.when(F.col("kind") == "ocr", F.concat(F.lit("[OCR] "), "text")).when(F.col("kind") == "pdf", F.concat(F.lit("[PDF] "), "text")).otherwise(F.col("text"))
    some = parts.filter(T.strip(F.coalesce("text", F.lit(""))) != "").select("url", "ordinal", marked.alias("text"))
    return some.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ").alias("body"))


def ocr_tiles(height: Column, tile: int = I.TILE, overlap: int = I.OVERLAP) -> Column:
    """Array of (top, bottom) of the tiles of an image of this height."""
    tops = F.sequence(F.lit(0), F.greatest(height - overlap - 1, F.lit(0)), F.lit(tile - overlap))
    return F.transform(tops, lambda y: F.struct(y.alias("top"), F.least(y + tile, height).alias("bottom")))


def large_enough(height: Column, width: Column) -> Column:
    return (height >= I.LEAST_HEIGHT) & (width >= I.LEAST_WIDTH)


def recognise(files: DataFrame, engine, pages: int = 10) -> DataFrame:
    """(path, ordinal, text) from files (path, content). engine(content) gives the texts of a file's pages; an error gives none. At most ``pages`` of each."""
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("text", pa.string())])

    def run(batches):
        for batch in in_ranges(batches):
            out = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = list(engine(content))[:pages]
                except Exception:  # noqa: BLE001  an unreadable file has no text
                    found = []
                out += [(path, k, t) for k, t in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, schema, strict=True)], schema=schema)

    raw = files.select("path", "content").mapInArrow(run, "path string, ordinal int, text string")
    return raw.withColumn("text", T.clean_ocr("text")).filter("text <> ''")


def recognised(files: DataFrame, engine: I.Engine, pages: int = 10) -> DataFrame:
    """(path, text) of images and PDF files (path, content and, where it does not follow from the path's extension, format).

    Images too small for text are left out; the others are prepared and read tile by tile. A PDF gives the text layer of
    its first ``pages`` pages, and only where that is blank the text of their pictures. Unreadable files have no text.
    """
    schema = pa.schema([("path", pa.string()), ("format", pa.string()), ("text", pa.string())])
    wanted = files.select("path", "content", F.col("format") if "format" in files.columns else T.image_format("path").alias("format"))

    def run(batches):
        for batch in in_ranges(batches):
            rows = [(path, form, I.file_text(engine, content, form, pages)) for path, content, form in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [[]] * 3, schema=schema)

    raw = wanted.mapInArrow(run, "path string, format string, text string")
    return raw.select("path", F.when(F.col("format") == "pdf", T.strip("text")).otherwise(T.clean_ocr("text")).alias("text")).filter("text <> ''")


def full_bodies(posts: DataFrame, files: DataFrame, engine: I.Engine, element: str | None = None, host: str = "") -> DataFrame:
    """(url, body) of posts (url, html): their text, that of their images worth reading and that of their PDF files, in this order.

    files: (path, content) of what has been fetched, path being the absolute URL.
    """
    body = bodies(posts, element, host)
    refs = body.select("url", F.posexplode(F.concat(F.transform("images", lambda p: F.struct(F.lit("ocr").alias("kind"), p.alias("path"))), F.transform("pdfs", lambda p: F.struct(F.lit("pdf").alias("kind"), p.alias("path"))))).alias("at", "r"))
    refs = refs.select("url", (F.col("at") + 1).alias("ordinal"), "r.kind", "r.path")
    forms = refs.select("path", F.when(F.col("kind") == "pdf", "pdf").otherwise(T.image_format("path")).alias("format")).distinct()
    read = recognised(files.select("path", "content").join(forms, "path"), engine).groupBy("path").agg(F.max("text").alias("text"))
    parts = refs.join(read, "path").select("url", "ordinal", "kind", "text")
    text = body.select("url", F.lit(0).alias("ordinal"), F.lit("text").alias("kind"), "text")
    joined = full_body(text.unionByName(parts))
    return body.select("url").join(joined, "url", "left").select("url", F.coalesce("body", F.lit("")).alias("body"))
