"""Scalar text functions as native columns. They follow Python's idea of white space and word characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() and re see it; Java's own class has ASCII only.
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
#: Letters, digits and underscores of every script.
WORD = r"[\p{L}\p{N}_]+"

# Markers that end a title.
TITLE_MARKERS = ("새글", "hot", "NEW")
# Image extensions that OCR takes, and those and names that it skips.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "pdf")
SKIPPED_EXTENSIONS = (".gif", ".svg", ".ico", ".webp", ".bmp")
SKIPPED_NAMES = ("logo", "banner", "icon", "btn_", "bullet", "bg_", "spacer", "arrow", "line_", "border")
#: What OCR noise removal keeps, beside word characters, white space and Hangul. Fixed value.
KEPT_MARKS = r".,!?%\-:/()\[\]@#&*+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+$", "")


def tokenize(c: Column | str) -> Column:
    """Lower-cased runs of word characters; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD), 0)


def _any_of(words) -> str:
    return "|".join(w.replace("\\", "\\\\").replace(".", r"\.") for w in words)


def clean_title(c: Column | str, labels, markers=TITLE_MARKERS) -> Column:
    """One line, single spaces, without one leading label of the board (labels: those that it uses) and one trailing marker."""
    out = F.regexp_replace(col(c), r"[\r\n]", " ")
    out = strip(F.regexp_replace(out, rf"{WS}{{2,}}", " "))
    out = strip(F.regexp_replace(out, rf"^(?:{_any_of(labels)}){WS}*", ""))
    return strip(F.regexp_replace(out, rf"(?i){WS}*(?:{_any_of(markers)}){WS}*$", ""))


def _decode(c: Column) -> Column:
    """Percent-decoding that leaves malformed escapes alone."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_url(c: Column | str, dropped=("layout",)) -> Column:
    """The query without blank and dropped parameters, the first value of each key, encoded anew; the fragment stays."""
    url = col(c)
    bare, fragment = F.substring_index(url, "#", 1), F.when(F.instr(url, "#") > 0, F.substr(url, F.instr(url, "#"))).otherwise("")
    path, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.substr(bare, F.instr(bare, "?") + 1)).otherwise("")
    pairs = F.filter(F.split(query, "&"), lambda p: (F.instr(p, "=") > 0) & (F.substr(p, F.instr(p, "=") + 1) != ""))
    pairs = F.transform(pairs, lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), _decode(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    keys = F.filter(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: ~k.isin(*dropped)) if dropped else F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    kept = F.transform(keys, lambda k: F.concat(_encode(k), F.lit("="), _encode(F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"])))
    new = F.array_join(kept, "&")
    return F.concat(path, F.when(new != "", F.concat(F.lit("?"), new)).otherwise(""), F.when(fragment == "#", "").otherwise(fragment))


def absolute(c: Column | str, host: str) -> Column:
    return F.when(col(c).startswith("/"), F.concat(F.lit(host), col(c))).otherwise(col(c))


def sentences(c: Column | str, longer_than: int = 10) -> Column:
    parts = F.transform(F.split(col(c), rf"[.!?。]{WS}*"), strip)
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def extractive_summary(c: Column | str) -> Column:
    """The first two sentences of more than 10 characters, else the first 150 characters."""
    found = sentences(c)
    return F.when(F.size(found) > 0, F.concat(F.array_join(F.slice(found, 1, 2), ". "), F.lit("."))).otherwise(F.substring(col(c), 1, 150))


def extension(c: Column | str) -> Column:
    """The extension of the last path part, lower-cased, with its dot; '' if there is none."""
    name = F.regexp_extract(F.substring_index(col(c), "?", 1), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def is_text_image(c: Column | str) -> Column:
    """Worth sending to OCR, by extension and name."""
    return ~extension(c).isin(*SKIPPED_EXTENSIONS) & ~col(c).rlike(f"(?i)({'|'.join(SKIPPED_NAMES)})")


def image_format(c: Column | str, formats=IMAGE_EXTENSIONS) -> Column:
    ext = F.regexp_replace(extension(c), r"^\.+", "")
    return F.when(ext.isin(*formats), ext).otherwise("jpg")


def clean_ocr(c: Column | str) -> Column:
    out = F.regexp_replace(F.regexp_replace(col(c), r"\n{2,}", "\n"), r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_\s\p{{Z}}{KEPT_MARKS}]", ""))


def title_of(c: Column | str) -> Column:
    """The first line of a text."""
    return F.substring_index(F.coalesce(col(c), F.lit("")), "\n", 1)


def body_of(c: Column | str) -> Column:
    """What follows the first line; '' if nothing does."""
    text = F.coalesce(col(c), F.lit(""))
    return F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise("")


def repaired_json(c: Column | str) -> Column:
    """JSON out of a model's reply: without a code fence, cut after its last closing bracket."""
    text = strip(c)
    fenced = F.regexp_replace(F.element_at(F.split(text, "```"), 2), "^json", "")
    text = strip(F.when(text.startswith("```"), fenced).otherwise(text))
    cut = F.regexp_extract(text, r"(?s)^(.*[\]}])", 1)
    return F.when(cut != "", cut).otherwise(text)


def parsed_json(c: Column | str, schema: str) -> Column:
    return F.from_json(repaired_json(c), schema)


#: In a rate-limit error, the seconds to wait.
RETRY = r"retry[^0-9]{0,40}(\d{1,8})"


def retry_delay(message: Column | str) -> Column:
    """Seconds to wait after a rate-limit error: what it says and 2 more, else 60."""
    said = F.regexp_extract(col(message), RETRY, 1)
    return F.coalesce(F.nullif(said, F.lit("")).cast("int") + 2, F.lit(60))


def elapsed(seconds: Column | str) -> Column:
    """'2 min 5 s' for 125 seconds."""
    whole = F.floor(col(seconds))
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(" min "), (whole % 60).cast("string"), F.lit(" s"))


def request_stamp() -> Column:
    """Struct of a random id and the time in milliseconds, as requests to recognition services carry; other values for each row and run."""
    return F.struct(F.uuid().alias("id"), F.unix_millis(F.current_timestamp()).alias("millis"))


def numbered(c: Column | str) -> Column:
    """'1. first', '2. second' and so on, a line each."""
    return F.array_join(F.transform(col(c), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def qa_counts(body: Column | str) -> Column:
    """How many well-formed and user-like questions a notice gets."""
    short = F.length(F.coalesce(col(body), F.lit(""))) < 300
    return F.when(short, F.struct(F.lit(2).alias("well"), F.lit(1).alias("user"))).otherwise(F.struct(F.lit(3).alias("well"), F.lit(2).alias("user")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
