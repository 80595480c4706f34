"""Scalar functions against Python's own, on fixtures and generated text."""

import hashlib
import re
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import text as T


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", f(F.col("x")).alias("y")).collect())]


def python_url(url, drop="layout"):
    parsed = urlparse(url)
    params = parse_qs(parsed.query)
    params.pop(drop, None)
    return urlunparse(parsed._replace(query=urlencode({k: v[0] for k, v in params.items()})))


def test_clean_url_fixtures(spark):
    urls = ["http://a.b/c?x=1&x=2&layout=q&y=", "http://a.b/c?k=a%20b&z=%7E*", "http://a.b/c?한=글#top", "http://a.b/c", "http://a.b/c?layout=1", "http://a.b/?a=1&b=%ED%95%9C", "http://a.b/c?a=b=c&d"]
    assert apply(spark, urls, T.clean_url) == [python_url(u) for u in urls]


def test_clean_url_generated(spark):
    found = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.tuples(st.sampled_from(["a", "b", "layout", "k1"]), st.text("ab1~*-_.é ", max_size=4)), max_size=5), st.sampled_from(["", "#f"]))
    def make(pairs, fragment):
        found.append("http://h.io/p?" + urlencode(pairs) + fragment)

    make()
    assert apply(spark, found, T.clean_url) == [python_url(u) for u in found]


def test_clean_title(spark):
    titles = ["학사  공지\n안내 새글", "장학 국가장학금 HOT", "취업취업 박람회", "　제목 ", "", None, "국제"]
    assert apply(spark, titles[:1] + [" a  b "], lambda c: T.clean_title(c, ())) == ["학사 공지 안내", "a b"]
    assert apply(spark, titles, lambda c: T.clean_title(c, ("국제", "학사", "장학", "취업"))) == ["공지 안내", "국가장학금", "취업 박람회", "제목", "", None, ""]


def test_tokenize(spark):
    words = apply(spark, ["Hello, World_1! 한글 테스트", "", None, "É²x"], T.tokenize)
    assert words[0] == ["hello", "world_1", "한글", "테스트"] and words[1] == [] and words[2] == []


def test_summary(spark):
    long = "This is the first one. Short. Another long sentence here! Third long sentence。Yes it is"
    assert apply(spark, [long, "tiny. no."], T.extractive_summary) == ["This is the first one. Another long sentence here.", "tiny. no."]


def test_json_repair(spark):
    texts = ['```json\n{"a": 1}\n```', '{"a": 2} thanks', '{"a": 3}', "[broken", '```\n{"a": 5}```']
    got = apply(spark, texts, lambda c: T.parsed_json(c, "a int")["a"])
    assert got == [1, 2, 3, None, 5]


def test_images_and_ocr(spark):
    names = ["http://x/a.PNG", "http://x/logo.png", "http://x/b.gif?c=.png", "http://x/scan"]
    assert apply(spark, names, T.is_text_image) == [True, False, False, True]
    assert apply(spark, names, T.image_format) == ["png", "png", "jpg", "jpg"]
    assert apply(spark, ["a\n\n\nb  \tc ★한글!"], T.clean_ocr) == ["a\nb c 한글!"]


def test_small_ones(spark):
    assert apply(spark, ["please retry in 7 s", "no number", None], T.retry_delay) == [9, 60, 60]
    assert apply(spark, [["a", "b"], []], T.numbered, "array<string>") == ["1. a\n2. b", ""]
    assert apply(spark, ["/x", "http://y"], lambda c: T.absolute(c, "http://h")) == ["http://h/x", "http://y"]
    assert apply(spark, ["x" * 299, "x" * 300, None], T.qa_counts) == [(2, 1), (3, 2), (2, 1)]
    assert apply(spark, ["t\nb\nc", "only", None], T.title_of) == ["t", "only", ""]
    assert apply(spark, ["t\nb\nc", "only", None], T.body_of) == ["b\nc", "", ""]
    assert apply(spark, ["é"], F.md5) == [hashlib.md5("é".encode()).hexdigest()]


def test_strip_like_python(spark):
    texts = ["  a　", "\x1c b \x85", " ", "c"]
    assert apply(spark, texts, T.strip) == [t.strip() for t in texts]
    assert re.sub(r"\s+", "", " ") == ""
