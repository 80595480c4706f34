"""Categories by ordered rules: title prefixes first, then keywords in the title, then keywords in the body.

The rules are data: an ordered mapping of prefixes to categories and one of categories to keywords, given by the caller or
read from a JSON file. The order of the categories matters: the first that matches wins. They compile to one expression, so
nothing is joined; matching is by case-sensitive substrings.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import col


@dataclass(frozen=True)
class Rules:
    prefixes: dict[str, str] = field(default_factory=dict)
    keywords: dict[str, list[str]] = field(default_factory=dict)
    default: str = "other"

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Rules:
        """A JSON object with prefixes, keywords and default, from any store that Spark reads."""
        return cls(**json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, priority, pattern, category) in the order of use."""
        rows = [(1, k, p, c) for k, (p, c) in enumerate(self.prefixes.items())]
        rows += [(stage, k, w, c) for stage in (2, 3) for k, (c, words) in enumerate(self.keywords.items()) for w in words]
        return spark.createDataFrame(rows, "stage int, priority int, pattern string, category string")


def _first_keyword(rules: Rules, text: Column) -> list[Column]:
    return [F.when(F.greatest(*[text.contains(w) for w in words], F.lit(False)), F.lit(c)) for c, words in rules.keywords.items() if words]


def infer_category(rules: Rules, title, body=None) -> Column:
    """body None: titles only. A null title or body matches nothing."""
    title = F.coalesce(col(title), F.lit(""))
    found = [F.when(title.startswith(p), F.lit(c)) for p, c in rules.prefixes.items()] + _first_keyword(rules, title)
    if body is not None:
        found += _first_keyword(rules, F.coalesce(col(body), F.lit("")))
    return F.coalesce(*found, F.lit(rules.default))


@lru_cache(maxsize=8)
def _matcher(keywords: tuple[tuple[str, tuple[str, ...]], ...]):
    """(automaton over all keywords that gives the place of the first category with each, place of the first category with the empty keyword)."""
    import ahocorasick

    places: dict[str, int] = {}
    for place, (_, words) in enumerate(keywords):
        for word in words:
            places.setdefault(word, place)
    always = places.pop("", None)
    if not places:
        return None, always
    automaton = ahocorasick.Automaton()
    for word, place in places.items():
        automaton.add_word(word, place)
    automaton.make_automaton()
    return automaton, always


def infer_category_at_once(rules: Rules, title, body=None) -> Column:
    """As infer_category(), for rules with very many keywords: an automaton finds all of them while it reads a text once.

    infer_category() looks for one keyword after another in native code and is the faster one as long as there are few.
    """
    names, prefixes = list(rules.keywords), dict(rules.prefixes)
    keywords = tuple((c, tuple(words)) for c, words in rules.keywords.items())
    lengths, order = sorted({len(p) for p in prefixes}), {p: k for k, p in enumerate(prefixes)}
    default = rules.default

    def run(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        automaton, always = _matcher(keywords)

        def first(text: str) -> int | None:
            least = always
            for _, place in automaton.iter(text) if automaton is not None else ():
                if least is None or place < least:
                    least = place
            return least

        def category(title, body):
            title = title or ""
            begun = [p for n in lengths if (p := title[:n]) in order]
            if begun:
                return prefixes[min(begun, key=order.get)]
            place = first(title)
            if place is None and body is not None:
                place = first(body)
            return default if place is None else names[place]

        return pd.Series([category(t, b) for t, b in zip(titles, bodies, strict=True)], dtype=object)

    text = F.lit(None).cast("string") if body is None else F.coalesce(col(body), F.lit(""))
    return F.pandas_udf(run, "string")(F.coalesce(col(title), F.lit("")), text)


def label_index(category, labels: list[str]) -> Column:
    """Place of a category among the labels, from 0; null for one that is not among them."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), col(category))
    return F.when(place > 0, (place - 1).cast("int"))
