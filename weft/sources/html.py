"""Text and links out of raw HTML columns."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weft.functions.text import strip_tags

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Elements(HTMLParser):
    """Texts of all elements of one tag and class, nested ones too, in the order they begin."""

    def __init__(self, tag: str, css_class: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css_class = tag.lower(), css_class
        self.found: list[list[str]] = []
        self.open: list[list[str] | None] = []  # the open elements of the tag; None: of another class

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_data(" ")
        if tag == self.tag:
            match = self.css_class is None or self.css_class in (dict(attrs).get("class") or "").split()
            text: list[str] | None = [] if match else None
            if match:
                self.found.append(text)
            if tag not in VOID:
                self.open.append(text)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.tag and self.open:
            self.open.pop()
        self.handle_data(" ")

    def handle_data(self, data: str) -> None:
        for text in self.open:
            if text is not None:
                text.append(data)


class Links(HTMLParser):
    """Targets of the links, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        target = dict(attrs).get("href")
        if tag == "a" and target:
            self.found.append(target)


def parsed(parser: HTMLParser, page: str | None) -> HTMLParser:
    parser.feed(page or "")
    parser.close()
    return parser


def html_extract(pages: DataFrame, key: str, html: str, tag: str, css_class: str | None = None) -> DataFrame:
    """Text of every ``tag`` element of a class (one of its classes), in page order: (key, pos, text)."""

    @F.pandas_udf("array<string>")
    def texts(page: pd.Series) -> pd.Series:
        return page.map(lambda p: [" ".join("".join(t).split()) for t in parsed(Elements(tag, css_class), p).found])

    return pages.select(key, F.posexplode(texts(F.col(html))).alias("pos", "text"))


def html_links(pages: DataFrame, key: str, html: str, pattern: str = ".", suffix: str = "") -> DataFrame:
    """Links that match a pattern and end in a suffix, with their file name: (key, pos, link, file)."""

    @F.pandas_udf("array<string>")
    def targets(page: pd.Series) -> pd.Series:
        return page.map(lambda p: parsed(Links(), p).found)

    links = pages.select(key, F.posexplode(targets(F.col(html))).alias("pos", "link"))
    return links.filter(F.col("link").rlike(pattern) & F.col("link").endswith(suffix)).withColumn(
        "file", F.substring_index("link", "/", -1)
    )


def contains_text_watch(pages: DataFrame, key: str, url: str, html: str, term: str) -> DataFrame:
    """Pages whose text contains a term; works on batch and streaming frames alike."""
    return pages.select(key, url, strip_tags(F.col(html)).alias("text")).filter(F.contains("text", F.lit(term))).select(
        key, url, F.lit(term).alias("term")
    )
