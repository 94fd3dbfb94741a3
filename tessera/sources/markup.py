"""HTML to text: Arrow batches with a stdlib parser, or regular expressions for flat pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = ("script", "style", "nav", "footer", "header")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.titled, self.title, self.parts = 0, 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden += 1
        elif tag == "title" and self.title is None:
            self.titled, self.title = 1, ""

    def handle_endtag(self, tag):
        if tag in DROPPED and self.hidden:
            self.hidden -= 1
        elif tag == "title":
            self.titled = 0

    def handle_data(self, data):
        if self.titled:
            self.title += data
        if not self.hidden:
            self.parts.append(data)


def visible(html: str) -> tuple[str, str]:
    """(title, text): visible lines, trimmed, blank ones left out."""
    p = _Visible()
    p.feed(html)
    p.close()
    lines = [x.strip() for part in p.parts for x in part.splitlines()]
    return (p.title or "").strip(), "\n".join(x for x in lines if x)


def html_documents(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, title, text) of pages with visible text."""
    dtype = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [visible(h or "") for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=[key, "title", "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {dtype}, title string, text string").where("text <> ''")


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def flat_text(html: Column) -> Column:
    """Text of a page without character references: dropped elements, comments and tags taken out by patterns."""
    out = html
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", "\n")
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")
