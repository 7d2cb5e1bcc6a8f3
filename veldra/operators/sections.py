"""HTML pages to section records: a table function over the standard library's parser.

Lists read as one paragraph, their items joined by ``; ``. An unclosed paragraph ends where the next
block begins, so its text is not repeated in what encloses it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.operators.chunking import merge_short

# Headings, dates and authors' titles of the two publishers.
SECTION_NUMBER = re.compile(r"\s*(\d+)\s*([a-zåäö])?\s*§", re.I)
NUMERIC_PREFIX = re.compile(r"\s*(\d+(?:\.\d+)*)")
AMENDMENT_DATE = re.compile(r"\d{1,2}\.\d{1,2}\.\d{4}")
AUTHOR_PREFIXES = ("johtava veroasiantuntija", "ylitarkastaja", "veroasiantuntija", "ylijohtaja", "pääjohtaja")
REPEALED, NOTICE_CLASS, TITLE_CLASS = "kumottu", "attention-box", "taxxa-title"

SECTION_FIELDS = (
    "publisher string, statute_name string, chapter string, section_id string, section_title string, section_number string, node_type string, "
    "amendment_date string, is_superseded boolean, superseded_by array<string>, paragraphs array<string>, cross_refs array<string>, raw_text string"
)
_HEADINGS, _LISTS = ("h1", "h2", "h3", "h4"), ("ul", "ol")
_BLOCKS = {*_HEADINGS, *_LISTS, "p", "div", "article", "section", "table", "nav", "body", "footer", "header"}


class Blocks(HTMLParser):
    """The headings, paragraphs and lists of a page in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.notices: list[dict] = []
        self.open: list[dict] = []
        self.hidden = 0
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in _BLOCKS:
            self._end("p")
        kinds = named.get("class", "").split()
        if tag in (*_HEADINGS, *_LISTS, "p") or (tag == "div" and NOTICE_CLASS in kinds):
            block = {"tag": tag, "id": named.get("id", ""), "classes": kinds, "parts": [], "items": [], "links": []}
            if tag != "div":
                self.blocks.append(block)
            if NOTICE_CLASS in kinds:
                self.notices.append(block)
            self.open.append(block)
        elif tag == "li":
            self._end("li", until=_LISTS)
            item = {"tag": "li", "parts": [], "links": []}
            for block in self.open:  # items of nested lists count for the outer ones too
                if block["tag"] in _LISTS:
                    block["items"].append(item)
            self.open.append(item)
        elif tag == "a" and named.get("href"):
            for block in self.open:
                if named["href"] not in block["links"]:
                    block["links"].append(named["href"])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS or tag == "li":
            if tag not in ("p", "li"):
                self._end("p")
            self._end(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden and (clean := data.strip()):
            self.text.append(clean)
            for block in self.open:
                block["parts"].append(clean)

    def _end(self, tag: str, until: tuple = ()) -> None:
        """Close the innermost open ``tag`` with what is open inside it, unless ``until`` stands before it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return
            if self.open[i]["tag"] in until:
                return

    def close(self) -> None:
        super().close()
        for tag in ("p", "li", *_LISTS):
            while any(b["tag"] == tag for b in self.open):
                self._end(tag)


def text_of(block: dict) -> str:
    if block["tag"] in _LISTS and block["items"]:
        return "; ".join(t for item in block["items"] if (t := " ".join(item["parts"])))
    return " ".join(block["parts"])


def parsed(html: str) -> Blocks:
    page = Blocks()
    page.feed(html or "")
    page.close()
    return page


def parse_sections(html: str, publisher: str) -> list[dict]:
    """Section records of a page, before short ones are merged; an unknown publisher is an error."""
    if publisher not in ("finlex", "vero"):
        raise ValueError(f"unknown publisher: {publisher!r}")
    page = parsed(html)
    titles = [b for b in page.blocks if b["tag"] == "h1"]
    marked = [b for b in titles if publisher == "vero" and TITLE_CLASS in b["classes"]]
    statute = text_of((marked or titles)[0]) if titles else ""
    repealed = [b for b in page.notices if publisher == "vero" and REPEALED in text_of(b).lower()]
    standing = {"is_superseded": bool(repealed), "superseded_by": list(dict.fromkeys(x for b in repealed for x in b["links"]))}
    out: list[dict] = []
    now: dict | None = None
    chapter, title_passed = "", False

    def begin(title: str, number: str, kind: str = "section", date: str = "", ident: str = "") -> dict:
        return {
            "publisher": publisher, "statute_name": statute, "chapter": chapter, "section_id": ident, "section_title": title, "section_number": number,
            "node_type": kind, "amendment_date": date, **standing, "paragraphs": [], "cross_refs": [],
        }

    def flush() -> None:
        if now and now["paragraphs"]:
            out.append(now | {"raw_text": "\n\n".join(x for x in (now["section_title"], *now["paragraphs"]) if x)})

    for block in page.blocks:
        tag, text = block["tag"], text_of(block)
        if tag in _HEADINGS:
            if publisher == "finlex":
                if tag == "h1":
                    continue
                flush()
                now = None
                if tag == "h2":
                    chapter = text
                elif tag == "h3":
                    m = SECTION_NUMBER.match(text)
                    now = begin(text, m[1] + (m[2] or "").lower() if m else "", ident=block["id"])
                else:
                    m = AMENDMENT_DATE.search(text)
                    now = begin(text, "", "amendment_provision", m[0] if m else "", block["id"])
            elif not title_passed and TITLE_CLASS in block["classes"]:
                title_passed = True
            elif text:
                flush()
                m = NUMERIC_PREFIX.match(text)
                now = begin(text, m[1] if m else "", ident=block["id"])
            continue
        if publisher == "vero":
            if NOTICE_CLASS in block["classes"] or not text or (len(text.strip()) <= 80 and text.strip().lower().startswith(AUTHOR_PREFIXES)):
                continue
            now = now or begin(statute or "intro", "")
        if now is None:
            continue
        if text:
            now["paragraphs"].append(text)
        now["cross_refs"] += [x for x in block["links"] if x not in now["cross_refs"]]
    flush()
    return out


def sections(pages: DataFrame) -> DataFrame:
    """``(source_file, pos, error, <section fields>)`` for ``pages(source_file, publisher, html)``, short sections merged.

    A page that cannot be parsed gives one row that holds its error and no section.
    """
    kind = f"source_file string, error string, sections array<struct<{SECTION_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
    names = [f.strip().split(" ")[0] for f in SECTION_FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, publisher, html in batch[["source_file", "publisher", "html"]].itertuples(index=False):
                try:
                    rows.append((source, None, [{n: s[n] for n in names} for s in parse_sections(html, publisher)]))
                except Exception as bad:
                    rows.append((source, f"{type(bad).__name__}: {bad}", []))
            yield pd.DataFrame(rows, columns=["source_file", "error", "sections"])

    found = pages.select("source_file", "publisher", "html").mapInPandas(run, kind)
    merged = found.select("source_file", "error", merge_short(F.col("sections")).alias("sections"))
    each = merged.select("source_file", "error", F.posexplode_outer("sections").alias("pos", "s"))
    return each.where("s IS NOT NULL OR error IS NOT NULL").select("source_file", F.coalesce("pos", F.lit(0)).alias("pos"), "error", "s.*")


def html_text(html: Column) -> Column:
    """Visible text by patterns alone: scripts, styles, comments and tags go, entities are read, spaces collapse."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, mark in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(mark))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def links(html: Column) -> Column:
    """The distinct link targets of a page in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'<a\s[^>]*?href="([^"]+)"'), F.lit(1)))


def toc_items(toc: str) -> int:
    """Entries of a table of contents given as JSON, children included; 0 if it cannot be read."""
    import json

    def count(items: list) -> int:
        return sum(1 + count(i.get("Children") or []) for i in items)

    try:
        return count(json.loads(toc).get("IndexItems", []))
    except Exception:
        return 0
