"""HTML and XML parsers, as pandas UDFs over whole columns."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F

HIDDEN = {"script", "style", "noscript", "head", "title"}


class _Article(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def article_text(page: str | None, most: int = 1200) -> str | None:
    """Visible text, what stands between tags parted by spaces, at most `most` characters with an ellipsis where something is cut."""
    if page is None:
        return None
    parser = _Article()
    parser.feed(page)
    parser.close()
    text = " ".join(html.unescape(" ".join(parser.parts)).split())
    return (text if len(text) <= most else text[: most - 1].rstrip() + "…") or None


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v]


def page_links(page: str | None, base: str | None, prefix: str = "") -> list[str]:
    """Targets of a page's links against its address whose path begins with a prefix, each once, in order."""
    parser = _Links()
    parser.feed(page or "")
    out = {}
    for link in parser.found:
        try:
            target = urljoin(base or "", link)
            if urlparse(target).path.startswith(prefix):
                out.setdefault(target)
        except ValueError:
            continue
    return list(out)


class _Results(HTMLParser):
    """Search results: an anchor of class result__a opens one, result__snippet belongs to it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.into, self.tag = None, None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        if tag == "a" and "result__a" in classes:
            self.rows.append({"title": "", "url": given.get("href"), "snippet": ""})
            self.into, self.tag = "title", tag
        elif "result__snippet" in classes and self.rows:
            self.into, self.tag = "snippet", tag

    def handle_endtag(self, tag):
        if tag == self.tag:
            self.into = None

    def handle_data(self, data):
        if self.into:
            self.rows[-1][self.into] += data


def search_results(page: str | None) -> list[dict]:
    parser = _Results()
    parser.feed(page or "")
    clean = lambda x: " ".join((x or "").split()) or None
    return [{"title": clean(r["title"]), "url": r["url"], "snippet": clean(r["snippet"])} for r in parser.rows]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _child(node, *names: str) -> str | None:
    for name in names:
        for c in node:
            if _local(c.tag) == name and (text := (c.text or "").strip()):
                return text
    return None


def feed_entries(payload: str | None) -> list[dict] | None:
    """Entries of an RSS, RDF or Atom document, whatever its namespaces; null where it can't be parsed."""
    try:
        root = ElementTree.fromstring(payload or "")
    except ElementTree.ParseError:
        return None
    channels = [c for c in root if _local(c.tag) == "channel"]
    nodes = [i for c in channels for i in c if _local(i.tag) == "item"] + [c for c in root if _local(c.tag) == "item"] + [c for c in root if _local(c.tag) == "entry"]
    out = []
    for node in nodes:
        link = next((c.get("href") or (c.text or "").strip() for c in node if _local(c.tag) == "link" and (c.get("href") or (c.text or "").strip())), None)
        title = _child(node, "title")
        guid = _child(node, "guid") or _child(node, "id") or link or title
        out.append({"guid": guid, "title": title, "url": link, "created_at": _child(node, "pubDate", "published", "updated"), "updated_at": _child(node, "updated", "published"), "excerpt": _child(node, "description", "summary")})
    return out


def sitemap_locations(payload: str | None) -> dict | None:
    """{'kind': 'urlset' or 'sitemapindex', 'locations': [...]} of a sitemap document."""
    try:
        root = ElementTree.fromstring(payload or "")
    except ElementTree.ParseError:
        return None
    found = [(c.text or "").strip() for n in root for c in n if _local(c.tag) == "loc"]
    return {"kind": _local(root.tag), "locations": [x for x in found if x]}


def plain(text: str | None) -> str | None:
    """Tags to spaces, all entities resolved, white space collapsed."""
    return None if text is None else " ".join(html.unescape(re.sub(r"<[^>]+>", " ", text)).split())


def _mapped(function, returns: str):
    """A pandas UDF over the columns it is given; made when called, as its type needs a session."""

    def call(*columns):
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([function(*values) for values in zip(*series)], dtype="object")

        def one(a: pd.Series) -> pd.Series:
            return run(a)

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return F.pandas_udf(one if len(columns) == 1 else two, returns)(*columns)

    return call


article_text_udf = _mapped(article_text, "string")
page_links_udf = _mapped(page_links, "array<string>")
search_results_udf = _mapped(search_results, "array<struct<title:string,url:string,snippet:string>>")
feed_entries_udf = _mapped(feed_entries, "array<struct<guid:string,title:string,url:string,created_at:string,updated_at:string,excerpt:string>>")
plain_udf = _mapped(plain, "string")
_locations_udf = _mapped(lambda payload: None if (found := sitemap_locations(payload)) is None else [found["kind"], *found["locations"]], "array<string>")


def sitemap_udf(payload):
    """struct<kind, locations> of a sitemap document; null where it can't be parsed."""
    found = _locations_udf(payload)
    return F.when(found.isNotNull(), F.struct(found[0].alias("kind"), F.slice(found, F.lit(2), F.size(found)).alias("locations")))
