"""Text kernels against Python's: character references, white space, articles of the whole table."""

from __future__ import annotations

import html
import random
import re
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import functions as F

from daybreak.functions import text
from daybreak.plans import content

FOLDER = "/root/testdata/sf0.01"


def test_character_references_are_those_of_python(spark):
    rng = random.Random(2)
    refs = [f"&{n}" for n in html5] + [f"&{n.rstrip(';')}x" for n in html5] + [f"&{n.rstrip(';')}=1;" for n in rng.sample(list(html5), 300)]
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 9999999, 10**8, 10**30]
    refs += [f"&#{n};" for n in numbers] + [f"&#x{n:x};" for n in numbers] + [f"&#X{n:X} " for n in numbers] + [f"&#000{n}" for n in numbers]
    refs += ["&", "&;", "&#;", "&#x;", "&#xg;", "& amp;", "&amp;amp;", "&&amp;", "a&b", "&notit;", "&noti", "&ampamp;", "&" + "x" * 40, "&é;", "&amp", "x&lt;y&gt;z", "", "no reference", "&\U0001f600;"]
    mixed = ["".join(rng.choice(refs) + rng.choice(["", " ", "é", ";"]) for _ in range(6)) for _ in range(500)]
    cases = refs + mixed
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    got = {r.k: r.out for r in df.select("k", text.unescape(F.col("c")).alias("out")).collect()}
    assert [(c, got[k]) for k, c in enumerate(cases) if got[k] != html.unescape(c)] == []
    assert df.select(text.unescape(F.lit(None).cast("string")).alias("n")).first().n is None


def test_white_space_is_that_of_python(spark):
    chars = [chr(n) for n in range(0x3100) if not 0xD800 <= n < 0xE000]
    df = spark.createDataFrame([(k, f"{c} a{c}{c}b{c}") for k, c in enumerate(chars)], "k int, c string")
    got = {r.k: r.out for r in df.select("k", text.collapse(F.col("c")).alias("out")).collect()}
    assert [hex(ord(c)) for k, c in enumerate(chars) if got[k] != " ".join(f"{c} a{c}{c}b{c}".split())] == []


def test_lines_titles_and_cuts(spark):
    row = spark.range(1).select(
        text.single_line(F.lit(" <p>\n</p>　one&nbsp;<b>two</b>&hearts;\n three")).alias("a"), text.single_line(F.lit("<br>\n&nbsp;")).alias("b"),
        text.page_title(F.lit("<TITLE lang=x>Tom &amp;　Jerry &copy 2024</TITLE>")).alias("c"), text.truncate(F.lit("a b c"), 4).alias("d"), text.clean_title(F.lit("　A - Grok "), "Grok").alias("e"),
    )
    assert tuple(row.first()) == ("one two ♥ three", None, "Tom & Jerry © 2024", "a b…", "A")


class Visible(HTMLParser):
    """What stands between tags outside of hidden elements."""

    def __init__(self):
        super().__init__()
        self.open, self.data = 0, []

    def handle_starttag(self, tag, attrs):
        self.open += tag in ("script", "style", "noscript", "head", "title")

    def handle_endtag(self, tag):
        self.open -= self.open > 0 and tag in ("script", "style", "noscript", "head", "title")

    def handle_data(self, data):
        self.data += [data] if not self.open else []


def test_articles_of_the_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r.page_id: r.body for r in content.article_bodies(spark, FOLDER).collect()}
    assert got.keys() == pages.keys()
    for key, page in pages.items():
        parser = Visible()
        parser.feed(page or "")
        parser.close()
        flat = re.sub(r"\s+", " ", html.unescape(" ".join(parser.data))).strip()
        want = flat if len(flat) <= 1200 else flat[:1199].rstrip() + "…"
        assert got[key] == (want or None)


def test_links_of_the_whole_table(spark):
    """Targets in order, each once, against a plain scan of anchors."""
    from urllib.parse import urljoin

    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}

    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.found += [v for k, v in attrs if tag == "a" and k == "href" and v]

    got = {}
    for r in content.link_extract(spark, FOLDER).collect():
        got.setdefault(r.page_id, []).append((r.pos, r.url))
    want = {}
    for key, page in pages.items():
        parser = Anchors()
        parser.feed(page.html or "")
        want[key] = list(enumerate(dict.fromkeys(urljoin(page.url, x) for x in parser.found)))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(got) > 100
