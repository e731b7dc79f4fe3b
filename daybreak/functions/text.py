"""Text kernels as built-in column expressions."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of every character that Unicode counts as white space, with the four separators of ASCII.
BLANKS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: A reference to a character: by number, or by a name whose semicolon may be missing.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def truncate(text: Column, most: int = 160) -> Column:
    """Collapsed text of at most `most` characters, the last of them an ellipsis where something is cut."""
    flat = collapse(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


@cache
def _names() -> tuple[str, str, int]:
    """The names of HTML 5 and what they stand for, as JSON: all of them, and those that need no semicolon with the longest one's length."""
    bare = {k: v for k, v in html5.items() if not k.endswith(";")}
    return json.dumps(html5), json.dumps(bare), max(map(len, bare))


def _character(number: Column) -> Column:
    """The character of a numeric reference: those of Windows in place of C1 controls, none for other controls and noncharacters, U+FFFD outside of Unicode."""
    windows = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))
    place = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    control = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    outside = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    in_windows = F.substring(F.lit(windows), (number - 0x7F).cast("int"), F.lit(1))
    return F.when(outside, "\ufffd").when(number.between(0x80, 0x9F), in_windows).when(control, "").otherwise(place)


def _resolved(reference: Column) -> Column:
    """What a reference stands for; one without a meaning stays, but for the name it may begin with."""
    every, bare, longest = _names()
    all_names, bare_names = (F.from_json(F.lit(x), "map<string,string>") for x in (every, bare))
    name = F.substring(reference, 2, 64)
    hexadecimal = F.lower(F.substring(reference, 3, 1)) == "x"
    digits = F.regexp_replace(F.when(hexadecimal, F.substring(reference, 4, 1 << 20)).otherwise(F.substring(reference, 3, 1 << 20)), "^0+|;$", "")
    number = F.when(F.length(digits) > 7, None).when(digits == "", 0).when(hexadecimal, F.conv(digits, 16, 10).cast("long")).otherwise(F.try_to_number(digits, F.lit("9999999")).cast("long"))
    begins = [F.when(F.length(name) > n, F.concat(F.try_element_at(bare_names, F.substring(name, 1, n)), F.substring(name, n + 1, 64))) for n in range(longest, 1, -1)]
    return F.when(name.startswith("#"), _character(number)).otherwise(F.coalesce(F.try_element_at(all_names, name), *begins, reference))


#: References that nearly all texts get along with; the ampersand's is replaced last, so what it leaves isn't resolved again.
COMMON = ("lt", "gt", "quot", "#39", "nbsp", "copy", "middot", "amp")


def unescape(text: Column) -> Column:
    """Named and numeric character references resolved once, as HTML 5 has them."""

    def resolved(given: Column) -> Column:
        plain = given
        for name in COMMON:
            plain = F.replace(plain, F.lit(f"&{name};"), F.lit(chr(39) if name == "#39" else html5[f"{name};"]))
        found = F.transform(F.regexp_extract_all(given, F.lit(REFERENCE), 0), _resolved)
        whole = F.array_join(F.zip_with(F.split(given, REFERENCE), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        return F.when(given.rlike(f"&(?!(?:{'|'.join(COMMON)});)"), whole).otherwise(plain)

    return F.get(F.transform(F.array(text), resolved), 0)  # the text is made once, however often it is used


def strip_tags(html: Column) -> Column:
    """Tags to spaces, character references resolved, white space collapsed."""
    return collapse(unescape(F.regexp_replace(html, r"<[^>]+>", " ")))


def single_line(text: Column) -> Column:
    """Text without tags in one line; null where nothing is left."""
    return F.nullif(strip_tags(text), F.lit(""))


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def page_title(html: Column) -> Column:
    return single_line(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def slug_title(url: Column) -> Column:
    """The last part of a URL's path as words, its first letter in upper case; the URL where there is none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    words = F.trim(F.translate(F.element_at(F.split(F.regexp_replace(path, r"^[a-zA-Z]+://[^/]*", ""), "/"), -1), "-_", "  "))
    return F.when(words == "", url).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20)))


def key_values(text: Column) -> Column:
    """Lines `key: value` as a map; keys trimmed in lower case, the last of equal keys wins."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p.k.alias("k"), p.v.alias("v"), F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q.k == p.k).alias("again"))), lambda p: ~p.again)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p.k, p.v)))


def links_to_pipes(markdown: Column) -> Column:
    """[label](url) to <url|label>."""
    return F.regexp_replace(markdown, r"\[([^\]]+)\]\((https?://[^)]+)\)", "<$2|$1>")


def link_urls(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"\[[^\]]+\]\((https?://[^)]+)\)"), 1)


def identity(url: Column, primary_url: Column, item_id: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(primary_url, F.lit("")), item_id)


def fingerprint(*parts: Column) -> Column:
    """sha256 over the parts; a null differs from an empty text."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts)), 256)


def spend_cap(message: Column) -> Column:
    low = F.lower(message)
    return low.contains("spend cap") | low.contains("creditsdepleted") | low.contains("spendcapreached")


def reset_date(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b", 1), F.lit(""))


def clean_title(title: Column, product: str) -> Column:
    """A title without white space around it and without the product's name at its end; blank ones are null."""
    flat = F.regexp_replace(title, f"^{BLANKS}|{BLANKS}$", "")
    cut = F.when(flat.endswith(f" - {product}"), F.regexp_replace(F.substring(flat, F.lit(1), F.length(flat) - len(product) - 3), f"{BLANKS}$", "")).otherwise(flat)
    return F.nullif(cut, F.lit(""))


def resolved_title(title: Column, fetched: Column, synthesised: Column, url: Column, excerpt: Column, body: Column) -> Column:
    """The title ladder: the own title, a fetched one, one made of the text, the address without its scheme; without an address the excerpt, the body, a default."""
    some = lambda c: F.nullif(truncate(c), F.lit(""))
    bare = F.regexp_replace(url, r"^.*?//", "")
    addressed = F.coalesce(some(fetched), some(synthesised), bare)
    return F.coalesce(some(title), F.when(F.coalesce(url, F.lit("")) != "", addressed).otherwise(F.coalesce(some(excerpt), some(body), F.lit("Untitled item"))))


def subject_key(source: Column, item_id: Column) -> Column:
    """What a suppression names: the JSON list of source and id."""
    return F.to_json(F.array(source, item_id))
