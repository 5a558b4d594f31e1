"""Scalar functions of normalization, as column expressions; Python only where no built-in has the semantics."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from html.entities import html5
from urllib.parse import quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track, besides those that begin with utm_.
TRACKING = ("fbclid", "gclid", "msclkid", "yclid", "mc_eid", "ref")


def strip_tracking(url: Column) -> Column:
    """The url without tracking keys, the rest sorted by key; unchanged where no key matches.

    Native, for queries whose keys and values need no re-encoding; ``strip_tracking_full`` covers all.
    """
    bare, mark = F.regexp_extract(url, r"(?s)^([^#]*)", 1), F.regexp_extract(url, r"(?s)(#.*)$", 1)
    base, query = F.regexp_extract(bare, r"(?s)^([^?]*)", 1), F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    drop = lambda p: key(p).startswith("utm_") | key(p).isin(*TRACKING)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~drop(p))
    placed = F.transform(kept, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    again = F.array_join(F.transform(F.array_sort(placed), lambda x: x["p"]), "&")
    return F.when(F.exists(pairs, drop), F.concat(base, F.when(again != "", F.concat(F.lit("?"), again)).otherwise(""), mark)).otherwise(url)


def _strip(url: str | None) -> str | None:
    if url is None or "?" not in url:
        return url
    bare, hash_, mark = url.partition("#")
    base, _, query = bare.partition("?")
    pairs = [p for p in query.split("&") if p and ";" not in p]
    split = [(unquote_plus(k), unquote_plus(v)) for k, _, v in (p.partition("=") for p in pairs)]
    gone = lambda k: k.lower().startswith("utm_") or k.lower() in TRACKING
    if not any(gone(k) for k, _ in split):
        return url
    kept = sorted(((k, v) for k, v in split if not gone(k)), key=lambda x: x[0])
    enc = lambda s: quote_plus(s, safe="~").replace("*", "%2A")
    again = "&".join(f"{enc(k)}={enc(v)}" for k, v in kept)
    return base + ("?" + again if again else "") + hash_ + mark


@F.pandas_udf(T.StringType())
def strip_tracking_full(url: pd.Series) -> pd.Series:
    """As ``strip_tracking``, with the query decoded and encoded again; repeated keys keep their order."""
    return url.map(_strip)


def collapse(text: Column) -> Column:
    """Runs of tab, line feed, form feed, carriage return and space to one space; Unicode space trimmed at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[\t\n\f\r ]+", " "), "^[\\s\\u00A0\\u0085\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+|[\\s\\u00A0\\u0085\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+$", "")


def basic_entities(text: Column) -> Column:
    """The five entities of XML, decoded once; the ampersand last."""
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


@F.pandas_udf(T.StringType())
def all_entities(text: pd.Series) -> pd.Series:
    """Every named and numeric entity of HTML, decoded once."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def _closed(markup: str | None) -> str | None:
    return None if markup is None else _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], markup)


@F.pandas_udf(T.StringType())
def closed_references(markup: pd.Series) -> pd.Series:
    """Markup of which only references that end with a semicolon decode: every other ampersand is escaped. Browsers also decode ``&amp`` and others without one."""
    return markup.map(_closed)


def closed_entities(text: Column) -> Column:
    """As ``all_entities``, of references that end with a semicolon."""
    return all_entities(closed_references(text))


def html_to_text(markup: Column, decode=all_entities) -> Column:
    """Each tag a space, entities decoded, white space collapsed and trimmed."""
    return collapse(decode(F.regexp_replace(markup, "<[^>]+>", " ")))


def feed_guid(guid: Column, link: Column) -> Column:
    """Hash of the entry's guid, else of its link as it came; null where both are empty (the entry is dropped)."""
    return F.sha2(F.coalesce(F.nullif(guid, F.lit("")), F.nullif(link, F.lit(""))), 256)


def page_guid(url: Column, title: Column) -> Column:
    """Hash of the stripped url followed by the title."""
    return F.sha2(F.concat(url, F.coalesce(title, F.lit(""))), 256)


def feed_content(content: Column, description: Column) -> Column:
    """The content, or the description where that is missing or empty."""
    return F.coalesce(F.nullif(content, F.lit("")), description)


def published(published_at: Column, updated_at: Column, fetched_at: Column) -> Column:
    return F.coalesce(published_at, updated_at, fetched_at)


#: The allow-list of ``sanitize``: elements, and attributes by element ("" for any).
ALLOWED = frozenset("a abbr b blockquote br code em h1 h2 h3 h4 h5 h6 hr i img li ol p pre q s strong sub sup table tbody td th thead tr u ul article div span main section".split())
ATTRIBUTES = {"a": ("href",), "img": ("src", "alt"), "": ("title",)}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


def _clean(m: re.Match) -> str:
    name = (m[3] or "").lower()
    if name not in ALLOWED:
        return ""
    if m[2]:
        return f"</{name}>"
    out = []
    for k, v in _ATTR.findall(m[4]):
        v = html.unescape(v.strip("\"'"))
        if k.lower() in ATTRIBUTES.get(name, ()) + ATTRIBUTES[""] and not (k.lower() in ("href", "src") and re.match(r"\s*(?!https?:|mailto:)[a-z][a-z0-9+.-]*:", v, re.I)):
            out.append(f' {k.lower()}="{html.escape(v)}"')
    return f"<{name}{''.join(out)}>"


@F.pandas_udf(T.StringType())
def sanitize(markup: pd.Series) -> pd.Series:
    """Markup reduced to the allow-list; scripts, styles and comments go with their content."""
    return markup.map(lambda t: None if t is None else _TAG.sub(_clean, t))


def _measure(stem: str) -> int:
    return len(re.findall("[aeiouy]+[^aeiouy]+", _marks(stem)))


def _marks(word: str) -> str:
    """y counts as a vowel after a consonant only."""
    out = ""
    for i, c in enumerate(word):
        out += ("a" if i and out[-1] not in "aeiou" else "t") if c == "y" else c
    return out


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" for c in _marks(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _marks(word)[-1] not in "aeiou"


def _short(word: str) -> bool:
    m = _marks(word)
    return len(word) > 2 and m[-1] not in "aeiou" and m[-2] in "aeiou" and m[-3] not in "aeiou" and word[-1] not in "wxy"


#: Suffixes of steps 2, 3 and 4 of Porter's algorithm (1980).
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate",
    alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) < 3:
        return word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if _vowel(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")) or _measure(word) == 1 and _short(word):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted(table, key=len, reverse=True):
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + table[end]
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short(stem):
            word = stem
    return word[:-1] if _measure(word) > 1 and _double(word) and word.endswith("l") else word


@lru_cache(1 << 17)
def _met(word: str) -> str:
    return porter(word)


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    """Porter stems; each distinct word of a batch is stemmed once, and a worker keeps the stems of the words it met last."""
    known = {w: None if w is None else _met(w) for w in words.unique()}
    return words.map(known)
