"""Extraction from web pages: links, a selector's first match, or the main content by rule."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """Elements in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


class _Tree(HTMLParser):
    """A tree of what the tokenizer of the standard library sees; unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        first: dict = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = Node(tag, first, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    tree = _Tree()
    tree.feed(markup)
    tree.close()
    return tree.root


def render(node: Node) -> str:
    """Inner markup: text and attribute values as they are, no comments, a closing tag for every element."""
    out, todo = [], list(reversed(node.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        out.append(f"<{n.tag}{''.join(f' {k}="{v}"' for k, v in n.attrs.items())}>")
        todo.append(f"</{n.tag}>")
        todo.extend(reversed(n.children))
    return "".join(out)


_PART = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)")
_TEST = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]")


def selector(text: str):
    """A test of nodes for compound selectors (tag, .class, #id, [attr=value]) joined by descent; None if not of that form."""
    steps = []
    for word in text.split():
        m = _PART.fullmatch(word)
        if not m or not word:
            return None
        steps.append((m[1], _TEST.findall(m[2])))
    if not steps:
        return None

    def one(n: Node, step) -> bool:
        tag, tests = step
        return bool(n.tag) and (tag in (None, "*", n.tag)) and all(
            (name in n.attrs.get("class", "").split() if mark == "." else n.attrs.get("id") == name) if mark else (attr in n.attrs and (not value or n.attrs[attr] == value))
            for mark, name, attr, value in tests
        )

    def test(n: Node) -> bool:
        if not one(n, steps[-1]):
            return False
        k, up = len(steps) - 2, n.parent
        while k >= 0 and up:
            if one(up, steps[k]):
                k -= 1
            up = up.parent
        return k < 0

    return test


def first_match(root: Node, text: str | None) -> Node | None:
    test = selector(text or "")
    return next((n for n in root.walk() if test(n)), None) if test else None


def _links(base: str, markup: str, within: str | None) -> list[str]:
    root = parse(markup or "")
    scope = first_match(root, within) or root
    host, out = urlsplit(base).netloc, []
    for n in scope.walk():
        href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if not href or href.startswith(("#", "javascript:")):
            continue
        try:
            full = urldefrag(urljoin(base, href)).url
            same = urlsplit(full).netloc == host
        except ValueError:
            continue
        if same:
            out.append(full)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(base: pd.Series, markup: pd.Series, within: pd.Series) -> pd.Series:
    """Links of a page to its own host, in order, repeats kept: within the selector's first match, or the whole page."""
    return pd.Series([None if b is None else _links(b, m, s) for b, m, s in zip(base, markup, within, strict=True)])


@F.pandas_udf(T.StringType())
def by_selector(markup: pd.Series, within: pd.Series) -> pd.Series:
    """Inner markup of the selector's first match; empty where nothing matches."""
    found = (first_match(parse(m or ""), s) for m, s in zip(markup, within, strict=True))
    return pd.Series([render(n) if n else "" for n in found])


def _heuristic(markup: str | None) -> tuple[str, str]:
    root = parse(markup or "")
    nodes = [n for n in root.walk() if n.tag]
    title = next((n for n in nodes if n.tag == "title"), None)
    head = title.children[0].strip() if title and title.children and isinstance(title.children[0], str) else ""
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main"):
        if found := next((n for n in nodes if test(n)), None):
            return head, render(found)
    return head, "".join(render(n) for n in nodes if n.tag == "p")


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))
def by_rule(markup: pd.Series) -> pd.DataFrame:
    """Title, and inner markup of the first article, else main, else role main, else of all paragraphs without a separator."""
    return pd.DataFrame([_heuristic(m) for m in markup], columns=["title", "content"])


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))
def by_config(markup: pd.Series, within: pd.Series) -> pd.DataFrame:
    """What ``by_selector`` finds, without a title, where there is a selector; else title and content of ``by_rule``. A page is parsed once."""
    found = [(("", render(n) if (n := first_match(parse(m or ""), s)) else "") if s else _heuristic(m)) for m, s in zip(markup, within, strict=True)]
    return pd.DataFrame(found, columns=["title", "content"])


def title_of(markup: Column) -> Column:
    """The first title, for well-formed pages, without Python."""
    return F.trim(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1))


def article_of(markup: Column) -> Column:
    """Inner markup of the first article, for pages that have one, without Python."""
    return F.regexp_extract(markup, r"(?is)<article[^>]*>(.*?)</article>", 1)


def plain_links(url: Column, markup: Column) -> Column:
    """Root-relative links made absolute, in order, without Python: for pages whose links are all of that form."""
    host = F.regexp_extract(url, r"^(\w+://[^/?#]*)", 1)
    return F.transform(F.regexp_extract_all(markup, F.lit(r'<a href="(/[^"#]*)'), 1), lambda p: F.concat(host, p))
