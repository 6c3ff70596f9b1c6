"""Markup as an array of nodes in document order, so that selectors are Columns over it.

Each page is read once, in an Arrow batch, into
    array<struct<i, tag, attrs, parent, last, path, pos, siblings, prev, text>>
where descendants of node i are exactly i+1..last, `path` lists its ancestors from the root,
and `pos`/`siblings`/`prev` place it among its element siblings. Text is its own node ('#text').
No selector runs in Python.
"""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

NODE = (
    "struct<i:int,tag:string,attrs:map<string,string>,parent:int,last:int,path:array<int>,"
    "pos:int,siblings:int,prev:int,text:string>"
)

# Elements without content, and what an opening tag closes implicitly.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
}
BLOCKS = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)
FENCES = {
    "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
    "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"},
}
HEAD_ONLY = set("title meta link base style script".split())
# Fixed value: characters of markup whose nodes a worker holds at once; a larger page is held whole.
PIECE = 1 << 18


class _Tree:
    """Nodes appended in document order with an open-element stack."""

    def __init__(self):
        self.nodes, self.stack, self.last_child = [], [], {}

    def open(self, tag, attrs, void=False):
        i, parent = len(self.nodes), self.stack[-1] if self.stack else -1
        prev = self.last_child.get(parent, -1)
        pos = self.nodes[prev]["pos"] + 1 if prev >= 0 else 1
        self.last_child[parent] = i
        self.nodes.append(
            {"i": i, "tag": tag, "attrs": attrs, "parent": parent, "last": i, "path": list(self.stack),
             "pos": pos, "siblings": 0, "prev": prev, "text": ""}
        )
        if not void:
            self.stack.append(i)
        return i

    def text(self, data):
        parent = self.stack[-1] if self.stack else -1
        self.nodes.append(
            {"i": len(self.nodes), "tag": "#text", "attrs": {}, "parent": parent, "last": len(self.nodes),
             "path": list(self.stack), "pos": 0, "siblings": 0, "prev": -1, "text": data}
        )

    def close(self):
        self.nodes[self.stack.pop()]["last"] = len(self.nodes) - 1

    def finish(self):
        while self.stack:
            self.close()
        for node in self.nodes:
            if node["tag"] != "#text":
                node["siblings"] = self.nodes[self.last_child[node["parent"]]]["pos"]
        return self.nodes


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def _open_tags(self):
        return [self.tree.nodes[i]["tag"] for i in self.tree.stack]

    def _close_through(self, targets, fences=frozenset()):
        tags = self._open_tags()
        for depth in range(len(tags) - 1, -1, -1):
            if tags[depth] in targets:
                while len(self.tree.stack) > depth:
                    self.tree.close()
                return True
            if tags[depth] in fences:
                return False
        return False

    def _scaffold(self, tag):
        """html, head and body exist whether or not they are written."""
        if not self.tree.stack and tag != "html":
            self.tree.open("html", {})
        tags = self._open_tags()
        if "body" not in tags and "head" not in tags and tag not in ("html", "head", "body", "frameset"):
            self.tree.open("head" if tag in HEAD_ONLY and len(self.tree.nodes) < 2 else "body", {})
        elif "head" in tags and "body" not in tags and tag not in HEAD_ONLY | {"html", "head", "noscript", "template"}:
            self._close_through({"head"})
            if tag != "body":
                self.tree.open("body", {})

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and tag in self._open_tags():
            return
        self._scaffold(tag)
        if tag in BLOCKS:
            self._close_through({"p"}, {"table", "td", "th", "button", "li"} if tag != "p" else {"table", "td", "th", "button"})
        while tag in CLOSES and self._close_through(CLOSES[tag], FENCES[tag]):
            pass
        if tag == "tr" and self._open_tags()[-1:] == ["table"]:
            self.tree.open("tbody", {})
        merged = {}
        for key, value in attrs:
            merged.setdefault(key, value or "")
        self.tree.open(tag, merged, void=tag in VOID)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._close_through({tag}, {"table"} if tag not in ("table", "html", "body") and tag not in FENCES else frozenset())

    def handle_data(self, data):
        if self.tree.stack and (data.strip() or "body" in self._open_tags()):
            if data.strip() and self._open_tags() in (["html"], ["html", "head"]):
                self._scaffold("#text")
            self.tree.text(data)
        elif data.strip():
            self._scaffold("#text")
            self.tree.text(data)


def html_nodes(body: str) -> list[dict]:
    parser = _Html()
    parser.feed(body)
    parser.close()
    return parser.tree.finish()


def xml_nodes(body: str) -> list[dict]:
    """Local names only; an element's own text comes before its children's, as one text node."""
    tree, own = _Tree(), {}
    tree.open("", {})

    def local(name):
        return name.rsplit(":", 1)[-1]

    def start(name, attrs):
        i = tree.open(local(name), {local(k): v for k, v in attrs.items()})
        tree.text("")
        own[i] = i + 1

    def data(text):
        slot = own.get(tree.stack[-1])
        if slot is not None:
            tree.nodes[slot]["text"] += text

    parser = xml.parsers.expat.ParserCreate()
    parser.StartElementHandler, parser.CharacterDataHandler = start, data
    parser.EndElementHandler = lambda _name: tree.close()
    parser.Parse(body.lstrip(), True)
    return tree.finish()


def _pieces(bodies: pd.Series, limit: int) -> Iterator[pd.Series]:
    """A batch of bodies cut where they come to `limit` characters, one body at least."""
    start, held = 0, 0
    for at, body in enumerate(bodies):
        size = len(body or "")
        if at > start and held + size > limit:
            yield bodies.iloc[start:at]
            start, held = at, 0
        held += size
    if start < len(bodies):
        yield bodies.iloc[start:]


def shredded(read: Callable[[str], list[dict]], batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """nodes and error of every body. The nodes of a whole batch take a hundred times its text, so it goes in pieces."""
    for batch in batches:
        for bodies in _pieces(batch, PIECE):
            rows = []
            for body in bodies:
                try:
                    rows.append((read(body or ""), None))
                except Exception as problem:
                    rows.append(([], str(problem)))
            yield pd.DataFrame(rows, columns=["nodes", "error"])


def _shredder(read):
    @F.pandas_udf(f"struct<nodes:array<{NODE}>,error:string>")
    def shred(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from shredded(read, batches)

    return shred


def shred(body: Column, kind: str) -> Column:
    """struct<nodes, error> of a page body; kind is html or xml."""
    return _shredder(xml_nodes if kind == "xml" else html_nodes)(body)
