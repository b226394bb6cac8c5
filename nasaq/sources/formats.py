"""Text of HTML pages and EPUB books."""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of one document, or of all of a book's chapters.
LIMIT = 256 << 20
_SKIP = frozenset("script style noscript svg template".split())
_BLOCK = frozenset("address article aside blockquote dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.now: list[str] = []
        self.node: list[str] = []  # the parser gives a text node in parts
        self.skip: list[str] = []

    def end_node(self, *_):
        self.now += "".join(self.node).split()
        self.node = []

    handle_comment = handle_decl = handle_pi = unknown_decl = end_node

    def flush(self):
        self.end_node()
        if self.now:
            self.lines.append(" ".join(self.now))
            self.now = []

    def handle_starttag(self, tag, attrs):
        self.handle_startendtag(tag, attrs)
        if tag in _SKIP and tag not in _VOID:
            self.skip.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.end_node()
        if tag in ("br", "hr") or tag in _BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        self.end_node()
        if tag in _BLOCK:
            self.flush()
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.node.append(data)


_UNFINISHED = re.compile(r"</?[A-Za-z]|<[!?]")


def html_text(page: str) -> str:
    """Lines of a page: blocks and breaks separate them, white space collapses, scripts and styles go.

    A tag or comment that the page's end cuts off is dropped.
    """
    p = _Lines()
    p.feed(page)
    if not _UNFINISHED.match(p.rawdata):
        p.close()
    p.flush()
    return "\n".join(p.lines) + "\n" if p.lines else ""


_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)


def html_bytes_text(raw: bytes) -> str:
    """As ``html_text``; bytes that aren't UTF-8 are read by the declared character set, else Windows-1252."""
    if len(raw) > LIMIT:
        raise ValueError("extract HTML: document exceeds 256 MiB")
    try:
        return html_text(raw.decode("utf-8"))
    except UnicodeDecodeError:
        pass
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return html_text(raw.decode("utf-16", errors="replace"))
    m = _CHARSET.search(raw[:1024])
    name = m.group(1).decode("ascii").lower() if m else "cp1252"
    name = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252"}.get(name, name)
    try:
        codecs.lookup(name)
    except LookupError:
        name = "cp1252"
    return html_text(raw.decode(name, errors="replace"))


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def epub_text(raw: bytes) -> str:
    """Text of a book's chapters in reading order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        files = {posixpath.normpath(n): n for n in z.namelist()}
        if "META-INF/container.xml" not in files:
            raise ValueError("extract EPUB: missing META-INF/container.xml")
        roots = [e.get("full-path") for e in ElementTree.fromstring(z.read(files["META-INF/container.xml"])).iter() if _local(e) == "rootfile"]
        if not roots:
            raise ValueError("extract EPUB: container has no rootfile")
        opf = posixpath.normpath(roots[0] or "")
        if opf not in files:
            raise ValueError(f"extract EPUB: missing package document {opf!r}")
        package = ElementTree.fromstring(z.read(files[opf]))
        items = {e.get("id"): (posixpath.normpath(posixpath.join(posixpath.dirname(opf), (e.get("href") or "").split("#")[0].split("?")[0])), e.get("media-type")) for e in package.iter() if _local(e) == "item"}
        out, total = [], 0
        for ref in (e.get("idref") for e in package.iter() if _local(e) == "itemref"):
            name, kind = items.get(ref, (None, None))
            if kind not in ("application/xhtml+xml", "text/html"):
                continue
            if name not in files:
                raise ValueError(f"extract EPUB: missing spine item {name!r}")
            with z.open(files[name]) as f:
                part = f.read(LIMIT - total + 1)
            text = html_bytes_text(part) if len(part) <= LIMIT - total else None
            total += len(text.encode("utf-8")) if text is not None else LIMIT + 1
            if total > LIMIT:
                raise ValueError("extract EPUB: extracted text exceeds 256 MiB")
            out.append(text)
    return "".join(out)


def extract(path: str, raw: bytes) -> str | None:
    """Text of an HTML or EPUB file by its extension; None for any other."""
    ext = posixpath.splitext(path)[1].lower()
    if ext in (".html", ".htm"):
        return html_bytes_text(raw)
    return epub_text(raw) if ext == ".epub" else None


def html_text_column(page: Column) -> Column:
    """``html_text`` of a column of pages."""

    @F.pandas_udf(T.StringType())
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else html_text(p))

    return text(page)
