"""Parsers of single files: bytes to blocks.

A block is a dict of ``block_type`` (title, text, list, table), ``text``, and
where it applies ``level``, ``page``, ``rows``. Only the standard library is used."""

from __future__ import annotations

import csv
import html as html_lib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

# Codecs tried in this order.
CODECS = ("utf-8", "gb2312", "gbk", "big5", "gb18030", "utf-16", "latin-1")
DELIMITERS = ",\t;|"


def block(kind: str, text: str, **more) -> dict:
    return {"block_type": kind, "text": text, **more}


def decoded(data: bytes) -> str:
    """Text by the first codec that fits; a byte order mark is dropped."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "ignore")
    for codec in CODECS:
        try:
            return data.decode(codec).removeprefix("\ufeff")
        except UnicodeError:
            continue
    return data.decode("utf-8", "ignore")


def markdown_table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    wide = max(map(len, rows))
    line = lambda r: "| " + " | ".join((x or "").replace("\n", "<br>") for x in [*r, *[""] * (wide - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * wide) + " |", *map(line, rows[1:])])


def table(rows: list[list[str]], **more) -> dict:
    return block("table", markdown_table(rows), rows=rows, **more)


def delimiter_of(text: str, name: str = "") -> str:
    """By the name for .tsv, else the sign that cuts the first lines most evenly."""
    if name.lower().endswith(".tsv"):
        return "\t"
    lines = [x for x in text.splitlines()[:20] if x.strip()]

    def fit(d: str) -> tuple:
        n = [len(next(csv.reader([x], delimiter=d))) for x in lines]
        return (min(n, default=0) > 1, -len(set(n)), max(n, default=0))

    return max(DELIMITERS, key=fit) if lines else ","


def delimited_rows(text: str, name: str = "") -> tuple[list[list[str]], str]:
    """Trimmed rows of one width without blank ones, and the delimiter."""
    d = delimiter_of(text, name)
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=d)]
    rows = [r for r in rows if any(r)]
    wide = max(map(len, rows), default=0)
    return [r + [""] * (wide - len(r)) for r in rows], d


def delimited(data: bytes, name: str = "") -> list[dict]:
    rows, _ = delimited_rows(decoded(data), name)
    return [table(rows)] if rows else []


def is_json_lines(text: str, sample: int = 10, least: float = 0.8) -> bool:
    try:
        json.loads(text)
        return False
    except ValueError:
        pass
    lines = [x for x in text.splitlines() if x.strip()][:sample]

    def fits(x: str) -> bool:
        try:
            json.loads(x)
            return True
        except ValueError:
            return False

    return bool(lines) and sum(map(fits, lines)) / len(lines) >= least


@dataclass
class _Json:
    """A value of a document, lists as objects by index, with its printed length."""

    value: object
    length: int
    kids: dict[str, _Json] | None = None

    @classmethod
    def of(cls, value) -> _Json:
        pairs = value.items() if isinstance(value, dict) else ((str(i), x) for i, x in enumerate(value)) if isinstance(value, list) else None
        if pairs is None:
            return cls(value, len(json.dumps(value, ensure_ascii=False)))
        kids = {str(k): cls.of(x) for k, x in pairs}
        entries = sum(_entry(k, x.length) for k, x in kids.items())
        return cls({k: x.value for k, x in kids.items()}, 2 + entries + 2 * max(0, len(kids) - 1), kids)


def _entry(key: str, length: int) -> int:
    return len(json.dumps(key, ensure_ascii=False)) + 2 + length


class _Part:
    """An object that grows by paths; its printed length is kept, not measured again."""

    def __init__(self):
        self.root: dict = {}
        self.length = 2

    def add(self, path: tuple[str, ...], node: _Json) -> None:
        at, depth = self.root, 0
        while depth < len(path) - 1 and path[depth] in at:
            at, depth = at[path[depth]], depth + 1
        self.length += 2 if at else 0
        value, length = node.value, node.length
        for key in reversed(path[depth + 1 :]):
            value, length = {key: value}, 2 + _entry(key, length)
        at[path[depth]] = value
        self.length += _entry(path[depth], length)


def json_parts(value, most: int = 4000, least: int | None = None) -> list[dict]:
    """A value cut along its structure into dicts of about ``most`` characters;
    lists become dicts by index, and every part keeps the path to what it holds.

    Lengths are found once from the leaves up. Then one pass in order puts what fits
    into the part at hand; what doesn't is opened, and from ``least`` characters on a
    new part begins first."""
    least = max(most - 200, 50) if least is None else least
    top, parts = _Json.of(value), [_Part()]
    waiting = [((), top)] if top.kids is not None else [(("value",), top)]
    while waiting:
        path, node = waiting.pop()
        if path:
            room = most - parts[-1].length
            if 2 + _entry(path[-1], node.length) < room or top.kids is None:
                parts[-1].add(path, node)
                continue
            if parts[-1].length >= least:
                parts.append(_Part())
            if node.kids is None:
                parts[-1].add(path, node)
                continue
        waiting += [((*path, k), x) for k, x in reversed(node.kids.items())]
    return [p.root for p in parts if p.root]


def json_blocks(data: bytes, name: str = "", most: int = 4000) -> list[dict]:
    text = decoded(data)
    values = []
    if is_json_lines(text):
        for line in text.splitlines():
            try:
                values.append(json.loads(line))
            except ValueError:
                continue
    else:
        try:
            values.append(json.loads(text))
        except ValueError:
            return plain(data, name)
    return [block("text", json.dumps(p, ensure_ascii=False)) for v in values for p in json_parts(v, most)]


class _Html(HTMLParser):
    """Blocks of a page in order; what stands in script, style and comments is left out."""

    OWN = {"p", "div", "li", "blockquote", "pre", "section", "article", "td", "th", "tr", "br", "ul", "ol", "body", "dd", "dt", "figcaption"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.kind, self.level, self.words = "text", None, []
        self.mute = 0
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def _close(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.words)).strip()
        if text:
            more = {"level": self.level} if self.kind == "title" else {}
            self.out.append(block(self.kind, text, **more))
        self.words, self.kind, self.level = [], "text", None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "table":
            self._close()
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.cell = []
        elif re.fullmatch("h[1-6]", tag):
            self._close()
            self.kind, self.level = "title", int(tag[1])
        elif tag in self.OWN:
            self._close()
            self.kind = "list" if tag == "li" else "text"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if any(r)]
            self.rows = None
            if rows:
                self.out.append(table(rows))
        elif self.rows is not None:
            if tag in ("td", "th") and self.cell is not None:
                (self.rows or self.rows.append([]) or self.rows)[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
                self.cell = None
        elif re.fullmatch("h[1-6]", tag) or tag in self.OWN:
            self._close()

    def handle_data(self, data):
        if self.mute:
            return
        if self.rows is not None:
            if self.cell is not None:
                self.cell.append(data)
        else:
            self.words.append(data)


def html_blocks(data: bytes | str, name: str = "") -> list[dict]:
    p = _Html()
    p.feed(data if isinstance(data, str) else decoded(data))
    p.close()
    p._close()
    return p.out


def markdown_blocks(data: bytes | str, name: str = "") -> list[dict]:
    """Headings, fenced code, lists, quotes, tables and runs of text, with their lines."""
    lines = (data if isinstance(data, str) else decoded(data)).split("\n")
    kinds = (("title", r"#{1,6}\s+\S"), ("list", r"\s*([-*+]|\d+\.)\s+\S"), ("quote", r"\s*>"), ("table", r"\s*\|.*\|\s*$"))
    kind_of = lambda x: next((k for k, p in kinds if re.match(p, x)), "text")
    out, i = [], 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        start = i
        if (fence := re.match(r"\s*(```+|~~~+)", lines[i])) is not None:
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(fence[1]):
                i += 1
            i += 1
            kind = "code"
        else:
            kind = kind_of(lines[i])
            i += 1
            while kind != "title" and i < len(lines) and lines[i].strip() and (kind_of(lines[i]) == kind or (kind == "list" and lines[i].startswith(" "))):
                i += 1
        text = "\n".join(lines[start:i])
        own = lines[start:i]
        if kind == "title":
            level = len(text) - len(text.lstrip("#"))
            out.append(block("title", text.lstrip("#").strip(), level=level, first=start, last=i - 1))
        elif kind == "table":
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in own if not re.fullmatch(r"[\s|:-]+", x)]
            out.append(table(rows, first=start, last=i - 1))
        else:
            out.append(block(kind, text, first=start, last=min(i, len(lines)) - 1))
    return out


def plain(data: bytes, name: str = "") -> list[dict]:
    return [block("text", p.strip()) for p in re.split(r"\n{2,}", decoded(data)) if p.strip()]


def _lined(text: str) -> list[dict]:
    """Lines as blocks; a short first one of several is the title."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) > 1 and len(lines[0]) <= 120:
        return [block("title", lines[0], level=1), *(block("text", x) for x in lines[1:])]
    return [block("text", x) for x in lines]


def rtf(data: bytes, name: str = "") -> list[dict]:
    text = data.decode("latin-1")
    text = re.sub(r"\{\\\*?\\?(fonttbl|colortbl|stylesheet|info|pict)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "ignore"), text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(par|line)\b ?", "\n", text)
    text = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", text)
    return _lined(re.sub(r"[{}]", "", text.replace("\\{", "(").replace("\\}", ")")))


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _text(e: ET.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def odt(data: bytes, name: str = "") -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("content.xml"))

    def walk(e: ET.Element) -> Iterator[dict]:
        for c in e:
            kind = _tag(c)
            if kind == "h" and _text(c):
                yield block("title", _text(c), level=int(_attr(c, "outline-level") or 1))
            elif kind == "p" and _text(c):
                yield block("text", _text(c))
            elif kind == "list":
                if items := [_text(x) for x in c.iter() if _tag(x) == "list-item" and _text(x)]:
                    yield block("list", "\n".join(f"- {x}" for x in items))
            elif kind == "table":
                rows = []
                for r in (x for x in c.iter() if _tag(x) == "table-row"):
                    rows.append([_text(x) for x in r if _tag(x) == "table-cell" for _ in range(min(int(_attr(x, "number-columns-repeated") or 1), 64))])
                if rows := [r for r in rows if any(r)]:
                    yield table(rows)
            elif kind not in ("p", "h"):
                yield from walk(c)

    body = next((e for e in root.iter() if _tag(e) == "text"), root)
    return list(walk(body))


def epub(data: bytes, name: str = "") -> list[dict]:
    """Chapters in the order of the spine; a block's page is its chapter from 1."""
    import posixpath

    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(_attr(e, "full-path") for e in box.iter() if _tag(e) == "rootfile")
        root = ET.fromstring(z.read(opf))
        items = {e.get("id"): e for e in root.iter() if _tag(e) == "item"}
        spine = [items.get(e.get("idref")) for e in root.iter() if _tag(e) == "itemref"]
        chapters = [e for e in spine if e is not None and re.search("x?html", e.get("media-type") or "")]
        for no, e in enumerate(chapters, 1):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), e.get("href").split("#")[0]))
            if path in z.namelist():
                out += [b | {"page": no} for b in html_blocks(z.read(path))]
    return out


def _pairs(rows: list[list[str]]) -> list[str]:
    """Table rows below the header as ``header: value`` lines."""
    return ["; ".join(f"{h}: {v}" if h else v for h, v in zip(rows[0], r, strict=False) if v) for r in rows[1:]]


def docx(data: bytes, name: str = "") -> list[dict]:
    """Paragraphs (headings by style) and tables; a rendered page break turns the page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body, out, page = next(e for e in root.iter() if _tag(e) == "body"), [], 1
    for e in body:
        if _tag(e) == "p":
            page += sum(_tag(x) == "lastRenderedPageBreak" or (_tag(x) == "br" and _attr(x, "type") == "page") for x in e.iter())
            text = re.sub(r"\s+", " ", "".join(x.text or "" for x in e.iter() if _tag(x) == "t")).strip()
            style = next((_attr(x, "val") or "" for x in e.iter() if _tag(x) == "pStyle"), "")
            level = re.match(r"(?i)heading\s*(\d)", style)
            if text:
                out.append(block("title", text, level=int(level[1]), page=page) if level else block("text", text, page=page))
        elif _tag(e) == "tbl":
            rows = [[re.sub(r"\s+", " ", "".join(x.text or "" for x in c.iter() if _tag(x) == "t")).strip() for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"]
            if rows := [r for r in rows if any(r)]:
                out.append(table(rows, page=page) | {"lines": _pairs(rows)})
    return out


def xlsx(data: bytes) -> dict[str, list[list[str | None]]]:
    """The sheets of a workbook as rows of texts, by name; what isn't a workbook is
    read as delimited rows. Empty rows at the end are left out."""
    if not data.startswith(b"PK"):
        return {"Sheet1": delimited_rows(decoded(data))[0]}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        tree = lambda name: ET.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        places = {_attr(r, "Id"): _attr(r, "Target").lstrip("/").removeprefix("xl/") for r in tree("xl/_rels/workbook.xml.rels")}
        sheets = [(_attr(e, "name"), places[_attr(e, "id")]) for e in tree("xl/workbook.xml").iter() if _tag(e) == "sheet"]
        return {name: _sheet_rows(tree(f"xl/{at}"), shared) for name, at in sheets if f"xl/{at}" in names}


def _sheet_rows(sheet: ET.Element, shared: list[str]) -> list[list[str | None]]:
    rows: dict[int, dict[int, str]] = {}
    for r, row in enumerate((e for e in sheet.iter() if _tag(e) == "row"), 1):
        no = int(_attr(row, "r") or r)
        for c, cell in enumerate(row, 1):
            letters = re.match(r"[A-Z]*", _attr(cell, "r") or "").group()
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            kind, texts = _attr(cell, "t"), ["".join(e.itertext()) for e in cell if _tag(e) in ("v", "is")]
            if texts and texts[0].strip():
                text = shared[int(texts[0])] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(texts[0], texts[0]) if kind == "b" else texts[0]
                rows.setdefault(no, {})[column or c] = text
    wide = max((max(r) for r in rows.values()), default=0)
    return [[rows.get(n, {}).get(c) for c in range(1, wide + 1)] for n in range(1, max(rows, default=0) + 1)]


def pptx(data: bytes, name: str = "") -> list[dict]:
    """Slides: shapes by height in tenths, then left; bullets indented by level."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for page, n in enumerate(names, 1):
            shapes = []
            for s in (e for e in ET.fromstring(z.read(n)).iter() if _tag(e) in ("sp", "graphicFrame")):
                off = next((x for x in s.iter() if _tag(x) == "off"), None)
                at = (int(off.get("y")), int(off.get("x"))) if off is not None else (0, 0)
                rows = [[_text(c) for c in r if _tag(c) == "tc"] for r in s.iter() if _tag(r) == "tr"]
                if rows:
                    shapes.append((at[0] // 10, at[1], "\n".join(_pairs(rows)), "table"))
                    continue
                lines = []
                for p in (x for x in s.iter() if _tag(x) == "p"):
                    text = "".join(x.text or "" for x in p.iter() if _tag(x) == "t").strip()
                    level = next((int(x.get("lvl") or 0) for x in p if _tag(x) == "pPr"), 0)
                    marked = any(_tag(x) in ("buChar", "buAutoNum") for x in p.iter())
                    if text:
                        lines.append("  " * level + "• " + text if marked else text)
                if lines:
                    shapes.append((at[0] // 10, at[1], "\n".join(lines), "text"))
            out += [block(kind, text, page=page) for _, _, text, kind in sorted(shapes) if text]
    return out


def eml(data: bytes, name: str = "") -> list[dict]:
    """Subject, body (plain preferred), the list of attachments and light ones' texts."""
    msg = message_from_bytes(data, policy=policy.default)
    body = msg.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = "\n".join(b["text"] for b in html_blocks(text))
    out = [block("title", str(msg["subject"]).strip(), level=1)] if msg["subject"] else []
    if text.strip():
        out.append(block("text", text.strip()))
    files = list(msg.iter_attachments())
    if files:
        out.append(block("list", "\n".join(f"- {a.get_filename() or 'unnamed'} ({a.get_content_type()})" for a in files)))
    for a in files:
        if a.get_content_maintype() == "text" and (own := a.get_content().strip()):
            out.append(block("text", html_lib.unescape(own), role="attachment_text", file=a.get_filename()))
    return out


def msg(data: bytes, name: str = "") -> list[dict]:
    """A message saved as text; binary ones need a library and are refused."""
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        raise ValueError("binary messages need a parser of their own")
    return _lined(re.sub(r"(?im)^(subject|title):\s*", "", decoded(data)))


PARSERS = {"csv": delimited, "tsv": delimited, "json": json_blocks, "jsonl": json_blocks, "html": html_blocks, "htm": html_blocks, "md": markdown_blocks, "markdown": markdown_blocks, "txt": plain, "log": plain, "rtf": rtf, "odt": odt, "epub": epub, "docx": docx, "pptx": pptx, "eml": eml, "msg": msg}
#: Formats whose libraries or models are not here: callers register a parser.
SLOTS = ("pdf", "xlsx", "xls", "doc", "ppt", "caj", "jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def file_type(name: str) -> str | None:
    """The last extension in lower case, if a parser or a slot is there for it."""
    kind = name.rpartition(".")[2].lower() if "." in name else ""
    return kind if kind in PARSERS or kind in SLOTS else None
