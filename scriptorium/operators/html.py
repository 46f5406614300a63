"""HTML pages to blocks, nodes and chunks.

Only the DOM walk and the packing of pieces, both sequential, run in Python (one Arrow batch at a
time); what surrounds them is DataFrame code.  The parser is the standard library's, so unclosed
tags are closed where their container ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as tx
from .validation import chunk_metadata

# Fixed values.
DROPPED_TAGS = {"script", "style", "noscript", "iframe", "form", "input", "button"}
DROPPED_CLASSES = {"navpath", "navtab", "tabs", "tabs2", "tabs3", "levels", "ingroups", "header", "footer", "summary", "anchor", "lineno"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5}
CONTAINERS = set("div p li dd dt ul ol dl section article blockquote td th tr tbody thead center font span em strong b i code a tt sub sup small big".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
TABLE_CHARS, MAX_CHARS, MIN_CHARS, SMALL, OVERFLOW, OVERSIZE = 1800, 2500, 20, 120, 1.3, 2
EXCLUDED_DIRS, EXCLUDED_SUFFIX = ("search", "static"), "_source.html"
INDEX_PAGES = r"^(annotated|classes|functions|functions_.*|pages|modules|dir_.*|files|globals.*|namespace.*)\.html$"

PAGES_HELD = 64

BLOCKS = "array<struct<kind:string,text:string,level:int,api_name:string>>"


class Node:
    """An element: tag, attributes, children (elements and strings)."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed([c for c in n.children if isinstance(c, Node)])

    def strings(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            else:
                todo += reversed(n.children)

    def text(self, glue: str = " ") -> str:
        return tidy(glue.join(s.strip() for s in self.strings() if s.strip()))

    def find(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        return next((n for n in self.walk() if (tag is None or n.tag == tag) and (cls is None or cls in n.classes())), None)


class Dom(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "dd", "dt") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tidy(s: str) -> str:
    return re.sub("[ \t 　]+", " ", s.replace("\r", "")).strip()


def dropped(n: Node) -> bool:
    return n.tag in DROPPED_TAGS or bool(n.classes() & DROPPED_CLASSES)


def pipe_table(rows: list[list[str]]) -> list[str]:
    """Pipe rows; a row with one filled cell stands alone and ends a group, a rule follows a group's first row."""
    lines: list[str] = []
    at = 0
    while at < len(rows):
        filled = [c for c in rows[at] if c]
        if len(filled) <= 1:
            lines += filled
            at += 1
            continue
        end = at
        while end < len(rows) and sum(map(bool, rows[end])) > 1:
            end += 1
        width = max(map(len, rows[at:end]))
        shown = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows[at:end]]
        lines += shown[:1] + (["|" + "---|" * width] if end - at > 1 else []) + shown[1:]
        at = end
    return lines


def table_parts(table: Node, budget: int = TABLE_CHARS) -> list[str]:
    """Texts of a table cut into parts of whole rows under ``budget``, each with the header; header-only tables have none."""
    rows = []
    for tr in (n for n in table.walk() if n.tag == "tr"):
        owner = tr.parent
        while owner is not None and owner.tag != "table":
            owner = owner.parent
        cells = [c.text().replace("|", "\\|") for c in tr.elements() if c.tag in ("td", "th")]
        if owner is table and cells:
            rows.append(cells)
    if len(rows) < 2:
        return []
    head, size = rows[0], sum(map(len, pipe_table(rows[:1])))
    parts, used = [[rows[1]]], size + sum(map(len, rows[1])) + 4
    for row in rows[2:]:
        cost = sum(map(len, row)) + 4
        if used + cost > budget:
            parts.append([])
            used = size
        parts[-1].append(row)
        used += cost
    note = lambda i: [f"（表续 {i + 1}/{len(parts)}，表头重复）"] if i else []
    return ["\n".join(note(i) + pipe_table([head, *p])) for i, p in enumerate(parts)]


def code_text(n: Node) -> str:
    for junk in [x for x in n.walk() if x.classes() & {"lineno"} and x.parent is not None]:
        junk.parent.children.remove(junk)
    lines = [x for x in n.walk() if x.tag == "div" and "line" in x.classes()]
    body = "\n".join("".join(x.strings()) for x in lines) if lines else "\n".join(n.strings()) if n.tag != "pre" else "".join(n.strings())
    body = "\n".join(x.rstrip() for x in body.replace("\r", "").split("\n"))
    return re.sub(r"\n{3,}", "\n\n", body).strip("\n")


def blocks_of(el: Node) -> list[tuple]:
    """(kind, text, level, api_name) of an element's content in document order.

    Text beside child elements of a container is dropped, only its elements are followed.
    """
    out: list[tuple] = []
    todo = list(reversed(list(el.elements())))
    while todo:
        n = todo.pop()
        cls = n.classes()
        if dropped(n) or n.tag in ("br", "hr"):
            continue
        if n.tag in HEADINGS:
            out.append(("heading", n.text(), HEADINGS[n.tag], None))
        elif n.tag == "div" and "memitem" in cls:
            proto, doc = n.find("div", "memproto"), n.find("div", "memdoc")
            name = (proto.find("td", "memname") or proto).text() if proto else ""
            found = re.findall(r"[A-Za-z_]\w*", name)
            body = [shown(b) for b in blocks_of(doc)] if doc else []
            out.append(("member", "\n\n".join(x for x in [proto.text() if proto else "", *body] if x), None, found[-1] if found else None))
        elif n.tag == "pre" or n.tag == "div" and "fragment" in cls:
            out.append(("code", code_text(n), None, None))
        elif n.tag == "table":
            out += [("table", t, None, None) for t in table_parts(n)]
        elif n.tag in CONTAINERS and any(not dropped(c) for c in n.elements()):
            todo += reversed(list(n.elements()))
        else:
            out.append(("text", n.text(), None, None))
    return [b for b in out if b[1]]


def shown(block: tuple, language: str = "c") -> str:
    return f"```{language}\n{block[1]}\n```" if block[0] == "code" else block[1].strip()


def parse_pages(pages: DataFrame, *keep: str, html: str = "html", root: tuple[str, str | None] = ("div", "contents"), title_prefix: str = "") -> DataFrame:
    """``keep`` columns, title and blocks of each page; blocks are null where the content root is missing."""
    fields = [pages.schema[c] for c in keep]
    schema = T.StructType([*fields, *T._parse_datatype_string(f"title string, blocks {BLOCKS}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("api_name", pa.string())]))
        # a page's tree and blocks are many times its text: few pages are held at once, whatever the batch
        for batch in (b.slice(at, PAGES_HELD) for b in batches for at in range(0, b.num_rows, PAGES_HELD)):
            titles, blocks = [], []
            for source in batch.column(html).to_pylist():
                dom = Dom(source or "").root
                title = dom.find("title")
                name = re.sub(rf"^{re.escape(title_prefix)}\s*[:：]\s*", "", title.text()) if title else ""
                if not name and (holder := dom.find("div", "title")):
                    name = tidy(" ".join(c for c in holder.children if isinstance(c, str)))
                contents = dom.find(*root)
                titles.append(name)
                blocks.append(None if contents is None else [dict(zip(("kind", "text", "level", "api_name"), b, strict=True)) for b in blocks_of(contents)])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(titles, pa.string()), pa.array(blocks, kind)], schema.names)

    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)


def html_nodes(parsed: DataFrame, id: str, *, least: int = MIN_CHARS, language: str = "c") -> DataFrame:
    """Nodes of parsed pages: a node per heading section and per member.

    A section's path is the chain of the last headings above it: for each level the last heading
    of that level, unless a heading of a smaller or equal level came after.
    """
    rows = parsed.filter("blocks IS NOT NULL").select(id, "title", F.posexplode("blocks").alias("seq", "b")).select(id, "title", "seq", "b.*")
    w = W.partitionBy(id).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)  # one page's blocks
    for n in range(1, 6):
        own = F.when((F.col("kind") == "heading") & (F.col("level") == n), F.struct("seq", "text"))
        rows = rows.withColumn(f"h{n}", F.last(own, ignorenulls=True).over(w))
    for n in range(5, 0, -1):
        above = [F.coalesce(F.col(f"h{m}.seq"), F.lit(-1)) for m in range(1, n)]
        last = F.greatest(F.lit(-1), F.lit(-1), *above)
        rows = rows.withColumn(f"h{n}", F.when(F.col(f"h{n}.seq") > last, F.col(f"h{n}")))
    heads = F.filter(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"h{n}.seq").alias("seq"), F.col(f"h{n}.text").alias("text")) for n in range(1, 6)]), lambda h: h["seq"].isNotNull())
    cut = F.when(F.col("kind").isin("heading", "member"), 1).otherwise(0)
    # a member is a group of its own, what follows it another
    after = F.lag(F.when(F.col("kind") == "member", 1).otherwise(0), 1, 0).over(W.partitionBy(id).orderBy("seq"))
    rows = rows.withColumn("heads", heads).withColumn("part", F.sum(cut + after).over(w))
    body = F.when(F.col("kind") == "code", F.concat(F.lit(f"```{language}\n"), "text", F.lit("\n```"))).otherwise(tx.strip(F.col("text")))
    parts = rows.groupBy(id, "title", "part").agg(  # one page's section
        F.array_sort(F.collect_list(F.struct("seq", "kind", body.alias("body"), "api_name", "heads"))).alias("bs"))
    first = F.get("bs", 0)
    member = first["kind"] == "member"
    own = F.filter("bs", lambda b: b["kind"] != "heading")
    joined = F.array_join(F.transform(own, lambda b: b["body"]), "\n\n")
    chain = F.col("bs")[0]["heads"]
    last_head = F.try_element_at(chain, F.lit(-1))
    parts = parts.filter(F.size(own) > 0)
    text = F.when(member | last_head.isNull() | joined.startswith(last_head["text"]), joined).otherwise(F.concat(last_head["text"], F.lit("\n\n"), joined))
    names = F.concat(F.transform(chain, lambda h: h["text"]), F.when(member, F.array(F.coalesce(first["api_name"], F.lit("成员")))).otherwise(F.array().cast("array<string>")))
    level = F.coalesce(last_head["level"], F.lit(0)) + F.when(member | last_head.isNull(), 1).otherwise(0)
    nodes = parts.select(
        id, "title", F.col("part"), F.array_join(F.concat(F.array("title"), names), tx.SECTION_SEPARATOR).alias("section_path"), F.least(F.greatest(level, F.lit(1)), F.lit(5)).alias("section_level"),
        tx.strip(text).alias("text"), F.when(member, first["api_name"]).alias("api_name"), F.when(member, F.lit("api")).alias("content_type"),
    )
    nodes = nodes.withColumn("seq", F.row_number().over(W.partitionBy(id).orderBy("part")) - 1).drop("part")
    return nodes.withColumn("error_code", tx.error_code(F.col("text"))).filter(F.length("text") >= least)


def cut_text(s: str, budget: int, overlap: int = 0, marks: tuple[str, ...] = ("\n\n", "\n", "。", "；", ".", ";")) -> list[str]:
    """Pieces of at most ``budget`` characters, cut behind the first kind of mark in a window's second half."""
    out, at = [], 0
    while at < len(s):
        end = at + budget
        if end < len(s):
            places = (s.rfind(m, at, end) + len(m) for m in marks if s.rfind(m, at, end) > at + budget // 2)
            end = next(places, end)
        out.append(s[at:end])
        at = max(end - overlap, at + 1) if overlap and end < len(s) else end
    return [p for p in out if p.strip()]


def pack_lines(lines: list[str], budget: int) -> list[str]:
    out: list[str] = []
    for line in lines:
        if out and len(out[-1]) + 1 + len(line) + 1 <= budget:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def pieces(s: str, budget: int = MAX_CHARS, small: int = SMALL, overflow: float = OVERFLOW) -> list[str]:
    """A node's pieces: paragraphs packed greedily, code and tables whole, small pieces joined to a neighbour."""
    flow: list[tuple[str, bool]] = []
    for para in filter(None, (p.strip() for p in re.split(r"\n{2,}", s))):
        code = para.startswith("```")
        whole = code or para.startswith("|") or "\n|" in para
        if whole and len(para) > budget * OVERSIZE:
            flow += [(f"```\n{x}\n```", True) for x in pack_lines(para.strip("`").split("\n"), budget)] if code else [(x, False) for x in para.split("\n")]
        elif not whole and len(para) > budget:
            flow += [(x, False) for x in cut_text(para, budget)]
        else:
            flow.append((para, whole))
    packed: list[str] = []
    open_ = False
    for para, whole in flow:
        if open_ and len(packed[-1]) + 2 + len(para) <= budget:
            packed[-1] += "\n\n" + para
        else:
            packed.append(para)
        open_ = not whole
    most = int(budget * overflow)
    out: list[str] = []
    for p in filter(str.strip, packed):
        if out and len(p) < small and len(out[-1]) + 2 + len(p) <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[0]) < small and len(out[0]) + 2 + len(out[1]) <= most:
        out[:2] = [out[0] + "\n\n" + out[1]]
    return out


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _pieces(s: str) -> list[str]:
    return pieces(s or "")


def html_chunks(nodes: DataFrame, file_name: Column, *, base_url: str = "", source_id: str = "html", version: str = "2.4", product: str = "", language: str = "c") -> DataFrame:
    """Chunks of nodes with metadata; ids carry the document, the node's place and the piece's number."""
    rows = nodes.withColumn("_file", file_name)
    section = F.element_at(F.split("section_path", tx.SECTION_SEPARATOR), -1)
    node_id = F.concat_ws("_", tx.slug(F.regexp_replace("_file", r"\.[^.]*$", "")), F.lpad(F.col("seq").cast("string"), 3, "0"), F.nullif(tx.slug(section), F.lit("")))
    rows = rows.select("*", node_id.alias("node_id"), section.alias("section")).withColumn("p", _pieces("text"))
    rows = rows.select("*", F.posexplode("p").alias("piece_no", "piece")).drop("p", "text")
    chunk_id = F.format_string("html_v1_%s_%05d", "node_id", "piece_no")
    body = tx.strip(F.col("piece"))
    meta = chunk_metadata(
        source_id=F.lit(source_id), source_file=F.col("_file"), source_type=F.lit("html"), part=F.lit(""), chapter=F.lit(""), section_path=F.col("section_path"), section_level=F.col("section_level"),
        node_ids=F.array("node_id"), chunk_id=chunk_id, version=F.lit(version), product=F.lit(product), language=F.lit(language), content_type=F.coalesce("content_type", tx.content_type(F.col("_file"))),
        api_name=F.col("api_name"), error_code=F.col("error_code"), source_url=tx.source_url(F.lit(base_url), F.col("_file")), title=F.col("section"),
    )
    return rows.select(chunk_id.alias("chunk_id"), body.alias("text"), meta.alias("metadata"), F.size(tx.terms(body)).alias("token_count"), F.lit(0).alias("char_start"), F.length(body).alias("char_end"))
