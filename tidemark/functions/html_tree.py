"""HTML as a tree: blocks of text and tables with their source paths, and the rows of a filing's file index."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that are blocks of text, and elements that are not shown.
TEXT_BLOCKS = {"address", "blockquote", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre"}
HIDDEN = {"script", "style", "noscript", "ix:header", "ix:hidden"}
#: Elements without content, and which open elements a start tag ends, up to an element that holds them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENDS |= {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
HOLDERS = {"table", "ul", "ol", "dl", "select", "body", "div", "blockquote"}


class Element:
    """An element: its tag, attributes, parent, children (elements and strings) and place among its parent's elements of that tag."""

    __slots__ = ("tag", "attrs", "parent", "children", "place", "counts", "has_block")

    def __init__(self, tag: str, attrs: dict, parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.counts: dict[str, int] = {}
        self.has_block = False
        self.place = 1
        if parent is not None:
            self.place = parent.counts[tag] = parent.counts.get(tag, 0) + 1
            parent.children.append(self)

    @property
    def name(self) -> str:
        """The tag without a namespace."""
        return self.tag.rsplit(":", 1)[-1]

    def path(self) -> str:
        """Tags from the root, with a place where the parent has several of the tag."""
        steps, at = [], self
        while at.parent is not None:
            several = at.parent.counts[at.tag] > 1
            steps.append(f"{at.tag}[{at.place}]" if several else at.tag)
            at = at.parent
        return "/" + "/".join(reversed(steps))

    def inside(self) -> Iterator[Element]:
        """All elements below, in order."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Element)]
        while waiting:
            at = waiting.pop()
            yield at
            waiting += [c for c in reversed(at.children) if isinstance(c, Element)]

    def text(self, hidden: bool = False) -> list[str]:
        """The strings below, in order; without those of hidden elements, unless told."""
        found, waiting = [], list(reversed(self.children))
        while waiting:
            at = waiting.pop()
            if isinstance(at, str):
                found.append(at)
            elif hidden or at.tag not in HIDDEN:
                waiting += reversed(at.children)
        return found


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            open_ = self.at
            while open_.parent is not None and open_.tag not in HOLDERS:
                if open_.tag in ENDS[tag]:
                    self.at = open_.parent
                open_ = open_.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        if tag not in VOID:
            self.at = new
        self._mark(new)

    def _mark(self, new: Element) -> None:
        if new.name not in TEXT_BLOCKS and new.name != "table":
            return
        at, path = new, []
        while at is not None:
            path.append(at)
            if at.tag in HIDDEN:  # what is hidden makes no block of what is around it
                return
            at = at.parent
        for element in path[1:]:
            element.has_block = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        open_ = self.at
        while open_.parent is not None and open_.tag != tag:
            open_ = open_.parent
        if open_.parent is not None:
            self.at = open_.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Element:
    """The root, above all elements of the text. End tags that match nothing are passed over; what is open at the end is closed."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def own_rows(table: Element) -> Iterator[Element]:
    """The rows of a table that are not of a table within it."""
    waiting = [c for c in reversed(table.children) if isinstance(c, Element)]
    while waiting:
        at = waiting.pop()
        if at.name == "tr":
            yield at
        if at.name != "table":
            waiting += [c for c in reversed(at.children) if isinstance(c, Element)]


def table_text(table: Element) -> str:
    lines = []
    for row in own_rows(table):
        cells = [squeezed(c.text()) for c in row.children if isinstance(c, Element) and c.name in ("td", "th")]
        lines.append(" | ".join(c for c in cells if c))
    return "\n".join(x for x in lines if x)


def blocks_of(html: str) -> list[tuple[str, str, str]]:
    """Kind (text or table), text and source path of each block of the body, or of the whole text if it has none.

    Text before, between and after the blocks of an element is a block of that element. A table is one block, with
    a line a row; the tables in its cells are text of the cells. What isn't shown is left out.
    """
    root = tree(html)
    body = next((e for e in root.inside() if e.tag == "body"), root)
    out: list[tuple[str, str, str]] = []
    # Steps that are left: a string to add, an element to go into, or an element whose text so far is to be put out.
    open_: list[list[str]] = []
    todo: list[tuple[str, Element, str]] = [("enter", body, "")]
    while todo:
        step, element, words = todo.pop()
        if step == "enter":
            if element.tag in HIDDEN:
                continue
            if element.name == "table":
                if found := table_text(element):
                    out.append(("table", found, element.path()))
                continue
            open_.append([])
            todo.append(("leave", element, ""))
            for child in reversed(element.children):
                if isinstance(child, str):
                    todo.append(("text", element, child))
                elif child.tag in HIDDEN:
                    continue
                elif child.name in TEXT_BLOCKS or child.name == "table" or child.has_block:
                    todo.append(("enter", child, ""))
                    todo.append(("put", element, ""))
                else:
                    todo.append(("text", element, squeezed(child.text())))
        elif step == "text":
            open_[-1].append(words)
        else:
            if found := squeezed(open_[-1]):
                out.append(("text", found, element.path()))
            open_[-1].clear()
            if step == "leave":
                open_.pop()
    return out


def block_rows(pages: DataFrame) -> DataFrame:
    """page_id, block_index, kind, text and source_path of the blocks of html; null and empty pages have none."""
    types = [pa.int32(), pa.string(), pa.string(), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, *b) for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if h for i, b in enumerate(blocks_of(h))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.types[0], *types])], names=["page_id", "block_index", "kind", "text", "source_path"])

    return pages.select("page_id", "html").mapInArrow(parse, f"page_id {dict(pages.dtypes)['page_id']}, block_index int, kind string, text string, source_path string")


def _stripped(parts: list[str], between: str) -> str:
    return between.join(t for p in parts if (t := p.strip()))


def index_rows(html: str) -> list[tuple[str | None, str, str, str | None]]:
    """Sequence, document name, type and description of the rows of a filing's index: rows of tables of the class tableFile with four cells or more and a named link in the third."""
    out = []
    for table in tree(html).inside():
        if table.tag != "table" or "tableFile" not in table.attrs.get("class", "").split():
            continue
        for row in (e for e in table.inside() if e.tag == "tr"):
            cells = [e for e in row.inside() if e.tag == "td"]
            if len(cells) < 4:
                continue
            link = next((e for e in cells[2].inside() if e.tag == "a"), None)
            name = "" if link is None else _stripped(link.text(hidden=True), "")
            if name:
                out.append((_stripped(cells[0].text(hidden=True), " ") or None, name, _stripped(cells[3].text(hidden=True), " "), _stripped(cells[1].text(hidden=True), " ") or None))
    return out


def filing_files(filings: DataFrame) -> DataFrame:
    """Files of filings (filing_id, cik, accession_number, primary_document, html, the index page), with path, the address below the archive, and is_primary."""
    kind = dict(filings.dtypes)["filing_id"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for filing_id, cik, number, primary, html in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for sequence, name, type_, description in index_rows(html or ""):
                    rows.append((filing_id, sequence, name, type_, description, f"{int(cik)}/{number.replace('-', '')}/{name}", name == primary))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [batch.schema.types[0], *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["filing_id", "sequence", "document_name", "document_type", "description", "path", "is_primary"])

    rows = filings.select("filing_id", "cik", "accession_number", "primary_document", "html")
    return rows.mapInArrow(parse, f"filing_id {kind}, sequence string, document_name string, document_type string, description string, path string, is_primary boolean")
