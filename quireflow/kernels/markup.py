"""Events of content documents: strict XML through expat, HTML through a small tree builder.

Both give (namespace, local name, attributes) starts, ends and character data in unit strings, and count
elements and character data as a browser's document does. The HTML builder covers the implied
structure, paragraph and list closing, tables, raw text, foreign content and the reopening of
formatting elements; of the adoption agency only the case without a block inside is followed, and
content that is misplaced in a table is put before it.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from xml.parsers import expat

from .errors import BookError
from .units import to_units

XHTML, SVG, MATH = "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg", "http://www.w3.org/1998/Math/MathML"
XML = "http://www.w3.org/XML/1998/namespace"
MAX_BYTES, MAX_ELEMENTS, MAX_DEPTH = 8 << 20, 100_000, 128

#: Windows-1252 for bytes 0x80 to 0x9f; undefined ones stay control characters.
_CP1252 = {b: chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in range(0x80, 0xA0)}


def decode(data: bytes, path: str | None = None) -> str:
    """Bytes of a content document: UTF-16 by its mark or a leading '<', declared Latin-1 as
    Windows-1252, else strict UTF-8 without its mark."""
    try:
        for mark, codec, skip in ((b"\xff\xfe", "utf-16-le", 2), (b"\xfe\xff", "utf-16-be", 2), (b"<\0", "utf-16-le", 0), (b"\0<", "utf-16-be", 0)):
            if data.startswith(mark) and (skip or len(data) >= 4):
                if len(data) % 2:
                    raise UnicodeError("odd byte count")
                return data[skip:].decode(codec, "surrogatepass")
        named = re.search(r"(?:encoding|charset)\s*=\s*[\"']?([a-z0-9_-]+)", data[:1024].decode("latin-1"), re.I)
        if named and named[1].lower() in ("iso-8859-1", "latin1", "windows-1252"):
            return data.decode("latin-1").translate(_CP1252)
        return data.decode("utf-8").removeprefix("\ufeff")
    except UnicodeError as error:
        raise BookError("content", "can't decode the document", path) from error


def line_feeds(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


_OPAQUE = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|&([A-Za-z][A-Za-z0-9]*);", re.S)
_XML_NAMES = {"amp", "lt", "gt", "quot", "apos"}


def _named(m: re.Match) -> str:
    name = m[1]
    if not name or name in _XML_NAMES or f"{name};" not in html5:
        return m[0]
    return "".join(f"&#{ord(c)};" for c in html5[f"{name};"])


def walk_xml(text: str, sink, path: str | None = None, max_elements: int = MAX_ELEMENTS, max_depth: int = MAX_DEPTH, kind: str = "content", entities: bool = True, internal_kind: str | None = None) -> None:
    """Feed a well-formed document to sink.start, sink.end and sink.text. Internal DTD subsets and
    documents past the limits are refused before anything is built from them."""
    parser = expat.ParserCreate(namespace_separator="\x01")
    parser.buffer_text = True
    parser.namespace_prefixes = True
    parser.UseForeignDTD(False)
    depth = count = 0

    def split(name: str) -> tuple[str | None, str]:
        parts = name.split("\x01")
        return (parts[0], parts[1]) if len(parts) > 1 else (None, name)

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth, count
        depth, count = depth + 1, count + 1
        if depth > max_depth or count > max_elements:
            raise BookError("limit" if kind != "content" else kind, "too many or too deep elements", path)
        named = {}
        for k, v in attributes.items():
            ns, local = split(k)
            named[f"xml:{local}" if ns == XML else local if ns is None else f"{{{ns}}}{local}"] = v
        sink.start(*split(name), named)

    def end(_: str) -> None:
        nonlocal depth
        depth -= 1
        sink.end()

    def doctype(_name, _system, _public, internal) -> None:
        if internal:
            raise BookError(internal_kind or kind, "the document has an internal DTD subset", path)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, lambda data: sink.text(to_units(data)), doctype
    source = _OPAQUE.sub(_named, text) if entities else text
    source = re.sub(r"^(<\?xml[^>]*?)\s+encoding\s*=\s*(\"[^\"]*\"|'[^']*')", r"\1", source, count=1)
    try:
        parser.Parse(source.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as error:
        raise BookError(kind, f"malformed XML: {error}", path) from error


# --- HTML ------------------------------------------------------------------------------------


class Node:
    __slots__ = ("attributes", "children", "name", "ns")

    def __init__(self, name: str, attributes: dict[str, str], ns: str = XHTML):
        self.name, self.attributes, self.ns, self.children = name, attributes, ns, []


# Element sets of the HTML parsing rules.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
HEAD_ONLY = set("base basefont bgsound link meta noframes script style template title".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
IMPLIED_END = set("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = set("applet caption html table td th marquee object template".split())
SPECIAL = CLOSES_P | VOID | SCOPE | HEAD_ONLY | set("body button colgroup dd dt frameset head iframe li noembed noscript select tbody textarea tfoot thead tr".split())
TABLE_PARTS = {"tbody": "table", "thead": "table", "tfoot": "table", "caption": "table", "colgroup": "table", "tr": "tbody", "td": "tr", "th": "tr"}
MARKS = set("applet caption marquee object td template th".split())
_BLANK = " \t\n\r\f"


class HtmlTree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.head: Node | None = None
        self.body: Node | None = None
        self.stack = [self.root]
        self.formatting: list[Node] = []
        self.skip_feed = False

    # places

    def _open(self, name: str, scope: set[str] = SCOPE) -> bool:
        for node in reversed(self.stack):
            if node.name == name:
                return True
            if node.name in scope:
                return False
        return False

    def _put(self, node: Node | str, parent: Node | None = None) -> None:
        parent = parent or self.stack[-1]
        if parent.name in ("table", "tbody", "thead", "tfoot", "tr") and (isinstance(node, str) and node.strip(_BLANK) or isinstance(node, Node) and node.name not in TABLE_PARTS and node.name not in HEAD_ONLY | {"form", "input", "col"}):
            table = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].name == "table")
            above = self.stack[table - 1].children
            at = above.index(self.stack[table]) if self.stack[table] in above else len(above)
            if isinstance(node, str) and at and isinstance(above[at - 1], str):
                above[at - 1] += node
            else:
                above.insert(at, node)
        elif isinstance(node, str) and parent.children and isinstance(parent.children[-1], str):
            parent.children[-1] += node
        else:
            parent.children.append(node)

    def _push(self, name: str, attributes: dict[str, str], ns: str = XHTML) -> Node:
        node = Node(name, attributes, ns)
        self._put(node)
        self.stack.append(node)
        return node

    def _pop_to(self, name: str) -> None:
        while self.stack[-1] is not self.root and self.stack.pop().name != name:
            pass

    def _close_p(self) -> None:
        if self._open("p", SCOPE | {"button"}):
            self._pop_to("p")

    def _implied(self, but: str = "") -> None:
        while self.stack[-1].name in IMPLIED_END and self.stack[-1].name != but:
            self.stack.pop()

    def _live(self) -> list[Node]:
        """The formatting elements since the innermost cell began; what began in closed cells is forgotten."""
        gone = next((i for i, n in enumerate(self.formatting) if n.name in MARKS and n not in self.stack), None)
        if gone is not None:
            del self.formatting[gone:]
        begin = max((i + 1 for i, n in enumerate(self.formatting) if n.name in MARKS), default=0)
        return self.formatting[begin:]

    def _reopen(self) -> None:
        if not self._live():
            return
        at = len(self.formatting)
        while at and self.formatting[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(self.formatting)):
            old = self.formatting[i]
            self.formatting[i] = self._push(old.name, dict(old.attributes))

    def _unlink(self, node: Node) -> None:
        """Take a node out of its parent, which is still open."""
        for parent in reversed(self.stack):
            for i, child in enumerate(parent.children):
                if child is node:
                    del parent.children[i]
                    return

    def _end_formatting(self, tag: str) -> bool:
        """The end of a formatting element, whose blocks adopt what they hold of it. False where no such
        element is open: then the end tag is like any other."""
        if self.stack[-1].name == tag and self.stack[-1] not in self.formatting:
            self.stack.pop()
            return True
        for _ in range(8):  # fixed value of the rules
            node = next((n for n in reversed(self._live()) if n.name == tag), None)
            if node is None:
                return _ > 0
            if node not in self.stack:
                self.formatting.remove(node)
                return True
            if not self._open(tag):
                return True
            at = self.stack.index(node)
            block = next((n for n in self.stack[at + 1 :] if n.name in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.formatting.remove(node)
                return True
            self._adopt(node, at, block)
        return True

    def _adopt(self, node: Node, at: int, block: Node) -> None:
        """Split formatting element `node`, open at `at`, around `block`: what is open between them is
        opened anew around the block, and the block's content goes into a copy of node."""
        self._unlink(block)
        mark, moved = self.formatting.index(node), block
        between = self.stack[at + 1 : self.stack.index(block)]
        for steps, inner in enumerate(reversed(between), 1):
            if steps > 3 and inner in self.formatting:  # fixed value of the rules
                mark -= self.formatting.index(inner) < mark
                self.formatting.remove(inner)
            if inner not in self.formatting:
                self.stack.remove(inner)
                continue
            copy = Node(inner.name, dict(inner.attributes), inner.ns)
            self.formatting[self.formatting.index(inner)] = self.stack[self.stack.index(inner)] = copy
            if moved is block:
                mark = self.formatting.index(copy) + 1
            copy.children.append(moved)
            moved = copy
        self._put(moved, self.stack[at - 1])
        copy = Node(node.name, dict(node.attributes), node.ns)
        copy.children, block.children = block.children, [copy]
        self.formatting.insert(mark, copy)
        self.formatting.remove(node)
        self.stack.remove(node)
        self.stack.insert(self.stack.index(block) + 1, copy)

    def _in_body(self) -> None:
        if self.body is None:
            if self.head is None:
                self.head = Node("head", {})
                self.root.children.append(self.head)
            self.stack = [self.root]
            self.body = self._push("body", {})

    # events

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool = False) -> None:
        attributes: dict[str, str] = {}
        for k, v in attrs:
            attributes.setdefault(k, v or "")
        self.skip_feed = False
        if self.stack[-1].ns != XHTML and self.stack[-1].name not in ("foreignObject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"):
            node = self._push(_SVG_CASE.get(tag, tag) if self.stack[-1].ns == SVG else tag, attributes, self.stack[-1].ns)
            if closed:
                self.stack.pop()
            return
        if tag == "html":
            for k, v in attributes.items():
                self.root.attributes.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None:
                self.head = Node("head", attributes)
                self.root.children.append(self.head)
                self.stack.append(self.head)
            return
        if tag == "body":
            if self.body is None:
                self._in_body()
            for k, v in attributes.items():
                self.body.attributes.setdefault(k, v)
            return
        if self.body is None and (tag in HEAD_ONLY or tag == "noscript"):
            if self.head is None:
                self.handle_starttag("head", [])
            elif self.head not in self.stack:
                self.stack.append(self.head)
            self._push(tag, attributes)
            if tag in VOID:
                self.stack.pop()
            return
        if self.body is None:
            self._in_body()
        if tag in CLOSES_P:
            self._close_p()
        if tag in HEADINGS and self.stack[-1].name in HEADINGS:
            self.stack.pop()
        elif tag in ("li", "dd", "dt"):
            for node in reversed(self.stack):
                if node.name == tag or (tag != "li" and node.name in ("dd", "dt")):
                    self._implied(node.name)
                    self._pop_to(node.name)
                    break
                if node.name in SPECIAL - {"address", "div", "p"}:
                    break
            self._close_p()
        elif tag == "button" and self._open("button"):
            self._implied()
            self._pop_to("button")
        elif tag in ("option", "optgroup"):
            if self.stack[-1].name == "option":
                self.stack.pop()
            if tag == "optgroup" and self.stack[-1].name == "optgroup":
                self.stack.pop()
        elif tag in ("rb", "rt", "rtc", "rp") and self._open("ruby"):
            self._implied("rtc" if tag in ("rt", "rp") else "")
        if tag in TABLE_PARTS or tag == "col":
            self._table_part("colgroup" if tag == "col" else tag)
            if not self._open("table", {"html", "template"}):
                return
            if tag == "col" and self.stack[-1].name != "colgroup":
                self._push("colgroup", {})
        elif tag == "a" and (old := next((n for n in self._live() if n.name == "a"), None)):
            self.handle_endtag("a")
            if old in self.formatting:
                self.formatting.remove(old)
        if tag in FORMATTING:
            self._reopen()
            node = self._push(tag, attributes)
            alike = [n for n in self._live() if n.name == tag and n.attributes == attributes]
            if len(alike) >= 3:
                self.formatting.remove(alike[0])
            self.formatting.append(node)
            return
        if tag not in CLOSES_P | {"li", "dd", "dt", "col"} and tag not in TABLE_PARTS:
            self._reopen()
        ns = {"svg": SVG, "math": MATH}.get(tag, XHTML)
        node = self._push("img" if tag == "image" else tag, attributes, ns)
        if tag in MARKS:
            self.formatting.append(node)  # a mark: formatting does not go into it
        if tag in VOID or tag == "image" or (closed and ns != XHTML):
            self.stack.pop()
        self.skip_feed = tag in ("pre", "listing", "textarea")
        if tag in ("textarea", "title", "xmp", "iframe", "noembed", "noframes") and self.cdata_elem is None:
            self.set_cdata_mode(tag)

    def _table_part(self, tag: str) -> None:
        """Close and open what stands between the table and the new part."""
        if not self._open("table", {"html", "template"}):
            return
        keep = {"td": ("tr", "table"), "th": ("tr", "table"), "tr": ("tbody", "thead", "tfoot", "table")}.get(tag, ("table",))
        while self.stack[-1].name not in keep:
            self.stack.pop()
        if tag == "tr" and self.stack[-1].name == "table":
            self._push("tbody", {})
        if tag in ("td", "th") and self.stack[-1].name == "table":
            groups = [c for c in self.stack[-1].children if isinstance(c, Node)]
            if groups and groups[-1].name in ("tbody", "thead", "tfoot"):
                self.stack.append(groups[-1])
            else:
                self._push("tbody", {})
            self._push("tr", {})

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag: str) -> None:
        self.skip_feed = False
        if tag in ("html", "body", "head"):
            if tag == "head" and self.body is None:
                self.stack = [self.root]
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "p" and not self._open("p", SCOPE | {"button"}):
            self._in_body()
            self._push("p", {})
            self.stack.pop()
            return
        if tag in FORMATTING and self._end_formatting(tag):
            return
        if tag in HEADINGS:
            if any(self._open(h) for h in HEADINGS):
                while self.stack[-1].name not in HEADINGS:
                    self.stack.pop()
                self.stack.pop()
            return
        for node in reversed(self.stack):
            if node.name.lower() == tag and node is not self.root and node is not self.body:
                self._pop_to(node.name)
                return
            if node.ns == XHTML and node.name in SPECIAL and tag not in CLOSES_P | IMPLIED_END | set(TABLE_PARTS) | {"table", "button", "select"}:
                return
            if node.name in ("table", "html") or (node.name in SCOPE and tag not in TABLE_PARTS and tag != "table"):
                return

    def handle_data(self, data: str) -> None:
        data = line_feeds(data).replace("\0", "")
        if self.skip_feed and data.startswith("\n"):
            data = data[1:]
        self.skip_feed = False
        if not data:
            return
        raw = self.stack[-1].name in HEAD_ONLY | {"noscript"}
        if self.body is None and not raw:
            blank = data[: len(data) - len(data.lstrip(_BLANK))]
            data = data[len(blank) :]
            if blank and self.head is not None:
                self._put(blank)  # into the head, or between head and body
            if not data:
                return
            self._in_body()
        if not raw and self.stack[-1].ns == XHTML:
            self._reopen()
        self._put(to_units(data))


#: SVG names with capitals, by their lower case.
_SVG_CASE = {n.lower(): n for n in "clipPath foreignObject linearGradient radialGradient textPath animateMotion animateTransform feGaussianBlur feColorMatrix feBlend feFlood feImage feMerge feMergeNode feOffset feTile".split()}


_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;)(?:([A-Za-z][A-Za-z0-9]*;)?)")


def _literal(m: re.Match) -> str:
    return m[0] if m[1] in html5 else "&amp;" + (m[1] or "")


def parse_html(text: str, bare_references: bool = True) -> Node:
    """HTML takes some references without their semicolon (&amp for &); where bare_references
    is False, only what a semicolon ends is a reference and the rest stays as written."""
    tree = HtmlTree()
    tree.feed(line_feeds(text if bare_references else _REFERENCE.sub(_literal, text)))
    tree.close()
    tree._in_body()
    return tree.root


def walk_html(text: str, sink, path: str | None = None, max_elements: int = MAX_ELEMENTS, max_depth: int = MAX_DEPTH, bare_references: bool = True) -> None:
    count = 0
    todo: list[tuple[Node | str | None, int]] = [(parse_html(text, bare_references), 1)]
    while todo:
        node, depth = todo.pop()
        if node is None:
            sink.end()
        elif isinstance(node, str):
            sink.text(node)
        else:
            count += 1
            if depth > max_depth or count > max_elements:
                raise BookError("content", "too many or too deep elements", path)
            sink.start(node.ns, node.name, node.attributes)
            todo.append((None, depth))
            todo += [(child, depth + 1) for child in reversed(node.children)]
