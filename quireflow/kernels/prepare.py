"""Documents made safe to show: nothing active is left, every other element and id stays in place, so
CFIs of the original hold for what is shown."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import escape
from urllib.parse import urlsplit

from .errors import BookError
from .markup import MATH, SVG, XHTML, XML, Node, decode, line_feeds, parse_html, walk_xml
from .paths import against, uri_of
from .units import from_units

# What runs or loads by itself, and attributes that name resources.
ACTIVE = {"script", "iframe", "frame", "frameset", "object", "embed", "applet", "portal", "base"}
LINKS = ("href", "src", "poster", "data", "{http://www.w3.org/1999/xlink}href", "xlink:href")
THEMES = {"light": ("#ffffff", "#111111"), "sepia": ("#f4ecd8", "#433422"), "dark": ("#121212", "#e6e6e6")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(frozen=True)
class Settings:
    flow: str = "paginated"
    theme: str = "light"
    font_scale: float = 1.0
    line_height: float = 1.5
    margin: int = 24

    def __post_init__(self):
        if self.flow not in ("paginated", "scrolled") or self.theme not in THEMES:
            raise ValueError("unknown flow or theme")
        if not (0.5 <= self.font_scale <= 3 and 1 <= self.line_height <= 2.5 and 0 <= self.margin <= 96):
            raise ValueError("font scale 0.5 to 3, line height 1 to 2.5, margin 0 to 96")


def reader_css(s: Settings, fixed: bool) -> str:
    """The style that a reader puts on top of a book's own."""
    if fixed:
        return "html,body{margin:0;padding:0;overflow:hidden}"
    back, ink = THEMES[s.theme]
    base = f"html{{background:{back};color:{ink};font-size:{s.font_scale * 100:g}%}}body{{line-height:{s.line_height:g};color:inherit;background:transparent}}img,svg,video{{max-width:100%;max-height:100vh}}"
    if s.flow == "scrolled":
        return f"{base}body{{margin:0 auto;padding:{s.margin}px;max-width:45em}}"
    return f"{base}html{{height:100vh;overflow:hidden}}body{{margin:0;padding:{s.margin}px;height:100vh;box-sizing:border-box;column-width:100vw;column-gap:{2 * s.margin}px}}"


def contained(value: str, document: str) -> str:
    """A reference that would leave the container, as the relative one it is clamped to; others as they are."""
    if not value or value.startswith("#"):
        return value
    try:
        parts = urlsplit(value)
        if parts.scheme or parts.netloc:
            return value
        notes: list = []
        inside = against(value, uri_of(document), notes)
    except (BookError, ValueError):
        return value
    if not notes:
        return value
    return "../" * document.count("/") + inside


class _Tree:
    """Markup events to nodes; what is active becomes an inert template that keeps its id."""

    def __init__(self):
        self.root: Node | None = None
        self.stack: list[Node] = []

    def start(self, ns, local, attributes):
        node = Node(local, attributes, ns or "")
        if self.stack:
            self.stack[-1].children.append(node)
        else:
            self.root = node
        self.stack.append(node)

    def end(self):
        self.stack.pop()

    def text(self, data):
        if self.stack:
            self.stack[-1].children.append(data)


def _is_script(value: str) -> bool:
    return re.sub(r"[\x00-\x20]", "", value).lower().startswith(("javascript:", "vbscript:"))


def disarm(node: Node, document: str) -> None:
    """Remove what acts, in place."""
    todo = [node]
    while todo:
        here = todo.pop()
        keep: dict[str, str] = {}
        for k, v in here.attributes.items():
            bare = k.rpartition("}")[2].lower()
            if bare.startswith("on") or bare in ("srcdoc", "ping") or _is_script(v):
                continue
            if bare == "http-equiv" and v.strip().lower() in ("refresh", "content-security-policy", "set-cookie"):
                keep["data-http-equiv"] = v
                continue
            keep[k] = contained(v, document) if k in LINKS else v
        here.attributes = keep
        for child in here.children:
            if isinstance(child, Node):
                if child.name.lower() in ACTIVE and child.ns in (XHTML, SVG, ""):
                    child.attributes = {k: v for k, v in child.attributes.items() if k == "id"}
                    child.name, child.ns, child.children = "template", XHTML, []
                else:
                    todo.append(child)


def _head(root: Node) -> Node:
    head = next((c for c in root.children if isinstance(c, Node) and c.name == "head"), None)
    if head is None:
        head = Node("head", {})
        # In front of the body a new element would move its step, so the head goes behind all.
        root.children.append(head)
    return head


def _xml(node: Node, above: str | None = None) -> str:
    attributes = {} if node.ns == above or not node.ns else {"xmlns": node.ns}
    prefixes: dict[str, str] = {}
    for k, v in node.attributes.items():
        if k.startswith("{"):
            ns, _, local = k[1:].partition("}")
            prefix = prefixes.setdefault(ns, f"n{len(prefixes)}")
            attributes[f"{prefix}:{local}"] = v
        else:
            attributes[k] = v
    attributes |= {f"xmlns:{p}": ns for ns, p in prefixes.items() if ns != XML}
    head = node.name + "".join(f' {k}="{escape(v)}"' for k, v in attributes.items())
    if not node.children:
        return f"<{head}/>"
    inner = "".join(_xml(c, node.ns) if isinstance(c, Node) else escape(from_units(c), quote=False) for c in node.children)
    return f"<{head}>{inner}</{node.name}>"


def _html(node: Node) -> str:
    head = node.name + "".join(f' {k}="{escape(v)}"' for k, v in node.attributes.items())
    if node.name in VOID and node.ns == XHTML:
        return f"<{head}>"
    raw = node.ns == XHTML and node.name in ("style", "script", "xmp", "noembed", "noframes", "iframe")
    inner = "".join(_html(c) if isinstance(c, Node) else from_units(c) if raw else escape(from_units(c), quote=False) for c in node.children)
    return f"<{head}>{inner}</{node.name}>"


def prepare(data: bytes, media_type: str, document: str, settings: Settings = Settings(), fixed: bool = False) -> str:
    """A document as a reader shows it, in UTF-8: active content inert, references contained, viewport
    and reader style last in the head."""
    text = decode(data, document)
    if media_type == "text/html":
        root = parse_html(text)
        for head in [c for c in root.children if isinstance(c, Node) and c.name == "head"]:
            for meta in [c for c in head.children if isinstance(c, Node) and c.name == "meta"]:
                if "charset" in meta.attributes:
                    meta.attributes["charset"] = "utf-8"
                elif meta.attributes.get("http-equiv", "").lower() == "content-type":
                    meta.attributes["content"] = "text/html; charset=utf-8"
    elif media_type in ("application/xhtml+xml", "image/svg+xml"):
        sink = _Tree()
        walk_xml(line_feeds(text), sink, document)
        root = sink.root
    else:
        raise BookError("content", f"unsupported type {media_type}", document)
    disarm(root, document)
    if root.ns == XHTML:
        head = _head(root)
        extra = [] if fixed else [Node("meta", {"name": "viewport", "content": "width=device-width, initial-scale=1"})]
        head.children += [*extra, Node("style", {"data-reader": "true"})]
        head.children[-1].children.append(reader_css(settings, fixed))
    return "<!DOCTYPE html>" + _html(root) if media_type == "text/html" else '<?xml version="1.0" encoding="utf-8"?>' + _xml(root)


__all__ = ["MATH", "Settings", "contained", "prepare", "reader_css"]
