"""Package documents: from a container to plain rows of metadata, manifest, spine and navigation.

parse() gives one Book of lists of dicts, ready to be columns. What can be repaired becomes a warning;
what can't raises a BookError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from .archive import Archive
from .errors import BookError
from .markup import XHTML, XML, walk_xml
from .paths import archive_path, resolve, resource_path, try_path, uri_of

# Namespaces, vocabularies and reserved prefixes of the format.
OPF, DC, OPS = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/ops"
NCX, ENC, OCF = "http://www.daisy.org/z3986/2005/ncx/", "http://www.w3.org/2001/04/xmlenc#", "urn:oasis:names:tc:opendocument:xmlns:container"
META = "http://idpf.org/epub/vocab/package/meta/#"
PREFIXES = {
    "dcterms": "http://purl.org/dc/terms/",
    "rendition": "http://www.idpf.org/vocab/rendition/#",
    "media": "http://www.idpf.org/epub/vocab/overlays/#",
    "schema": "http://schema.org/",
    "marc": "http://id.loc.gov/vocabulary/relators/",
}
# Media types by extension.
MEDIA_TYPES = {
    "xhtml": "application/xhtml+xml", "html": "text/html", "htm": "text/html", "css": "text/css", "svg": "image/svg+xml", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "mp3": "audio/mpeg", "aac": "audio/aac",
    "m4a": "audio/mp4", "mp4": "video/mp4", "ogg": "audio/ogg", "smil": "application/smil+xml", "js": "text/javascript", "xml": "application/xml", "opf": "application/oebps-package+xml",
    "ncx": "application/x-dtbncx+xml",
}


@dataclass(frozen=True)
class Options:
    xml_bytes: int = 8 << 20
    xml_elements: int = 100_000
    xml_depth: int = 128
    nav_items: int = 10_000
    nav_depth: int = 64


# --- a small element tree ----------------------------------------------------------------------


@dataclass
class Element:
    ns: str | None
    name: str
    attributes: dict[str, str]
    parent: Element | None
    children: list[Element | str] = field(default_factory=list)

    def __call__(self, name: str, ns: str | None = None) -> str | None:
        return self.attributes.get(name if ns is None else f"{{{ns}}}{name}")

    def elements(self, name: str | None = None, ns: str = OPF) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element) and (name is None or (c.name, c.ns) == (name, ns))]

    def first(self, name: str, ns: str = OPF) -> Element | None:
        return next(iter(self.elements(name, ns)), None)

    def everything(self):
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.everything()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def lineage(self) -> list[Element]:
        """This element and its ancestors."""
        out, here = [], self
        while here is not None:
            out.append(here)
            here = here.parent
        return out

    def inherited(self, name: str) -> str | None:
        return next((e.attributes[name] for e in self.lineage() if name in e.attributes), None)


class _Builder:
    def __init__(self):
        self.root: Element | None = None
        self.here: Element | None = None

    def start(self, ns, local, attributes):
        e = Element(ns, local, attributes, self.here)
        if self.here is None:
            self.root = e
        else:
            self.here.children.append(e)
        self.here = e

    def end(self):
        self.here = self.here.parent

    def text(self, data):
        if self.here is not None:
            self.here.children.append(data)


_LEGAL = re.compile("[\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]*")


def decode_xml(data: bytes, path: str) -> str:
    try:
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            text = data.decode("utf-16")
        elif len(data) >= 4 and (data[0] == 0x3C and data[1] == data[3] == 0):
            text = data.decode("utf-16-le")
        elif len(data) >= 4 and (data[1] == 0x3C and data[0] == data[2] == 0):
            text = data.decode("utf-16-be")
        else:
            text = data.decode("utf-8")
    except UnicodeError as error:
        raise BookError("package", "invalid XML encoding", path) from error
    named = re.match(r"\ufeff?<\?xml\s+[^?]*encoding\s*=\s*[\"']([^\"']+)", text, re.I)
    if named and named[1].lower() not in ("utf-8", "utf-16", "utf-16le", "utf-16be") or not _LEGAL.fullmatch(text):
        raise BookError("package", "unsupported XML encoding or character", path)
    return text


def clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def tokens(text: str | None) -> list[str]:
    return list(dict.fromkeys((text or "").split()))


# --- values ------------------------------------------------------------------------------------


def expand(name: str, prefixes: dict[str, str]) -> str:
    prefix, colon, rest = name.partition(":")
    return META + name if not colon else prefixes[prefix] + rest if prefix in prefixes else name


def canonical(full: str) -> str:
    if full.startswith(META):
        return full[len(META) :]
    for name, uri in [*PREFIXES.items(), ("schema", "https://schema.org/")]:
        if full.startswith(uri):
            return f"{name}:{full[len(uri) :]}"
    return full


def prefix_table(declared: str | None) -> dict[str, str]:
    return PREFIXES | {n: u for n, u in re.findall(r"([A-Za-z][\w.-]*):\s+(\S+)", declared or "") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", u)}


def media_type(declared: str | None, href: str) -> str:
    value = declared.split(";")[0].strip().lower() if declared is not None else None
    name = re.split("[?#]", href)[0].rpartition("/")[2]
    known = MEDIA_TYPES.get(name.rpartition(".")[2].lower()) if "." in name else None
    if value == "image/jpg":
        return "image/jpeg"
    if value == "text/xml":
        return known or "application/xml"
    if value == "text/html" and known == "application/xhtml+xml":
        return known
    if value in (None, "application/octet-stream") or not re.fullmatch(r"[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+", value):
        return known or "application/octet-stream"
    return value


def clock(value: str | None) -> int | None:
    """Microseconds of a clock value: h:m:s, m:s, or a number with h, min, s or ms."""
    text = (value or "").strip()
    if ":" in text:
        try:
            *upper, last = (float(x) for x in text.split(":"))
        except ValueError:
            return None
        if len(upper) not in (1, 2) or not all(0 <= x < float("inf") for x in (*upper, last)) or last >= 60 or upper[-1] >= 60 or any(x != int(x) for x in upper):
            return None
        seconds = sum(x * 60 ** (len(upper) - i) for i, x in enumerate(upper)) + last
    else:
        m = re.fullmatch(r"(\d+(?:\.\d+)?)(h|min|ms|s)?", text)
        if not m:
            return None
        seconds = float(m[1]) * {"h": 3600, "min": 60, "ms": 0.001}.get(m[2], 1)
    return None if seconds > 9e9 else int(seconds * 1e6 + 0.5)


def date(value: str | None) -> datetime | None:
    """A date, year or month (its first day); impossible days are refused."""
    text = (value or "").strip()
    text += {4: "-01-01", 7: "-01"}.get(len(text), "") if re.fullmatch(r"\d{4}(-\d{2})?", text) else ""
    if not re.match(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        out = datetime.fromisoformat(text)
    except ValueError:
        return None
    return out.astimezone(timezone.utc).replace(tzinfo=None) if out.tzinfo else out


def rendition(names: list[str], prefixes: dict[str, str]) -> dict[str, str]:
    out = {}
    for name in (canonical(expand(n, prefixes)) for n in names):
        bare = name.removeprefix("rendition:")
        if bare.startswith("page-spread-"):
            out["page"] = bare.removeprefix("page-spread-")
        if name == bare:
            continue
        if bare in ("layout-pre-paginated", "layout-reflowable"):
            out["layout"] = "fixed" if bare == "layout-pre-paginated" else "reflowable"
        for kind in ("orientation", "spread", "flow"):
            if bare.startswith(f"{kind}-"):
                out[kind] = bare[len(kind) + 1 :]
    return out


def _integer(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*[+-]?\d+\s*", text) else None


def _number(text: str | None) -> float | None:
    try:
        x = float(text) if text else None
    except ValueError:
        return None
    return x if x is not None and abs(x) < float("inf") else None


# --- the package -------------------------------------------------------------------------------


@dataclass
class Book:
    package_path: str
    identifier: str | None = None  # as written: it is a key
    metadata: dict = field(default_factory=dict)
    manifest: list[dict] = field(default_factory=list)
    spine: list[dict] = field(default_factory=list)
    nav: list[dict] = field(default_factory=list)  # kind, node, parent, depth, ord, href, title, rels, properties
    links: list[dict] = field(default_factory=list)
    collections: list[dict] = field(default_factory=list)
    encryption: dict[str, str] = field(default_factory=dict)
    warnings: list[tuple[str, str, str]] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


class _Metadata:
    """Records of the metadata element, and what refines them."""

    def __init__(self, element: Element, root: Element):
        self.element, self.root = element, root
        self.prefixes = prefix_table(root("prefix"))
        self.records = [self._record(e) for e in element.elements()]
        self.about: dict[str, list[dict]] = {}
        for r in self.records:
            if (r["refines"] or "").startswith("#"):
                self.about.setdefault(r["refines"][1:], []).append(r)

    def _record(self, e: Element) -> dict:
        meta = (e.name, e.ns) == ("meta", OPF)
        prop = e("property") if meta else None
        return {
            "name": e.name, "namespace": e.ns, "value": e("content") if meta and e("content") is not None else clean(e.text()), "id": e("id"), "refines": e("refines"), "scheme": e("scheme"),
            "language": e.inherited("xml:lang") or None, "property": None if prop is None else expand(prop, self.prefixes), "attributes": dict(e.attributes),
        }

    def refined(self, of: str | None, name: str) -> list[str]:
        full = expand(name, self.prefixes)
        return [r["value"] for r in self.about.get(of or "", ()) if r["namespace"] == OPF and r["property"] == full]

    def one(self, of: str | None, name: str) -> str | None:
        return next(iter(self.refined(of, name)), None)

    def primary(self) -> list[dict]:
        return [r for r in self.records if r["namespace"] == OPF and r["refines"] is None]

    def value(self, name: str) -> str | None:
        full = expand(name, self.prefixes)
        return next((r["value"] for r in self.primary() if r["property"] == full), None)

    def legacy(self, name: str) -> str | None:
        return next((r["value"] for r in self.records if r["namespace"] == OPF and r["name"] == "meta" and r["attributes"].get("name") == name), None)

    def dc(self, name: str) -> list[Element]:
        return self.element.elements(name, DC)

    def key(self) -> str | None:
        wanted = self.root("unique-identifier")
        return next((e.text() for e in self.dc("identifier") if wanted is not None and e("id") == wanted), None)

    def person(self, e: Element, role: str) -> dict:
        roles = dict.fromkeys(r.rpartition("/")[2] for r in self.refined(e("id"), "role"))
        return {
            "name": clean(e.text()), "roles": list(roles) or [e("role", OPF) or role], "file_as": self.one(e("id"), "file-as") or e("file-as", OPF), "identifier": self.one(e("id"), "identifier"),
            "language": e.inherited("xml:lang") or None, "direction": direction(e),
        }


def direction(e: Element) -> str | None:
    value = (e.inherited("dir") or "").strip().lower()
    return value if value in ("ltr", "rtl", "auto") else None


class _Parser:
    def __init__(self, archive: Archive, options: Options):
        self.archive, self.options = archive, options
        self.warnings: list[tuple[str, str, str]] = []

    def warn(self, code: str, message: str, path: str) -> None:
        self.warnings.append((code, message, path))

    def raw(self, path: str) -> str:
        e = self.archive.entries.get(path)
        if e is None or e.is_dir:
            raise BookError("package", "a required document is missing", path)
        if e.size > self.options.xml_bytes:
            raise BookError("limit", "XML document is too large", path)
        return decode_xml(self.archive.read(path), path)

    def xml(self, path: str) -> Element:
        sink = _Builder()
        walk_xml(self.raw(path).removeprefix("\ufeff"), sink, path, self.options.xml_elements, self.options.xml_depth, kind="package", entities=False, internal_kind="security")
        return sink.root

    def href(self, reference: str, document: str, e: Element) -> str:
        bases = [b for a in reversed(e.lineage()) if (b := a("xml:base"))]
        return resolve(reference, document, bases, self.warnings)

    def parse(self) -> Book:
        if self.raw("mimetype") != "application/epub+zip":
            raise BookError("package", "the mimetype entry is wrong", "mimetype")
        container = self.xml("META-INF/container.xml")
        if (container.name, container.ns) != ("container", OCF):
            raise BookError("package", "the container's root is not a container")
        roots = container.first("rootfiles", OCF)
        named = [r("full-path") for r in (roots.elements("rootfile", OCF) if roots else ()) if r("media-type") == "application/oebps-package+xml" and r("full-path") is not None]
        if not named:
            raise BookError("package", "no package is named")
        self.path = archive_path(named[0])
        self.root = self.xml(self.path)
        if (self.root.name, self.root.ns) != ("package", OPF):
            raise BookError("package", "the package's root is not a package", self.path)
        book = self.package()
        book.encryption = self.encryption()
        book.warnings = self.warnings
        entries = self.archive.entries
        book.missing = [i["href"] for i in book.manifest if not i["external"] and i["path"] not in entries]
        return book

    def package(self) -> Book:
        version = self.root("version")
        if not re.fullmatch(r"[23]\.\d+(\.\d+)?", version or ""):
            self.warn("package-version-unsupported", f"Read as version 3: {version or 'none given'}.", self.path)
        metadata, manifest, spine = (self.root.first(n) for n in ("metadata", "manifest", "spine"))
        if not (metadata and manifest and spine):
            raise BookError("package", "metadata, manifest and spine are required", self.path)
        self.meta = _Metadata(metadata, self.root)
        book = Book(self.path, self.meta.key())
        items = self.manifest_items(manifest)
        self.alternates(items)
        book.spine = self.spine_items(spine, items)
        linear = {s["idref"] for s in book.spine if s["linear"]}
        if not linear:
            raise BookError("package", "no linear reading order", self.path)
        for s in book.spine:
            if not s["linear"]:
                items[s["idref"]]["properties"] = s["properties"]
        book.manifest = list(items.values())
        cover = next((i["href"] for i in book.manifest if "cover" in i["rels"]), None)
        turn = spine("page-progression-direction") or "auto"
        book.metadata = self.describe(cover, turn if turn in ("auto", "ltr", "rtl", "ttb", "btt") else "auto")
        book.links = [{"href": uri_of(self.path), "type": "application/oebps-package+xml", "rels": ["self"], "properties": {}}, *self.metadata_links(metadata)]
        self.navigation(book, items, spine)
        guide = self.guide()
        if any(n["kind"] == "landmarks" for n in book.nav):
            if guide:
                book.collections.append({"role": "guide", "path": [], "links": guide})
        else:
            book.nav += [n | {"kind": "landmarks"} for n in _rows("landmarks", guide)]
        for i, c in enumerate(self.root.elements("collection")):
            self.collection(c, [i], book.collections)
        if bound := self.bindings(items):
            book.collections.append({"role": "bindings", "path": [], "links": bound})
        return book

    def manifest_items(self, manifest: Element) -> dict[str, dict]:
        items: dict[str, dict] = {}
        cover, hrefs = self.meta.legacy("cover"), set()
        for e in manifest.elements("item"):
            name, reference = e("id"), e("href")
            if not (name or "").strip() or not reference or name in items:
                raise BookError("package", "manifest item is incomplete or repeats an id", self.path)
            href = self.href(reference, self.path, e)
            external = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href) is not None
            path = href if external else resource_path(href)
            if href in hrefs:
                raise BookError("package", "manifest repeats an href", href)
            hrefs.add(href)
            declared = e("media-type")
            kind = media_type(declared, href)
            if declared != kind:
                self.warn("media-type-normalized", f"Media type read as {kind}.", path)
            names = list(dict.fromkeys(canonical(expand(t, self.meta.prefixes)) for t in tokens(e("properties"))))
            entry = self.archive.entries.get(path)
            if not external and (entry is None or entry.is_dir):
                self.warn("resource-missing", "The container has no such entry.", path)
            told = self.meta.one(name, "media:duration")
            if told is not None and clock(told) is None:
                self.warn("media-duration-invalid", "media:duration is no clock value.", path)
            properties = {"id": name} | ({"properties": " ".join(names)} if names else {}) | ({"declared-media-type": declared} if declared is not None else {}) | rendition(names, self.meta.prefixes)
            items[name] = {
                "ord": len(items), "item_id": name, "href": href, "path": path, "media_type": kind, "declared_type": declared, "tokens": names, "fallback": e("fallback"),
                "media_overlay": e("media-overlay"), "fallback_style": e("fallback-style"), "external": external, "duration_us": clock(told),
                "rels": (["cover"] if "cover-image" in names or name == cover else []) + (["contents"] if "nav" in names else []), "properties": properties,
            }
        if not items:
            raise BookError("package", "the manifest is empty", self.path)
        return items

    def alternates(self, items: dict[str, dict]) -> None:
        """Fallbacks and overlays name other items; what they name must exist and end."""
        done: set[str] = set()
        for name in items:
            trail: dict[str, None] = {}
            todo: list[tuple[str, bool]] = [(name, False)]
            while todo:
                at, left = todo.pop()
                if left:
                    trail.pop(at)
                    done.add(at)
                    continue
                if at in done:
                    continue
                if at not in items or at in trail:
                    raise BookError("package", "fallback or overlay is missing or goes in a circle", self.path)
                trail[at] = None
                if len(trail) > self.options.xml_depth:
                    raise BookError("limit", "fallbacks are too deep", self.path)
                todo.append((at, True))
                todo += [(items[at][k], False) for k in ("fallback", "media_overlay") if items[at][k] is not None]
        for i in items.values():
            if (overlay := i["media_overlay"]) and items[overlay]["media_type"] != "application/smil+xml":
                raise BookError("package", "a media overlay is no SMIL", i["path"])
            if (style := i["fallback_style"]) and style not in items:
                raise BookError("package", "fallback style is missing", i["path"])
            for k, name in (("fallback", "fallback"), ("media_overlay", "media-overlay"), ("fallback_style", "fallback-style")):
                if i[k] is not None:
                    i["properties"] = i["properties"] | {name: items[i[k]]["href"]}

    def spine_items(self, spine: Element, items: dict[str, dict]) -> list[dict]:
        def step(position: int, e: Element) -> str:
            name = e("id")
            return f"/{2 * (position + 1)}" + (f"[{re.sub(r'[\^\[\](),;=]', r'^\g<0>', name)}]" if name else "")

        out = []
        head = step(self.root.elements().index(spine), spine)
        for position, ref in enumerate(spine.elements()):
            if (ref.name, ref.ns) != ("itemref", OPF):
                continue
            item = items.get(ref("idref") or "")
            if item is None:
                raise BookError("package", "the spine names a missing item", self.path)
            linear = (ref("linear") or "yes").lower() if ref("linear") is not None else "yes"
            if linear not in ("yes", "no"):
                self.warn("spine-linear-invalid", "linear is neither yes nor no; taken for yes.", self.path)
            properties = item["properties"] | rendition(tokens(ref("properties")), self.meta.prefixes) | {"linear": "no" if linear == "no" else "yes"}
            out.append({"pos": len(out), "idref": item["item_id"], "href": item["href"], "path": item["path"], "media_type": item["media_type"], "linear": linear != "no", "cfi_path": head + step(position, ref), "properties": properties})
        return out

    def describe(self, cover: str | None, turn: str) -> dict:
        m = self.meta
        titles = sorted(m.dc("title"), key=lambda e: (s if (s := _integer(m.one(e("id"), "display-seq"))) is not None else 2147483647))
        kind = {id(e): m.one(e("id"), "title-type") for e in titles}
        main = next((e for e in titles if kind[id(e)] == "main"), None) or next((e for e in titles if kind[id(e)] != "subtitle"), None) or next(iter(titles), None)
        subtitle = next((e for e in titles if kind[id(e)] == "subtitle"), None)
        people = [p for name, role in (("creator", "aut"), ("contributor", "ctb")) for e in m.dc(name) if (p := m.person(e, role))["name"]]
        properties, access = {}, {}
        for r in m.primary():
            if r["property"] is not None:
                name = canonical(r["property"])
                properties.setdefault(name, r["value"])
                if name.startswith(("schema:access", "schema:certified")):
                    access.setdefault(name[7:], []).append(r["value"])
        dates = m.dc("date")
        published = next((e for e in dates if e("event", OPF) == "publication"), dates[0] if dates else None)
        told = {"published": None if published is None else clean(published.text()), "modified": m.value("dcterms:modified"), "duration": m.value("media:duration")}
        read = {"published": date(told["published"]), "modified": date(told["modified"]), "duration": clock(told["duration"])}
        for name in told:
            if told[name] is not None and read[name] is None:
                self.warn(f"metadata-invalid-{name}", f"Ignoring invalid {name} value.", self.path)
        belongs = [
            {"name": r["value"], "type": m.one(r["id"], "collection-type"), "position": _number(m.one(r["id"], "group-position"))}
            for r in m.primary() if r["property"] == META + "belongs-to-collection"
        ]
        if not belongs and (series := m.legacy("calibre:series")) is not None:
            belongs = [{"name": series, "type": "series", "position": _number(m.legacy("calibre:series_index"))}]
        title = clean(main.text()) if main else ""
        for name, lacks in (("title", not title), ("identifier", m.key() is None), ("language", not m.dc("language"))):
            if lacks:
                self.warn(f"metadata-missing-{name}", f"Package has no usable {name}.", self.path)
        first = lambda name: next((t for e in m.dc(name) if (t := clean(e.text()))), None)
        key = m.key()
        pages = _integer(m.value("schema:numberOfPages") or m.value("number-of-pages"))
        return {
            "title": title, "subtitle": clean(subtitle.text()) if subtitle else None, "identifier": key.strip() if key is not None else first("identifier"),
            "titles": [{"value": clean(e.text()), "language": e.inherited("xml:lang") or None, "direction": direction(e), "id": e("id")} for e in titles],
            "identifiers": [clean(e.text()) for e in m.dc("identifier")], "languages": [t for e in m.dc("language") if (t := clean(e.text()))],
            "authors": [p for p in people if "aut" in p["roles"]], "contributors": [p for p in people if "aut" not in p["roles"]], "publishers": [m.person(e, "pbl") for e in m.dc("publisher")],
            "subjects": [{"name": clean(e.text()), "code": m.one(e("id"), "term"), "scheme": m.one(e("id"), "authority")} for e in m.dc("subject")],
            "belongs_to": belongs, "description": first("description"), "rights": first("rights"), "published": read["published"], "modified": read["modified"], "duration_us": read["duration"],
            "pages": pages if pages and pages > 0 else None, "reading_progression": turn, "layout": "fixed" if m.value("rendition:layout") == "pre-paginated" else "reflowable",
            "orientation": m.value("rendition:orientation"), "spread": m.value("rendition:spread"), "cover": cover, "accessibility": access, "properties": properties, "raw": m.records,
        }

    def metadata_links(self, parent: Element) -> list[dict]:
        return [
            {"href": self.href(e("href"), self.path, e), "type": e("media-type"), "rels": tokens(e("rel")), "properties": {n: e(n) for n in ("properties", "refines", "hreflang") if e(n) is not None}}
            for e in parent.elements("link") if e("href") is not None
        ]

    def guide(self) -> list[dict]:
        guide = self.root.first("guide")
        renamed = {"text": "bodymatter", "toc": "contents"}
        return [
            {"href": self.href(e("href"), self.path, e), "title": e("title"), "rels": [renamed.get(t, t) for t in tokens(e("type"))], "properties": {}, "children": []}
            for e in (guide.elements("reference") if guide else ()) if e("href") is not None
        ]

    def collection(self, e: Element, path: list[int], out: list[dict]) -> None:
        out.append({"role": e("role") or "unknown", "path": path, "links": self.metadata_links(e)})
        for i, c in enumerate(e.elements("collection")):
            self.collection(c, [*path, i], out)

    def bindings(self, items: dict[str, dict]) -> list[dict]:
        bindings, out, seen = self.root.first("bindings"), [], set()
        for e in bindings.elements("mediaType") if bindings else ():
            kind, item = e("media-type"), items.get(e("handler") or "")
            if kind is None or kind in seen or item is None or item["external"] or item["media_type"] != "application/xhtml+xml":
                raise BookError("package", "invalid binding", self.path)
            seen.add(kind)
            out.append({"href": item["href"], "type": item["media_type"], "rels": [*item["rels"], "handler"], "properties": item["properties"] | {"handles": kind}})
        return out

    # navigation

    def navigation(self, book: Book, items: dict[str, dict], spine: Element) -> None:
        nav = next((i for i in items.values() if "nav" in i["tokens"]), None)
        found: dict[str, list[dict]] = {}
        if nav:
            try:
                found = self.nav_document(nav["path"])
                if not found.get("toc"):
                    self.warn("navigation-empty", "The nav document has no usable contents.", nav["path"])
            except BookError as error:
                if error.kind != "package":
                    raise
                self.warn("navigation-invalid", error.message, nav["path"])
        if not found.get("toc"):
            ncx = items.get(spine("toc") or "") or next((i for i in items.values() if i["media_type"] == "application/x-dtbncx+xml"), None)
            try:
                if ncx is None:
                    raise LookupError
                old = self.ncx(ncx["path"])
                found = old | {k: v for k, v in found.items() if v and k != "toc"}
            except LookupError:
                self.warn("navigation-missing", "Publication has no usable contents.", self.path)
            except BookError as error:
                if error.kind != "package":
                    raise
                self.warn("ncx-invalid", error.message, ncx["path"])
                self.warn("navigation-missing", "Publication has no usable contents.", self.path)
        for kind, links in found.items():
            book.nav += _rows(kind, links)

    def _visit(self, depth: int, path: str) -> None:
        self.visited += 1
        if self.visited > self.options.nav_items or depth > self.options.nav_depth:
            raise BookError("limit", "navigation is too large or too deep", path)

    def nav_document(self, path: str) -> dict[str, list[dict]]:
        root = self.xml(path)
        if (root.name, root.ns) != ("html", XHTML):
            raise BookError("package", "the nav document has no XHTML root", path)
        self.visited, out = 0, {}
        for nav in root.everything():
            roles = tokens(nav("type", OPS)) if (nav.name, nav.ns) == ("nav", XHTML) else []
            if roles and (ol := nav.first("ol", XHTML)):
                links = self.nav_list(ol, path, 1)
                for role in roles:
                    out.setdefault(role, links)
        return out

    def nav_list(self, ol: Element, path: str, depth: int) -> list[dict]:
        out = []
        for li in ol.elements("li", XHTML):
            self._visit(depth, path)
            label = next((e for e in li.elements() if e.ns == XHTML and e.name in ("a", "span")), None)
            inner = li.first("ol", XHTML)
            children = self.nav_list(inner, path, depth + 1) if inner else []
            title = label_text(label) if label else ""
            reference = label("href") if label and label.name == "a" else None
            if title and (reference is not None or children):
                out.append({"href": "" if reference is None else self.href(reference, path, label), "title": title, "rels": tokens(label("type", OPS)), "properties": {}, "children": children})
        return out

    def ncx(self, path: str) -> dict[str, list[dict]]:
        root = self.xml(path)
        if (root.name, root.ns) != ("ncx", NCX):
            raise BookError("package", "the NCX has no NCX root", path)
        self.visited = 0
        out = {}
        for kind, parent, child in (("toc", root.first("navMap", NCX), "navPoint"), ("page-list", root.first("pageList", NCX), "pageTarget")):
            out[kind] = self.ncx_list(parent, child, path, 1) if parent else []
        for e in root.elements("navList", NCX):
            out[f"ncx:{e('id') or 'nav-list'}"] = self.ncx_list(e, "navTarget", path, 1)
        return out

    def ncx_list(self, parent: Element, kind: str, path: str, depth: int) -> list[dict]:
        out = []
        for e in parent.elements(kind, NCX):
            self._visit(depth, path)
            content, label = e.first("content", NCX), e.first("navLabel", NCX)
            text = label.first("text", NCX) if label else None
            title = clean(text.text()) if text else ""
            reference = content("src") if content else None
            children = self.ncx_list(e, kind, path, depth + 1) if kind == "navPoint" else []
            if title and (reference is not None or children):
                out.append({"href": "" if reference is None else self.href(reference, path, content), "title": title, "rels": [], "properties": {k: e(k) for k in ("value", "type") if e(k) is not None}, "children": children})
        return out

    def encryption(self) -> dict[str, str]:
        if "META-INF/encryption.xml" not in self.archive.entries:
            return {}
        root, out = self.xml("META-INF/encryption.xml"), {}
        if (root.name, root.ns) != ("encryption", OCF):
            raise BookError("security", "encryption metadata has a wrong root")
        for e in root.elements("EncryptedData", ENC):
            method, cipher = e.first("EncryptionMethod", ENC), e.first("CipherData", ENC)
            reference = cipher.first("CipherReference", ENC) if cipher else None
            algorithm, uri = method and method("Algorithm"), reference and reference("URI")
            if not algorithm or not uri:
                raise BookError("security", "an encryption declaration is incomplete")
            try:
                path = resource_path(uri)
            except BookError as error:
                raise BookError("security", "invalid reference", uri) from error
            if path in out:
                raise BookError("security", "encryption is declared twice", path)
            out[path] = algorithm
        return out


def label_text(label: Element) -> str:
    def parts(e: Element):
        for c in e.children:
            if isinstance(c, str):
                yield c
            elif (c.name, c.ns) == ("img", XHTML):
                yield f" {c('alt') or ''} "
            else:
                yield from parts(c)

    return clean("".join(parts(label))) or clean(label("title"))


def _rows(kind: str, links: list[dict]) -> list[dict]:
    """A link tree in preorder."""
    out: list[dict] = []

    def visit(nodes: list[dict], parent: int | None, depth: int) -> None:
        for n in nodes:
            number = len(out)
            out.append({"kind": kind, "node": number, "parent": parent, "depth": depth, "ord": number, "href": n["href"], "title": n["title"], "rels": sorted(n["rels"]), "properties": n["properties"]})
            visit(n["children"], number, depth + 1)

    visit(links, None, 1)
    return out


def parse(archive: Archive, options: Options | None = None) -> Book:
    options = options or Options()
    if min(options.xml_bytes, options.xml_elements, options.xml_depth, options.nav_items, options.nav_depth) <= 0:
        raise BookError("package", "limits must be positive")
    return _Parser(archive, options).parse()


def fallback(href: str, manifest: dict[str, dict], missing: set[str], accept) -> str | None:
    """The first of href and its fallbacks that is present, local and accepted. manifest: by href."""
    seen: set[str] = set()
    here: str | None = re.split("[?#]", href)[0]
    while here is not None and here not in seen:
        seen.add(here)
        item = manifest.get(here)
        if item is None:
            return None
        if here not in missing and not item["external"] and accept(item):
            return href if len(seen) == 1 else here
        here = item["properties"].get("fallback")
    return None


__all__ = ["Book", "Element", "Options", "XML", "clock", "date", "fallback", "media_type", "parse", "try_path"]
