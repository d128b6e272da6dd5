"""Names inside a container, and references between its documents."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit

from .errors import BookError

_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_DRIVE = re.compile("[A-Za-z]:")
_BAD_ESCAPE = re.compile("%(?![0-9a-fA-F]{2})")
_ROOT = "https://container.invalid/"


def _walk(segments: list[str], kind: str, whole: str) -> str:
    """Dot segments resolved; the root can't be left and a name must remain."""
    out: list[str] = []
    for part in segments:
        if part in ("", "."):
            continue
        if part == "..":
            if not out:
                raise BookError(kind, "path escapes the root", whole)
            out.pop()
        elif _DRIVE.match(part):
            raise BookError(kind, "path is absolute", whole)
        else:
            out.append(part)
    if not out:
        raise BookError(kind, "path has no file name", whole)
    return "/".join(out)


def archive_path(name: str) -> str:
    """A literal entry name (percent signs stand for themselves) in canonical form."""
    if not name or name.startswith("/") or "\\" in name or _CONTROL.search(name):
        raise BookError("archive", "entry path is unsafe", name)
    return _walk(name.split("/"), "archive", name)


def _decoded(segment: str, whole: str) -> str:
    if _BAD_ESCAPE.search(segment):
        raise BookError("resource", "invalid percent encoding", whole)
    try:
        out = unquote_to_bytes(segment).decode("utf-8")
    except UnicodeDecodeError:
        raise BookError("resource", "invalid percent encoding", whole) from None
    if "/" in out or "\\" in out or _CONTROL.search(out):
        raise BookError("resource", "encoded path separator", whole)
    return out


def resource_path(reference: str, base: str | None = None) -> str:
    """The entry that a reference names: relative to the publication, or to the document `base`.
    Each segment is decoded once; query and fragment don't count."""
    path = re.split("[?#]", reference, maxsplit=1)[0]
    if (not path and base is None) or path.startswith("/") or "\\" in path or _SCHEME.match(path):
        raise BookError("resource", "reference must be relative to the publication", reference)
    if base is not None:
        if _CONTROL.search(base) or re.search(r"[?#\\]", base) or base.startswith("/") or _SCHEME.match(base):
            raise BookError("resource", "base path is invalid", base)
        at_base = resource_path(base)
        if not path:
            return at_base
        path = f"{base.rpartition('/')[0]}/{path}"
    return _walk([_decoded(part, reference) for part in path.split("/")], "resource", reference)


def try_path(href: str | None) -> str | None:
    """resource_path, or None for remote, empty and invalid references."""
    try:
        if not href or urlsplit(href).scheme or urlsplit(href).netloc:
            return None
        return resource_path(href)
    except (BookError, ValueError):
        return None


def uri_of(path: str) -> str:
    """An entry name as a reference."""
    return quote(path, safe="/!$&'()*+,;=:@-._~")


def _leaves(reference: str, base: str) -> bool:
    path = re.split("[?#]", reference, maxsplit=1)[0]
    if not path:
        return False
    if path.endswith("/") or path in (".", ".."):
        path += "/x"
    try:
        resource_path(path, base + "x" if base.endswith("/") else base)
    except BookError as error:
        return "escapes" in error.message
    return False


def _normal(href: str) -> str:
    return quote(href, safe="/!$&'()*+,;=:@-._~%?#[]")


def against(reference: str, base: str, warnings: list | None = None, where: str | None = None) -> str:
    """Resolve a reference of a document at the container's root URL: nothing leaves the container,
    what tries to is clamped and reported. Only http(s) may be remote."""
    if re.search(r"[\x00-\x1f\x7f-\x9f\\]", reference) or _BAD_ESCAPE.search(reference):
        raise BookError("security", "invalid characters in a reference", reference)
    try:
        target, at = urlsplit(reference), urlsplit(base)
    except ValueError:
        raise BookError("security", "malformed reference", reference) from None
    if target.netloc and not target.scheme:
        raise BookError("security", "scheme-relative reference", reference)
    if target.scheme or at.scheme:
        whole = urljoin(base, reference)
        parts = urlsplit(whole)
        if parts.scheme not in ("http", "https") or not parts.netloc:
            raise BookError("security", "unsafe scheme", reference)
        return whole
    if warnings is not None:
        if target.path.startswith("/"):
            warnings.append(("url-path-absolute", "Path-absolute reference resolved at the container root.", where or reference))
        elif _leaves(reference, base):
            warnings.append(("url-leaks-container", "Reference out of the container resolved at its root.", where or reference))
    href = _normal(urljoin(urljoin(_ROOT, base), reference).removeprefix(_ROOT).lstrip("/"))
    if not reference:
        href = _normal(base)
    try:
        resource_path(href)
    except BookError as error:
        raise BookError("security", "reference can't be resolved in the publication", reference) from error
    return href


def resolve(reference: str, document: str, bases: list[str] = (), warnings: list | None = None) -> str:
    """A reference of the document at entry name `document`, with its inherited xml:base values."""
    at = uri_of(document)
    for base in bases:
        at = against(base, at, warnings, document)
    return against(reference, at, warnings, document)
