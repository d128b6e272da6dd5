"""Media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels.package import MEDIA_TYPES
from ..kernels.reading import TEXT_TYPES

# Fixed values.
ENTRY_TYPES = {
    "xhtml": "application/xhtml+xml", "html": "text/html", "htm": "text/html", "css": "text/css", "svg": "image/svg+xml", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "opf": "application/oebps-package+xml", "ncx": "application/x-dtbncx+xml", "xml": "application/xml",
}
DISPLAYABLE = (*TEXT_TYPES, "image/png", "image/jpeg", "image/gif", "image/webp", "image/avif")
CORE = (
    "image/gif", "image/jpeg", "image/png", "image/svg+xml", "image/webp", "audio/mpeg", "audio/mp4", "audio/ogg", "audio/opus", "text/css", "font/ttf", "application/font-sfnt", "font/otf",
    "application/vnd.ms-opentype", "font/woff", "application/font-woff", "font/woff2", "application/xhtml+xml", "application/javascript", "application/ecmascript", "text/javascript",
    "application/x-dtbncx+xml", "application/smil+xml", "application/pls+xml",
)


def _table(types: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in types.items() for x in pair])


def extension(href: Column) -> Column:
    """Lower-case extension of the last path segment, null without one."""
    name = F.regexp_extract(F.regexp_replace(href, "(?s)[?#].*$", ""), "([^/]*)$", 1)
    return F.nullif(F.lower(F.regexp_extract(name, r"[.]([^.]*)$", 1)), F.lit(""))


def by_extension(path: Column) -> Column:
    """What a container entry is taken for."""
    return F.try_element_at(_table(ENTRY_TYPES), extension(path))


def normalise(declared: Column, href: Column) -> Column:
    """A declared media type, repaired by the extension where it is missing, generic or wrong."""
    value = F.lower(F.trim(F.substring_index(declared, ";", 1)))
    known = F.try_element_at(_table(MEDIA_TYPES), extension(href))
    vague = value.isNull() | (value == "application/octet-stream") | ~value.rlike(r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$")
    return (
        F.when(value == "image/jpg", "image/jpeg")
        .when(value == "text/xml", F.coalesce(known, F.lit("application/xml")))
        .when((value == "text/html") & (known == "application/xhtml+xml"), known)
        .when(vague, F.coalesce(known, F.lit("application/octet-stream")))
        .otherwise(value)
    )


def is_text(media_type: Column) -> Column:
    return media_type.isin(*TEXT_TYPES)


def is_displayable(media_type: Column) -> Column:
    return media_type.isin(*DISPLAYABLE)


def is_core(media_type: Column) -> Column:
    return media_type.isin(*CORE)
