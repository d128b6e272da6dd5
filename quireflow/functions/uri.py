"""References and entry names as Catalyst expressions; unsafe ones give null, or a reason beside."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import paths
from ..kernels.errors import BookError

_CONTROL = "[\\x00-\\x1f\\x7f-\\x9f]"


def without_fragment(href: Column) -> Column:
    """The part of a reference that names a resource."""
    return F.regexp_replace(href, "(?s)[?#].*$", "")


def fragment(href: Column) -> Column:
    """The decoded fragment, null without one; left as it is where it can't be decoded."""
    raw = F.nullif(F.regexp_extract(href, "(?s)#(.*)$", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def _fold(segments: Column) -> Column:
    """Dot segments resolved: null once the root is left, or a drive stands in the path."""
    step = (
        lambda out, s: F.when(out.isNull() | s.isNull() | s.rlike("^[A-Za-z]:"), F.lit(None).cast("array<string>"))
        .when(s.isin("", "."), out)
        .when(s == "..", F.when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1)))
        .otherwise(F.concat(out, F.array(s)))
    )
    joined = F.aggregate(segments, F.array().cast("array<string>"), step, lambda out: F.array_join(out, "/"))
    return F.nullif(joined, F.lit(""))


def archive_path(name: Column) -> Column:
    """A container entry's canonical name; null if it is unsafe. Percent signs stand for themselves."""
    safe = (name != "") & ~F.startswith(name, F.lit("/")) & ~F.contains(name, F.lit("\\")) & ~name.rlike(_CONTROL)
    return F.when(safe, _fold(F.split(name, "/")))


def archive_path_error(name: Column) -> Column:
    """Why archive_path is null."""
    return F.when(archive_path(name).isNotNull(), F.lit(None)).when(
        (name == "") | F.startswith(name, F.lit("/")) | F.contains(name, F.lit("\\")) | name.rlike(_CONTROL), "unsafe"
    ).otherwise("escapes, absolute or empty")


def _decoded(segment: Column) -> Column:
    """A segment decoded once ('+' stays); null for broken escapes and encoded separators."""
    out = F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))
    return F.when(~segment.rlike("%(?![0-9a-fA-F]{2})") & ~out.rlike(r"[/\\]|" + _CONTROL), out)


def resource_path(reference: Column, base: Column | None = None) -> Column:
    """The entry that a reference names, relative to the publication or the document `base`; null for
    remote, absolute, unsafe and escaping references."""
    path = without_fragment(reference)
    local = ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & ~path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    if base is None:
        local, raw = local & (path != ""), path
    else:
        folder = F.regexp_replace(base, "[^/]*$", "")
        raw = F.when(path == "", base).otherwise(F.concat(folder, path))
        local = local & ~base.rlike(r"[?#\\]|^/|^[A-Za-z][A-Za-z0-9+.-]*:|" + _CONTROL)
    return F.when(local, _fold(F.transform(F.split(raw, "/"), _decoded)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1))


_PLACED = T.StructType([T.StructField("href", T.StringType()), T.StructField("warning", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_PLACED)
def in_container(reference: pd.Series, document: pd.Series, bases: pd.Series) -> pd.DataFrame:
    """A reference of a document below its inherited bases, resolved at the container's root: the href, a
    warning where it was clamped, or the error that refuses it."""

    def one(r, d, b):
        notes: list = []
        try:
            return paths.resolve(r, d, list(b if b is not None else ()), notes), notes[0][0] if notes else None, None
        except BookError as error:
            return None, None, error.kind

    return pd.DataFrame([one(*row) if row[0] is not None and row[1] is not None else (None, None, None) for row in zip(reference, document, bases, strict=True)], columns=["href", "warning", "error"])
