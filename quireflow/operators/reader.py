"""Reader-side relations: navigation decisions, page geometry, decorations, serving rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uri import resource_path, without_fragment
from ..functions.values import byte_range
from ..kernels import prepare as P
from ..kernels.errors import BookError


def decide(url: Column, session: Column, pending: Column) -> Column:
    """What a page may do with a link: 'load' (the pending document), 'navigate' (inside the session),
    'external' (reported, not followed), 'block' (anything else)."""
    inside = F.startswith(url, session)
    path = without_fragment(F.substring(url, F.length(session) + 1, F.length(url)))
    return F.when(inside & (path == pending), "load").when(inside, "navigate").when(url.rlike("^https?://"), "external").otherwise("block")


def url_for(base: Column, href: Column, fallback: Column | None = None) -> Column:
    """Where a session shows a resource: its own href, or that of the fallback that stands for it (then
    without the fragment, which belongs to the original)."""
    own = href if fallback is None else F.coalesce(fallback, href)
    return F.concat(base, own)


def resource_for(urls: DataFrame, reading_order: DataFrame, resources: DataFrame) -> DataFrame:
    """urls (book, path) with href: of the reading order first, then of the resources."""
    own = lambda df, rank: df.select("book", resource_path(F.col("href")).alias("path"), "href", F.lit(rank).alias("rank"))
    best = own(reading_order, 0).union(own(resources, 1)).groupBy("book", "path").agg(F.min_by("href", F.struct("rank", "href")).alias("href"))
    return urls.join(best, ["book", "path"])


def page_turn(event: Column, direction: Column) -> Column:
    """Steps of swipes, keys and edge taps: 1 onwards, -1 back; mirrored in right-to-left books."""
    onward = event.isin("swipeLeft", "ArrowRight", "tapRight")
    back = event.isin("swipeRight", "ArrowLeft", "tapLeft")
    always = F.when(event.isin("PageDown", "Space"), 1).when(event.isin("PageUp"), -1)
    sign = F.when(direction == "rtl", -1).otherwise(1)
    return F.coalesce(always, F.when(onward, sign).when(back, -sign), F.lit(0))


def pages(scroll: Column, viewport: Column, extent: Column) -> Column:
    """Page count, page index and progression from a scroller's geometry."""
    count = F.greatest(F.lit(1), F.round(extent / viewport)).cast("int")
    page = F.greatest(F.lit(0), F.least(count - 1, F.round(F.abs(scroll) / viewport))).cast("int")
    return F.struct(count.alias("pages"), page.alias("page"), F.when(extent > viewport, F.least(F.lit(1.0), F.abs(scroll) / (extent - viewport))).otherwise(0.0).alias("progression"))


def progress_line(title: Column, position: Column, total: Column, progression: Column) -> Column:
    """Title, page and rounded percent in one line; parts that are unknown are left out."""
    return F.concat_ws(" · ", title, F.concat(F.lit("page "), position.cast("string"), F.lit(" of "), total.cast("string")), F.concat(F.round(progression * 100).cast("int").cast("string"), F.lit(" %")))


def latest_decorations(changes: DataFrame) -> DataFrame:
    """Decorations in force: of each (reader, group) the last revision's list; an empty list deletes it.
    Groups are in the order of their first use. changes: (reader, group, revision, items array)."""
    last = changes.groupBy("reader", "group").agg(F.max_by("items", "revision").alias("items"), F.max("revision").alias("revision"), F.min("revision").alias("since"))
    return last.where("size(items) > 0")


def decoration_errors(changes: DataFrame) -> DataFrame:
    """Changes that name an id twice."""
    ids = F.transform("items", lambda i: i["id"])
    return changes.where(F.size(F.array_distinct(ids)) < F.size(ids)).select("reader", "group", "revision")


def drawable(resolved: DataFrame) -> DataFrame:
    """Decorations that are drawn: found by CFI or text, and not empty."""
    return resolved.where(F.col("match").isin("cfi", "text") & (F.col("end") > F.col("start")))


def hit_test(taps: DataFrame, boxes: DataFrame) -> DataFrame:
    """taps (tap, x, y) with the topmost box (id, order, left, top, right, bottom) that holds them. Boxes meet
    taps in grid cells of 256 units, so this is an equi-join."""
    cell = 256
    grid = lambda c: F.floor(c / cell)
    spread = boxes.withColumn("cx", F.explode(F.sequence(grid(F.col("left")), grid(F.col("right"))))).withColumn("cy", F.explode(F.sequence(grid(F.col("top")), grid(F.col("bottom")))))
    placed = taps.withColumn("cx", grid(F.col("x"))).withColumn("cy", grid(F.col("y")))
    inside = placed.join(spread, ["cx", "cy"]).where("x >= left and x <= right and y >= top and y <= bottom")
    return inside.groupBy("tap").agg(F.max_by("id", F.struct("order", "id")).alias("id"))


def bounds(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """The union of an item's boxes, clipped to the viewport; null where nothing is visible."""
    c = boxes.groupBy("id").agg(F.greatest(F.min("left"), F.lit(0)).alias("left"), F.greatest(F.min("top"), F.lit(0)).alias("top"), F.least(F.max("right"), F.lit(width)).alias("right"), F.least(F.max("bottom"), F.lit(height)).alias("bottom"))
    return c.where("left < right and top < bottom")


def respond(requests: DataFrame, resources: DataFrame, token: str) -> DataFrame:
    """requests (id, method, host, path, range) answered from resources (path, media_type, length): status and
    byte range, by the rules of a loopback server: GET and HEAD, own host, own token, manifest only."""
    prefix = f"/{token}/"
    wanted = requests.withColumn("_path", F.when(F.startswith("path", F.lit(prefix)), resource_path(F.substring("path", len(prefix) + 1, 10_000))))
    joined = wanted.join(resources.withColumnRenamed("path", "_path"), "_path", "left")
    r = byte_range(F.col("range"), F.col("length"))
    status = (
        F.when(~F.col("method").isin("GET", "HEAD"), 405).when(~F.col("host").rlike(r"^(127\.0\.0\.1|localhost)(:\d+)?$"), 403).when(~F.startswith("path", F.lit(prefix)), 403)
        .when(F.col("_path").isNull(), 400).when(F.col("length").isNull(), 404).otherwise(r["status"])
    )
    ok = status.isin(200, 206)
    return joined.select("id", status.alias("status"), F.when(ok, F.col("media_type")).alias("media_type"), F.when(ok, F.coalesce(r["start"], F.lit(0))).alias("start"), F.when(ok, F.coalesce(r["end"], F.col("length"))).alias("end"))


def prepared(documents: DataFrame, settings: P.Settings = P.Settings(), content: str = "content", max_bytes: int = 8 << 20) -> DataFrame:
    """documents (book, path, media_type, fixed, content) ready to be shown, or with an error. Other types are
    filtered before Python sees them, and so is the content of documents past the limit."""
    shown = documents.where(F.col("media_type").isin("application/xhtml+xml", "text/html", "image/svg+xml"))
    size = F.octet_length(content)
    error = F.when(size.isNull(), F.lit("content: the document is missing")).when(size > max_bytes, F.lit("content: the document is too large"))
    source = shown.select("book", "path", "media_type", F.coalesce("fixed", F.lit(False)).alias("fixed"), F.when(error.isNull(), F.col(content).cast("binary")).alias("content"), error.alias("refused"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, kind, fixed, data, refused in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5)), strict=True):
                if refused:
                    out.append((None, refused))
                    continue
                try:
                    out.append((P.prepare(data, kind, str(path), settings, fixed), None))
                except BookError as error:
                    out.append((None, f"{error.kind}: {error.message}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["book", "path", "media_type", "html", "error"])

    return source.mapInArrow(run, f"book {source.schema['book'].dataType.simpleString()}, path {source.schema['path'].dataType.simpleString()}, media_type string, html string, error string")
