"""Thumbnails: geometry, pixels, numbering and coordinate maps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the longer edge of a thumbnail.
EDGE = 128


def anchors(height: Column, width: Column, edge: int = EDGE) -> Column:
    """Where a frame lies in its square thumbnail: scale, size, and corners (lower right exclusive)."""
    scale = F.lit(float(edge)) / F.greatest(height, width)
    h, w = (height * scale).cast("int"), (width * scale).cast("int")
    top, left = F.floor((edge - h) / 2).cast("int"), F.floor((edge - w) / 2).cast("int")
    return F.struct(scale.alias("scale_factor"), h.alias("new_height"), w.alias("new_width"), top.alias("top"), left.alias("left"), (top + h).alias("bottom"), (left + w).alias("right"))


def numbered(frames: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """``thumbnail_index`` of each frame in its series."""
    return frames.withColumn("thumbnail_index", F.row_number().over(Window.partitionBy(*series).orderBy(*order)) - 1)


def normalised(pixels: Column) -> Column:
    """Pixel values stretched to 0..255; a constant frame becomes zeros."""
    # the bounds are found once a frame: as fields of a struct in an array of one, not in the function of each pixel
    bounded = F.transform(F.array(F.struct(F.array_min(pixels).alias("low"), F.array_max(pixels).alias("high"))), lambda b: F.transform(pixels, lambda p: F.when(b["high"] > b["low"], F.round((p - b["low"]) / (b["high"] - b["low"]) * 255, 0)).otherwise(F.lit(0.0)).cast("int")))
    return F.element_at(bounded, 1)


def halved(pixels: Column, edge: int) -> Column:
    """A square frame at half its edge, by means of two by two pixels."""
    half = edge // 2
    return F.transform(
        F.sequence(F.lit(0), F.lit(half * half - 1)),
        lambda k: sum((F.element_at(pixels, (F.floor(k / half).cast("int") * 2 + dy) * edge + (k % half) * 2 + dx + 1) for dy in (0, 1) for dx in (0, 1)), F.lit(0.0)) / 4,
    )


def stale(series: DataFrame, thumbnails: DataFrame, key: str, instance: str) -> DataFrame:
    """Whether a series' thumbnail covers other instances than the series has, or is missing."""
    now = series.groupBy(key).agg(F.array_sort(F.collect_set(instance)).alias("_now"))
    then = thumbnails.groupBy(key).agg(F.array_sort(F.collect_set(instance)).alias("_then"))
    return now.join(then, key, "left").select(key, (~F.col("_now").eqNullSafe(F.col("_then"))).alias("stale"))


def letterbox(frame: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """A frame (H, W[, C]) resized by area means and centred on black."""
    h, w = frame.shape[:2]
    scale = edge / max(h, w)
    nh, nw = int(h * scale), int(w * scale)

    def weights(n: int, m: int) -> np.ndarray:
        at = np.arange(m + 1) * n / m
        low, high = at[:-1, None], at[1:, None]
        cells = np.arange(n)[None]
        return np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None) * m / n

    resized = np.tensordot(weights(w, nw), np.tensordot(weights(h, nh), frame.astype(float), (1, 0)), (1, 1)).swapaxes(0, 1)
    out = np.zeros((edge, edge, *frame.shape[2:]))
    top, left = (edge - nh) // 2, (edge - nw) // 2
    out[top : top + nh, left : left + nw] = resized
    return out


class NoPixelData(ValueError):
    """A series without any pixel data has no thumbnail."""


def generate(frames: DataFrame, series: list[str], order: list[str], edge: int = EDGE) -> DataFrame:
    """Thumbnails of ``frames`` (series and order columns, height, width, channels 1 or 3 or 4, pixels row by row).

    Adds to the series and order columns: thumbnail_index (place in the series), anchors, channels and
    ``pixels``, an ``edge`` x ``edge`` image as bytes: the frame stretched to 0..255, resized and centred on
    black. If any frame of a series has colours all have three channels. A frame without pixels has null
    pixels and no index.
    """
    colour = F.max(F.coalesce(F.col("channels"), F.lit(1)) > 1).over(Window.partitionBy(*series))
    known = numbered(frames.withColumn("_colour", colour).filter("pixels IS NOT NULL"), series, order).withColumn("anchors", anchors(F.col("height"), F.col("width"), edge))
    named = known.select(*series, *order, "thumbnail_index", "anchors", F.when(F.col("_colour"), 3).otherwise(1).alias("channels"), F.col("channels").alias("_channels"), "height", "width", F.col("pixels").cast("array<double>").alias("pixels"))
    schema = named.drop("_channels", "height", "width").withColumn("pixels", F.lit(None).cast("binary")).schema

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole.iloc[k : k + 16] for whole in parts for k in range(0, len(whole), 16)):
            images = []
            for row in part.itertuples(index=False):
                held = dict(zip(part.columns, row, strict=True))
                own = np.asarray(held["pixels"], float).reshape(held["height"], held["width"], -1)[..., :3]
                span = own.max() - own.min()
                own = np.round((own - own.min()) / span * 255) if span > 0 else np.zeros_like(own)
                own = np.repeat(own[..., :1], 3, 2) if held["channels"] == 3 and own.shape[2] < 3 else own[..., : held["channels"]]
                images.append(np.clip(np.round(letterbox(own, edge)), 0, 255).astype(np.uint8).tobytes())
            yield part.drop(columns=["_channels", "height", "width"]).assign(pixels=images)[schema.names]

    drawn = named.mapInPandas(draw, schema)
    blank = frames.filter("pixels IS NULL").select(*series, *order, *(F.lit(None).cast(schema[c].dataType).alias(c) for c in ("thumbnail_index", "anchors", "channels", "pixels")))
    return drawn.unionByName(blank)


def require_pixels(frames: DataFrame, series: list[str]) -> DataFrame:
    """``frames``, or ``NoPixelData`` if all frames of a series lack pixels."""
    bare = frames.groupBy(*series).agg(F.count("pixels").alias("n")).filter("n = 0").limit(5).collect()
    if bare:
        raise NoPixelData(", ".join(str(tuple(r)[:-1]) for r in bare))
    return frames


def write_thumbnails(thumbnails: DataFrame, path: str) -> None:
    """Keep the thumbnails of ``generate``, by series for later look-up."""
    thumbnails.write.mode("overwrite").parquet(path)


def current(path: str, now: DataFrame, frames: DataFrame, series: str, instance: str) -> DataFrame:
    """Stored thumbnails of series whose instances have not changed, with new ones for the others.

    ``now`` (series, instance) are the instances there are; ``frames`` those to draw from, whose order is ``instance``, frame.
    """
    stored = now.sparkSession.read.parquet(path)
    old = stale(now, stored, series, instance).filter("stale").select(series)
    return stored.join(old, series, "left_anti").unionByName(generate(frames.join(old, series, "left_semi"), [series], [instance, "frame"]))


def harmonised(frames: list[np.ndarray]) -> np.ndarray:
    """Frames of one shape stacked; if any has colours, grey ones get three equal channels and alpha goes."""
    if not frames:
        raise ValueError("no frames")
    if any(f.ndim > 2 for f in frames):
        frames = [np.repeat(f[..., None], 3, 2) if f.ndim == 2 else f[..., :3] for f in frames]
    if len({f.shape for f in frames}) > 1:
        raise ValueError("frames differ in shape")
    return np.stack(frames)


def image(pixels: bytes, channels: int, edge: int = EDGE) -> np.ndarray:
    """A stored thumbnail as an array, (edge, edge) or (edge, edge, channels)."""
    return np.frombuffer(pixels, np.uint8).reshape((edge, edge) if channels == 1 else (edge, edge, channels))


def index_map(thumbnails: DataFrame, series: str, instance: str, frame: str) -> DataFrame:
    """For each series the (instance, frame) of each thumbnail index, as an array in order of the index."""
    listed = F.array_sort(F.collect_list(F.struct("thumbnail_index", instance, frame)))
    return thumbnails.filter("thumbnail_index IS NOT NULL").groupBy(series).agg(F.transform(listed, lambda x: F.struct(x[instance].alias("instance"), x[frame].alias("frame"))).alias("thumbnails"))


def at_index(maps: Column, index: Column) -> Column:
    """The (instance, frame) at a thumbnail index of an ``index_map``; an error if it is out of bounds."""
    outside = (index < 0) | (index >= F.size(maps))
    return F.when(outside, F.raise_error(F.concat(F.lit("no thumbnail at "), index.cast("string"))).cast("struct<instance:string,frame:int>")).otherwise(F.try_element_at(maps, (index + 1).cast("int")).cast("struct<instance:string,frame:int>"))


def of_instance(maps: Column, instance: Column) -> Column:
    """The thumbnail indexes of an instance's frames, in order; none if it has no thumbnail."""
    return F.filter(F.transform(maps, lambda x, i: F.when(x["instance"].eqNullSafe(instance), i)), lambda i: i.isNotNull())


@dataclass(frozen=True)
class CoordinateMap:
    """Maps (row, column) between an original frame and its thumbnail."""

    height: int
    width: int
    top: int
    left: int
    bottom: int
    right: int
    scale: float

    def to_thumbnail(self, row: float, column: float) -> tuple[float, float]:
        if not (0 <= row <= self.height and 0 <= column <= self.width):
            raise ValueError("outside the frame")
        return row * self.scale + self.top, column * self.scale + self.left

    def to_original(self, row: float, column: float) -> tuple[float, float]:
        if not (self.top <= row <= self.bottom and self.left <= column <= self.right):
            raise ValueError("outside the thumbnail's frame")
        return (row - self.top) / self.scale, (column - self.left) / self.scale
