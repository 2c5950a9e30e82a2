"""Masks, polarity and glyph blobs of caption bitmaps, on numpy arrays of height x width x RGBA."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cuemill.session import bounded_batches

# Fixed values.
ALPHA, LUMA, INK, POLARITY_PIXELS, POLARITY_MARGIN, POLARITY_IMAGES = 100, 128, 150, 20, 40, 25
#: Bytes of bitmaps that a Python pass hands on at once, beside those of the last image.
IMAGE_BYTES = 4 << 20


def _weighted(rgba: np.ndarray) -> np.ndarray:
    """A thousand times the luma, before it is cut to whole numbers."""
    out = np.zeros(rgba.shape[:-1], np.int32)
    for channel, weight in enumerate((299, 587, 114)):
        out += np.multiply(rgba[..., channel], weight, dtype=np.int32)
    return out


def luma(rgba: np.ndarray) -> np.ndarray:
    return _weighted(rgba) // 1000


def in_pieces(frame: pd.DataFrame, made: Iterable[dict], limit: int = IMAGE_BYTES) -> Iterator[tuple[pd.DataFrame, list[dict]]]:
    """Stretches of a frame with what is made of their rows, one by one; they end once their bitmaps hold `limit` bytes."""
    at, size, found = 0, 0, []
    for k, one in enumerate(made, 1):
        found.append(one)
        size += len(one["bitmap"]["rgba"]) if one.get("bitmap") else 0
        if size >= limit or k == len(frame):
            yield frame.iloc[at:k], found
            at, size, found = k, 0, []


def binarize(rgba: np.ndarray, inverted: bool = False) -> tuple[np.ndarray, tuple[int, int, int] | None]:
    """The mask of foreground pixels and their dominant colour: the fullest bucket of 5 bits a channel, if it has 1.5 times the next."""
    light = _weighted(rgba)
    mask = (rgba[..., 3] >= ALPHA) & ((light < 1000 * LUMA) if inverted else (light >= 1000 * LUMA))
    colors = [rgba[..., channel][mask] for channel in range(3)]
    if not len(colors[0]):
        return mask, None
    r, g, b = (c.astype(np.uint16) >> 3 for c in colors)
    bucket = r << 10 | g << 5 | b
    count = np.bincount(bucket)
    first = int(count.argmax())  # the least of equal ones
    most, count[first] = int(count[first]), 0
    if most < 1.5 * int(count.max()):
        return mask, None
    return mask, tuple(int(c[bucket == first].sum()) // most for c in colors)


def dark_on_light(rgba: np.ndarray) -> bool | None:
    """Whether opaque edges are lighter than opaque interiors; None if either is scarce or they are close. The outer pixels don't count."""
    solid = rgba[..., 3] >= ALPHA
    if min(solid.shape) < 3:
        return None
    around = solid[:-2, 1:-1] & solid[2:, 1:-1] & solid[1:-1, :-2] & solid[1:-1, 2:]
    core, light = solid[1:-1, 1:-1], luma(rgba)[1:-1, 1:-1]
    inside, edge = light[core & around], light[core & ~around]
    if min(len(inside), len(edge)) < POLARITY_PIXELS:
        return None
    gap = int(edge.sum()) // len(edge) - int(inside.sum()) // len(inside)
    return None if abs(gap) < POLARITY_MARGIN else gap > 0


def bands(filled: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of true values of at least `least`, both ends included."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], filled.astype(np.int8), [0]))))
    edge = edge.tolist()
    return [(a, b - 1) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def split_glyphs(mask: np.ndarray) -> list[dict]:
    """Blobs in reading order: bits, x, top margin, gap to the blob before (-1 for a line's first), line height, whether a line starts."""
    out = []
    for top, bottom in bands(mask.any(1), 2):
        strip, before = mask[top : bottom + 1], None
        found = bands(strip.any(0), 1)
        rows = np.logical_or.reduceat(strip, [left for left, _ in found], axis=1)  # of each blob; between it and the next there is no ink
        over, under = rows.argmax(0).tolist(), rows[::-1].argmax(0).tolist()
        for (left, right), first, last in zip(found, over, under):
            bits = strip[first : len(strip) - last, left : right + 1]
            out.append({"bits": bits, "x": left, "top_margin": first, "gap": -1 if before is None else left - before - 1, "line_height": len(strip), "new_line": before is None})
            before = right
    return out


def to_array(bitmap: dict) -> np.ndarray:
    return np.frombuffer(bitmap["rgba"], np.uint8).reshape(bitmap["height"], bitmap["width"], 4)


def polarities(images: DataFrame, track: str, order: str, bitmap: str = "bitmap") -> DataFrame:
    """track, inverted: most of a track's first 25 images that tell are dark on light; ties and silence mean normal."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    bounded_batches(images.sparkSession)
    first = images.withColumn("__n", F.row_number().over(Window.partitionBy(track).orderBy(order))).filter(f"__n <= {POLARITY_IMAGES}").select(track, bitmap)
    kind = dict(images.dtypes)[track]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            votes = [dark_on_light(to_array(b)) for b in frame[bitmap]]
            yield pd.DataFrame({track: frame[track], "vote": [0 if v is None else 1 if v else -1 for v in votes]})

    votes = first.mapInPandas(run, f"{track} {kind}, vote int")
    return votes.groupBy(track).agg((F.sum("vote") > 0).alias("inverted"))
