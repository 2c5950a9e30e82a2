"""Glyph databases and matching: a scored join of blobs with trained glyphs, and recognition of whole images.

A glyph is a set of foreground and background strokes on its own box. A blob's errors are the stroke points, scaled to the blob's box,
that miss. Points of a glyph at a size are rasterised once and kept.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.operators.imaging import binarize, split_glyphs, to_array
from cuemill.session import bounded_batches

#: Sizes whose points a matcher keeps, and blobs whose glyph it remembers: captions repeat few shapes.
SIZES_KEPT, BLOBS_KEPT = 256, 20_000
SENSITIVE = frozenset("Oo0'-:\"")
# Fixed values, a row for each pass: least allowance, thorough only, aspect, size, margin (differences below), least strokes,
# sensitive glyphs (None: either), errors allowed (None: the caller's).
PASSES = [
    (0, False, 15, 5, 5, 0, None, 0),
    (1, False, None, 4, 8, 0, None, 1),
    (1, False, None, 8, 8, 0, None, 1),
    (2, False, 20, None, 15, 0, None, 3),
    (10, False, 20, None, 15, 41, False, 20),
    (10, False, 30, None, 15, 41, True, 10),
    (0, True, 60, None, 17, 51, None, None),
]


# Letters of one shape in both cases, letters of x-height, letters up to the cap line; errors a line's slant may cost.
TWINS, SMALL, TALL, SLANT_MARGIN = "cosuvwxz", "aemnr", "bdfhkltABDEFGHIJKLMNPQRTY", 3


@dataclass
class Glyph:
    text: str
    width: int
    height: int
    margin: int
    fg: np.ndarray
    bg: np.ndarray
    italic: bool = False
    expand: int = 0
    points: dict = field(default_factory=dict, repr=False)

    @property
    def strokes(self) -> int:
        return len(self.fg) + len(self.bg)

    @cached_property
    def slanted(self) -> bool:
        """Whether its slant counts: marks have none of their own."""
        return any(c.isalnum() for c in self.text)

    def at(self, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat indices of foreground and background points on a box of this size; points outside it are left out."""
        if (width, height) not in self.points:
            self.points[width, height] = tuple(stroke_points(s, self.width, self.height, width, height) for s in (self.fg, self.bg))
        return self.points[width, height]


def away(v: np.ndarray) -> np.ndarray:
    """Rounded half away from zero."""
    return np.where(v >= 0, np.floor(v + 0.5), np.ceil(v - 0.5)).astype(int)


def stroke_points(strokes: np.ndarray, gw: int, gh: int, w: int, h: int) -> np.ndarray:
    out = []
    for s in strokes.reshape(-1, 4):
        x1, y1, x2, y2 = away(s * np.array([w, h, w, h]) / np.array([gw, gh, gw, gh]))
        if abs(x2 - x1) > abs(y2 - y1):
            (x1, y1), (x2, y2) = sorted([(x1, y1), (x2, y2)])
            x = np.arange(x1, x2 + 1)
            y = away(y1 + (y2 - y1) / (x2 - x1) * (x - x1))
        else:
            (y1, x1), (y2, x2) = sorted([(y1, x1), (y2, x2)])
            y = np.arange(y1, y2 + 1)
            # a stroke that shrinks to a point has no slope; its one point counts at x 0
            x = away(x1 + (x2 - x1) / (y2 - y1) * (y - y1)) if y2 > y1 else np.zeros(1, int)
        ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        out.append(y[ok] * w + x[ok])
    return np.concatenate(out) if out else np.zeros(0, int)


def read_database(data: bytes) -> list[Glyph]:
    """Glyphs of a database file, gzip or plain, with or without the V2 mark, up to the first record that is broken."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    second = data[:2] == b"V2"
    at, out = 2 * second, []

    def strokes(size: str) -> np.ndarray:
        nonlocal at
        (n,) = struct.unpack_from(">" + size, data, at)
        at += struct.calcsize(">" + size)
        values = struct.unpack_from(f">{4 * n}{size}", data, at)
        at += struct.calcsize(f">{4 * n}{size}")
        return np.array(values, int).reshape(-1, 4)

    while at < len(data):
        try:
            if second:
                flag = data[at]
                size, italic = ("B", "H")[not flag & 0x10], bool(flag & 0x20)
                expand, at = (flag & 15, at + 1) if flag & 0x10 else (data[at + 1], at + 2)
                w, h, margin = struct.unpack_from(f">3{size}", data, at)
                at += struct.calcsize(f">3{size}")
            else:
                w, h, margin, italic, expand = struct.unpack_from(">HHH?B", data, at)
                size, at = "H", at + 8
            n = data[at]
            text = data[at + 1 : at + 1 + n].decode("utf-8", "replace")
            at += 1 + n
            fg, bg = strokes(size), strokes(size)
        except (struct.error, IndexError):
            break
        if not (0 < w <= 1920 and 0 < h <= 1080) or "\0" in text:
            break
        out.append(Glyph(text, w, h, margin, fg, bg, bool(italic), expand))
    return out


def write_database(glyphs: list[Glyph]) -> bytes:
    """A gzip V2 file; a glyph whose values all fit a byte takes the short form."""
    out = [b"V2"]
    for g in glyphs:
        text = g.text.encode()
        values = [g.width, g.height, g.margin, len(g.fg), len(g.bg), *g.fg.ravel().tolist(), *g.bg.ravel().tolist()]
        short = max(values) < 256 and g.expand < 16
        size = "B" if short else "H"
        head = bytes([0x10 | g.expand | 0x20 * g.italic]) if short else bytes([0x20 * g.italic, g.expand])
        out.append(head + struct.pack(f">3{size}", g.width, g.height, g.margin) + bytes([len(text)]) + text)
        for s in (g.fg, g.bg):
            out.append(struct.pack(f">{size}{s.size}{size}", len(s), *s.ravel().tolist()))
    return gzip.compress(b"".join(out), mtime=0)


class Matcher:
    def __init__(self, glyphs: list[Glyph]):
        self.single = [g for g in glyphs if g.expand == 0]
        self.multi = sorted((g for g in glyphs if g.expand > 1), key=lambda g: -g.expand)
        self.shape = tuple(np.array(v) for v in zip(*[(g.width, g.height, g.margin, g.strokes, g.text in SENSITIVE) for g in self.single])) if self.single else ()
        self.stacked: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.known: dict[tuple, int | None] = {}

    @staticmethod
    def errors(bits: np.ndarray, g: Glyph) -> int | None:
        if not g.strokes:
            return None
        fg, bg = g.at(bits.shape[1], bits.shape[0])
        flat = bits.ravel()
        return int((~flat[fg]).sum() + flat[bg].sum())

    def _points(self, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Glyph, flat place and whether it has to be ink, of all stroke points of all single glyphs at a size; the last sizes are kept."""
        if (height, width) not in self.stacked:
            if len(self.stacked) >= SIZES_KEPT:
                self.stacked.pop(next(iter(self.stacked)))
            sets = [(k, p, ink) for k, g in enumerate(self.single) for p, ink in zip((stroke_points(x, g.width, g.height, width, height) for x in (g.fg, g.bg)), (True, False))]
            sizes = [len(p) for _, p, _ in sets]
            self.stacked[height, width] = (
                np.repeat([k for k, _, _ in sets], sizes).astype(np.int32),
                np.concatenate([p for _, p, _ in sets]).astype(np.int32) if sets else np.zeros(0, np.int32),
                np.repeat([ink for _, _, ink in sets], sizes).astype(bool),
            )
        return self.stacked[height, width]

    def all_errors(self, bits: np.ndarray) -> np.ndarray:
        """Errors of every single glyph, in load order."""
        owner, place, ink = self._points(*bits.shape)
        return np.bincount(owner[bits.ravel()[place] != ink], minlength=len(self.single))

    def match(self, bits: np.ndarray, top: int, thorough: bool = True, allowed: int = 25) -> Glyph | None:
        """An exact glyph, else of the first pass that has any the one of fewest errors, then best fit, then load order."""
        if not self.single:
            return None
        key = (bits.tobytes(), bits.shape, top, thorough, allowed)
        if key not in self.known:
            if len(self.known) >= BLOBS_KEPT:
                self.known.clear()
            self.known[key] = self._matched(bits, top, thorough, allowed)
        place = self.known[key]
        return None if place is None else self.single[place]

    def _matched(self, bits: np.ndarray, top: int, thorough: bool, allowed: int) -> int | None:
        h, w = bits.shape
        width, height, margin, strokes, sensitive = self.shape
        errors, off = self.all_errors(bits), abs(margin - top)
        exact = np.flatnonzero((width == w) & (height == h) & (off < 5) & (errors == 0) & (strokes > 0))
        if len(exact):
            return int(exact[0])
        aspect, size = abs(h * 100.0 / w - height * 100.0 / width), np.maximum(abs(width - w), abs(height - h))
        fit = off + abs(height - h) + abs(width - w)
        for least, deep, d_aspect, d_size, d_margin, at_least, kind, budget in PASSES:
            if deep and not thorough or allowed < least:
                continue
            budget = allowed if budget is None else min(budget, allowed) if budget in (3, 20) else budget
            good = (strokes > 0) & (strokes >= at_least) & (off < d_margin) & (errors <= budget)
            if d_aspect is not None:
                good &= aspect < d_aspect
            if d_size is not None:
                good &= size < d_size
            if kind is not None:
                good &= sensitive == kind
            found = np.flatnonzero(good)
            if len(found):
                return int(found[np.lexsort((fit[found], errors[found]))[0]])
        return None

    def match_run(self, bits: np.ndarray, n: int, allowed: int) -> Glyph | None:
        """A glyph of n blobs: aspect within 15 and no error, else within 20 and up to 3; fewest errors, then aspect."""
        aspect = bits.shape[0] * 100.0 / bits.shape[1]
        for within, budget in ((15, 0), (20, min(3, allowed))):
            found = [(e, abs(aspect - g.height * 100.0 / g.width), k) for k, g in enumerate(self.multi) if g.expand == n and abs(aspect - g.height * 100.0 / g.width) < within and (e := self.errors(bits, g)) is not None and e <= budget]
            if found:
                return self.multi[min(found)[2]]
        return None

    def halves(self, blob: dict, allowed: int) -> tuple[Glyph, Glyph] | None:
        """A wide blob cut at its thinnest inner columns until both halves match."""
        bits = blob["bits"]
        w = bits.shape[1]
        if w < 6 or w < blob["line_height"] // 2:
            return None
        ink = bits.sum(0)
        for x in sorted(range(2, w - 2), key=lambda c: (ink[c], c)):
            found = []
            for part in (bits[:, :x], bits[:, x:]):
                rows = np.flatnonzero(part.any(1))
                columns = np.flatnonzero(part.any(0))
                if not len(rows):
                    break
                part = part[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
                g = self.match(part, blob["top_margin"] + int(rows[0]), False, allowed)
                if g is None:
                    break
                found.append(g)
            if len(found) == 2:
                return found[0], found[1]
        return None

    def recognize(self, mask: np.ndarray, allowed: int = 25, thorough: bool = True, unknown: str = "□", space_floor: int = 6, space_factor: float = 0.25) -> dict:
        """text with <i> tags, glyphs (blobs) and unknown of a mask: widest runs of blobs first, then single glyphs, then halves."""
        blobs = split_glyphs(mask)
        lengths = sorted({g.expand for g in self.multi}, reverse=True)
        read: list[tuple[dict, Glyph | None]] = []
        at = missed = 0
        while at < len(blobs):
            b = blobs[at]
            step, found = 1, []
            for n in lengths:
                run = blobs[at : at + n]
                if len(run) == n and not any(r["new_line"] for r in run[1:]):
                    left, right = run[0]["x"], run[-1]["x"] + run[-1]["bits"].shape[1]
                    top = min(r["top_margin"] for r in run)
                    bottom = max(r["top_margin"] + r["bits"].shape[0] for r in run)
                    whole = np.zeros((bottom - top, right - left), bool)
                    for r in run:
                        y, x = r["top_margin"] - top, r["x"] - left
                        whole[y : y + r["bits"].shape[0], x : x + r["bits"].shape[1]] |= r["bits"]
                    if g := self.match_run(whole, n, allowed):
                        step, found = n, [g]
                        break
            if not found:
                g = self.match(b["bits"], b["top_margin"], thorough, allowed)
                found = [g] if g else list(self.halves(b, allowed) or ())
            missed += not found
            # the first blob stands for a run; both halves of a cut keep the whole blob, the second without a gap
            read += [(b if k == 0 else {**b, "gap": 0, "new_line": False}, g) for k, g in enumerate(found or [None])]
            at += step
        text = self.lined(read, unknown, lambda h: max(space_floor, round(space_factor * h)), allowed)
        return {"text": text, "glyphs": len(blobs), "unknown": missed}

    def variant_errors(self, blob: dict, text: str, italic: bool, allowed: int) -> float:
        """Fewest errors, within the allowance, of the glyphs of one text and slant; infinite without one."""
        found = [e for g in self.single if g.text == text and g.italic == italic and (e := self.errors(blob["bits"], g)) is not None and e <= allowed]
        return min(found, default=float("inf"))

    def lined(self, read: list[tuple[dict, Glyph | None]], unknown: str, space, allowed: int) -> str:
        """Text of matched blobs: lines, spaces, the case of letters whose cases share a shape, and italic runs.

        A line keeps its slant unless the other one is better by more than SLANT_MARGIN errors; marks and unread glyphs inherit it.
        """
        heights = lambda letters: sorted(b["bits"].shape[0] for b, g in read if g and len(g.text) == 1 and g.text in letters)
        middle = lambda v: v[len(v) // 2] if v else 0
        small, tall = middle(heights(SMALL)), middle(heights(TALL))
        out, shown, line = "", False, False
        for blob, g in read:
            if blob["new_line"] and out:
                out += "</i>" * shown + "\n"
                shown = line = False
            elif blob["gap"] >= space(blob["line_height"]):
                out += " "
            if g is None:
                out += unknown
                continue
            if g.slanted:
                slant = g.italic
                if slant != line:
                    own, other = (self.variant_errors(blob, g.text, s, allowed) for s in (slant, line))
                    slant = line = line if other < float("inf") and other <= own + SLANT_MARGIN else slant
                if slant != shown:
                    out += "<i>" if slant else "</i>"
                    shown = slant
            text = g.text
            if 0 < small < tall and len(text) == 1 and text.lower() in TWINS:
                h = blob["bits"].shape[0]
                text = text.upper() if abs(h - tall) < abs(h - small) else text.lower()
            out += text
        return out + "</i>" * shown


def exact_size(blobs: DataFrame, glyphs: DataFrame, keys: list[str], size: list[str], within: int = 5) -> DataFrame:
    """keys, glyph: the first glyph (glyph, size..., top) of exactly the blob's size whose top margin differs by less than `within`. An equi-join."""
    near = glyphs.select("glyph", *size, F.col("top").alias("__top"))
    return blobs.join(near, size).filter(F.abs(F.col("__top") - F.col("top")) < within).groupBy(*keys).agg(F.min("glyph").alias("glyph"))


def fewest_errors(blobs: DataFrame, templates: DataFrame, keys: list[str], errors: Callable[[Column], Column], fit: Callable[[Column], Column], allowed: int) -> DataFrame:
    """keys, glyph, errors, fit of the best of the templates (glyph) of one bounded database: fewest errors, then best fit, then load order.

    errors and fit score a row of blobs with a glyph. All templates are scored within the row, so no pair is ever sorted; what is sorted
    is the best of each row, dealt by keys, for rows that share them.
    """
    known = F.broadcast(templates.agg(F.collect_list("glyph").alias("__glyphs")))
    scored = F.transform("__glyphs", lambda g: F.struct(errors(g).alias("errors"), fit(g).alias("fit"), g.alias("glyph")))
    met = blobs.crossJoin(known).select(*keys, F.array_min(F.filter(scored, lambda m: m["errors"] <= allowed)).alias("__m")).filter("__m is not null")
    best = met.repartition(*keys).groupBy(*keys).agg(F.min("__m").alias("__m"))
    return best.select(*keys, "__m.glyph", "__m.errors", "__m.fit")


def recognize(images: DataFrame, keys: list[str], database: bytes, bitmap: str = "bitmap", inverted: str | None = None, allowed: int = 25, image: Callable[[Any], np.ndarray] = to_array) -> DataFrame:
    """keys, text, glyphs, unknown and the fill colour of each image, no text of a missing one. Narrow; the database is one bounded broadcast (about 700 glyphs).

    image makes an RGBA array of a value of the column `bitmap`. Batches are small and one image is held at a time, so memory goes by the
    largest image, whatever the number of rows.
    """
    bounded_batches(images.sparkSession)
    kinds = dict(images.dtypes)
    shared = images.sparkSession.sparkContext.broadcast(database)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", text string, glyphs int, unknown int, r int, g int, b int"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(read_database(shared.value))
        for frame in frames:
            rows = []
            for i in range(len(frame)):
                value = frame[bitmap].iloc[i]
                if value is None:
                    rows.append({"text": None, "glyphs": 0, "unknown": 0, "r": None, "g": None, "b": None})
                    continue
                mask, color = binarize(image(value), bool(frame[inverted].iloc[i]) if inverted else False)
                rows.append({**matcher.recognize(mask, allowed), **dict(zip("rgb", color or (None, None, None)))})
            found = pd.DataFrame(rows, columns=["text", "glyphs", "unknown", "r", "g", "b"]).astype({c: "Int32" for c in "rgb"})
            yield pd.concat([frame[keys].reset_index(drop=True), found], axis=1)

    return images.select(*keys, bitmap, *([inverted] if inverted else [])).mapInPandas(run, schema)
