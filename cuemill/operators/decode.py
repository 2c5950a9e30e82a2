"""Bitmap caption packets: PGS display sets and VobSub sub-pictures, as functions on bytes and as Arrow operators on binary columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cuemill.operators.imaging import in_pieces

BITMAP = "struct<width:int,height:int,rgba:binary>"


def ycbcr_to_rgb(y: int, cr: int, cb: int) -> tuple[int, int, int]:
    """BT.709 limited range in integers of 1/256."""
    luma = 298 * (y - 16) + 128
    red, green, blue = luma + 459 * (cr - 128), luma - 55 * (cb - 128) - 136 * (cr - 128), luma + 541 * (cb - 128)
    return tuple(min(255, max(0, v >> 8)) for v in (red, green, blue))


def _u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def segments(packet: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, payload) up to the first truncated one."""
    at = 0
    while at + 3 <= len(packet):
        size = _u16(packet, at + 1)
        if at + 3 + size > len(packet):
            return
        yield packet[at], packet[at + 3 : at + 3 + size]
        at += 3 + size


def pgs_runs(rle: bytes, width: int, height: int) -> np.ndarray:
    """Colour indices; runs never leave their line."""
    out = np.zeros((height, width), np.uint8)
    x = y = at = 0
    while at < len(rle) and y < height:
        color, run = rle[at], 1
        at += 1
        if color == 0:
            if at >= len(rle):
                break
            code = rle[at]
            at += 1
            if code == 0:
                x, y = 0, y + 1
                continue
            wide, coloured = code & 0x40, code & 0x80
            if at + bool(wide) + bool(coloured) > len(rle):
                break
            run = code & 0x3F
            if wide:
                run = run << 8 | rle[at]
                at += 1
            if coloured:
                color = rle[at]
                at += 1
        out[y, x : x + run] = color
        x = min(width, x + run)
    return out


def pgs_display_set(packet: bytes) -> dict:
    """kind: show, clear or ignore; of a show also the bitmap, forced and the centres."""
    palette = np.zeros((256, 4), np.uint8)
    objects: dict[int, dict] = {}
    placed: list[dict] | None = None
    update_only, screen = False, (0, 0)
    for kind, body in segments(packet):
        if kind == 0x16:
            placed, update_only, screen = [], False, (0, 0)
            if len(body) < 11:
                continue
            screen, update_only, at = (_u16(body, 0), _u16(body, 2)), body[8] != 0, 11
            for _ in range(body[10]):
                if at + 8 > len(body):
                    break
                one = {"id": _u16(body, at), "forced": bool(body[at + 3] & 0x40), "x": _u16(body, at + 4), "y": _u16(body, at + 6), "crop": None}
                cropped = body[at + 3] & 0x80
                at += 8
                if cropped:
                    if at + 8 > len(body):
                        break
                    one["crop"] = tuple(_u16(body, at + k) for k in (0, 2, 4, 6))
                    at += 8
                placed.append(one)
        elif kind == 0x14:
            for at in range(2, len(body) - 4, 5):
                palette[body[at]] = (*ycbcr_to_rgb(body[at + 1], body[at + 2], body[at + 3]), body[at + 4])
        elif kind == 0x15 and len(body) >= 4:
            key, flag = _u16(body, 0), body[3]
            if flag & 0x80:
                if len(body) >= 11:
                    objects[key] = {"w": _u16(body, 7), "h": _u16(body, 9), "rle": body[11:], "whole": bool(flag & 0x40)}
            elif key in objects:
                objects[key] |= {"rle": objects[key]["rle"] + body[4:], "whole": bool(flag & 0x40)}
    if not placed:
        return {"kind": "clear"}
    seen = [c for c in placed if objects.get(c["id"], {}).get("whole")]
    if not seen or update_only:
        return {"kind": "ignore"}
    size = lambda c: c["crop"][2:] if c["crop"] else (objects[c["id"]]["w"], objects[c["id"]]["h"])
    boxes = [(c["x"], c["y"], c["x"] + size(c)[0], c["y"] + size(c)[1]) for c in seen if min(size(c)) > 0]
    if not boxes:
        return {"kind": "ignore"}
    left, top, right, bottom = (f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max)))
    canvas = np.zeros((bottom - top, right - left, 4), np.uint8)
    for c in seen:
        o = objects[c["id"]]
        pixels = palette[pgs_runs(o["rle"], o["w"], o["h"])]
        if c["crop"]:
            cx, cy, cw, ch = c["crop"]
            pixels = pixels[cy : cy + ch, cx : cx + cw]
        x, y = c["x"] - left, c["y"] - top
        spot = canvas[y : y + pixels.shape[0], x : x + pixels.shape[1]]
        pixels = pixels[: spot.shape[0], : spot.shape[1]]
        shown = pixels[..., 3] > 0
        spot[shown] = pixels[shown]
    v = (top + bottom) / 2 / screen[1] if screen[1] else 0.9
    h = (left + right) / 2 / screen[0] if screen[0] else 0.5
    return {"kind": "show", "bitmap": canvas, "forced": any(c["forced"] for c in seen), "v": v, "h": h}


def _field(data: bytes, at: int, bitmap: np.ndarray, first: int, colors: np.ndarray) -> None:
    """Every other line from `first`: codes of one to four nibbles, value << 2 | colour; a run of 0 fills the line."""
    height, width = bitmap.shape[:2]
    nibble, x, y = 2 * at, 0, first
    take = lambda k: data[k >> 1] >> 4 if k % 2 == 0 else data[k >> 1] & 15
    while y < height and (nibble >> 1) + 2 < len(data):
        code, size = take(nibble), 1
        while size < 4 and code < (0, 4, 16, 64)[size]:
            code, size = code << 4 | take(nibble + size), size + 1
        nibble += size
        run = code >> 2 or width - x
        end = min(width, x + run)
        if code & 3:
            bitmap[y, x:end] = colors[code & 3]
        x = end
        if x >= width:
            nibble += nibble % 2
            x, y = 0, y + 2


def sub_picture(spu: bytes, palette: list[int]) -> dict | None:
    """bitmap, forced and duration in ticks of 100 ns (or None) of a VobSub packet; None if it is not valid."""
    if len(spu) < 6 or _u16(spu, 2) >= len(spu):
        return None
    colors = np.zeros((4, 4), np.uint8)
    forced, duration, area, fields = False, None, None, (0, 0)
    at, before = _u16(spu, 2), -1
    for _ in range(64):
        if at <= before or at + 4 > len(spu):
            break
        delay, following, i = _u16(spu, at), _u16(spu, at + 2), at + 4
        for _ in range(1000):
            if i >= len(spu) or spu[i] == 0xFF:
                break
            command, left = spu[i], len(spu) - i
            if command == 0x00:
                forced = True
            elif command == 0x02:
                duration = int((delay << 10) / 90.0 * 10_000)
            if command in (0x03, 0x04) and left > 2:
                for k, value in enumerate((spu[i + 2] & 15, spu[i + 2] >> 4, spu[i + 1] & 15, spu[i + 1] >> 4)):
                    if command == 0x04:
                        colors[k, 3] = value * 17
                    elif value < len(palette):
                        colors[k, :3] = palette[value] >> 16 & 255, palette[value] >> 8 & 255, palette[value] & 255
                i += 3
            elif command == 0x05 and left > 6:
                if area is None:
                    bits = int.from_bytes(spu[i + 1 : i + 7], "big")
                    area = tuple(bits >> s & 0xFFF for s in (36, 24, 12, 0))
                i += 7
            elif command == 0x06 and left > 4:
                fields = _u16(spu, i + 1), _u16(spu, i + 3)
                i += 5
            elif command == 0x07 and left > 2:
                i += max(2, spu[i + 2])
            else:
                i += 1
        before, at = at, following
    if area is None or not fields[0]:
        return None
    x0, x1, y0, y1 = area
    width, height = x1 - x0 + 1, y1 - y0 + 1
    if not (0 < width <= 2048 and 0 < height <= 2048):
        return None
    bitmap = np.zeros((height, width, 4), np.uint8)
    for first, start in enumerate(fields):
        _field(spu, start, bitmap, first, colors)
    return {"bitmap": bitmap, "forced": forced, "duration": duration}


def _struct(bitmap: np.ndarray | None) -> dict | None:
    return None if bitmap is None else {"width": bitmap.shape[1], "height": bitmap.shape[0], "rgba": bitmap.tobytes()}


def decode_pgs(packets: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """keys, kind, forced, v, h, bitmap of PGS packets. Narrow."""
    kinds = dict(packets.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", kind string, forced boolean, v double, h double, bitmap {BITMAP}"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = (pgs_display_set(bytes(x) if x is not None else b"") for x in frame[data])
            for part, found in in_pieces(frame, ({**f, "bitmap": _struct(f.get("bitmap"))} for f in sets)):
                out = part[keys].copy()
                out["kind"] = [f["kind"] for f in found]
                out["forced"] = [f.get("forced", False) for f in found]
                out["v"], out["h"] = [f.get("v") for f in found], [f.get("h") for f in found]
                out["bitmap"] = [f["bitmap"] for f in found]
                yield out

    return packets.select(*keys, data).mapInPandas(run, schema)


def decode_vobsub(packets: DataFrame, keys: list[str], data: str = "data", palette: str = "palette") -> DataFrame:
    """keys, decodable, forced, own (whole milliseconds, as all times of cues), bitmap of VobSub packets with their 16-colour palette. Narrow."""
    kinds = dict(packets.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", decodable boolean, forced boolean, own long, bitmap {BITMAP}"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pictures = (sub_picture(bytes(x), list(p)) if x is not None else None for x, p in zip(frame[data], frame[palette]))
            for part, found in in_pieces(frame, ({**f, "bitmap": _struct(f["bitmap"])} if f else {} for f in pictures)):
                out = part[keys].copy()
                out["decodable"] = [bool(f) for f in found]
                out["forced"] = [bool(f and f["forced"]) for f in found]
                out["own"] = pd.array([f["duration"] // 10_000 if f and f["duration"] is not None else None for f in found], dtype="Int64")
                out["bitmap"] = [f.get("bitmap") for f in found]
                yield out

    return packets.select(*keys, data, palette).mapInPandas(run, schema)
