"""Bitmap decoders, imaging and glyph matching beyond the plainest packet: FIXTURES.md section 2 and the rows of SURVEY 2.3 to 2.5."""

import numpy as np
import pytest

from cuemill.operators import decode, glyphs, imaging
from tests.test_bitmaps import letter, segment, spu

u16 = lambda *v: b"".join(x.to_bytes(2, "big") for x in v)
PALETTE = segment(0x14, bytes([0, 0, 1, 235, 128, 128, 255, 2, 16, 128, 128, 255, 3, 126, 128, 128, 255]))


def screen(*placed, state=0x80, update=0):
    body = u16(1920, 1080) + bytes([0x10, 0, 0, state, update, 0, len(placed)])
    for key, x, y, flags, *crop in placed:
        body += u16(key) + bytes([0, flags]) + u16(x, y) + (u16(*crop) if flags & 0x80 else b"")
    return segment(0x16, body)


def first_part(key, w, h, rle, last=True):
    return segment(0x15, u16(key) + bytes([0, 0x80 | 0x40 * last]) + (len(rle) + 4).to_bytes(3, "big") + u16(w, h) + rle)


def next_part(key, rle, last):
    return segment(0x15, u16(key) + bytes([0, 0x40 * last]) + rle)


def test_objects_in_fragments():
    rle = bytes([0, 0x84, 1, 0, 0]) * 3
    whole = decode.pgs_display_set(screen((7, 10, 20, 0)) + PALETTE + first_part(7, 4, 3, rle))
    parts = decode.pgs_display_set(screen((7, 10, 20, 0)) + PALETTE + first_part(7, 4, 3, rle[:4], False) + next_part(7, rle[4:9], False) + next_part(7, rle[9:], True))
    assert (parts["bitmap"] == whole["bitmap"]).all() and (parts["bitmap"] == 255).all() and parts["bitmap"].shape == (3, 4, 4)
    missing = decode.pgs_display_set(screen((7, 10, 20, 0)) + PALETTE + first_part(7, 4, 3, rle[:4], False))
    assert missing["kind"] == "ignore"
    assert decode.pgs_display_set(screen((7, 10, 20, 0), update=0x80) + PALETTE + first_part(7, 4, 3, rle))["kind"] == "ignore"


def test_two_objects_and_a_crop():
    white, black = bytes([0, 0x84, 1, 0, 0]) * 2, bytes([0, 0x86, 2, 0, 0]) * 4
    got = decode.pgs_display_set(screen((1, 10, 20, 0), (2, 20, 30, 0x40)) + PALETTE + first_part(1, 4, 2, white) + first_part(2, 6, 4, black))
    assert got["forced"] and got["bitmap"].shape == (14, 16, 4)  # from (10, 20) to (26, 34)
    assert (got["bitmap"][:2, :4] == 255).all() and (got["bitmap"][10:, 10:, 3] == 255).all() and (got["bitmap"][10:, 10:, :3] == 0).all()
    assert (got["bitmap"][..., 3] > 0).sum() == 8 + 24
    assert (got["v"], got["h"]) == ((20 + 34) / 2 / 1080, (10 + 26) / 2 / 1920)
    mixed = bytes([1, 1, 2, 3, 0, 0]) * 2  # four pixels of three colours, one by one
    cut = decode.pgs_display_set(screen((1, 10, 20, 0x80, 2, 0, 2, 2)) + PALETTE + first_part(1, 4, 2, mixed))
    assert cut["bitmap"].shape == (2, 2, 4) and cut["bitmap"][0, :, 0].tolist() == [0, 128]


@pytest.mark.parametrize("width", [3, 63, 64, 300])
def test_long_runs(width):
    """6-bit and 14-bit runs, coloured and clear, that never leave their line."""
    run = lambda n, c: bytes([0, (0x80 if c else 0) | n]) + (bytes([c]) if c else b"") if n < 64 else bytes([0, (0xC0 if c else 0x40) | n >> 8, n & 255]) + (bytes([c]) if c else b"")
    out = decode.pgs_runs(run(width, 5) + b"\0\0" + run(width, 0) + b"\0\0" + run(width + 50, 6) + b"\0\0" + bytes([9]), width, 4)
    assert (out[0] == 5).all() and (out[1] == 0).all() and (out[2] == 6).all() and out[3].tolist() == [9] + [0] * (width - 1)


def test_sub_picture_pixels():
    got = decode.sub_picture(spu(), [0x000000, 0xFF0000, 0x00FF00, 0x0000FF] + [0] * 12)
    assert (got["bitmap"][..., 3] == 255).sum() == 32 and not got["forced"] and got["duration"] is None


GREY = lambda v: np.array([v, v, v, 255], np.uint8)


def test_polarity_of_outlines():
    def glyph(text, outline):
        a = np.zeros((24, 24, 4), np.uint8)
        a[2:22, 2:22] = GREY(outline)
        a[6:18, 6:18] = GREY(text)
        return a

    assert [imaging.dark_on_light(glyph(*x)) for x in ((255, 0), (0, 255), (255, 150), (200, 190))] == [False, True, False, None]


def test_colours():
    color = lambda a: imaging.binarize(a)[1]
    flat = np.full((4, 4, 4), 255, np.uint8)
    flat[..., 2] = 0
    assert color(flat) == (255, 255, 0)
    assert color(np.zeros((4, 4, 4), np.uint8)) is None  # transparent
    dark = flat.copy()
    dark[0] = GREY(0)
    assert color(dark) == (255, 255, 0)  # a dark outline is no foreground
    tie = np.concatenate([np.tile(GREY(255), (2, 4, 1)), np.tile(GREY(200), (2, 4, 1))])
    assert color(tie) is None
    shades = np.concatenate([np.tile(GREY(255), (10, 10, 1))] + [np.tile(GREY(130 + 9 * k), (3, 10, 1)) for k in range(10)])
    assert color(shades) == (255, 255, 255)  # 100 of one against 300 over ten shades
    edge = np.tile(GREY(255), (10, 10, 1))
    edge[0] = GREY(140)
    assert color(edge) == (255, 255, 255)


def plain_match(m, bits, top, thorough=True, allowed=25):
    """The cascade with loops: exact, then pass by pass the fewest errors, the best fit, the load order."""
    h, w = bits.shape
    for k, g in enumerate(m.single):
        if (g.width, g.height) == (w, h) and abs(g.margin - top) < 5 and g.strokes and m.errors(bits, g) == 0:
            return k
    for least, deep, d_aspect, d_size, d_margin, strokes, sensitive, budget in glyphs.PASSES:
        if deep and not thorough or allowed < least:
            continue
        budget = allowed if budget is None else min(budget, allowed) if budget in (3, 20) else budget
        found = []
        for k, g in enumerate(m.single):
            e = m.errors(bits, g)
            if e is None or e > budget or abs(g.margin - top) >= d_margin or g.strokes < strokes:
                continue
            if d_aspect is not None and abs(h * 100.0 / w - g.height * 100.0 / g.width) >= d_aspect or d_size is not None and max(abs(w - g.width), abs(h - g.height)) >= d_size:
                continue
            if sensitive is not None and sensitive != (g.text in glyphs.SENSITIVE):
                continue
            found.append((e, abs(g.margin - top) + abs(g.height - h) + abs(g.width - w), k))
        if found:
            return min(found)[2]
    return None


def random_glyph(rng, text):
    w, h = int(rng.integers(4, 16)), int(rng.integers(6, 20))
    lines = lambda n: np.stack([rng.integers(0, w, n), rng.integers(0, h, n), rng.integers(0, w, n), rng.integers(0, h, n)], 1)
    return glyphs.Glyph(text, w, h, int(rng.integers(0, 8)), lines(int(rng.integers(0, 40))), lines(int(rng.integers(0, 20))))


def test_cascade_equals_plain_loops():
    rng = np.random.default_rng(11)
    m = glyphs.Matcher([random_glyph(rng, c) for c in "abcdefOo0'-:xyz\"" * 4])
    hit = set()
    for _ in range(400):
        g = m.single[rng.integers(len(m.single))]
        h, w = max(2, g.height + int(rng.integers(-2, 3))), max(2, g.width + int(rng.integers(-2, 3)))
        bits = np.zeros((h, w), bool)
        bits.ravel()[glyphs.stroke_points(g.fg, g.width, g.height, w, h)] = True
        bits ^= rng.random((h, w)) < rng.choice([0, 0.01, 0.05, 0.3])
        top, thorough, allowed = int(rng.integers(0, 12)), bool(rng.integers(2)), int(rng.choice([0, 1, 3, 25]))
        want = plain_match(m, bits, top, thorough, allowed)
        got = m.match(bits, top, thorough, allowed)
        assert got is (None if want is None else m.single[want])
        assert m.match(bits, top, thorough, allowed) is got  # remembered
        hit.add(want is None)
    assert hit == {True, False} and len(m.stacked) <= glyphs.SIZES_KEPT


@pytest.mark.parametrize("scale", [1.0, 1.4, 2.0, 3.0])
def test_glyphs_redrawn_at_scales(scale):
    box = [[0, 0, 11, 0], [0, 13, 11, 13], [0, 0, 0, 13], [11, 0, 11, 13]]
    shapes = {"O": (12, box, [[5, 5, 6, 8]]), "l": (6, [[2, 0, 2, 13], [3, 0, 3, 13]], [[0, 2, 0, 11]]), "T": (12, [[0, 0, 11, 0], [5, 0, 5, 13]], [[1, 6, 2, 12], [9, 6, 10, 12]]), "L": (10, [[0, 0, 0, 13], [0, 13, 9, 13]], [[5, 1, 8, 8]])}
    made = [glyphs.Glyph(c, w, 14, 0, np.array(fg), np.array(bg)) for c, (w, fg, bg) in shapes.items()]
    m = glyphs.Matcher(made)
    for g in made:
        w, h = round(g.width * scale), round(g.height * scale)
        bits = np.zeros((h, w), bool)
        bits.ravel()[glyphs.stroke_points(g.fg, g.width, g.height, w, h)] = True
        if scale > 1:
            wide = np.pad(bits, 1)
            bits = np.logical_or.reduce([wide[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        found = m.match(bits, 0)
        assert found is not None and found.text == g.text


def test_runs_of_blobs_and_cut_blobs():
    quote = glyphs.Glyph('"', 9, 5, 0, np.array([[0, 0, 0, 4], [1, 0, 1, 4], [7, 0, 7, 4], [8, 0, 8, 4]]), np.array([[4, 0, 4, 4]]), expand=2)
    o, mo = letter("O", 12, 14, [[0, 0, 11, 0], [0, 13, 11, 13], [0, 0, 0, 13], [11, 0, 11, 13]])
    t, mt = letter("+", 9, 14, [[0, 8, 8, 8], [4, 0, 4, 13]])
    m = glyphs.Matcher([quote, o, t])
    mask = np.zeros((18, 60), bool)
    mask[2:7, 1:3] = mask[2:7, 8:10] = True
    mask[2:16, 30:42] = mo
    got = m.recognize(mask)
    assert got == {"text": '" O', "glyphs": 3, "unknown": 0}  # a run is one glyph and counts its blobs
    joined = np.zeros((18, 40), bool)
    joined[2:16, 4:16], joined[2:16, 16:25] = mo, mt  # they touch: one blob, cut where ink is thinnest
    assert m.recognize(joined) == {"text": "O+", "glyphs": 1, "unknown": 0}
    blurred = joined.copy()
    blurred[2:16, 4:25] = True
    assert m.recognize(blurred) == {"text": "□", "glyphs": 1, "unknown": 1}


def test_shrunk_strokes():
    assert glyphs.stroke_points(np.array([[44, 4, 44, 4]]), 100, 100, 10, 10).tolist() == [0]  # no slope: the point counts at x 0
    assert glyphs.stroke_points(np.array([[0, 0, 99, 99]]), 100, 100, 1, 1).tolist() in ([0], [])
