import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuemill.operators import decode, glyphs, imaging
from cuemill.plans import registry


def segment(kind, body):
    return bytes([kind]) + len(body).to_bytes(2, "big") + body


def show(forced=False):
    rle = bytes([0, 0x84, 1, 0, 0]) * 2
    place = (0).to_bytes(2, "big") + bytes([0, 0x40 if forced else 0]) + (10).to_bytes(2, "big") + (20).to_bytes(2, "big")
    screen = (1920).to_bytes(2, "big") + (1080).to_bytes(2, "big")
    obj = bytes([0, 0, 0, 0xC0, 0, 0, len(rle) + 4]) + (4).to_bytes(2, "big") + (2).to_bytes(2, "big") + rle
    return segment(0x16, screen + bytes([0x10, 0, 0, 0x80, 0, 0, 1]) + place) + segment(0x14, bytes([0, 0, 1, 235, 128, 128, 255])) + segment(0x15, obj) + segment(0x80, b"")


CLEAR = segment(0x16, bytes([7, 128, 4, 56, 16, 0, 1, 0, 0, 0, 0])) + segment(0x80, b"")


@pytest.mark.parametrize("forced", [False, True])
def test_pgs_show(forced):
    got = decode.pgs_display_set(show(forced))
    assert got["kind"] == "show" and got["forced"] == forced and got["bitmap"].shape == (2, 4, 4)
    assert (got["bitmap"] == 255).all() and got["v"] == 21 / 1080 and got["h"] == 12 / 1920


def test_pgs_others():
    assert decode.pgs_display_set(CLEAR)["kind"] == "clear"
    assert decode.pgs_display_set(b"")["kind"] == "clear"
    assert decode.pgs_display_set(show()[:30])["kind"] == "ignore"


def spu():
    pixels = bytes([0x21, 0x21])
    control = 4 + 4
    body = bytes([3, 0x32, 0x10, 4, 0xFF, 0xF0, 5, 0, 0, 7, 0, 0, 3, 6, 0, 4, 0, 6, 0xFF])
    data = pixels * 2 + control.to_bytes(2, "big")[:0]
    data = (0).to_bytes(2, "big") + control.to_bytes(2, "big") + data + bytes([0, 0]) + control.to_bytes(2, "big") + body
    return len(data).to_bytes(2, "big") + data[2:]


def test_sub_picture():
    # value 0x21: two codes a byte would be short runs, so the rows fill by the codes' own lengths
    got = decode.sub_picture(spu(), [0x000000, 0xFF0000, 0x00FF00, 0x0000FF] + [0] * 12)
    assert got is not None and got["bitmap"].shape == (4, 8, 4) and not got["forced"] and got["duration"] is None
    assert decode.sub_picture(b"abc", [0] * 16) is None


def test_spark_decoders(spark):
    df = spark.createDataFrame([(1, bytearray(show())), (2, bytearray(CLEAR)), (3, None)], "seq int, data binary")
    rows = {r.seq: r for r in decode.decode_pgs(df, ["seq"]).collect()}
    assert (rows[1].kind, rows[2].kind, rows[3].kind) == ("show", "clear", "clear") and rows[1].bitmap.width == 4
    vob = spark.createDataFrame([(1, bytearray(spu()), [0] * 16), (2, bytearray(b"x"), [0] * 16)], "seq int, data binary, palette array<int>")
    assert [r.decodable for r in decode.decode_vobsub(vob, ["seq"]).orderBy("seq").collect()] == [True, False]


def test_binarize_and_polarity():
    px = np.array([[[255, 255, 255, 255], [10, 10, 10, 255]]], np.uint8)
    assert imaging.binarize(px)[0].tolist() == [[True, False]] and imaging.binarize(px, True)[0].tolist() == [[False, True]]

    def glyph(text, outline):
        a = np.zeros((24, 24, 4), np.uint8)
        a[2:22, 2:22] = [outline] * 3 + [255]
        a[6:18, 6:18] = [text] * 3 + [255]
        return a

    for (text, outline), want in {(255, 0): False, (0, 255): True, (200, 190): None}.items():
        assert imaging.dark_on_light(glyph(text, outline)) is want
    flat = np.full((4, 4, 4), 250, np.uint8)
    assert imaging.binarize(flat)[1] == (250, 250, 250)
    half = flat.copy()
    half[:2] = 200
    assert imaging.binarize(half)[1] is None


def letter(text, w, h, strokes, **more):
    strokes = np.array(strokes)
    free = [s for s in [[w // 2, 1, w // 2, 2], [1, h // 2, 2, h // 2]]]
    mask = np.zeros((h, w), bool)
    mask.ravel()[glyphs.stroke_points(strokes, w, h, w, h)] = True
    bg = np.array([s for s in free if not mask.ravel()[glyphs.stroke_points(np.array([s]), w, h, w, h)].any()], int).reshape(-1, 4)
    return glyphs.Glyph(text, w, h, 0, strokes, bg, **more), mask


def test_database_round_trip_and_recognition():
    box = lambda w, h: [[0, 0, w - 1, 0], [0, h - 1, w - 1, h - 1], [0, 0, 0, h - 1], [w - 1, 0, w - 1, h - 1]]
    o, mo = letter("O", 12, 14, box(12, 14))
    i, mi = letter("l", 3, 14, [[0, 0, 0, 13], [1, 0, 1, 13], [2, 0, 2, 13]])
    x, mx = letter("x", 9, 9, [[0, 0, 8, 8], [8, 0, 0, 8]], italic=True)
    wide = glyphs.Glyph("W", 300, 20, 0, np.array([[0, 0, 299, 19]]), np.zeros((0, 4), int), expand=2)
    again = glyphs.read_database(glyphs.write_database([o, i, x, wide]))
    assert [(g.text, g.width, g.italic, g.expand) for g in again] == [("O", 12, False, 0), ("l", 3, False, 0), ("x", 9, True, 0), ("W", 300, False, 2)]
    assert all((a.fg == b.fg).all() and (a.bg == b.bg).all() for a, b in zip(again, [o, i, x, wide]))
    mask = np.zeros((20, 60), bool)
    mask[2:16, 1:13], mask[2:16, 15:18], mask[2:16, 30:42] = mo, mi, mo
    got = glyphs.Matcher(again).recognize(mask)
    assert got == {"text": "Ol O", "glyphs": 3, "unknown": 0}
    assert glyphs.Matcher([]).recognize(mask)["unknown"] == 3


def test_case_and_slant_of_lines():
    m = glyphs.Matcher([])
    blob = lambda h, gap=1, new=False: {"bits": np.ones((h, 4), bool), "gap": gap, "line_height": 20, "new_line": new, "top_margin": 0}
    g = lambda t, italic=False: glyphs.Glyph(t, 4, 9, 0, np.zeros((0, 4), int), np.zeros((0, 4), int), italic)
    space = lambda h: max(6, round(0.25 * h))
    read = [(blob(14, -1, True), g("T")), (blob(9), g("a")), (blob(14), g("s")), (blob(9, 8), g("S")), (blob(9), None), (blob(14, -1, True), g("i", True)), (blob(2), g(".")), (blob(9), g("n", True)), (blob(9), g("n"))]
    assert m.lined(read, "?", space, 25) == "TaS s?\n<i>i.n</i>n"
    box = np.array([[0, 0, 3, 0], [0, 8, 3, 8]])
    both = glyphs.Matcher([glyphs.Glyph("n", 4, 9, 0, box, np.zeros((0, 4), int), s) for s in (False, True)])
    assert both.lined([(blob(9, -1, True), both.single[1])], "?", space, 25) == "n"


def test_recognize_on_spark(spark):
    i, mi = letter("l", 3, 14, [[0, 0, 0, 13], [1, 0, 1, 13], [2, 0, 2, 13]])
    rgba = np.zeros((20, 12, 4), np.uint8)
    rgba[3:17, 2:5][mi] = 255
    df = spark.createDataFrame([(1, (12, 20, bytearray(rgba.tobytes())))], f"seq int, bitmap {decode.BITMAP}")
    r = glyphs.recognize(df, ["seq"], glyphs.write_database([i])).first()
    assert (r.text, r.glyphs, r.unknown, r.r) == ("l", 1, 0, 255)
    assert imaging.polarities(df.withColumnRenamed("seq", "track").selectExpr("track", "1 AS n", "bitmap"), "track", "n").first().inverted is False


def test_images_are_handed_on_in_pieces(spark):
    made = ({"bitmap": {"rgba": bytes(4000)}} if k % 4 else {"bitmap": None} for k in range(40))
    got = list(imaging.in_pieces(pd.DataFrame({"k": range(40)}), made, limit=10_000))
    assert [k for frame, _ in got for k in frame["k"]] == list(range(40)) and len(got) == 10
    assert max(sum(len(x["bitmap"]["rgba"]) for x in found if x["bitmap"]) for _, found in got) <= 12_000
    i, _ = letter("l", 3, 14, [[0, 0, 0, 13], [1, 0, 1, 13], [2, 0, 2, 13]])
    df = spark.createDataFrame([(1, None)], f"seq int, bitmap {decode.BITMAP}")
    r = glyphs.recognize(df, ["seq"], glyphs.write_database([i])).first()
    assert (r.text, r.glyphs, r.unknown, r.r) == (None, 0, 0, None)  # a missing image has no text


def test_drawn_lines_do_not_travel(spark, tmp_path):
    said = [(1, k, "user", t) for k, t in enumerate(["Ab, c!", None, "", "x" * 3000] + ["word " * 200] * 300)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = registry.QUERIES["recognized_lines"](spark, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1  # images are drawn in the pass that reads them
    got = {r.turn: (r.text, r.unknown) for r in out.collect()}
    assert got[0] == ("ab c", 0) and got[1] == (None, 0) and got[2] == ("", 0) and got[3] == ("x" * 3000, 0)
    assert all(got[k] == (" ".join(["word"] * 200), 0) for k in range(4, 304))


def test_best_templates_are_found_without_sorting_pairs(spark):
    rng = np.random.default_rng(5)
    blobs = [(int(k), int(a)) for k, a in zip(rng.integers(0, 150, 400), rng.integers(0, 100, 400))] + [(900, 900), (901, None)]
    templates = [int(x) for x in rng.permutation(30)] + [None]
    errors, fit = lambda g: F.abs(F.col("a") - g * 3).cast("long"), lambda g: F.abs(F.col("k") % 7 - g % 5)
    found = glyphs.fewest_errors(spark.createDataFrame(blobs, "k long, a int"), spark.createDataFrame([(t,) for t in templates], "glyph int"), ["k"], errors, fit, 10)
    before_exchange = found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(k", 1)[1]
    assert "Sort" not in before_exchange
    want = {}
    for k, a in blobs:
        for t in templates[:-1]:
            if a is not None and abs(a - t * 3) <= 10:
                want[k] = min(want.get(k, (99,)), (abs(a - t * 3), abs(k % 7 - t % 5), t))
    rows = found.collect()
    assert {r.k: (r.errors, r.fit, r.glyph) for r in rows} == want and len(rows) == len(want) > 100
