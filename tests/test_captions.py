import numpy as np
from pyspark.sql import functions as F

from cuemill.operators import cues, glyphs
from cuemill.plans import captions
from tests.test_bitmaps import CLEAR, letter, segment


def pgs(mask):
    h, w = mask.shape
    rle = b"".join(b"".join(b"\x01" if p else b"\x00\x01" for p in row) + b"\x00\x00" for row in mask)
    place = bytes([0, 0, 0, 0]) + (10).to_bytes(2, "big") + (900).to_bytes(2, "big")
    screen = (1920).to_bytes(2, "big") + (1080).to_bytes(2, "big")
    obj = bytes([0, 0, 0, 0xC0]) + (len(rle) + 4).to_bytes(3, "big") + w.to_bytes(2, "big") + h.to_bytes(2, "big") + rle
    return segment(0x16, screen + bytes([0x10, 0, 0, 0x80, 0, 0, 1]) + place) + segment(0x14, bytes([0, 0, 1, 235, 128, 128, 255])) + segment(0x15, obj) + segment(0x80, b"")


def test_packets_to_files(spark):
    box = [[0, 0, 11, 0], [0, 13, 11, 13], [0, 0, 0, 13], [11, 0, 11, 13]]
    o, mo = letter("O", 12, 14, box)
    i, mi = letter("l", 3, 14, [[0, 0, 0, 13], [1, 0, 1, 13], [2, 0, 2, 13]])
    shot = np.zeros((20, 50), bool)
    shot[2:16, 1:13], shot[2:16, 15:18], shot[2:16, 30:42] = mo, mi, mo
    rows = [("a", 1, 1000, bytearray(pgs(shot))), ("a", 2, 3000, bytearray(CLEAR)), ("a", 3, 3100, bytearray(pgs(shot))), ("a", 4, 6000, bytearray(CLEAR)), ("b", 1, 0, bytearray(CLEAR))]
    packets = spark.createDataFrame(rows, "track string, seq int, start long, data binary")
    out = captions.caption_files(packets, glyphs.write_database([o, i]), "eng").collect()
    assert [(r.track, r.body) for r in out] == [("a", "1\r\n00:00:01,000 --> 00:00:06,000\r\nOl O\r\n\r\n")]
    styled = captions.caption_files(packets, glyphs.write_database([o, i]), "eng", captions.Settings(container="ass")).first().body
    assert styled.endswith("Dialogue: 0,0:00:01.00,0:00:06.00,Default,,0,0,0,,{\\an1}Ol O\n")
    assert captions.caption_files(packets, glyphs.write_database([]), "eng").count() == 0


def test_italic_spans(spark):
    cases = {"a <i>b</i> c": ("a b c", [(2, 1)]), "<i>x": ("x", [(0, 1)]), "<i></i>y": ("y", []), "<i>a<i>b</i>": ("ab", [(1, 1)]), "😀<i>z</i><": ("😀z<", [(2, 1)]), "": ("", [])}
    for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", cues.italic_spans(F.col("t")).alias("p")).collect():
        assert (r.p.text, [tuple(s) for s in r.p.spans]) == cases[r.t], r.t
