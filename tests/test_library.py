"""Scan, output policy, state and log operators; and media files from packets to caption files, a test for each branch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.operators import glyphs, state
from cuemill.plans import captions
from cuemill.sources import probe, writers
from tests.test_bitmaps import CLEAR, letter
from tests.test_captions import pgs

BOX = [[0, 0, 11, 0], [0, 13, 11, 13], [0, 0, 0, 13], [11, 0, 11, 13]]
O, MO = letter("O", 12, 14, BOX)
I, MI = letter("l", 3, 14, [[0, 0, 0, 13], [1, 0, 1, 13], [2, 0, 2, 13]])
DATABASE = glyphs.write_database([O, I])
TRACK = "track string, item_id string, path string, stream_index int, format string, language string, title string, forced boolean, hearing_impaired boolean, comment boolean, palette array<int>"
PACKET = "track string, seq int, start long, duration long, data binary"


def shot(spell="Ol O", extra=0):
    mask = np.zeros((20, 60 + 16 * extra), bool)
    at = 1
    for c in spell:
        if c == " ":
            at += 9
            continue
        m = MO if c == "O" else MI
        mask[2:16, at : at + m.shape[1]] = m
        at += m.shape[1] + 2
    for k in range(extra):  # shapes that no glyph has
        mask[2:16, at + 16 * k : at + 16 * k + 10] = np.eye(14, 10, dtype=bool) | np.eye(14, 10, -3, dtype=bool) | np.eye(14, 10, -4, dtype=bool)
    return pgs(mask)


def sub_picture(duration=None):
    """A VobSub packet that shows `l`, drawn by runs to the ends of its lines."""
    top, lower = bytearray(), bytearray()
    for y in range(20):
        line = top if y % 2 == 0 else lower
        if 2 <= y < 16:
            line += bytes([0b00001000 | 0, 0])[:0]
            # 3 clear, 3 of colour 1, the rest clear: codes 0xC (3<<2|0), 0xD (3<<2|1), 0x0000
            line += bytes([0xCD, 0x00, 0x00])
        else:
            line += bytes([0x00, 0x00])
    first = 4
    second = first + len(top)
    control = second + len(lower)
    commands = bytes([3, 0x00, 0x10, 4, 0x00, 0xF0, 5, 0, 0, 11, 0, 0, 19, 6]) + first.to_bytes(2, "big") + second.to_bytes(2, "big") + bytes([1, 0xFF])
    chain = (0).to_bytes(2, "big")
    if duration is None:
        body = chain + control.to_bytes(2, "big") + commands
    else:
        later = control + 4 + len(commands)
        body = chain + later.to_bytes(2, "big") + commands + duration.to_bytes(2, "big") + later.to_bytes(2, "big") + bytes([2, 0xFF])
    size = control + len(body)
    return size.to_bytes(2, "big") + control.to_bytes(2, "big") + bytes(top) + bytes(lower) + body


def track(name, language="eng", fmt="pgs", index=2, item="m", title=None, forced=False, sdh=False, comment=False):
    return (name, item, f"/films/{item}.mkv", index, fmt, language, title, forced, sdh, comment, [0, 0xFFFFFF] + [0] * 14)


def run(spark, tracks, packets, settings=captions.Settings(), resources=None, **more):
    rows = [(t, k, start, duration, bytearray(data)) for t, ps in packets.items() for k, (start, duration, data) in enumerate(ps)]
    out = captions.process(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(rows, PACKET), resources or captions.Resources(DATABASE), settings, **more)
    return {r.track: r for r in out.collect()}


SHOWN = [(1000, None, shot()), (3000, None, CLEAR)]


def test_names_counts_and_policies(spark):
    tracks = [track("a"), track("b", "en", index=3, title="Ext.ra "), track("c", "ger", index=4, comment=True, sdh=True), track("d", "fre"), track("e", "ita", forced=True), track("f", "rus")]
    packets = {t[0]: SHOWN for t in tracks} | {"f": [(0, None, CLEAR)]}
    existing = spark.createDataFrame([("/films/m.fra.OCR.srt",), ("/films/x.srt",)], "path string")
    covered = spark.createDataFrame([("m", "ita"), ("z", "eng")], "item_id string, normalized string")
    out = run(spark, tracks, packets, existing=existing, covered=covered)
    assert {k: (r.outcome, r.file) for k, r in out.items()} == {
        "a": ("written", "/films/m.eng.OCR.2.srt"),
        "b": ("written", "/films/m.eng.Extra.OCR.3.srt"),
        "c": ("written", "/films/m.deu.Commentary.sdh.OCR.srt"),
        "f": ("empty", None),
    }  # d exists, e is covered
    assert out["a"].body == "1\r\n00:00:01,000 --> 00:00:03,000\r\nOl O\r\n\r\n" and out["a"].events == 1 and not out["a"].stale
    again = run(spark, tracks, packets, captions.Settings(overwrite=True, languages=("fr", "it"), skip_covered=False), existing=existing, covered=covered)
    assert {k: (r.outcome, r.file) for k, r in again.items()} == {"d": ("written", "/films/m.fra.OCR.srt"), "e": ("written", "/films/m.ita.forced.OCR.srt")}


def test_vobsub_track(spark):
    packets = {"v": [(1000, None, sub_picture()), (3000, None, b"broken"), (9000, None, sub_picture(176)), (20_000, 500, sub_picture())]}
    out = run(spark, [track("v", fmt="vobsub")], packets)["v"]
    assert out.outcome == "written" and not out.positioned
    # the next packet's start, though it can't be decoded; its own duration of 176 units (2,002 ms); the packet's, held to the least display
    assert [x for x in out.body.split("\r\n") if "-->" in x] == ["00:00:01,000 --> 00:00:03,000", "00:00:09,000 --> 00:00:11,002", "00:00:20,000 --> 00:00:20,750"]
    assert out.body.split("\r\n")[2] == "I"  # a lone l of an English track


def test_dropped_and_unreadable_tracks(spark):
    bad = [(1000 * k, None, x) for k, x in enumerate([shot(), CLEAR, shot("l", 3), CLEAR] * 2)]
    existing = spark.createDataFrame([("/films/m.eng.OCR.srt",)], "path string")
    out = run(spark, [track("a")], {"a": bad}, captions.Settings(overwrite=True), existing=existing)["a"]
    assert (out.outcome, out.stale, out.body) == ("dropped", True, None)
    kept = run(spark, [track("a")], {"a": bad}, captions.Settings(max_dropped=0.6))["a"]
    assert kept.outcome == "written" and kept.events == 2
    murky = run(spark, [track("a")], {"a": [(0, None, shot("Ol O", 1)), (900, None, CLEAR)]}, captions.Settings(overwrite=True), existing=existing)["a"]
    assert (murky.outcome, murky.stale) == ("unreadable", True)


def test_detected_language_fix_list_spelling_and_casing(spark):
    # glyphs that stand for words, so that a track can speak
    words = {"O": "and you know that", "l": "the house is what they have for"}
    database = glyphs.write_database([glyphs.Glyph(words[g.text], g.width, g.height, g.margin, g.fg, g.bg) for g in (O, I)])
    packets = {"u": [(1000 * k, None, x) for k, x in enumerate([shot(), CLEAR] * 3)]}
    fixes = {"eng": ({"what": "whot"}, [("ho(u)se", "h$1s")])}
    dictionary = spark.createDataFrame([("eng", w, 9) for w in "and you know that the hut is what they have for".split()], "language string, word string, freq int")
    resources = captions.Resources(database, fix_lists=fixes, dictionary=dictionary, protected=spark.createDataFrame([("m", "Husex")], "item_id string, word string"))
    out = run(spark, [track("u", None)], packets, resources=resources)["u"]
    assert (out.outcome, out.language, out.file) == ("written", "eng", "/films/m.eng.OCR.srt")
    line = out.body.split("\r\n")[2]
    assert line.startswith("And you know that") and "whot" not in line and "what" in line and "hut" in line
    covered = spark.createDataFrame([("m", "eng")], "item_id string, normalized string")
    assert run(spark, [track("u", None)], packets, resources=resources, covered=covered)["u"].outcome == "covered"
    assert run(spark, [track("u", None)], packets, captions.Settings(skip_covered=False), resources, covered=covered)["u"].outcome == "written"
    special = captions.Resources(DATABASE, {"und": database})
    assert run(spark, [track("u", None)], packets, resources=special)["u"].language == "eng"


def test_auto_container_and_forced(spark):
    high = pgs(np.pad(MI, 2)).replace((900).to_bytes(2, "big"), (100).to_bytes(2, "big"))
    packets = {"a": [(0, None, high), (900, None, CLEAR)], "b": SHOWN}
    out = run(spark, [track("a"), track("b", "deu")], packets, captions.Settings(container="auto"))
    assert out["a"].file.endswith(".ass") and "Dialogue" in out["a"].body and out["a"].positioned
    assert out["b"].file.endswith(".srt") and not out["b"].positioned
    none = captions.process(spark.createDataFrame([], TRACK), spark.createDataFrame([], PACKET), captions.Resources(DATABASE))
    assert none.count() == 0


def test_scan_state_log_and_reprocess(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.json").write_text('{"streams": [{"index": 2, "codec_name": "dvd_subtitle", "tags": {"language": "ger"}, "extradata": "\\n00000000: 7061 6c65 7474 653a 2030 3030 3030 302c  palette: 000000,\\n00000010: 2066 6630 3030 30                           ff0000\\n"}], "format": {"tags": {"title": "Das Boot"}}}')
    head = probe.headers(spark, str(tmp_path / "h"))
    path = head.first().path
    items = spark.createDataFrame([("m", "Boat", path, "Movie", False, 7, None, ["Boat"]), ("e", None, "/none", "Episode", None, 1, None, None), ("v", "x", "/v", "Movie", True, 1, None, None), ("s", "x", "/s", "Series", False, 1, None, None), ("n", "x", None, "Movie", False, 1, None, None)], "item_id string, item_name string, path string, kind string, virtual boolean, modified long, series_id string, titles array<string>")
    known = spark.createDataFrame([("e", 1, 90), ("m", 6, 99)], "item_id string, modified long, probed long")
    text = spark.createDataFrame([("m", "en", True), ("m", "eng", True), ("m", "", True), ("m", "fr", False)], "item_id string, language string, text boolean")
    chosen, tracks, covered = captions.scan(items, known, head, text, 100, 30)
    assert [r.item_id for r in chosen.collect()] == ["m"]
    t = tracks.first()
    assert (t.track, t.format, t.language, t.palette[1], len(t.palette)) == ("m:2", "vobsub", "ger", 0xFF0000, 16)
    assert [tuple(r) for r in covered.collect()] == [("m", "eng")]
    none = spark.createDataFrame([], "owner_id string, type string, role string, name string")
    assert {r.word for r in captions.protected_words(items.filter("item_id = 'm'"), none, head).collect()} == {"boat", "das", "boot"}
    probed = spark.createDataFrame([("m", 7, 100)], "item_id string, modified long, probed long")
    after = state.record_probes(known, probed)
    folder = str(tmp_path / "state")
    for _ in range(2):
        probe.save_state(after, folder)
        assert sorted(map(tuple, probe.json_state(spark, folder, "item_id string, modified long, probed long").collect())) == [("e", 1, 90), ("m", 7, 100)]
    (tmp_path / "broken").write_text('{"item_id": "a", "modified": 1, "probed": 2}\n{"item_id": \n')
    assert probe.json_state(spark, str(tmp_path / "broken"), "item_id string, modified long, probed long").count() == 1

    log = spark.createDataFrame([("m", "Boat", "/m.srt", "deu", 3, 5), ("e", "", "/e.srt", "eng", 1, 6)], "item_id string, item_name string, path string, language string, events long, when long")
    files = spark.createDataFrame([("/m.srt", "old"), ("/e.srt", "kept")], "path string, body string")
    results = spark.createDataFrame([("m:2", "m", "/m.deu.srt", "deu", "written", 2, "new", False), ("m:3", "m", "/m.x.srt", "fra", "dropped", 0, None, True)], "track string, item_id string, file string, language string, outcome string, events long, body string, stale boolean")
    new_log, new_files = captions.reprocess("m", log, files, lambda: (results, captions.log_rows(results, items, 9)))
    assert sorted((r.item_id, r.path, r.when) for r in new_log.collect()) == [("e", "/e.srt", 6), ("m", "/m.deu.srt", 9)]
    assert sorted(map(tuple, new_files.collect())) == [("/e.srt", "kept"), ("/m.deu.srt", "new")]
    assert [r.path for r in state.newest_first(log).collect()] == ["/e.srt", "/m.srt"] and state.cleared(log).count() == 0
    stale = spark.createDataFrame([("/e.srt",)], "path string")
    assert sorted(r.path for r in writers.merge_files(files, new_files.filter("path = '/m.deu.srt'"), stale).collect()) == ["/m.deu.srt", "/m.srt"]


def test_fix_list_and_dictionary_files(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<R><WholeWords><Word from="teh" to="the"/><Word from="teh" to="The"/><Word from="a"/></WholeWords><PartialWords><WordPart from="cat" to="dog"/></PartialWords><RegularExpressions><RegularExpression find="(\\d)l" replaceWith="$11"/><RegularExpression find="(" replaceWith="x"/></RegularExpressions></R>')
    words, rules = probe.fix_list(spark, str(tmp_path / "x.xml"))
    assert words == {"teh": "The"} and rules == [("(\\d)l", "$11")]
    (tmp_path / "bad.xml").write_text("<R><")
    assert probe.fix_list(spark, str(tmp_path / "bad.xml")) == ({}, []) == probe.fix_list(spark, str(tmp_path / "none.xml"))
    (tmp_path / "en.dic").write_text("3\nHello/SM\nworld\nice\\/cream/x\n\n")
    assert {r.word for r in probe.dictionary(spark, str(tmp_path / "en.dic")).collect()} == {"hello", "world", "ice\\/cream"}
    assert probe.dictionary(spark, str(tmp_path / "none.dic")).count() == 0


@pytest.mark.parametrize("language,want", [("en", "/db/own.nocr"), ("de", "/db/deu.nocr"), ("fr", "/all.nocr")])
def test_database_precedence(spark, language, want):
    languages = spark.createDataFrame([(language,)], "c string").select(state.tagged_language("c").alias("normalized"))
    configured = spark.createDataFrame([("eng", "own.nocr", 0), ("en", "other.nocr", 1)], "language string, path string, position int")
    there = spark.createDataFrame([("deu.nocr",), ("eng.nocr",)], "name string")
    assert state.database_paths(languages, configured, there, "/all.nocr", "/db").first().database == want
    assert state.database_paths(languages, configured.limit(0), there.limit(0), " ", "/db").first().database is None
