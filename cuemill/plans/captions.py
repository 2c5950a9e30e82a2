"""From the image tracks of media files to caption files: the operators of a track, put together as one plan.

One narrow stage decodes, one recognises; everything that looks at neighbours partitions by track. Tracks are keyed by one column,
`track`; times are milliseconds. What depends on the language is planned once for each language that occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import lang, textfix
from cuemill.operators import cues, decode, glyphs, imaging, spell, state
from cuemill.session import settled
from cuemill.sources import probe, writers

#: Cues above this height are placed; a last show that nothing ends, and all of the older format, stand here.
PLACED, DEFAULT_V, DEFAULT_H = 0.6, 0.9, 0.5


@dataclass(frozen=True)
class Settings:
    """Defaults of the thresholds; a ratio drops what lies above it."""

    max_unknown: float = 0.4
    max_dropped: float = 0.25
    max_placeholders: float = 0.05
    allowed_errors: int = 25
    placeholder: str = "□"
    forced_only: bool = False
    container: str = "srt"  # srt, ass or auto
    languages: tuple[str, ...] = ()
    skip_covered: bool = True
    overwrite: bool = False
    tag: str = "OCR"
    fold_ellipsis: bool = True
    fold_accents: bool = True
    aggressive: bool = False
    detect_sdh: bool = True
    spell_check: bool = True


@dataclass(frozen=True)
class Resources:
    """Glyph databases by language and a general one; fix lists by language; dictionary (language, word, freq); protected (item_id, word)."""

    database: bytes = b""
    databases: dict[str, bytes] = field(default_factory=dict)
    fix_lists: dict[str, tuple[dict[str, str], Sequence[tuple[str, str]]]] = field(default_factory=dict)
    dictionary: DataFrame | None = None
    protected: DataFrame | None = None


def by_language(df: DataFrame, column: str, work: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """work(rows of a language, language) for each language that occurs in a settled table, put together again."""
    found = sorted(r[0] for r in df.select(column).distinct().collect())  # codes of languages: few
    parts = [work(df.filter(F.col(column) == x), x) for x in found]
    return reduce(DataFrame.unionByName, parts) if parts else work(df, "und")


def pgs_images(packets: DataFrame) -> DataFrame:
    """track, seq, start, end, forced, v, h, bitmap of PGS packets (track, seq, start, data); a last open show keeps the default place."""
    shown = cues.pair_shows(decode.decode_pgs(packets, ["track", "seq", "start"]))
    place = lambda c, d: F.when(F.col("last"), F.lit(d)).otherwise(F.col(c)).alias(c)
    return shown.select("track", "seq", "start", "end", "forced", place("v", DEFAULT_V), place("h", DEFAULT_H), "bitmap")


def vobsub_images(packets: DataFrame) -> DataFrame:
    """The same of VobSub packets (track, seq, start, duration, data, palette)."""
    found = cues.resolve_ends(decode.decode_vobsub(packets, ["track", "seq", "start", "duration"]))
    return found.select("track", "seq", "start", "end", "forced", F.lit(DEFAULT_V).alias("v"), F.lit(DEFAULT_H).alias("h"), "bitmap")


def images(packets: DataFrame) -> DataFrame:
    """Of packets (track, seq, start, duration, data, format, palette) in either format."""
    return pgs_images(packets.filter("format = 'pgs'")).unionByName(vobsub_images(packets.filter("format = 'vobsub'")))


def recognised(shots: DataFrame, database: bytes, settings: Settings) -> DataFrame:
    """Cues of images, in the polarity that most of the track's first images show."""
    told = shots.join(imaging.polarities(shots, "track", "seq"), "track")
    if settings.forced_only:
        told = told.filter(~F.col("forced"))
    return glyphs.recognize(told, ["track", "seq", "start", "end", "v", "h"], database, inverted="inverted", allowed=settings.allowed_errors)


def legible(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Cues with `bad`: those with more unread glyphs than the ratio; cues without glyphs go."""
    return found.filter("glyphs > 0").withColumn("bad", F.col("unknown") > F.col("glyphs") * settings.max_unknown)


def dropped_gate(seen: DataFrame, track: str = "track", settings: Settings = Settings()) -> DataFrame:
    """track, cues, dropped, discard: a track that lost more cues than the ratio is discarded."""
    drop = F.count_if("bad")
    return seen.groupBy(track).agg(F.count("*").alias("cues"), drop.alias("dropped"), (drop > F.count("*") * settings.max_dropped).alias("discard"))


def placeholder_gate(kept: DataFrame, track: str = "track", settings: Settings = Settings()) -> DataFrame:
    """track, chars, unread, discard: a track whose texts hold more unread glyphs than the ratio is discarded. Lengths are in UTF-16 units."""
    size = cues.utf16_length(F.col("text"))
    unread = F.sum(F.length("text") - F.length(F.replace("text", F.lit(settings.placeholder), F.lit(""))))
    return kept.groupBy(track).agg(F.sum(size.cast("long")).alias("chars"), unread.cast("long").alias("unread"), (unread > F.sum(size) * settings.max_placeholders).alias("discard"))


def track_texts(events: DataFrame, track: str = "track", order: str = "seq") -> DataFrame:
    """track, text: a track's cues in order, parted by a space."""
    joined = F.array_join(F.col("__all.text"), " ")
    return events.groupBy(track).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("__all")).select(track, joined.alias("text"))


def planned(tracks: DataFrame, covered: DataFrame, existing: DataFrame, settings: Settings) -> DataFrame:
    """The tracks worth recognising, with normalized language, descriptor and number in the file name; covered (item_id, normalized), existing (path)."""
    normalized = lang.normalize_language(F.col("language"))
    title = writers.sanitize_tag(F.col("title"))
    descriptor = F.when(title != "", title).when(F.coalesce(F.col("comment"), F.lit(False)), "Commentary")
    every = state.with_language_counts(tracks.withColumn("normalized", normalized), "item_id").withColumns({"descriptor": descriptor, "number": F.when(F.col("alike") > 1, F.col("stream_index"))}).drop("alike")
    left = state.allowed(every, settings.languages)
    if settings.skip_covered:
        left = state.uncovered(left, covered, "item_id")
    if settings.container == "auto" or settings.overwrite:
        return left
    name = lambda sdh: writers.output_path(F.col("path"), F.col("normalized"), F.col("descriptor"), F.col("forced"), sdh, F.lit(settings.tag), F.col("number"), F.lit(settings.container))
    there = existing.select(F.col("path").alias("__there")).distinct()
    known = left.withColumn("__name", F.explode(F.array_distinct(F.array(name(F.col("hearing_impaired")), name(F.lit(True))))))
    done = known.filter("normalized <> 'und'").join(there, F.col("__name") == F.col("__there"), "left_semi").select("track").distinct()
    return left.join(done, "track", "left_anti")


def fixed(seen: DataFrame, todo: DataFrame, resources: Resources, settings: Settings) -> DataFrame:
    """Legible cues with fixed characters, by the track's tagged language."""
    events = seen.filter("not bad").join(todo.select("track", "item_id", "normalized"), "track")
    shield = None
    if resources.protected is not None:
        words = resources.protected.groupBy("item_id").agg(F.collect_set(F.lower("word")).alias("__safe"))
        events = events.join(words, "item_id", "left").withColumn("__safe", F.coalesce("__safe", F.array().cast("array<string>")))
        shield = F.col("__safe")
    fix = lambda part, x: part.withColumn("text", textfix.fix(F.col("text"), x, lang_is_latin(x), settings.placeholder, settings.fold_ellipsis, settings.fold_accents, settings.aggressive, shield))
    return by_language(settled(events), "normalized", fix).drop("__safe")


def lang_is_latin(language: str) -> bool:
    return language not in lang.NOT_LATIN


def named(events: DataFrame, todo: DataFrame, covered: DataFrame, settings: Settings) -> DataFrame:
    """Tracks that have cues, with effective language, container, sdh and path; a detected language that is covered drops its track."""
    texts = track_texts(events)
    told = lang.detected(texts, "text").select("track", lang.normalize_language(F.coalesce("language", F.lit("und"))).alias("told"))
    known = todo.join(told, "track").withColumn("effective", F.when(F.col("normalized") == "und", F.col("told")).otherwise(F.col("normalized"))).drop("told")
    if settings.skip_covered:
        found = known.filter("normalized = 'und' and effective <> 'und'").withColumn("__tagged", F.col("normalized")).withColumn("normalized", F.col("effective"))
        found = state.uncovered(found, covered, "item_id").withColumn("normalized", F.col("__tagged")).drop("__tagged")
        known = known.filter("normalized <> 'und' or effective = 'und'").unionByName(found)
    if settings.container == "auto":
        placed = events.groupBy("track").agg((F.min("v") < PLACED).alias("placed"))
        known = known.join(placed, "track").join(cues.uses_color(events, "track"), "track").withColumn("container", F.when(F.col("placed") | F.col("uses_color"), "ass").otherwise("srt")).drop("placed", "uses_color")
    else:
        known = known.withColumn("container", F.lit(settings.container))
    if settings.detect_sdh:
        known = known.join(cues.hearing_impaired(events, "track").select("track", "sdh"), "track").withColumn("sdh", F.col("hearing_impaired") | F.col("sdh"))
    else:
        known = known.withColumn("sdh", F.col("hearing_impaired"))
    path = writers.output_path(F.col("path"), F.col("effective"), F.col("descriptor"), F.col("forced"), F.col("sdh"), F.lit(settings.tag), F.col("number"), F.col("container"))
    return known.withColumn("file", path)


def spelled(events: DataFrame, resources: Resources, settings: Settings) -> DataFrame:
    """Fix list, then spelling, then sentence case, by the effective language."""
    none = events.sparkSession.createDataFrame([], "item_id string, word string")
    safe = resources.protected if resources.protected is not None else none
    safe = safe.select(F.col("item_id").cast(dict(events.dtypes)["item_id"]).alias("item_id"), "word")

    def work(part: DataFrame, language: str) -> DataFrame:
        part = part.withColumn("text", spell.fix_words(F.col("text"), *resources.fix_lists.get(language, ({}, ()))))
        if settings.spell_check and resources.dictionary is not None:
            words = resources.dictionary.filter(F.col("language") == language).select("word", "freq")
            if words.head(1):  # without a dictionary nothing is corrected
                part = spell.correct(part, words, safe, ["track", "seq"], placeholder=settings.placeholder, by=["item_id"])
        return cues.sentence_case(part) if lang_is_latin(language) else part

    return by_language(settled(events), "effective", work)


def process(tracks: DataFrame, packets: DataFrame, resources: Resources, settings: Settings = Settings(), covered: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """track, item_id, file, language, outcome, events, body, stale, positioned of every image track that was worth recognising.

    tracks: track, item_id, path (of the media file), stream_index, format, language, title, forced, hearing_impaired, comment, palette.
    packets: track, seq, start, duration, data. covered: item_id, normalized (languages of text captions). existing: path of files.
    outcome: written, empty, covered, exists, dropped (too many cues were) or unreadable; stale: the file at `file` has to go.
    """
    spark = tracks.sparkSession
    covered = covered if covered is not None else spark.createDataFrame([], "item_id string, normalized string")
    covered = covered.select(F.col("item_id").cast(dict(tracks.dtypes)["item_id"]).alias("item_id"), "normalized")
    existing = existing if existing is not None else spark.createDataFrame([], "path string")
    todo = settled(planned(tracks, covered, existing, settings))
    shots = images(packets.join(todo.select("track", "format", "palette", "normalized"), "track"))
    shots = shots.join(todo.select("track", "normalized"), "track")
    positioned = shots.groupBy("track").agg((F.min("v") < PLACED).alias("positioned"))
    special = list(resources.databases)
    found = recognised(shots.filter(~F.col("normalized").isin(special)).drop("normalized"), resources.database, settings)
    for language, database in resources.databases.items():
        found = found.unionByName(recognised(shots.filter(F.col("normalized") == language).drop("normalized"), database, settings))
    seen = settled(legible(found, settings))
    events = settled(fixed(seen, todo, resources, settings))
    known = settled(named(events, todo, covered, settings))
    there = existing.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct()
    judged = known.join(there, "file", "left").join(dropped_gate(seen, settings=settings).select("track", "discard"), "track")
    outcome = F.when(F.col("there") & ~F.lit(settings.overwrite), "exists").when(F.col("discard"), "dropped").otherwise("written")
    judged = judged.withColumn("outcome", outcome).drop("discard")
    good = events.drop("item_id", "normalized").join(judged.filter("outcome = 'written'").select("track", "item_id", "effective", "container"), "track")
    final = settled(spelled(good, resources, settings))
    gate = placeholder_gate(final, settings=settings).select("track", F.col("discard").alias("murky"))
    clean = final.join(gate.filter("not murky").select("track"), "track").withColumn("text", writers.srt_body(F.col("text")))
    timed = cues.normalize_timings(cues.coalesce_duplicates(clean.select("track", "seq", "start", "end", "text")))
    timed = settled(timed.join(clean.select("track", "seq", "v", "h", "r", "g", "b", "container"), ["track", "seq"]))
    bodies = writers.srt(timed.filter("container = 'srt'")).unionByName(writers.ass(timed.filter("container = 'ass'")))
    counts = timed.groupBy("track").agg(F.count("*").alias("events"))
    out = judged.join(gate, "track", "left").withColumn("outcome", F.when(F.col("murky"), "unreadable").otherwise(F.col("outcome")))
    stale = F.coalesce(F.col("there") & F.col("outcome").isin("dropped", "unreadable"), F.lit(False))
    out = out.join(counts, "track", "left").join(bodies, "track", "left").withColumn("body", F.when(F.col("outcome") == "written", F.coalesce("body", F.lit("")))).withColumn("stale", stale)
    out = out.select("track", "item_id", "file", F.col("effective").alias("language"), "outcome", F.coalesce("events", F.lit(0)).alias("events"), "body", "stale")
    lost = todo.join(known.select("track"), "track", "left_anti").join(events.select("track", F.lit(True).alias("read")).distinct(), "track", "left")
    silent = lost.select("track", "item_id", F.lit(None).cast("string").alias("file"), F.col("normalized").alias("language"), F.when(F.col("read"), "covered").otherwise("empty").alias("outcome"), F.lit(0).cast("long").alias("events"), F.lit(None).cast("string").alias("body"), F.lit(False).alias("stale"))
    return out.unionByName(silent).join(positioned, "track", "left").withColumn("positioned", F.coalesce("positioned", F.lit(False)))


def scan(items: DataFrame, known: DataFrame, header: DataFrame, text_streams: DataFrame, now: int, window: int, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a scheduled run looks at: items that changed, their image tracks, and the languages their text captions cover.

    items: item_id, item_name, path, kind, virtual, modified. known: item_id, modified, probed. header: path, h. text_streams: item_id,
    language, text.
    """
    chosen = state.unprocessed(state.media_items(items), known, "item_id", now, window, force)
    tracks = probe.stream_palettes(probe.image_streams(header)).join(chosen.select("item_id", "path"), "path")
    tracks = tracks.withColumn("track", F.concat_ws(":", F.col("item_id").cast("string"), F.col("stream_index").cast("string")))
    covered = state.text_languages(text_streams).select("item_id", F.explode("covered").alias("normalized"))
    return chosen, tracks, covered


def protected_words(items: DataFrame, people: DataFrame, header: DataFrame) -> DataFrame:
    """item_id, word: names from an item's metadata and from its file's own tags."""
    own = probe.header_words(header).join(items.select("item_id", "path"), "path").select("item_id", "word")
    return probe.metadata_words(items, people).unionByName(own).distinct()


def log_rows(results: DataFrame, items: DataFrame, when: int) -> DataFrame:
    """Log records of what was written."""
    named_ = items.select("item_id", F.coalesce("item_name", F.lit("")).alias("item_name"))
    return results.filter("outcome = 'written'").join(named_, "item_id").select("item_id", "item_name", F.col("file").alias("path"), "language", "events", F.lit(when).cast("long").alias("when"))


def reprocess(item: object, log: DataFrame, files: DataFrame, run: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Log and files (path, body) after an item is done again: its old files go first, then run() gives results and log rows."""
    own, others = state.split_log(log, item)
    left = files.join(own.select("path").distinct(), "path", "left_anti")
    results, fresh = run()
    written = results.filter("outcome = 'written'").select(F.col("file").alias("path"), "body")
    return others.unionByName(fresh.select(*log.columns)), writers.merge_files(left, written, results.filter("stale").select(F.col("file").alias("path")))


def caption_files(packets: DataFrame, database: bytes, language: str = "und", settings: Settings = Settings()) -> DataFrame:
    """track, body of the caption file of each PGS track (track, seq, start, data) that can be read, all in one language."""
    text = lambda c, v=None: F.lit(v).cast("string").alias(c)
    tracks = packets.select("track").distinct().select("track", F.col("track").cast("string").alias("item_id"), F.concat(F.lit("/"), F.col("track").cast("string")).alias("path"), F.lit(0).alias("stream_index"), text("format", "pgs"), text("language", language), text("title"), *[F.lit(False).alias(c) for c in ("forced", "hearing_impaired", "comment")], F.array().cast("array<int>").alias("palette"))
    done: Column = F.col("outcome") == "written"
    return process(tracks, packets.withColumn("duration", F.lit(None).cast("long")), Resources(database), settings).filter(done).select("track", "body")
