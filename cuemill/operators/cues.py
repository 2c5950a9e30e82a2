"""Operators on timed cues: a row is (track, seq, start, end, text, ...); times are integers of one unit (milliseconds by default)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in milliseconds.
MERGE_GAP, DEFAULT_DURATION, MIN_DISPLAY, MIN_GAP = 250, 4000, 750, 1


def _ordered(track: str) -> Window:
    return Window.partitionBy(track).orderBy("start", "seq")


def coalesce_duplicates(cues: DataFrame, track: str = "track", gap: int = MERGE_GAP) -> DataFrame:
    """Neighbours of equal text whose gap is at most `gap` become one cue: the first one's attributes, the latest end. Apply once."""
    w = _ordered(track)
    fresh = ~(F.lag("text").over(w).eqNullSafe(F.col("text")) & (F.col("start") - F.lag("end").over(w) <= gap)) | F.lag("seq").over(w).isNull()
    marked = cues.withColumn("__fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    island = marked.withColumn("__island", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min(F.struct("start", "seq", "text"))
    return island.groupBy(track, "__island").agg(first.alias("f"), F.max("end").alias("end")).select(track, "f.seq", "f.start", "end", "f.text")


def normalize_timings(cues: DataFrame, track: str = "track") -> DataFrame:
    """Ends only: a default duration, a least display, and never past the next start less the gap."""
    upcoming = F.lead("start").over(_ordered(track))
    held = F.greatest(F.when(F.col("end") <= F.col("start"), F.col("start") + DEFAULT_DURATION).otherwise(F.col("end")), F.col("start") + MIN_DISPLAY)
    pulled = F.when(upcoming - MIN_GAP <= F.col("start"), upcoming).otherwise(upcoming - MIN_GAP)
    return cues.withColumn("end", F.when(held > upcoming - MIN_GAP, pulled).otherwise(held))


def pair_shows(sets: DataFrame, track: str = "track") -> DataFrame:
    """Show sets with the start of the next set that is not ignored as their end; a last one ends at its start, at the default place."""
    kept = sets.filter("kind <> 'ignore'")
    upcoming = F.lead("start").over(_ordered(track))
    out = kept.withColumn("end", F.coalesce(upcoming, F.col("start"))).withColumn("last", upcoming.isNull())
    return out.filter("kind = 'show'")


def resolve_ends(packets: DataFrame, track: str = "track") -> DataFrame:
    """Own duration, else the packet's, else the next packet's start if later, else the start; then undecodable packets go."""
    upcoming = F.lead("start").over(_ordered(track))
    end = F.when(F.col("own") > 0, F.col("start") + F.col("own")).when(F.col("duration") > 0, F.col("start") + F.col("duration")).when(upcoming > F.col("start"), upcoming).otherwise(F.col("start"))
    return packets.withColumn("end", end).filter("decodable")


# What may stand after a sentence's last mark, and before a cue's first letter.
TRAILING = r"(?:</?i>|[\s\u0085\p{Z}])+$"
LEADING = r"^(?:</?i>|[\s\u0085\p{Z}\-‐‑–—\"'“‘¿¡(\[])+"


def ends_sentence(text: Column, placeholder: str = "□") -> Column:
    t = F.regexp_replace(text, TRAILING, "")
    last = F.substr(t, F.length(t), F.lit(1))
    closed = F.when(last.isin('"', "'", "”", "’"), F.substr(t, F.length(t) - 1, F.lit(1))).otherwise(last)
    return F.when((t == "") | t.rlike(r"(?:\.[\s\u0085\p{Z}]*){2,}$|…$") | (last == placeholder), False).when(last.isin(")", "]"), True).otherwise(closed.isin(".", "!", "?") & ((F.length(t) > 1) | ~last.isin('"', "'", "”", "’")))


def capitalize(text: Column) -> Column:
    head = F.regexp_extract(text, LEADING, 0)
    at = F.length(head)
    c = F.substr(text, at + 1, F.lit(1))
    return F.when(c.rlike(r"^\p{Ll}"), F.concat(head, F.upper(c), F.substr(text, at + 2))).otherwise(text)


def sentence_case(cues: DataFrame, track: str = "track", order: str = "seq") -> DataFrame:
    """A cue that opens a track or follows a finished sentence starts with a capital. One lag: capitals never change how a cue ends."""
    before = F.lag("text").over(Window.partitionBy(track).orderBy(order))
    first = F.row_number().over(Window.partitionBy(track).orderBy(order)) == 1
    return cues.withColumn("text", F.when(first | ends_sentence(before), capitalize(F.col("text"))).otherwise(F.col("text")))


# Fixed value: a line that opens with a bracket, after a dash and a label in capitals.
SOUND_CUE = r"(?md)^[ \t]*[-–—]?[ \t]*(?:\p{Lu}[\p{Lu} ]*:[ \t]*)?[\[(][ \t]*\p{L}"


def hearing_impaired(cues: DataFrame, track: str, ratio: float = 0.05, least: int = 20) -> DataFrame:
    """track, cues, sound_cues, sdh: the share of cues that open with a sound cue reaches the ratio."""
    sound = F.regexp_replace("text", "</?i>", "").rlike(SOUND_CUE)
    out = cues.groupBy(track).agg(F.count("*").alias("cues"), F.count_if(sound).alias("sound_cues"))
    return out.withColumn("sdh", (F.col("cues") >= least) & (F.col("sound_cues") / F.col("cues") >= ratio))


def bucket(r: Column, g: Column, b: Column) -> Column:
    """Five bits a channel."""
    return F.shiftleft(F.shiftright(r, 3), 10).bitwiseOR(F.shiftleft(F.shiftright(g, 3), 5)).bitwiseOR(F.shiftright(b, 3))


def modal_color(cues: DataFrame, track: str) -> DataFrame:
    """track, r, g, b: the last colour seen in the fullest bucket, of equal ones the first seen; white without colours."""
    known = cues.filter(F.col("r").isNotNull() & (F.trim("text") != ""))
    by = known.groupBy(track, bucket(F.col("r"), F.col("g"), F.col("b")).alias("bucket")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max_by(F.struct("r", "g", "b"), "seq").alias("c"))
    best = by.groupBy(track).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "c")).alias("m")).select(track, "m.c.r", "m.c.g", "m.c.b")
    every = cues.select(track).distinct()
    return every.join(best, track, "left").select(track, *[F.coalesce(c, F.lit(255)).alias(c) for c in "rgb"])


def uses_color(cues: DataFrame, track: str, least: int = 3) -> DataFrame:
    """track, uses_color: at least two buckets hold `least` cues."""
    by = cues.filter(F.col("r").isNotNull() & (F.trim("text") != "")).groupBy(track, bucket(F.col("r"), F.col("g"), F.col("b")).alias("bucket")).agg(F.count("*").alias("n"))
    return cues.select(track).distinct().join(by.filter(F.col("n") >= least).groupBy(track).agg(F.count("*").alias("k")), track, "left").select(track, (F.coalesce("k", F.lit(0)) >= 2).alias("uses_color"))


def dominant_color(pixels: DataFrame, image: str) -> DataFrame:
    """image, r, g, b: truncated mean of the fullest bucket, null unless it holds 1.5 times the next one."""
    by = pixels.groupBy(image, bucket(F.col("r"), F.col("g"), F.col("b")).alias("bucket")).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in "rgb"])
    top = by.groupBy(image).agg(F.max(F.struct("n", (-F.col("bucket")).alias("x"), "r", "g", "b")).alias("m"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    clear = 2 * F.col("m.n") >= 3 * F.coalesce(F.try_element_at("ns", F.lit(2)), F.lit(0))
    return top.select(image, *[F.when(clear, F.floor(F.col(f"m.{c}") / F.col("m.n")).cast("long")).alias(c) for c in "rgb"])


def utf16_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "xx"))


def italic_spans(text: Column) -> Column:
    """struct(text, spans): the text without <i> tags and its italic runs as (start, len) in UTF-16 units.

    An unclosed run ends with the text, empty runs are dropped, a second opening starts the run anew.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(</?i>|(?:(?!</?i>).)+)".replace("(?:", "(?s:")), F.lit(1))
    none = F.array().cast("array<struct<start:int,len:int>>")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(-1).alias("opened"), none.alias("spans"))

    def closed(s: Column) -> Column:
        run = F.struct(s["opened"].alias("start"), (s["at"] - s["opened"]).alias("len"))
        return F.when((s["opened"] >= 0) & (s["at"] > s["opened"]), F.concat(s["spans"], F.array(run))).otherwise(s["spans"])

    def step(s: Column, p: Column) -> Column:
        tag = p.isin("<i>", "</i>")
        return F.struct(
            F.when(tag, s["text"]).otherwise(F.concat(s["text"], p)).alias("text"),
            F.when(tag, s["at"]).otherwise(s["at"] + utf16_length(p)).cast("int").alias("at"),
            F.when(p == "<i>", s["at"]).when(p == "</i>", -1).otherwise(s["opened"]).cast("int").alias("opened"),
            F.when(p == "</i>", closed(s)).otherwise(s["spans"]).alias("spans"),
        )

    return F.aggregate(pieces, start, step, lambda s: F.struct(s["text"].alias("text"), closed(s).alias("spans")))


def italic_runs(text: Column) -> Column:
    """array<struct(italic, text)>: the text without <i> tags in runs.

    An unclosed run ends with the text, empty runs are dropped, a second opening starts the run anew, a stray closing tag goes.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(</?i>|(?:(?!</?i>).)+)"), F.lit(1))
    none = F.array().cast("array<struct<italic:boolean,text:string>>")
    run = lambda italic, t: F.array(F.struct(F.lit(italic).alias("italic"), t.alias("text")))
    start = F.struct(none.alias("runs"), F.lit(False).alias("open"), F.lit("").alias("held"))

    def closed(s: Column, italic: bool) -> Column:
        return F.when(s["held"] != "", F.concat(s["runs"], run(italic, s["held"]))).otherwise(s["runs"])

    def step(s: Column, p: Column) -> Column:
        opens, ends = p == "<i>", p == "</i>"
        plain = F.concat(s["held"], p)
        return F.struct(
            F.when(opens, closed(s, False)).when(ends & s["open"], closed(s, True)).otherwise(s["runs"]).alias("runs"),
            F.when(opens, True).when(ends, False).otherwise(s["open"]).alias("open"),
            F.when(opens | ends & s["open"], "").when(ends, s["held"]).otherwise(plain).alias("held"),
        )

    return F.aggregate(pieces, start, step, lambda s: F.when(s["open"], closed(s, True)).otherwise(closed(s, False)))


def emit_italics(runs: Column, opening: str, closing: str, plain: Callable[[Column], Column] = lambda t: t) -> Column:
    """Text of runs, italic ones between the marks of a format; of abutting runs the first closes before the second opens."""
    marked = F.transform(runs, lambda r: F.when(r["italic"], F.concat(F.lit(opening), plain(r["text"]), F.lit(closing))).otherwise(plain(r["text"])))
    return F.array_join(marked, "")
