"""Caption writers: SRT and ASS text per track, output paths, and file sinks. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.operators.cues import bucket, emit_italics, italic_runs, modal_color

# The format of the files.
ASS_HEAD = (
    "[Script Info]\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\nPlayResX: 384\nPlayResY: 288\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,Arial,20,&H00"
)
ASS_MIDDLE = ",&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,10,1\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm, truncated."""
    t = F.floor(ms).cast("long")
    part = lambda unit, size: F.floor(t / unit) % size
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3_600_000), part(60_000, 60).cast("long"), part(1000, 60).cast("long"), (t % 1000).cast("long"))


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc, rounded half away from zero, at least zero."""
    c = F.greatest(F.round(ms / 10.0), F.lit(0.0)).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360_000), (F.floor(c / 6000) % 60).cast("long"), (F.floor(c / 100) % 60).cast("long"), (c % 100).cast("long"))


def alignment(v: Column, h: Column) -> Column:
    column = F.when(h < 0.35, 1).when(h < 0.65, 2).otherwise(3)
    an = column + F.when(v < 0.35, 6).when(v < 0.60, 3).otherwise(0)
    return F.when(an == 2, "").otherwise(F.concat(F.lit("{\\an"), an.cast("string"), F.lit("}")))


def bgr(r: Column, g: Column, b: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (b, g, r)])


def color_override(r: Column, g: Column, b: Column, sr: Column, sg: Column, sb: Column) -> Column:
    return F.when(r.isNotNull() & (bucket(r, g, b) != bucket(sr, sg, sb)), F.concat(F.lit("{\\c&H"), bgr(r, g, b), F.lit("&}"))).otherwise("")


def ass_body(marked: Column) -> Column:
    """Text with <i> tags by its italic runs: braces of the text escaped, line breaks as \\N, runs between override codes."""
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")), F.lit("\n"), F.lit("\\N"))
    return F.when(marked.contains("<"), emit_italics(italic_runs(marked), "{\\i1}", "{\\i0}", escaped)).otherwise(escaped(marked))


def srt_body(marked: Column) -> Column:
    """Text with <i> tags by its italic runs: every run closed, none empty."""
    return F.when(marked.contains("<"), emit_italics(italic_runs(marked), "<i>", "</i>")).otherwise(marked)


def _joined(lines: DataFrame, track: str, order: str = "start") -> DataFrame:
    files = lines.groupBy(track).agg(F.sort_array(F.collect_list(F.struct(order, "seq", "line"))).alias("ls"))
    return files.select(track, F.array_join(F.col("ls.line"), "").alias("body"))


def srt(cues: DataFrame, track: str = "track") -> DataFrame:
    """track, body: blank cues go, the rest is numbered from 1; a track's cues are one file, so they are gathered per track."""
    kept = cues.filter(F.regexp_replace("text", r"[\s\p{Z}\u0085]+", "") != "")
    number = F.row_number().over(Window.partitionBy(track).orderBy("start", "seq"))
    line = F.concat(number.cast("string"), F.lit("\r\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\r\n"), F.replace(srt_body(F.col("text")), F.lit("\n"), F.lit("\r\n")), F.lit("\r\n\r\n"))
    return _joined(kept.withColumn("line", line), track)


def ass(cues: DataFrame, track: str = "track") -> DataFrame:
    """track, body: header in the modal colour, a dialogue row for each cue that is not blank."""
    style = modal_color(cues, track).select(track, F.col("r").alias("sr"), F.col("g").alias("sg"), F.col("b").alias("sb"))
    kept = cues.filter(F.regexp_replace("text", r"[\s\p{Z}\u0085]+", "") != "").join(style, track)
    over = color_override(*[F.col(c) for c in ("r", "g", "b", "sr", "sg", "sb")])
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start")), F.lit(","), ass_time(F.col("end")), F.lit(",Default,,0,0,0,,"), alignment(F.col("v"), F.col("h")), over, ass_body(F.col("text")), F.lit("\n"))
    bodies = _joined(kept.withColumn("line", line), track)
    head = F.concat(F.lit(ASS_HEAD), bgr(F.col("sr"), F.col("sg"), F.col("sb")), F.lit(ASS_MIDDLE))
    return style.join(bodies, track, "left").select(track, F.concat(head, F.coalesce("body", F.lit(""))).alias("body"))


def sanitize_tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(tag, F.lit("")), r"[./\x00]", ""))


def output_path(media: Column, language: Column, descriptor: Column, forced: Column, sdh: Column, tag: Column, index: Column, extension: Column) -> Column:
    """folder/name.language[.descriptor][.forced][.sdh][.tag][.index].extension; null parts are left out."""
    folder = F.regexp_extract(media, r"(?s)^(.*/)[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(media, r"(?s)([^/]*)$", 1), r"\.[^.]*$", "")
    blank = lambda c: F.when(c != "", c)
    return F.concat(folder, F.concat_ws(".", stem, language, blank(descriptor), F.when(forced, "forced"), F.when(sdh, "sdh"), blank(sanitize_tag(tag)), index.cast("string"), extension))


def merge_files(current: DataFrame, written: DataFrame, stale: DataFrame) -> DataFrame:
    """The table of files (path, body) after a run: written ones replace what stood at their path, stale paths (path) go."""
    gone = written.select("path").unionByName(stale.select("path")).distinct()
    return current.select("path", "body").join(gone, "path", "left_anti").unionByName(written.select("path", "body"))


def write_files(files: DataFrame, folder: str) -> None:
    """One Parquet row for each file (path, body): a distributed, atomic sink; single files are cut from it where they are served."""
    files.write.mode("overwrite").parquet(folder)
