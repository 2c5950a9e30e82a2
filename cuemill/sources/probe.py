"""Sources: probe headers (JSON), packet indexes (CSV), hex dumps, palettes, fix lists (XML), dictionaries and state files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = """
streams array<struct<index:int,codec_name:string,extradata:string,tags:map<string,string>,disposition:map<string,int>>>,
chapters array<struct<tags:map<string,string>>>, format struct<tags:map<string,string>>
"""
# Codec names of image captions and their formats.
CODECS = {"dvd_subtitle": "vobsub", "dvdsub": "vobsub", "vobsub": "vobsub", "hdmv_pgs_subtitle": "pgs", "pgssub": "pgs"}
# Technical tag names whose values hold no content words.
TECHNICAL = ["encoder", "encoder_options", "creation_time", "duration", "language", "filename", "mimetype", "bps"]
WORD = r"(\p{L}{2,})"
# The palette that stands in for a missing one.
DEFAULT_PALETTE = [0x000000, 0x0000FF, 0x00FF00, 0xFF0000, 0xFFFF00, 0xFF00FF, 0x00FFFF, 0xFFFFFF, 0x808000, 0x8080FF, 0x800080, 0x80FF80, 0x008080, 0xFF8080, 0x555555, 0xAAAAAA]


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """path and the parsed header of every probe file."""
    raw = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return raw.select("path", F.from_json("value", PROBE).alias("h"))


def image_streams(head: DataFrame) -> DataFrame:
    """A row for each image stream; other codecs go."""
    s = head.select("path", F.explode("h.streams").alias("s"))
    codec = F.create_map(*[F.lit(x) for kv in CODECS.items() for x in kv])
    flag = lambda name: F.coalesce(F.try_element_at("s.disposition", F.lit(name)) == 1, F.lit(False)).alias(name)
    tag = lambda name: F.try_element_at("s.tags", F.lit(name)).alias(name)
    out = s.select("path", F.col("s.index").alias("stream_index"), F.try_element_at(codec, F.lower("s.codec_name")).alias("format"), tag("language"), tag("title"), flag("forced"), flag("hearing_impaired"), flag("comment"), F.col("s.extradata").alias("extradata"))
    return out.filter("format is not null")


def content_words(tags: Column) -> Column:
    """Words of two letters or more, in lower case, of tags that carry content."""
    kept = F.map_filter(tags, lambda k, v: ~F.lower(k).isin(TECHNICAL) & ~k.startswith("_") & ~F.lower(k).contains("statistics"))
    return F.array_distinct(F.flatten(F.transform(F.map_values(kept), lambda v: F.regexp_extract_all(F.lower(v), F.lit(WORD), F.lit(1)))))


def header_words(head: DataFrame) -> DataFrame:
    """path, word: of format and chapter tags, and of the titles of all streams."""
    titles = F.transform("h.streams", lambda s: F.coalesce(F.regexp_extract_all(F.lower(F.try_element_at(s["tags"], F.lit("title"))), F.lit(WORD), F.lit(1)), F.array().cast("array<string>")))
    chapters = F.transform("h.chapters", lambda c: F.coalesce(F.regexp_extract_all(F.lower(F.try_element_at(c["tags"], F.lit("title"))), F.lit(WORD), F.lit(1)), F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce(content_words(F.col("h.format.tags")), none), F.coalesce(F.flatten(titles), none), F.coalesce(F.flatten(chapters), none))
    return head.select("path", F.explode(F.array_distinct(every)).alias("word"))


def parse_hex_dump(dump: Column) -> Column:
    """Bytes of a dump: of each line, after its first colon if it has one, up to 16 bytes, ended by two blanks or what is no pair of digits."""
    body = lambda s: F.regexp_replace(F.regexp_extract(s, r"^(?:[^:]*:)?((?: ?[0-9a-fA-F]{2})*)", 1), " ", "")
    return F.unhex(F.array_join(F.transform(F.split(F.coalesce(dump, F.lit("")), "\n"), lambda s: F.substr(body(s), F.lit(1), F.lit(32))), ""))


def stream_palettes(streams: DataFrame) -> DataFrame:
    """Image streams with `palette`: the dump in their extradata read as text, the default without one."""
    text = parse_hex_dump(F.col("extradata")).cast("string")
    return streams.withColumn("palette", parse_palette(F.when(F.col("extradata").isNotNull(), text)))


def parse_palette(text: Column) -> Column:
    """16 colours as integers of the `palette:` line, padded with black; the default palette without one."""
    line = F.regexp_extract(text, r"(?im)^[ \t]*palette:[ \t]*((?:[0-9a-f]{1,6}[ \t]*,?[ \t]*)+)", 1)
    values = F.transform(F.regexp_extract_all(line, F.lit("([0-9a-fA-F]{1,6})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))
    padded = F.slice(F.concat(values, F.array_repeat(F.lit(0), 16)), 1, 16)
    return F.when(text.isNull() | (line == ""), F.array(*[F.lit(x) for x in DEFAULT_PALETTE])).otherwise(padded)


def packet_index(spark: SparkSession, path: str, streams: DataFrame) -> DataFrame:
    """path, stream_index, seq, pts, duration, size of index lines `stream,pts,duration,size`; bad rows and unwanted streams go.

    An index is read whole, so seq is a line's number in its file, whatever the partitions. streams: stream_index, and path if it matters.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("seq", "value"))
    raw = lines.withColumn("f", F.split("value", ","))
    number = lambda i, kind: F.expr(f"try_cast(f[{i}] as {kind})")
    rows = raw.filter(F.size("f") >= 4).select("path", number(0, "int").alias("stream_index"), "seq", F.coalesce(number(1, "double"), F.lit(0.0)).alias("pts"), number(2, "double").alias("duration"), number(3, "int").alias("size"))
    keys = [c for c in ("path", "stream_index") if c in streams.columns]
    return rows.filter("stream_index is not null and size >= 0").join(streams.select(*keys).distinct(), keys, "left_semi")


def slice_payloads(placed: DataFrame, payloads: DataFrame) -> DataFrame:
    """Cuts packets (offset, size) out of their stream's payload."""
    return placed.join(payloads, "stream_index").withColumn("data", F.substring("payload", F.col("offset").cast("int") + 1, F.col("size"))).drop("payload")


def fix_list(spark: SparkSession, path: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Whole-word fixes (of equal words the last wins) and regular expressions (find, replacement), in order, of one XML list.

    A list is a small file that the driver reads. Sections of partial words are not used; expressions that are invalid are skipped, a
    file that is missing or no XML gives an empty list. Expressions are Java's.
    """
    import xml.etree.ElementTree as tree

    try:
        root = tree.fromstring(spark.read.text(path, wholetext=True).first()["value"])
    except (tree.ParseError, TypeError):
        return {}, []
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}, []
    words = {w.get("from"): w.get("to") for part in root.findall("WholeWords") for w in part.findall("Word") if w.get("from") and w.get("to") is not None}
    rules = [(r.get("find"), r.get("replaceWith")) for part in root.findall("RegularExpressions")[:1] for r in part.findall("RegularExpression")]
    return words, [(find, to) for find, to in rules if find and to is not None and _compiles(spark, find)]


def _compiles(spark: SparkSession, pattern: str) -> bool:
    from pyspark.errors import IllegalArgumentException

    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # what an invalid pattern raises is one
        return False
    return True


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word (lower case), freq of a word list: a word a line, flags after a slash, a first line that counts; a missing list is empty."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "word string, freq int")
    word = F.lower(F.trim(F.regexp_replace("value", r"(?<!\\)/.*$|\t.*$", "")))
    return lines.select(word.alias("word")).filter((F.col("word") != "") & ~F.col("word").rlike(r"^\d+$")).distinct().withColumn("freq", F.lit(1))


def save_state(state: DataFrame, path: str) -> None:
    """Writes a state table as JSON beside the old one and then takes its place, so that a reader never meets half a table."""
    fs = state.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(state.sparkSession._jsc.hadoopConfiguration())
    at = lambda p: state.sparkSession._jvm.org.apache.hadoop.fs.Path(p)
    fresh, old = path.rstrip("/") + ".next", path.rstrip("/") + ".last"
    state.write.mode("overwrite").json(fresh)
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(fresh), at(path))
    fs.delete(at(old), True)


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table kept as JSON; a missing one is empty, lines that are no JSON go."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("s")).filter("s is not null")
    return parsed.select("s.*").filter("_bad is null").drop("_bad")


def metadata_words(items: DataFrame, people: DataFrame) -> DataFrame:
    """item_id, word (lower case): names that a script may hold.

    items (item_id, series_id, titles array<string>), people (owner_id, type, role, name): roles of actors and guest stars of an item and
    of its series; an actor's own name only if the role says so.
    """
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(1)), none)
    titles = items.select("item_id", F.explode(F.flatten(F.transform(F.coalesce("titles", none), of))).alias("word"))
    owners = items.select("item_id", F.explode(F.array_distinct(F.array_compact(F.array("item_id", "series_id")))).alias("owner_id"))
    own = F.col("role").rlike(r"(?i)^\s*(self|himself|herself|themself|themselves)(?![\p{L}\p{Nd}_])")
    cast = people.filter(F.col("type").isin("Actor", "GuestStar"))
    # words of an owner once, however many people share them: items meet words, not people
    said = cast.select("owner_id", F.explode(F.concat(of(F.col("role")), F.when(own, of(F.col("name"))).otherwise(none))).alias("word")).distinct()
    return titles.unionByName(owners.join(said, "owner_id").select("item_id", "word")).distinct()
