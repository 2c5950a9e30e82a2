"""Incremental state: what to process, what to record, and packet bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.lang import normalize_language


def unprocessed(items: DataFrame, state: DataFrame, key: str, now: int, window: int, force: bool = False) -> DataFrame:
    """Items that changed, were never probed, or were probed longer ago than the window (0: never again)."""
    if force:
        return items
    recent = F.lit(True) if window == 0 else F.lit(now) - F.col("__probed") < window
    known = state.select(F.col(key).alias("__key"), F.col("modified").alias("__modified"), F.col("probed").alias("__probed"))
    return items.join(known, (F.col(key) == F.col("__key")) & (F.col("modified") == F.col("__modified")) & recent, "left_anti")


def upsert_log(log: DataFrame, fresh: DataFrame, path: str = "path") -> DataFrame:
    """Rows of the log whose path (in any case) is written anew make way for the new ones."""
    taken = fresh.select(F.lower(path).alias("__path")).distinct()
    return log.join(taken, F.lower(F.col(path)) == F.col("__path"), "left_anti").unionByName(fresh)


def keep_last(log: DataFrame, order: str, n: int = 10_000) -> DataFrame:
    """The last n rows by order: a limited sort, no window over everything."""
    return log.orderBy(F.desc(order)).limit(n)


def payload_offsets(index: DataFrame, stream: str, order: list[str], size: str, length: DataFrame) -> DataFrame:
    """Offsets of packets in their stream's payload, up to the first that overruns it; length: (stream, payload_length)."""
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = index.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return placed.join(length, stream).filter(F.col("offset") + F.col(size) <= F.col("payload_length")).drop("payload_length")


def census(rows: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Counts by kind and in total."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("total"))


def media_items(items: DataFrame) -> DataFrame:
    """Films and episodes that exist as files."""
    return items.filter(F.col("kind").isin("Movie", "Episode") & ~F.coalesce(F.col("virtual"), F.lit(False)) & F.col("path").isNotNull())


def text_languages(streams: DataFrame, key: str = "item_id") -> DataFrame:
    """key, covered: the normalised languages of an item's text captions (key, language, text); untagged ones tell nothing."""
    tagged = streams.filter("text").filter(F.col("language").isNotNull() & (F.col("language") != ""))
    return tagged.groupBy(key).agg(F.collect_set(normalize_language(F.col("language"))).alias("covered"))


def tagged_language(language: str = "language") -> Column:
    return normalize_language(F.col(language))


def allowed(tracks: DataFrame, languages: Sequence[str], language: str = "normalized") -> DataFrame:
    """Tracks of the chosen languages (codes of any kind); no choice means all."""
    if not languages:
        return tracks
    chosen = tracks.sparkSession.createDataFrame([(x,) for x in languages], "code string").select(normalize_language(F.col("code")).alias(language)).distinct()
    return tracks.join(F.broadcast(chosen), language, "left_semi")  # the setting's few codes


def uncovered(tracks: DataFrame, covered: DataFrame, key: str, language: str = "normalized") -> DataFrame:
    """Tracks whose language no text caption of their item covers; covered: (key, language)."""
    return tracks.join(covered.select(key, language).distinct(), [key, language], "left_anti")


def with_language_counts(tracks: DataFrame, key: str, language: str = "normalized") -> DataFrame:
    """tracks with `alike`: how many image tracks of their item have their tagged language."""
    return tracks.withColumn("alike", F.count("*").over(Window.partitionBy(key, language)))


def database_paths(languages: DataFrame, configured: DataFrame, dropped_in: DataFrame, fallback: str | None, folder: str, language: str = "normalized") -> DataFrame:
    """language, database: the first configured path of the language (language, path, position), else a file named after it in the
    folder (name), else the general path; null means the built-in one. Paths that are not absolute lie in the folder."""
    whole = lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), c))
    own = configured.filter(F.trim("path") != "").select(normalize_language(F.col("language")).alias(language), "path", "position").groupBy(language).agg(F.min_by("path", "position").alias("own"))
    there = dropped_in.select(F.regexp_replace("name", r"\.nocr$", "").alias(language), F.col("name").alias("there")).filter(F.col("there").endswith(".nocr"))
    general = F.lit(fallback if fallback and fallback.strip() else None).cast("string")
    found = languages.select(language).distinct().join(own, language, "left").join(there, language, "left")
    return found.select(language, whole(F.coalesce("own", "there", general)).alias("database"))


def record_probes(state: DataFrame, probed: DataFrame, key: str = "item_id") -> DataFrame:
    """The state after a run: items that succeeded replace what was known of them; failed ones keep theirs and come again."""
    return state.join(probed.select(key).distinct(), key, "left_anti").unionByName(probed)


def run_totals(results: DataFrame) -> DataFrame:
    """written, with_streams, positioned: totals of a run over items (written, image_streams, positioned)."""
    return results.agg(F.coalesce(F.sum("written"), F.lit(0)).alias("written"), F.count_if(F.col("image_streams") > 0).alias("with_streams"), F.count_if("positioned").alias("positioned"))


def log_by_item(log: DataFrame, key: str = "item_id", order: str = "seq") -> DataFrame:
    """key, first, records: an item's log records in their order, items in that of their first record."""
    rest = [c for c in log.columns if c != key]
    grouped = log.groupBy(key).agg(F.min(order).alias("first"), F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("records"))
    return grouped.orderBy("first")


def split_log(log: DataFrame, item: object, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """The records of one item, and those of all others."""
    return log.filter(F.col(key) == F.lit(item)), log.filter(~F.col(key).eqNullSafe(F.lit(item)))


def newest_first(log: DataFrame, when: str = "when", n: int = 10_000) -> DataFrame:
    """The log as it is listed."""
    return log.orderBy(F.desc(when)).limit(n)


def cleared(log: DataFrame) -> DataFrame:
    return log.limit(0)
