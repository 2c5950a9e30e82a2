"""The registered queries over the driver's tables and their SQL oracles (DuckDB).

The tables hold no captions, so queries frame them as cues, packets or items, and damage texts by a pure function of the key that both
dialects spell alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import lang, textfix
from cuemill.operators import cues, glyphs, spell, state
from cuemill.plans import captions
from cuemill.sources import probe, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- timed cues ---------------------------------------------------------------------------------------------------------------------

EVENT_CUES = """cues AS (
  SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS track, event_id AS seq,
    CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS BIGINT) AS start,
    CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) + CASE WHEN event_type = 'error' THEN 0 ELSE round(value) END AS BIGINT) AS "end",
    event_type AS text FROM events)"""
COALESCED = """flagged AS (
  SELECT *, CASE WHEN lag(text) OVER w = text AND start - lag("end") OVER w <= 250 THEN 0 ELSE 1 END AS fresh FROM cues WINDOW w AS (PARTITION BY track ORDER BY start, seq)
), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY start, seq) AS island FROM flagged
), merged AS (SELECT track, arg_min(seq, (start, seq)) AS seq, min(start) AS start, max("end") AS "end", min(text) AS text FROM islands GROUP BY track, island)"""


def event_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues: a track a day, seconds read as milliseconds, an error lasting no time."""
    second = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")
    last = F.when(F.col("event_type") == "error", 0).otherwise(F.round("value").cast("long"))
    return table(spark, sf_dir, "events").select(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("track"), F.col("event_id").alias("seq"), second.alias("start"), (second + last).alias("end"), F.col("event_type").alias("text"))


@query(f'WITH {EVENT_CUES}, {COALESCED} SELECT track, seq, start, "end", text FROM merged')
def coalesce_cues(spark, sf_dir):
    return cues.coalesce_duplicates(event_cues(spark, sf_dir))


@query(f"""WITH {EVENT_CUES}, {COALESCED}, held AS (
  SELECT *, greatest(CASE WHEN "end" <= start THEN start + 4000 ELSE "end" END, start + 750) AS h, lead(start) OVER (PARTITION BY track ORDER BY start, seq) AS n FROM merged)
SELECT track, seq, start, CASE WHEN n IS NULL OR h <= n - 1 THEN h WHEN n - 1 <= start THEN n ELSE n - 1 END AS "end", text FROM held""")
def normalize_timings(spark, sf_dir):
    return cues.normalize_timings(cues.coalesce_duplicates(event_cues(spark, sf_dir)))


@query(f"""WITH {EVENT_CUES}, s AS (SELECT *, CASE text WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'ignore' ELSE 'show' END AS kind FROM cues),
p AS (SELECT *, lead(start) OVER (PARTITION BY track ORDER BY start, seq) AS n FROM s WHERE kind <> 'ignore')
SELECT track, seq, start, coalesce(n, start) AS "end", n IS NULL AS last FROM p WHERE kind = 'show'""")
def pair_show_clear(spark, sf_dir):
    kind = F.when(F.col("text") == "error", "clear").when(F.col("text") == "signup", "ignore").otherwise("show")
    return cues.pair_shows(event_cues(spark, sf_dir).withColumn("kind", kind)).select("track", "seq", "start", "end", "last")


@query(f"""WITH {EVENT_CUES}, p AS (SELECT track, seq, start, text, CASE WHEN seq % 3 = 0 THEN "end" - start END AS own, CASE WHEN seq % 5 = 0 THEN 100 END AS duration FROM cues),
n AS (SELECT *, lead(start) OVER (PARTITION BY track ORDER BY start, seq) AS n FROM p)
SELECT track, seq, CASE WHEN own > 0 THEN start + own WHEN duration > 0 THEN start + duration WHEN n > start THEN n ELSE start END AS "end" FROM n WHERE text <> 'signup'""")
def resolve_end(spark, sf_dir):
    packets = event_cues(spark, sf_dir).withColumns({"own": F.when(F.col("seq") % 3 == 0, F.col("end") - F.col("start")), "duration": F.when(F.col("seq") % 5 == 0, 100), "decodable": F.col("text") != "signup"})
    return cues.resolve_ends(packets).select("track", "seq", "end")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN lower(left(text, 1)) || substr(text, 2) WHEN (conv_id + turn) % 6 = 2 THEN regexp_replace(text, '[.!?]$', '') ELSE text END AS text FROM conversations),
l AS (SELECT *, lag(text) OVER w AS p, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT *, regexp_replace(p, '(?:</?i>|[\\s\\p{Z}])+$', '') AS q, regexp_extract(text, '^(?:</?i>|[\\s\\p{Z}\\-‐‑–—"''“‘¿¡(\\[])+') AS h FROM l),
e AS (SELECT *, CASE WHEN n = 1 THEN true WHEN q = '' OR regexp_matches(q, '(?:\\.[\\s\\p{Z}]*){2,}$|…$') THEN false WHEN right(q, 1) IN (')', ']') THEN true
  WHEN right(q, 1) IN ('"', '''', '”', '’') THEN length(q) > 1 AND substr(q, length(q) - 1, 1) IN ('.', '!', '?') ELSE right(q, 1) IN ('.', '!', '?') END AS s FROM t)
SELECT conv_id, turn, CASE WHEN s AND regexp_matches(substr(text, length(h) + 1, 1), '\\p{Ll}') THEN h || upper(substr(text, length(h) + 1, 1)) || substr(text, length(h) + 2) ELSE text END AS text FROM e""".replace("\\\\", "\\"))
def sentence_case(spark, sf_dir):
    k = F.col("conv_id") + F.col("turn")
    damaged = F.when(k % 3 == 0, F.concat(F.lower(F.substr("text", F.lit(1), F.lit(1))), F.substr("text", F.lit(2)))).when(k % 6 == 2, F.regexp_replace("text", r"[.!?]$", "")).otherwise(F.col("text"))
    return cues.sentence_case(table(spark, sf_dir, "conversations").withColumn("text", damaged), "conv_id", "turn").select("conv_id", "turn", "text")


@query(r"""WITH d AS (SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'MAN: [' || text WHEN doc_id % 9 = 1 THEN text || ' [aside]' ELSE text END AS text FROM documents),
s AS (SELECT source, count(*) AS cues, count(*) FILTER (regexp_matches(text, '(?m)^[ \t]*[-–—]?[ \t]*(?:\p{Lu}[\p{Lu} ]*:[ \t]*)?[\[(][ \t]*\p{L}')) AS sound_cues FROM d GROUP BY source)
SELECT *, cues >= 20 AND sound_cues / cues >= 0.05 AS sdh FROM s""")
def sdh_flag(spark, sf_dir):
    k = F.col("doc_id") % 9
    docs = table(spark, sf_dir, "documents").select("source", F.when(k == 0, F.concat(F.lit("MAN: ["), "text")).when(k == 1, F.concat("text", F.lit(" [aside]"))).otherwise(F.col("text")).alias("text"))
    return cues.hearing_impaired(docs, "source")


@query("""WITH g AS (SELECT source, length(text) AS glyphs, CASE WHEN doc_id % 3 = 0 THEN length(text) - length(translate(text, 'aeioutnr', '')) ELSE doc_id % 5 END AS unknown FROM documents WHERE length(text) > 0)
SELECT source, count(*) AS cues, count(*) FILTER (unknown > glyphs * 0.4) AS dropped, count(*) FILTER (unknown > glyphs * 0.4) > count(*) * 0.25 AS discard FROM g GROUP BY source""")
def dropped_gate(spark, sf_dir):
    glyphs_ = F.length("text")
    unknown = F.when(F.col("doc_id") % 3 == 0, glyphs_ - F.length(F.translate("text", "aeioutnr", ""))).otherwise(F.col("doc_id") % 5)
    found = table(spark, sf_dir, "documents").select("source", glyphs_.alias("glyphs"), unknown.alias("unknown"))
    return captions.dropped_gate(captions.legible(found), "source")


@query(r"""WITH t AS (SELECT source, CASE WHEN doc_id % 4 = 0 THEN replace(text, 'e', '□') ELSE text END AS text FROM documents),
n AS (SELECT source, length(regexp_replace(text, '[\x{10000}-\x{10FFFF}]', 'xx', 'g')) AS n, length(text) - length(replace(text, '□', '')) AS unread FROM t)
SELECT source, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(unread) AS BIGINT) AS unread, sum(unread) > sum(n) * 0.05 AS discard FROM n GROUP BY source""")
def placeholder_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("e"), F.lit("□"))).otherwise(F.col("text")).alias("text"))
    return captions.placeholder_gate(docs, "source")


# --- colours ------------------------------------------------------------------------------------------------------------------------

COLOURED = """c AS (SELECT user_id AS track, event_id AS seq, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS text,
  CASE WHEN event_type <> 'view' THEN CAST(event_id % 3 * 90 + event_id % 2 AS INTEGER) END AS r, CASE WHEN event_type <> 'view' THEN CAST(event_id % 5 * 12 AS INTEGER) END AS g, CASE WHEN event_type <> 'view' THEN 200 END AS b FROM events),
b AS (SELECT *, (r // 8) * 1024 + (g // 8) * 32 + b // 8 AS bucket FROM c WHERE r IS NOT NULL AND trim(text) <> '')"""


def coloured(spark, sf_dir):
    some = lambda x: F.when(F.col("event_type") != "view", x.cast("int"))
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), i.alias("seq"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("text"), some(i % 3 * 90 + i % 2).alias("r"), some(i % 5 * 12).alias("g"), some(F.lit(200)).alias("b"))


@query(f"""WITH {COLOURED}, n AS (SELECT track, bucket, count(*) AS n, min(seq) AS first, arg_max(r, seq) AS r, arg_max(g, seq) AS g, arg_max(b, seq) AS b FROM b GROUP BY track, bucket),
m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, first) = 1)
SELECT t.track, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b FROM (SELECT DISTINCT track FROM c) t LEFT JOIN m ON m.track = t.track""")
def modal_color(spark, sf_dir):
    return cues.modal_color(coloured(spark, sf_dir), "track")


@query(f"""WITH {COLOURED}, n AS (SELECT track, bucket, count(*) AS n FROM b GROUP BY track, bucket)
SELECT t.track, (SELECT count(*) FROM n WHERE n.track = t.track AND n.n >= 3) >= 2 AS uses_color FROM (SELECT DISTINCT track FROM c) t""")
def uses_color(spark, sf_dir):
    return cues.uses_color(coloured(spark, sf_dir), "track")


@query("""WITH p AS (SELECT l_orderkey AS image, CAST(l_quantity * 5 AS INTEGER) AS r, CAST(l_suppkey % 2 * 100 AS INTEGER) AS g, CAST(l_linenumber AS INTEGER) AS b FROM lineitem),
n AS (SELECT image, (r // 8) * 1024 + (g // 8) * 32 + b // 8 AS bucket, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM p GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, bucket) AS k FROM n)
SELECT image, CAST(CASE WHEN ok THEN r // n END AS BIGINT) AS r, CAST(CASE WHEN ok THEN g // n END AS BIGINT) AS g, CAST(CASE WHEN ok THEN b // n END AS BIGINT) AS b
FROM (SELECT a.*, 2 * a.n >= 3 * coalesce(x.n, 0) AS ok FROM o a LEFT JOIN o x ON x.image = a.image AND x.k = 2 WHERE a.k = 1)""")
def dominant_color(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_quantity") * 5).cast("int").alias("r"), (F.col("l_suppkey") % 2 * 100).cast("int").alias("g"), F.col("l_linenumber").cast("int").alias("b"))
    return cues.dominant_color(pixels, "image")


# --- languages and text -------------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"('{k}', '{w}')" for k, ws in lang.STOPWORDS.items() for w in dict.fromkeys(ws.split()))


@query(f"""WITH l(language, word) AS (VALUES {_STOP}), w AS (SELECT word, 12 // count(*) AS weight FROM l GROUP BY word),
d AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '</?i>', '', 'g')), '\\p{{L}}+')) AS word FROM documents),
s AS (SELECT doc_id, language, CAST(sum(weight) AS BIGINT) AS score FROM d JOIN l USING (word) JOIN w USING (word) GROUP BY doc_id, language),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language DESC) AS k FROM s)
SELECT t.doc_id, CASE WHEN a.score >= 72 AND 10 * a.score >= 14 * coalesce(b.score, 0) THEN a.language END AS language, coalesce(a.score, 0) AS best, coalesce(b.score, 0) AS second
FROM documents t LEFT JOIN o a ON a.doc_id = t.doc_id AND a.k = 1 LEFT JOIN o b ON b.doc_id = t.doc_id AND b.k = 2""")
def detect_language(spark, sf_dir):
    return lang.detect(table(spark, sf_dir, "documents"), "doc_id", "text")


_CODES = ["", " GER ", "fre", "xx", "RU", "zho", "Slo", "en"]
_CASES = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES))
_MAPPED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**lang.TWO_TO_T, **lang.B_TO_T}.items())


@query(f"""WITH c AS (SELECT doc_id, CASE doc_id % 9 {_CASES} ELSE lang END AS code FROM documents),
n AS (SELECT doc_id, CASE WHEN trim(code) = '' THEN 'und' ELSE coalesce(CASE lower(trim(code)) {_MAPPED} END, lower(trim(code))) END AS language FROM c)
SELECT doc_id, language, language NOT IN ({', '.join(f"'{x}'" for x in lang.NOT_LATIN)}) AS latin FROM n""")
def normalize_language(spark, sf_dir):
    code = F.col("lang")
    for i, c in enumerate(_CODES):
        code = F.when(F.col("doc_id") % 9 == i, F.lit(c)).otherwise(code)
    return table(spark, sf_dir, "documents").select("doc_id", lang.normalize_language(code).alias("language"), lang.is_latin_script(code).alias("latin"))


def damaged(spark, sf_dir, modulus: int, changes: dict[int, Callable[[Column], Column]]) -> DataFrame:
    t = F.col("text")
    out = t
    for k, change in changes.items():
        out = F.when(F.col("doc_id") % modulus == k, change(t)).otherwise(out)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", out.alias("text"))


def swap(a: str, b: str) -> Callable[[Column], Column]:
    return lambda t: F.replace(t, F.lit(a), F.lit(b))


def _swapped(modulus: int, pairs: dict[int, tuple[str, str]]) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return "CASE doc_id % " + str(modulus) + " " + " ".join(f"WHEN {k} THEN replace(text, {q(a)}, {q(b)})" for k, (a, b) in pairs.items()) + " ELSE text END"


_DQ = '"' * 4
_QUOTES = {1: (" ", "  "), 2: ("e", "|"), 3: ("a", "’"), 4: (" ", " “"), 5: ("th", "''")}


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(replace(replace(translate(translate(t, '‘’‚‛`´', ''''''''''''''), '“”„‟', '{_DQ}'), '|', 'I'), '''''', '"'), '[ \t]{{2,}}', ' ', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text
FROM (SELECT doc_id, {_swapped(6, _QUOTES)} AS t FROM documents)""")
def quotes_pipes_spaces(spark, sf_dir):
    t = F.replace(F.replace(textfix.straight_quotes(F.col("text")), F.lit("|"), F.lit("I")), F.lit("''"), F.lit('"'))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), f"^{textfix.SPACES}+|{textfix.SPACES}+$", "")
    return damaged(spark, sf_dir, 6, {k: swap(*p) for k, p in _QUOTES.items()}).select("doc_id", t.alias("text"))


_DIGITS = {1: ("o", "0"), 2: ("l", "1"), 3: ("O", "0"), 4: ("x", "X"), 5: ("i", "I"), 6: ("ll", "II"), 7: ("v", "V")}
_TWICE = lambda x, d, u, low: "regexp_replace(" * 4 + x + "".join(rf", '(\p{{{k}}}){d}(\p{{{k}}})', '\1{c}\2', 'g')" for k, c in (("Lu", u), ("Lu", u), ("L", low), ("L", low)))


@query("SELECT doc_id, " + _TWICE(_TWICE("t", "0", "O", "o"), "1", "I", "l") + f" AS text FROM (SELECT doc_id, {_swapped(8, _DIGITS)} AS t FROM documents)")
def zero_one_in_word(spark, sf_dir):
    return damaged(spark, sf_dir, 8, {k: swap(*p) for k, p in _DIGITS.items()}).select("doc_id", textfix.zero_one(F.col("text")).alias("text"))


def _inner(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '(\p{{Ll}})X', '\1x', 'g'), '(\p{{Ll}})V', '\1v', 'g')"
    for _ in range(6):
        x = rf"regexp_replace({x}, '(\p{{Ll}})I', '\1l', 'g')"
    return x


@query(f"SELECT doc_id, {_inner('t')} AS text FROM (SELECT doc_id, {_swapped(8, _DIGITS)} AS t FROM documents)")
def midword_capitals(spark, sf_dir):
    return damaged(spark, sf_dir, 8, {k: swap(*p) for k, p in _DIGITS.items()}).select("doc_id", textfix.inner_capitals(F.col("text")).alias("text"))


_MARKS = {1: (". ", " . "), 2: (",", " ,"), 3: (". ", " . . . "), 4: (" the ", " [ the ) "), 5: ("\n", "  \n-"), 6: (". ", ".. ")}
_SQL_MARKS = _swapped(7, {k: v for k, v in _MARKS.items() if k != 5}).replace(" ELSE text END", " WHEN 5 THEN replace(text, chr(10), '  ' || chr(10) || '-') ELSE text END")


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '([\[(])[ \t]+|[ \t]+([\])])', '\1\2', 'g'), '[ \t]*\.[ \t]*\.(?:[ \t]*\.)*', '…', 'g'), '[ \t]+,', ',', 'g'), '[ \t]+\.', '.', 'g'), '(?m)^([ \t]*)-(\p{{L}})', '\1- \2', 'g'),
  '[ \t]{{2,}}', ' ', 'g'), '[ \t]+(\n)', '\1', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text FROM (SELECT doc_id, {_SQL_MARKS} AS t FROM documents)""")
def bracket_ellipsis_punct(spark, sf_dir):
    t = textfix.punctuation_spaces(textfix.ellipsis(textfix.brackets(F.col("text"))))
    return damaged(spark, sf_dir, 7, {k: swap(*p) for k, p in _MARKS.items()}).select("doc_id", t.alias("text"))


_LANGUAGES = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa"}


def _fold_sql(language: str) -> str:
    one, to, many = lang.fold_table(language)
    x = f"translate(text, '{one}', '{to}')"
    for c, base in many.items():
        x = f"replace({x}, '{c}', '{base}')"
    return x


# texts of a language are folded by the next one's accents, so that there is something to fold
_NEXT = {"en": "fra", "fr": "deu", "de": "spa", "es": "eng"}


@query("SELECT doc_id, CASE lang " + " ".join(f"WHEN '{k}' THEN {_fold_sql(v)}" for k, v in _NEXT.items()) + " ELSE text END AS text FROM documents")
def fold_diacritics(spark, sf_dir):
    t = F.col("text")
    for k, v in _NEXT.items():
        t = F.when(F.col("lang") == k, lang.fold_accents(F.col("text"), v)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


_IL = {1: (" of ", " l "), 2: (" the ", " lt "), 3: (" is ", " 's "), 4: (" to ", " TO: ls it "), 5: (" and ", " n't ")}
_E = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(^|{_E})l($|{_E})', '\1I\2', 'g'), '(^|{_E})l($|{_E})', '\1I\2', 'g'),
  '(\p{{Lu}}{{2,}}:\s*)l([a-z])', '\1I\2', 'g'), '(^|{_E})l([tsnf])($|{_E})', '\1I\2\3', 'g'), '(\p{{L}})[ \t]+(n''t|''(?:s|ll|re|ve|d|m))($|{_E})', '\1\2\3', 'g') AS text
FROM (SELECT doc_id, {_swapped(6, _IL)} AS t FROM documents WHERE lang = 'en')""")
def english_il_fixes(spark, sf_dir):
    return damaged(spark, sf_dir, 6, {k: swap(*p) for k, p in _IL.items()}).filter("lang = 'en'").select("doc_id", textfix.english_il(F.col("text")).alias("text"))


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN translate(upper(replace(text, 'ß', 'SS')), 'COI', 'col') WHEN 2 THEN replace(text, 'the', 'THlS') ELSE text END AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '\p{L}[\p{L}'']*|[^\p{L}]+'), lambda w: CASE WHEN regexp_matches(w, '\p{Lu}.*\p{Lu}') AND NOT regexp_matches(translate(w, 'lcosuvwxz', ''), '\p{Ll}') THEN upper(translate(w, 'l', 'I')) ELSE w END), '') AS text FROM d""")
def allcaps_restore(spark, sf_dir):
    # upper-casing ß differs between the two dialects: translated away in both
    docs = damaged(spark, sf_dir, 4, {1: lambda t: F.translate(F.upper(F.replace(t, F.lit("ß"), F.lit("SS"))), "COI", "col"), 2: swap("the", "THlS")})
    return docs.select("doc_id", textfix.restore_caps(F.col("text")).alias("text"))


_TAGS = {1: (" the ", " <i>the </i>"), 2: (" a ", " <i> a</i> "), 3: (" of ", " <i>of</i> "), 4: (". ", "<i>.</i> ")}


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([ \t]+)</i>', '</i>\1', 'g'), '<i>([ \t]+)', '\1<i>', 'g'), '<i>([^<]?)</i>', '\1', 'g') AS text
FROM (SELECT doc_id, {_swapped(5, _TAGS)} AS t FROM documents)""")
def italic_tidy(spark, sf_dir):
    return damaged(spark, sf_dir, 5, {k: swap(*p) for k, p in _TAGS.items()}).select("doc_id", textfix.italic_tags(F.col("text")).alias("text"))


_LONG = r"length(regexp_replace({}, '[\x{{10000}}-\x{{10FFFF}}]', 'xx', 'g'))"
_SPANNED = _swapped(5, {1: (" the ", " <i>the</i> "), 2: (" a ", "<i></i> a "), 3: (". ", "</i>. <i>x</i> ")}).replace(" ELSE text END", " WHEN 4 THEN text || ' <i>end' ELSE text END")


@query(rf"""WITH t AS (SELECT doc_id, {_SPANNED} AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, '<i>')) AS piece, generate_subscripts(string_split(t, '<i>'), 1) AS k FROM t),
q AS (SELECT doc_id, k, CASE WHEN k = 1 THEN 0 ELSE {_LONG.format("split_part(piece, '</i>', 1)")} END AS inside, {_LONG.format("replace(piece, '</i>', '')")} AS total FROM p),
w AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM q),
s AS (SELECT doc_id, coalesce(string_agg(CAST(place AS BIGINT) || ':' || inside, ',' ORDER BY k) FILTER (inside > 0), '') AS spans FROM w GROUP BY doc_id)
SELECT doc_id, replace(replace(t, '<i>', ''), '</i>', '') AS text, spans FROM t JOIN s USING (doc_id)""")
def italic_spans(spark, sf_dir):
    changes = {1: swap(" the ", " <i>the</i> "), 2: swap(" a ", "<i></i> a "), 3: swap(". ", "</i>. <i>x</i> "), 4: lambda t: F.concat(t, F.lit(" <i>end"))}
    found = damaged(spark, sf_dir, 5, changes).select("doc_id", cues.italic_spans(F.col("text")).alias("p"))
    shown = F.transform("p.spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["len"].cast("string")))
    return found.select("doc_id", "p.text", F.array_join(shown, ",").alias("spans"))


@query(rf"""SELECT doc_id, replace(replace(replace(replace(replace(t, '{{', '\{{'), '}}', '\}}'), chr(10), '\N'), '<i>', '{{\i1}}'), '</i>', '{{\i0}}') || CASE WHEN doc_id % 5 = 4 THEN '{{\i0}}' ELSE '' END AS body
FROM (SELECT doc_id, {_SPANNED.replace("'<i></i> a '", "' {a} '").replace("'</i>. <i>x</i> '", "'. <i>x</i> '")} AS t FROM documents)""")
def ass_bodies(spark, sf_dir):
    changes = {1: swap(" the ", " <i>the</i> "), 2: swap(" a ", " {a} "), 3: swap(". ", ". <i>x</i> "), 4: lambda t: F.concat(t, F.lit(" <i>end"))}
    return damaged(spark, sf_dir, 5, changes).select("doc_id", writers.ass_body(F.col("text")).alias("body"))


_FIX = {"the": "thé", "of": "0f", "and": "&", "que": "quê", "der": "dér"}


@query("""SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda s: array_to_string(list_transform(string_split(s, ' '), lambda w: coalesce(CASE w """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _FIX.items()) + r""" END,
  CASE regexp_replace(w, '[^\p{L}\p{Nd}]+$', '') """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _FIX.items()) + r""" END || substr(w, length(regexp_replace(w, '[^\p{L}\p{Nd}]+$', '')) + 1), w)), ' ')), chr(10)), '^\n+', '') AS text FROM documents""")
def fix_list_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", spell.fix_words(F.col("text"), _FIX).alias("text"))


_SHOUT = {w: w.upper() for w in lang.word_weights() if w.isascii()}
_RULES = [("([a-z])nn([a-z])", "$1m$2"), ("(?i)qu([aeiou])", "k$1"), ("[0-9]{3,}", "#")]


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([a-z])nn([a-z])', '\1m\2', 'g'), '(?i)qu([aeiou])', 'k\1', 'g'), '[0-9]{3,}', '#', 'g') AS t FROM documents),
w(w) AS (VALUES """ + ", ".join(f"('{w}')" for w in _SHOUT) + r""")
SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda s: array_to_string(list_transform(string_split(s, ' '), lambda x: CASE WHEN x IN (SELECT w FROM w) THEN upper(x)
  WHEN regexp_replace(x, '[^\p{L}\p{Nd}]+$', '') IN (SELECT w FROM w) THEN upper(regexp_replace(x, '[^\p{L}\p{Nd}]+$', '')) || substr(x, length(regexp_replace(x, '[^\p{L}\p{Nd}]+$', '')) + 1) ELSE x END), ' ')), chr(10)), '^\n+', '') AS text FROM r""".replace("IN (SELECT w FROM w)", "IN (" + ", ".join(f"'{w}'" for w in _SHOUT) + ")"))
def fix_list_rules(spark, sf_dir):
    """Regular expressions, then a list too long to be a literal in the plan."""
    return table(spark, sf_dir, "documents").select("doc_id", spell.fix_words(F.col("text"), _SHOUT, _RULES).alias("text"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), d AS (SELECT unnest(string_split(p_name, ' ')) AS m, count(*) AS freq FROM part GROUP BY 1),
x AS (SELECT DISTINCT CASE length(w) % 3 WHEN 0 THEN substr(w, 2) WHEN 1 THEN w || 'x' ELSE 'z' || substr(w, 2) END AS word FROM w),
p AS (SELECT word, m, freq, levenshtein(word, m) AS dist FROM x, d WHERE length(word) >= 3 AND levenshtein(word, m) <= CASE WHEN length(word) >= 8 THEN 2 ELSE 1 END)
SELECT word, m AS match, CAST(dist AS INTEGER) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, m) = 1""")
def close_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    w, n = F.col("word"), F.length("word") % 3
    broken = names.select(F.when(n == 0, F.substr(w, F.lit(2))).when(n == 1, F.concat(w, F.lit("x"))).otherwise(F.concat(F.lit("z"), F.substr(w, F.lit(2)))).alias("word"))
    return spell.close_matches(broken, names.groupBy("word").agg(F.count("*").alias("freq")))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) || 'ings' AS w FROM part), d AS (SELECT unnest(string_split(p_name, ' ')) || 'ings' AS m, count(*) AS freq FROM part GROUP BY 1),
x AS (SELECT DISTINCT CASE length(w) % 3 WHEN 0 THEN substr(w, 1, 1) || substr(w, 3, 2) || substr(w, 6) WHEN 1 THEN '#' || substr(w, 2, 2) || '#' || substr(w, 5) ELSE substr(w, 1, 2) || '#' || substr(w, 3, 3) || '#' || substr(w, 6) END AS word FROM w),
p AS (SELECT word, m, freq, levenshtein(word, m) AS dist FROM x, d WHERE length(word) >= 3 AND levenshtein(word, m) <= CASE WHEN length(word) >= 8 THEN 2 ELSE 1 END)
SELECT word, m AS match, CAST(dist AS INTEGER) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, m) = 1""")
def close_match_two(spark, sf_dir):
    """Words two edits away: two letters lost, two changed, two added."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).select(F.concat("word", F.lit("ings")).alias("word"))
    w, n = F.col("word"), F.length("word") % 3
    cut = lambda a, k=None: F.substr(w, F.lit(a)) if k is None else F.substr(w, F.lit(a), F.lit(k))
    broken = F.when(n == 0, F.concat(cut(1, 1), cut(3, 2), cut(6))).when(n == 1, F.concat(F.lit("#"), cut(2, 2), F.lit("#"), cut(5))).otherwise(F.concat(cut(1, 2), F.lit("#"), cut(3, 3), F.lit("#"), cut(6)))
    return spell.close_matches(names.select(broken.alias("word")), names.groupBy("word").agg(F.count("*").alias("freq")))


@query("""WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS m FROM part), w AS (SELECT DISTINCT substr(m, 1, 1) || '□' || substr(m, 3) AS word FROM k WHERE length(m) >= 2),
p AS (SELECT word, m FROM w JOIN k ON length(word) = length(m) AND substr(word, 1, 1) = substr(m, 1, 1) AND substr(word, 3) = substr(m, 3))
SELECT word, min(m) AS match FROM p GROUP BY word HAVING count(*) = 1""")
def wildcard_match(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    w = F.col("word")
    asked = known.filter(F.length(w) >= 2).select(F.concat(F.substr(w, F.lit(1), F.lit(1)), F.lit("□"), F.substr(w, F.lit(3))).alias("word"))
    return spell.wildcard_matches(asked, known)


# --- sources, state and writers -----------------------------------------------------------------------------------------------------


@query("""SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey = o.o_orderkey AND s.o_orderkey % 3 <> 0
  AND s.o_custkey + CASE WHEN s.o_orderkey % 7 = 0 THEN 1 ELSE 0 END = o.o_custkey AND 1000 - s.o_orderkey % 1000 < 500)""")
def incremental_scan(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("modified"))
    seen = items.filter("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("modified") + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("modified"), (F.col("o_orderkey") % 1000).alias("probed"))
    return state.unprocessed(items, seen, "o_orderkey", 1000, 500).select("o_orderkey")


@query("""WITH l AS (SELECT o_orderkey AS id, o_orderpriority || '/' || o_custkey AS path, o_totalprice AS events FROM orders WHERE o_orderkey % 4 <> 0),
f AS (SELECT o_orderkey AS id, lower(o_orderpriority) || '/' || o_custkey AS path, o_totalprice AS events FROM orders WHERE o_orderkey % 4 = 0)
SELECT * FROM l WHERE lower(path) NOT IN (SELECT lower(path) FROM f) UNION ALL SELECT * FROM f""")
def log_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = lambda p: (F.col("o_orderkey").alias("id"), F.concat(p, F.lit("/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_totalprice").alias("events"))
    return state.upsert_log(orders.filter("o_orderkey % 4 <> 0").select(*rows(F.col("o_orderpriority"))), orders.filter("o_orderkey % 4 = 0").select(*rows(F.lower("o_orderpriority"))))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 10000")
def log_cap(spark, sf_dir):
    return state.keep_last(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("""SELECT event_type, CAST(isodow(ts) AS INTEGER) AS weekday, count(*) FILTER (user_id % 2 = 0) AS n_movie, count(*) FILTER (user_id % 2 = 1) AS n_episode, count(*) AS total FROM events GROUP BY 1, 2""")
def stream_census(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.weekday("ts") + 1).alias("weekday"), F.when(F.col("user_id") % 2 == 0, "movie").otherwise("episode").alias("kind"))
    return state.census(rows, ["event_type", "weekday"], "kind", ["movie", "episode"]).orderBy(F.desc("total"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_quantity AS BIGINT) AS size, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, size, CAST("offset" AS BIGINT) AS "offset" FROM p WHERE "offset" + size <= 60 + l_orderkey % 50""")
def payload_offsets(spark, sf_dir):
    index = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("size"))
    lengths = index.select("l_orderkey").distinct().withColumn("payload_length", 60 + F.col("l_orderkey") % 50)
    out = state.payload_offsets(index, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "size", lengths)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "size", "offset")


@query("""SELECT doc_id, lang FROM documents d WHERE lang IN ('en', 'de', 'fr') AND NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 50 = 0 AND c.source = d.source AND c.lang = d.lang)""")
def language_allow_cover(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", state.tagged_language("lang").alias("normalized"))
    covered = docs.filter("doc_id % 50 = 0").select("source", "normalized")
    return state.uncovered(state.allowed(docs, ["en", "ger", "fre"]), covered, "source").select("doc_id", "lang")


@query("""SELECT c_nationkey, CAST(count(*) AS BIGINT) AS tracks, CAST(sum(alike) AS BIGINT) AS alike FROM (SELECT c_nationkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS alike FROM customer) GROUP BY c_nationkey""")
def language_counts(spark, sf_dir):
    tracks = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("normalized"))
    return state.with_language_counts(tracks, "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("tracks"), F.sum("alike").alias("alike"))


@query("""WITH b AS (SELECT p_partkey, p_size, p_brand, CAST(floor(p_retailprice) AS BIGINT) % 20 AS top FROM part), g AS (SELECT * FROM b WHERE p_partkey % 10 = 0)
SELECT b.p_partkey, min(g.p_partkey) AS glyph FROM b JOIN g ON g.p_size = b.p_size AND g.p_brand = b.p_brand AND abs(g.top - b.top) < 5 GROUP BY b.p_partkey""")
def exact_size_probe(spark, sf_dir):
    blobs = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", (F.floor("p_retailprice") % 20).alias("top"))
    return glyphs.exact_size(blobs, blobs.filter("p_partkey % 10 = 0").withColumnRenamed("p_partkey", "glyph"), ["p_partkey"], ["p_size", "p_brand"])


@query("""WITH m AS (SELECT c_custkey, n_nationkey, abs(c_custkey % 97 - n_nationkey * 4) AS errors, abs(c_nationkey - n_nationkey) AS fit FROM customer, nation)
SELECT c_custkey, n_nationkey AS glyph, CAST(errors AS BIGINT) AS errors, CAST(fit AS INTEGER) AS fit FROM m WHERE errors <= 20 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY errors, fit, n_nationkey) = 1""")
def glyph_argmin(spark, sf_dir):
    """A theta join with the 25 templates of a fixed table, scored; the best of each."""
    templates = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("glyph"))
    errors, fit = lambda g: F.abs(F.col("c_custkey") % 97 - g * 4).cast("long"), lambda g: F.abs(F.col("c_nationkey") - g)
    return glyphs.fewest_errors(table(spark, sf_dir, "customer"), templates, ["c_custkey"], errors, fit, 20)


CONVERSATION_CUES = """cues AS (SELECT conv_id AS track, turn AS seq, turn * 61234 + 7 AS start, turn * 61234 + 3456007 AS "end", CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text,
  turn % 10 / 10.0 AS v, conv_id % 10 / 10.0 AS h, CAST(CASE WHEN role = 'user' THEN turn * 9 % 256 END AS INTEGER) AS r, CAST(CASE WHEN role = 'user' THEN 100 END AS INTEGER) AS g, CAST(CASE WHEN role = 'user' THEN conv_id % 256 END AS INTEGER) AS b FROM conversations)"""


def conversation_cues(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id")
    user = lambda x: F.when(F.col("role") == "user", x.cast("int"))
    return table(spark, sf_dir, "conversations").select(conv.alias("track"), turn.alias("seq"), (turn * 61234 + 7).alias("start"), (turn * 61234 + 3456007).alias("end"), F.when(turn % 5 == 4, " ").otherwise(F.col("text")).alias("text"), (turn % 10 / 10.0).alias("v"), (conv % 10 / 10.0).alias("h"), user(turn * 9 % 256).alias("r"), user(F.lit(100)).alias("g"), user(conv % 256).alias("b"))


_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"""WITH {CONVERSATION_CUES}, k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY start, seq) AS n FROM cues WHERE trim(text) <> '')
SELECT track, string_agg(n || chr(13) || chr(10) || {_SRT.format('start')} || ' --> ' || {_SRT.format('"end"')} || chr(13) || chr(10) || replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(10) || chr(13) || chr(10), '' ORDER BY n) AS body FROM k GROUP BY track""")
def srt_lines(spark, sf_dir):
    return writers.srt(conversation_cues(spark, sf_dir))


_ASS = "printf('%d:%02d:%02d.%02d', CAST(round({0} / 10.0) AS BIGINT) // 360000, CAST(round({0} / 10.0) AS BIGINT) // 6000 % 60, CAST(round({0} / 10.0) AS BIGINT) // 100 % 60, CAST(round({0} / 10.0) AS BIGINT) % 100)"
_HEX = "printf('%02X%02X%02X', {2}, {1}, {0})"


@query(f"""WITH {CONVERSATION_CUES}, kept AS (SELECT * FROM cues WHERE trim(text) <> ''), n AS (SELECT track, (r // 8) * 1024 + (g // 8) * 32 + b // 8 AS bucket, count(*) AS n, min(seq) AS first, arg_max(r, seq) AS r, arg_max(g, seq) AS g, arg_max(b, seq) AS b FROM kept WHERE r IS NOT NULL GROUP BY 1, 2),
m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, first) = 1),
s AS (SELECT t.track, coalesce(r, 255) AS sr, coalesce(g, 255) AS sg, coalesce(b, 255) AS sb FROM (SELECT DISTINCT track FROM cues) t LEFT JOIN m ON m.track = t.track),
a AS (SELECT k.*, sr, sg, sb, (CASE WHEN h < 0.35 THEN 1 WHEN h < 0.65 THEN 2 ELSE 3 END) + (CASE WHEN v < 0.35 THEN 6 WHEN v < 0.6 THEN 3 ELSE 0 END) AS an FROM kept k JOIN s USING (track)),
l AS (SELECT track, start, seq, 'Dialogue: 0,' || {_ASS.format('start')} || ',' || {_ASS.format('"end"')} || ',Default,,0,0,0,,' || CASE WHEN an = 2 THEN '' ELSE '{{\\an' || an || '}}' END ||
  CASE WHEN r IS NOT NULL AND (r // 8) * 1024 + (g // 8) * 32 + b // 8 <> (sr // 8) * 1024 + (sg // 8) * 32 + sb // 8 THEN '{{\\c&H' || {_HEX.format('r', 'g', 'b')} || '&}}' ELSE '' END ||
  replace(replace(replace(text, '{{', '\\{{'), '}}', '\\}}'), chr(10), '\\N') || chr(10) AS line FROM a)
SELECT s.track, '{writers.ASS_HEAD}' || {_HEX.format('any_value(sr)', 'any_value(sg)', 'any_value(sb)')} || '{writers.ASS_MIDDLE}' || coalesce(string_agg(line, '' ORDER BY start, seq), '') AS body FROM s LEFT JOIN l ON l.track = s.track GROUP BY s.track""")
def ass_lines(spark, sf_dir):
    return writers.ass(conversation_cues(spark, sf_dir))


@query(r"""SELECT page_id, regexp_extract(url, '^(.*/)[^/]*$', 1) || concat_ws('.', regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), CASE WHEN page_id % 2 = 0 THEN 'en' ELSE 'de' END, CASE WHEN page_id % 5 = 0 THEN 'commentary' END,
  CASE WHEN page_id % 3 = 0 THEN 'forced' END, CASE WHEN page_id % 7 = 0 THEN 'sdh' END, CASE WHEN page_id % 4 <> 0 THEN 'OCR' END, CASE WHEN page_id % 6 = 0 THEN CAST(page_id % 10 AS VARCHAR) END, 'srt') AS path FROM pages""")
def output_paths(spark, sf_dir):
    i = F.col("page_id")
    path = writers.output_path(F.col("url"), F.when(i % 2 == 0, "en").otherwise("de"), F.when(i % 5 == 0, "commentary"), i % 3 == 0, i % 7 == 0, F.when(i % 4 == 0, ".").otherwise("O.CR"), F.when(i % 6 == 0, i % 10), F.lit("srt"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\p{L}{2,}')) AS word FROM pages""")
def metadata_words(spark, sf_dir):
    tags = F.create_map(F.lit("title"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("encoder"), F.lit("made by nobody"), F.lit("_statistics"), F.lit("none of these"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(probe.content_words(tags)).alias("word"))


@query("SELECT p_partkey, hex(encode(p_name || p_brand || p_type)) AS bytes FROM part")
def hex_dump(spark, sf_dir):
    """Dumps of 16 bytes a line, with a gutter of hex look-alikes, read back."""
    digits = F.hex(F.concat("p_name", "p_brand", "p_type").cast("binary"))
    lines = F.transform(F.sequence(F.lit(0), F.ceil(F.length(digits) / 32).cast("int") - 1), lambda i: F.concat(F.lit("0000: "), F.regexp_replace(F.substr(digits, i * 32 + 1, F.lit(32)), "(....)", "$1 "), F.lit("  ab cd")))
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(probe.parse_hex_dump(F.array_join(lines, "\n"))).alias("bytes"))


@query(r"""WITH t AS (SELECT c_custkey AS item_id, unnest(regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '\p{L}{2,}')) AS word FROM customer),
p AS (SELECT s_nationkey AS nation, s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0),
r AS (SELECT c_custkey AS item_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Self ' || s_name ELSE s_name END AS role, CASE WHEN s_suppkey % 2 = 0 THEN 'Actor Number' ELSE '' END AS name FROM customer JOIN p ON nation = c_nationkey)
SELECT item_id, word FROM t UNION SELECT item_id, unnest(regexp_extract_all(lower(role || ' ' || name), '\p{L}{2,}')) FROM r""")
def item_words(spark, sf_dir):
    """Titles of an item, and roles of the people of its series; a name counts only where the role says so."""
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), (-1 - F.col("c_nationkey")).cast("long").alias("series_id"), F.array("c_name", "c_mktsegment").alias("titles"))
    own = F.col("s_suppkey") % 2 == 0
    people = table(spark, sf_dir, "supplier").select((-1 - F.col("s_nationkey")).cast("long").alias("owner_id"), F.when(F.col("s_suppkey") % 3 == 0, "Director").otherwise("Actor").alias("type"), F.when(own, F.concat(F.lit("Self "), "s_name")).otherwise(F.col("s_name")).alias("role"), F.lit("Actor Number").alias("name"))
    return probe.metadata_words(items, people)


@query("""SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS written, count(*) FILTER (o_orderkey % 4 > 0) AS with_streams, count(*) FILTER (o_orderstatus = 'O') AS positioned FROM orders""")
def run_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("long").alias("written"), (F.col("o_orderkey") % 4).alias("image_streams"), (F.col("o_orderstatus") == "O").alias("positioned"))
    return state.run_totals(rows)


@query("""SELECT o_custkey AS item_id, min(o_orderkey) AS first, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS records FROM orders GROUP BY o_custkey""")
def log_by_item(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("seq"))
    return state.log_by_item(log).select("item_id", "first", F.array_join(F.transform("records", lambda r: r["seq"].cast("string")), ",").alias("records"))


@query("""WITH l AS (SELECT DISTINCT lang FROM documents), n AS (SELECT lang, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE lang END AS normalized FROM l)
SELECT normalized, CASE normalized WHEN 'eng' THEN '/a/e.nocr' WHEN 'deu' THEN '/db/g.nocr' WHEN 'fra' THEN '/db/fra.nocr' ELSE '/db/all.nocr' END AS database FROM n""")
def database_paths(spark, sf_dir):
    """Configured, dropped in, general."""
    languages = table(spark, sf_dir, "documents").select(lang.normalize_language(F.col("lang")).alias("normalized"))
    configured = spark.createDataFrame([("ger", "g.nocr", 1), ("de", "late.nocr", 2), ("en", "/a/e.nocr", 0), ("fr", " ", 3)], "language string, path string, position int")
    dropped_in = spark.createDataFrame([("fra.nocr",), ("deu.nocr",), ("notes.txt",)], "name string")
    return state.database_paths(languages, configured, dropped_in, "all.nocr", "/db")


# --- images --------------------------------------------------------------------------------------------------------------------------

#: Bytes of its files for which a table whose rows are much work gets a partition.
DEALT_BYTES = 1 << 20
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _letters() -> tuple[dict[str, np.ndarray], bytes]:
    """A made-up script: a frame around six cells that spell a letter's number; its bitmaps and its glyph database."""
    frame = [[0, 0, 9, 0], [0, 13, 9, 13], [0, 0, 0, 13], [9, 0, 9, 13]]
    cells = [[[2 + 3 * (k % 2), 2 + 4 * (k // 2), 3 + 3 * (k % 2), 2 + 4 * (k // 2)], [2 + 3 * (k % 2), 3 + 4 * (k // 2), 3 + 3 * (k % 2), 3 + 4 * (k // 2)]] for k in range(6)]
    shapes, found = {}, []
    for i, c in enumerate(_ALPHABET, 1):
        ink = frame + [s for k in range(6) if i >> k & 1 for s in cells[k]]
        g = glyphs.Glyph(c, 10, 14, 0, np.array(ink), np.array([s for k in range(6) if not i >> k & 1 for s in cells[k]]))
        shapes[c] = np.zeros((14, 10), bool)
        shapes[c].ravel()[glyphs.stroke_points(g.fg, 10, 14, 10, 14)] = True
        found.append(g)
    return shapes, glyphs.write_database(found)


def drawing() -> Callable[[str], np.ndarray]:
    """Draws a text of small letters and blanks in that script, white on nothing, one line high, as an RGBA array."""
    columns = {c: np.pad(shape, ((0, 0), (0, 1))).T.astype(np.uint8).tobytes() for c, shape in _letters()[0].items()} | {" ": bytes(6 * 14)}

    def draw(text: str) -> np.ndarray:
        line = np.frombuffer(b"".join([columns[c] for c in text]) or bytes(14), np.uint8).reshape(-1, 14).T
        light = np.zeros((18, line.shape[1] + 4), np.uint8)
        light[2:-2, 2:-2] = line * np.uint8(255)
        return np.broadcast_to(light[..., None], (*light.shape, 4))

    return draw


@query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS text, CAST(0 AS INTEGER) AS unknown FROM conversations")
def recognized_lines(spark, sf_dir):
    """Texts drawn as images and read back. The work is in the rows, so they are dealt to all cores, however few files hold them.

    Images are 300 times as large as their texts, so each is drawn where it is read; none travels.
    """
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    dealt = docs.repartition(min(100_000, max(2 * spark.sparkContext.defaultParallelism, size // DEALT_BYTES)), "conv_id", "turn")
    plain = dealt.select("conv_id", "turn", F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).alias("text"))
    return glyphs.recognize(plain, ["conv_id", "turn"], _letters()[1], bitmap="text", image=drawing()).select("conv_id", "turn", "text", "unknown")
