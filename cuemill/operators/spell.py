"""Fix lists, wildcard and close-match rules; the source of suggestions is a table, ranked by distance, frequency and word."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.session import settled


#: Fixes that stay a literal map in the plan; a map is searched in line, so larger lists are looked up by hash in Arrow batches.
LITERAL_WORDS = 64


def fix_words(text: Column, words: dict[str, str], rules: Sequence[tuple[str, str]] = ()) -> Column:
    """Regular expressions in their order over the whole text; then per line and blank-parted token the whole token, else the token less its
    trailing marks, which stay. With any fix at all, leading empty lines go."""
    if not words and not rules:
        return text
    for find, to in rules:
        text = F.regexp_replace(text, find, to)
    fixed = _fixed_literally(text, words) if len(words) <= LITERAL_WORDS else _fixed_by_hash(words)(text)
    return F.regexp_replace(fixed, r"^\n+", "")


def _fixed_literally(text: Column, words: dict[str, str]) -> Column:
    if not words:
        return text
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])

    def token(t: Column) -> Column:
        core = lambda stem: F.when(stem != "", F.concat(F.try_element_at(table, stem), F.substr(t, F.length(stem) + 1)))
        return F.coalesce(F.try_element_at(table, t), F.transform(F.array(F.regexp_replace(t, r"[^\p{L}\p{Nd}]+$", "")), core)[0], t)

    line = lambda s: F.array_join(F.transform(F.split(s, " "), token), " ")
    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def _fixed_by_hash(words: dict[str, str]):
    """The same for lists of any length; what decides a letter or digit is Python's isalpha and isdecimal, which are \\p{L} and \\p{Nd}."""
    marks = re.compile(r"[\n ]")

    def token(t: str) -> str:
        if t in words:
            return words[t]
        end = len(t)
        while end and not (t[end - 1].isalpha() or t[end - 1].isdecimal()):
            end -= 1
        return words[t[:end]] + t[end:] if 0 < end < len(t) and t[:end] in words else t

    def text(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for m in marks.finditer(t):
            out += [token(t[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, token(t[at:])])

    def fixed(texts: pd.Series) -> pd.Series:
        return texts.map(text, na_action="ignore")

    return F.pandas_udf(fixed, "string")


def match_case(word: Column, suggestion: Column) -> Column:
    count = lambda kind: F.length(F.regexp_replace(word, rf"[^\p{{{kind}}}]", ""))
    head = F.substr(suggestion, F.lit(1), F.lit(1))
    return F.when((F.length(word) > 1) & (count("Lu") > count("Ll")), F.upper(suggestion)).when(word.rlike(r"^\p{Lu}") & ~head.rlike(r"\p{Lu}"), F.concat(F.upper(head), F.substr(suggestion, F.lit(2)))).otherwise(suggestion)


def wildcard_matches(words: DataFrame, known: DataFrame, placeholder: str = "□", by: Sequence[str] = ()) -> DataFrame:
    """by, word, match: the only known word of its length that agrees wherever the word has no placeholder (at most 2, at most half).

    Joined on length and on the first and the last letter that a word shows, with their places (the third from its end at most, since
    there are two placeholders), so a word meets few candidates.
    """
    gaps = F.length("word") - F.length(F.replace("word", F.lit(placeholder), F.lit("")))
    asked = words.filter((gaps > 0) & (gaps <= 2) & (2 * gaps <= F.length("word"))).select(*by, "word").distinct()
    pattern = F.concat(F.lit("(?iu)^\\Q"), F.replace("word", F.lit(placeholder), F.lit("\\E.\\Q")), F.lit("\\E$"))
    same = lambda c: F.lower(F.upper(c))  # noqa: E731  one form of a letter's cases
    head = F.coalesce(*[F.when(F.substr("word", F.lit(i), F.lit(1)) != placeholder, i) for i in (1, 2, 3)])
    tail = F.coalesce(*[F.when(F.substr("word", F.length("word") - i + 1, F.lit(1)) != placeholder, i) for i in (1, 2, 3)])
    left = asked.withColumns({"n": F.length("word"), "i": head, "j": tail})
    left = left.withColumns({"a": same(F.substr("word", F.col("i"), F.lit(1))), "b": same(F.substr("word", F.col("n") - F.col("j") + 1, F.lit(1)))})
    right = known.select(*by, F.col("word").alias("match")).distinct().withColumn("n", F.length("match"))
    for name, kind in (("i", "a"), ("j", "b")):
        right = right.withColumn(name, F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter(F.col(name) <= F.col("n"))
        right = right.withColumn(kind, same(F.substr("match", F.col("i") if name == "i" else F.col("n") - F.col("j") + 1, F.lit(1))))
    pairs = left.join(right, [*by, "n", "i", "a", "j", "b"]).filter(F.rlike("match", pattern))
    return pairs.groupBy(*by, "word").agg(F.count("*").alias("c"), F.min("match").alias("match")).filter("c = 1").select(*by, "word", "match")


def _free_distance(placeholder: str):
    """Edit distance in which the word's placeholder is free against any character; nothing that Spark has counts like this."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y and x != placeholder))
        return row[-1]

    return F.udf(distance, "int")


def _variants(words: DataFrame, word: str, deletions: int) -> DataFrame:
    """words by `k`: the word less up to so many letters."""
    one = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    words = words.withColumn("k", F.array(F.col(word)))
    for _ in range(deletions):
        words = words.withColumn("k", F.array_distinct(F.concat("k", F.flatten(F.transform(F.filter("k", lambda c: F.length(c) > 0), one)))))
    return words.withColumn("k", F.explode("k"))


def close_matches(words: DataFrame, dictionary: DataFrame, placeholder: str = "□") -> DataFrame:
    """word, match, distance: the nearest dictionary word within distance 1, or 2 from 8 letters on; the word's placeholders are free.

    Both sides join on variants with as many deletions as the distance; a placeholder is one deletion more. Words with over two
    placeholders, whose variants are too many, meet all dictionary words of about their length.

    Distinct words of both sides are computed once, as checkpoints, and variants are made of them. In one plan with what came before,
    filters on variants would be pushed below the distinct and make them for every occurrence, and each kind of word would read anew.
    """
    gaps = F.length("word") - F.length(F.replace("word", F.lit(placeholder), F.lit("")))
    left = settled(words.select("word").filter(F.length("word") >= 3).distinct())
    left = left.select("word", F.when(F.length("word") >= 8, 2).otherwise(1).alias("most"), F.least(gaps, F.lit(3)).alias("gaps"))
    right = settled(dictionary.select(F.col("word").alias("match"), "freq").filter(F.length("match") >= 1).distinct())
    near = left.select("word").limit(0).crossJoin(right.limit(0)).withColumn("d", F.lit(0))
    for most, held in sorted(map(tuple, left.select("most", "gaps").distinct().collect())):  # 8 kinds at most
        asked, known = left.filter((F.col("most") == most) & (F.col("gaps") == held)).select("word"), right.filter(F.length("match") >= (6 if most == 2 else 2))
        if held < 3:
            pairs = _variants(asked, "word", most + held).join(_variants(known, "match", most + held), "k").select("word", "match", "freq").distinct()
        else:
            lengths = F.explode(F.sequence(F.length("word") - most, F.length("word") + most))
            pairs = asked.withColumn("n", lengths).join(known.withColumn("n", F.length("match")), "n").drop("n")
        distance = _free_distance(placeholder)("word", "match") if held else F.levenshtein("word", "match")
        near = near.unionByName(pairs.withColumn("d", distance).filter(F.col("d") <= most))
    return near.groupBy("word").agg(F.min(F.struct("d", (-F.col("freq")).alias("f"), "match")).alias("m")).select("word", F.col("m.match").alias("match"), F.col("m.d").alias("distance"))


def corrections(words: DataFrame, dictionary: DataFrame, protected: DataFrame, placeholder: str = "□", by: Sequence[str] = ()) -> DataFrame:
    """by, word, corrected: what changes of distinct words. dictionary (word, freq) in lower case, protected (by, word).

    Unread glyphs first (at most 2, at most half of the word): the one protected word that agrees. Then words of 3 letters or more that
    the dictionary does not hold, unless they look like names, take the nearest dictionary word in their own case.
    """
    words = words.select(*by, "word").distinct().withColumn("low", F.lower("word"))
    safe = protected.select(*by, F.lower("word").alias("low")).distinct()
    open_ = words.join(safe, [*by, "low"], "left_anti").drop("low")
    wild = wildcard_matches(open_, protected, placeholder, by).select(*by, "word", F.col("match").alias("corrected"))
    gaps = F.length("word") - F.length(F.replace("word", F.lit(placeholder), F.lit("")))
    left = open_.filter((gaps == 0) | ((gaps <= 2) & (2 * gaps <= F.length("word")))).join(wild, [*by, "word"], "left_anti").filter(F.length("word") >= 3)
    count = lambda kind: F.length(F.regexp_replace("word", rf"[^\p{{{kind}}}]", ""))
    name = F.col("word").rlike(r"^\p{Lu}") & ((count("Ll") == 0) | (count("Lu") <= count("Ll")))
    unknown = left.filter(~name).withColumn("low", F.lower("word")).join(dictionary.select(F.col("word").alias("low")).distinct(), "low", "left_anti")
    near = close_matches(unknown.select(F.col("low").alias("word")), dictionary, placeholder).select(F.col("word").alias("low"), "match")
    fixed = unknown.join(near, "low").filter(~F.col("match").rlike(r"\s")).select(*by, "word", match_case(F.col("word"), F.col("match")).alias("corrected"))
    return wild.unionByName(fixed).filter("word <> corrected")


def correct(cues: DataFrame, dictionary: DataFrame, protected: DataFrame, keys: list[str], text: str = "text", placeholder: str = "□", by: Sequence[str] = ()) -> DataFrame:
    """cues with corrected texts, protected words (by, word) holding for cues of equal `by`: tags around a corrected word stay, tags inside it go. Words meet the tables once, however often they occur."""
    mark = "\\Q" + placeholder + "\\E"
    token = rf"((?:</?i>)*\p{{L}}(?:</?i>|\p{{L}}|'|{mark})*)"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){token}|((?!(?:</?i>)*\p{{L}}).)"), F.lit(0))
    parts = cues.select(*dict.fromkeys((*keys, *by)), F.posexplode_outer(pieces).alias("__at", "__piece")).withColumn("word", F.regexp_replace("__piece", "</?i>", ""))
    changed = corrections(parts.filter(F.col("word").rlike(r"^\p{L}")), dictionary, protected, placeholder, by)
    joined = parts.join(changed, [*by, "word"], "left")
    tags = F.regexp_extract("__piece", "^((?:</?i>)*)", 1), F.regexp_extract("__piece", "((?:</?i>)*)$", 1)
    new = F.when(F.col("corrected").isNotNull(), F.concat(tags[0], "corrected", tags[1])).otherwise(F.col("__piece"))
    texts = joined.withColumn("__new", new).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__at", "__new"))).alias("__all"))
    return cues.drop(text).join(texts.select(*keys, F.array_join(F.col("__all.__new"), "").alias(text)), keys)
