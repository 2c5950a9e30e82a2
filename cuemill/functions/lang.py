"""Language codes, legal accents, accent folding and language detection, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO 639-2/B to 639-2/T codes that differ.
B_TO_T = dict(
    alb="sqi", arm="hye", baq="eus", bur="mya", chi="zho", cze="ces", dut="nld", fre="fra", geo="kat", ger="deu", gre="ell",
    ice="isl", mac="mkd", mao="mri", may="msa", per="fas", rum="ron", slo="slk", tib="bod", wel="cym",
)
# ISO 639-1 to 639-2/T codes.
TWO_TO_T = {
    "en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "sv": "swe", "no": "nor", "da": "dan",
    "fi": "fin", "pl": "pol", "cs": "ces", "sk": "slk", "hu": "hun", "ro": "ron", "el": "ell", "ru": "rus", "bg": "bul", "uk": "ukr",
    "sr": "srp", "hr": "hrv", "mk": "mkd", "be": "bel", "tr": "tur", "ar": "ara", "he": "heb", "fa": "fas", "zh": "zho", "ja": "jpn",
    "ko": "kor", "th": "tha", "hi": "hin", "is": "isl", "et": "est", "lv": "lav", "lt": "lit", "sl": "slv", "ca": "cat", "eu": "eus", "gl": "glg",
}
# Languages that are not written in Latin script.
NOT_LATIN = "ell rus bul ukr srp mkd bel kaz kir tgk mon heb yid ara fas urd pus zho jpn kor tha lao khm mya hin ben tam tel kan mal guj pan ori sin hye kat amh tir".split()
# Lower-case accented letters that a language writes.
LEGAL = {
    "eng": "", "fra": "àâçéèêëîïôùûüÿœ", "deu": "äöüß", "spa": "áéíóúüñ", "por": "áâãàçéêíóôõú", "ita": "àèéìòóù", "nld": "áéíóúëïöü",
    "swe": "åäöé", "nob": "æøåé", "nno": "æøåé", "nor": "æøåé", "dan": "æøåé", "fin": "äöå", "isl": "áéíóúýþæöð", "pol": "ąćęłńóśźż",
    "ces": "áčďéěíňóřšťúůýž", "slk": "áäčďéíĺľňóôŕšťúýž", "hun": "áéíóöőúüű", "ron": "ăâîșț", "hrv": "čćđšž", "slv": "čšž",
    "tur": "çğıöşü", "cat": "àéèíïóòúüçŀ", "est": "äöõüšž", "lav": "āčēģīķļņšūž", "lit": "ąčęėįšųūž",
}
# Forms of one letter that Romanian and Turkish spell apart (found, own).
OWN_FORM = {"ron": ("şŞţŢ", "șȘțȚ"), "tur": ("șȘțȚ", "şŞţŢ")}
# Letters that no decomposition reduces, and what they fold to.
STROKED = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H"}
LIGATURES = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss"}
# Function words by language, the reference's 17 lists. The table is a parameter of detect(); further languages go in the same way.
STOPWORDS = {
    "en": "the and you that was for are with they this have what your not his",
    "da": "og er jeg ikke det til har som den med dig mig hvad skal være",
    "no": "og er jeg ikke det til har som den med deg meg hva være ikkje",
    "sv": "och är jag inte att det som på med för den har vad dig mig",
    "fi": "että on ei ja hän minä mutta niin kuin mitä ole tämä siitä täällä",
    "nl": "het een van en dat niet ik de wat met voor maar zijn hebben je",
    "de": "und der die das ist nicht ein ich sie mit auch sich wir was für",
    "fr": "les est pas vous une que qui dans pour je nous avec mais ce sur",
    "es": "que los en un por con para una más como pero esto está muy bien",
    "it": "che il non per una sono con come questo cosa bene mi ti ma gli",
    "pt": "não os uma com para você isso mais como mas então está tudo seu aqui",
    "pl": "nie się jest że co jak ale mnie tak czy jestem tylko tego jego",
    "cs": "se na že je ne co jak ale tak jsem prosím první den tady ještě",
    "hr": "sam što nije ovo za ne je se ali kako mi dobro ovdje ovaj",
    "ro": "să nu este pentru cu ce mai dar aici acum trebuie vreau poate bine",
    "hu": "hogy nem az egy van és ez de még csak vagy mit lesz tudom",
    "tr": "için bir bu ne çok daha ben sen evet hayır önce burada efendim değil",
}
BLANK = r"[\s\u0085\p{Z}]"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalize_language(code: Column) -> Column:
    """639-2/T code in lower case; blank and null become `und`, unknown codes pass."""
    c = F.lower(F.regexp_replace(code, f"^{BLANK}+|{BLANK}+$", ""))
    return F.when(code.isNull() | (c == ""), "und").otherwise(F.coalesce(_lookup(TWO_TO_T, c), _lookup(B_TO_T, c), c))


def to_two_letter(code: Column) -> Column:
    """The 639-1 code, or null."""
    return _lookup({v: k for k, v in TWO_TO_T.items()}, normalize_language(code))


def is_latin_script(code: Column) -> Column:
    return ~normalize_language(code).isin(NOT_LATIN)


def fold_table(language: str) -> tuple[str, str, dict[str, str]]:
    """(from, to) of one translate, and what needs a replace; built by rule from Unicode decompositions of BMP letters."""
    legal = set(LEGAL[language])
    one, to, many = [], [], {}
    for i in range(128, 0x10000):
        c = chr(i)
        if not unicodedata.category(c).startswith("L") or c.lower() in legal or 0xAC00 <= i < 0xD7A4:
            continue
        if c in LIGATURES:
            many[c] = LIGATURES[c]
            continue
        base = STROKED.get(c) or "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn")
        if base and base != c:
            if len(base) == 1:
                one.append(c)
                to.append(base)
            else:
                many[c] = base
    return "".join(one), "".join(to), many


def canonical_forms(text: Column, language: str) -> Column:
    return F.translate(text, *OWN_FORM[language]) if language in OWN_FORM else text


def fold_accents(text: Column, language: str, protected: Column | None = None) -> Column:
    """Accents that the language does not write fold to their base letters, except in protected words (lower-case array)."""
    if language not in LEGAL:
        return text
    one, to, many = fold_table(language)

    def folded(t: Column) -> Column:
        t = F.translate(t, one, to)
        for c, base in many.items():
            t = F.replace(t, F.lit(c), F.lit(base))
        return t

    if protected is None:
        return F.when(text.rlike(r"[^\x00-\x7F]"), folded(text)).otherwise(text)
    pieces = F.regexp_extract_all(text, F.lit(r"(\p{L}[\p{L}']*|[^\p{L}]+)"), F.lit(1))
    kept = F.transform(pieces, lambda w: F.when(F.array_contains(protected, F.lower(w)), w).otherwise(folded(w)))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(kept, "")).otherwise(text)


def word_weights(stopwords: dict[str, str] = STOPWORDS) -> dict[str, int]:
    """12 over the number of lists that hold a word (for the default lists a whole number: at most 4 do)."""
    held: dict[str, int] = {}
    for words in stopwords.values():
        for w in set(words.split()):
            held[w] = held.get(w, 0) + 1
    return {w: 12 // n for w, n in held.items()}


def stopword_rows(spark, stopwords: dict[str, str] = STOPWORDS) -> DataFrame:
    """language, word and weight."""
    weight = word_weights(stopwords)
    return spark.createDataFrame([(k, w, weight[w]) for k, ws in stopwords.items() for w in dict.fromkeys(ws.split())], "language string, word string, weight int")


def detected(docs: DataFrame, text: str, stopwords: dict[str, str] = STOPWORDS, floor: int = 6) -> DataFrame:
    """docs with language, best and second (in twelfths): null unless the best score reaches the floor and 1.4 times the second.

    The stopword table is fixed and small, so each row counts its own hits by hashed sets of literals: no join, no shuffle.
    """
    weight = word_weights(stopwords)
    words = F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "</?i>", "")), F.lit(r"(\p{L}+)"), F.lit(1))
    hits = F.filter(words, lambda w: w.isin(list(weight)))

    def score(language: str) -> Column:
        own = dict.fromkeys(stopwords[language].split())
        kinds = sorted({weight[w] for w in own})
        each = lambda w: F.coalesce(*[F.when(w.isin([x for x in own if weight[x] == k]), k) for k in kinds], F.lit(0))
        return F.aggregate("__hits", F.lit(0).cast("long"), lambda s, w: s + each(w))

    scored = F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("language")) for k in stopwords])
    ranked = docs.withColumn("__hits", hits).withColumn("__s", F.sort_array(F.filter(scored, lambda s: s["score"] > 0), asc=False))
    best, second = (F.coalesce(F.try_element_at("__s", F.lit(i))["score"], F.lit(0)) for i in (1, 2))
    name = F.when((best >= 12 * floor) & (10 * best >= 14 * second), F.col("__s")[0]["language"])
    return ranked.withColumns({"language": name, "best": best, "second": second}).drop("__hits", "__s")


def detect(docs: DataFrame, key: str, text: str, stopwords: dict[str, str] = STOPWORDS, floor: int = 6) -> DataFrame:
    """key, language, best and second of every row, whatever its key."""
    return detected(docs.select(key, F.col(text).alias("__text")), "__text", stopwords, floor).select(key, "language", "best", "second")
