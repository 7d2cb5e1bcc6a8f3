"""Text rules of the retrieval engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list of English and Finnish function words.
STOPWORDS = sorted(
    set(
        (
    "a", "an", "the", "and", "or", "but", "if", "of", "in", "on", "at", "to", "for", "from", "by", "with", "as", "is", "are", "was", "were",
    "be", "been", "being", "do", "does", "did", "have", "has", "had", "this", "that", "these", "those", "it", "its", "his", "her", "their",
    "our", "your", "my", "what", "when", "where", "which", "who", "whom", "how", "why", "than", "then", "so", "such", "into", "about",
    "between", "over", "under", "any", "all", "some", "no", "not", "ja", "on", "ei", "se", "että", "tai", "kuin", "olla", "ovat", "oli",
    "ovatko", "mitä", "mikä", "miten", "miksi", "milloin", "missä", "joka", "jolla", "jonka", "jossa", "jotta", "kun", "vai", "vaan", "mutta",
    "kuitenkin", "myös", "vielä", "jo", "ne", "tämä", "tuo", "voi", "voiko", "saa", "saako", "tulee", "pitää", "olemme", "olen",
)
    )
)
# Cue patterns. Word edges are spelled out so that engines agree on accented letters.
_W = r"[\p{L}\p{N}_]"
CONDITIONAL = rf"(?i)(?<!{_W})(?:if|when|whether|depending|provided|unless|in\s+case|jos|kun|mikäli|ellei)(?!{_W})"
STATUTE_REF = rf"(?i)§|(?<!{_W})(?:TVL|EPL|PerVL|AVL|EVL|laki)(?!{_W})"
YEAR = rf"(?<!{_W})(?:19|20)\d{{2}}(?!{_W})"
CURRENCY = rf"(?i)€|(?<!{_W})(?:EUR|euro(?:a|ja|n)?)(?!{_W})"
MULTIPART = rf"(?i)\?\s*[A-ZÅÄÖ]|(?<!{_W})(?:and|as well as|sekä)(?!{_W})|(?<={_W});\s"
WORD = r"[A-Za-zÅÄÖåäö][A-Za-zÅÄÖåäö0-9'\-]+"
NUMBER = rf"(?<!{_W})\d+(?:[.,]\d+(?!{_W})|[.,](?={_W})|(?!{_W}))"
DIGIT_GAP = r"(\d)[   ](?=\d)"
THOUSANDS = rf"(\d),(\d{{3}}(?!{_W}))"
TOKEN = r"§|[\p{L}\p{N}_]+"


def collapse_numbers(text: Column) -> Column:
    """Digits that spaces or a thousands comma keep apart are joined."""
    joined = F.regexp_replace(text, DIGIT_GAP, "$1")
    return F.regexp_replace(joined, THOUSANDS, "$1$2")


def tokens(text: Column) -> Column:
    """Search tokens in order, repeats included: lower-cased words, numbers and section marks."""
    return F.regexp_extract_all(F.lower(collapse_numbers(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Words of two characters or more that begin with a letter."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def content_words(text: Column) -> Column:
    """The set of lower-cased words of three characters or more that are not in the stop list."""
    low = F.transform(words(text), F.lower)
    long = F.filter(low, lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(long), F.array(*[F.lit(w) for w in STOPWORDS]))


def rare_terms(text: Column) -> Column:
    """The set of lower-cased words that are long (7 or more) or capitalised (4 or more)."""
    kept = F.filter(words(text), lambda w: (F.length(w) >= 7) | (w.rlike("^[A-ZÅÄÖ]") & (F.length(w) >= 4)))
    return F.array_distinct(F.transform(kept, F.lower))


def numeric_tokens(text: Column) -> Column:
    """The set of numbers, with a decimal comma read as a point."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("."))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets over their union; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def share(part: Column, whole: Column) -> Column:
    """How much of the set ``whole`` is in ``part``; 0 if it is empty."""
    return F.when(F.size(whole) == 0, 0.0).otherwise(F.size(F.array_intersect(whole, part)) / F.size(whole))


def strip_diacritics(text: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(text, "åäöéèêëáàâãíìîïóòôõúùûüñçÅÄÖÉÈÊËÁÀÂÃÍÌÎÏÓÒÔÕÚÙÛÜÑÇ", "aaoeeeeaaaaiiiioooouuuuncAAOEEEEAAAAIIIIOOOOUUUUNC")


def sanitize_path(path: Column) -> Column:
    """A path safe on any file system: forward slashes, reserved marks to underscores, segments trimmed, empty ones gone."""
    safe = F.translate(F.translate(path, "\\", "/"), ':?*"<>|', "_______")
    parts = F.transform(F.split(safe, "/"), lambda s: F.btrim(s, F.lit(" .")))
    return F.array_join(F.filter(parts, lambda s: s != ""), "/")


def base_name(path: Column) -> Column:
    """The last segment of a path without its ``.html`` ending."""
    return F.regexp_replace(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1), r"\.html$", "")


def fixed(value: Column, digits: int = 3, signed: bool = False) -> Column:
    """A number with fixed digits, or ``-`` where there is none."""
    shown = F.format_string(f"%{'+' if signed else ''}.{digits}f", value.cast("double"))
    return F.when(value.isNull() | F.isnan(value.cast("double")), "-").otherwise(shown)
