"""Token sets, near-duplicate and conflict predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"
_SPLIT_KEEP_UNDERSCORE = r"[^\p{IsAlphabetic}\p{N}_]+"
# The words that negate.
NEGATIONS = ["no", "not", "never", "cannot", "without", "disable", "disabled"]

# The extensions that make a word a path.
PATH_EXTENSIONS = "php js ts tsx jsx py rs go rb java cs css html json md yml yaml toml twig scss sass vue svelte sh sql".split()


def fts_terms(text: Column, limit: int = 12) -> Column:
    """The first query terms: split but for _, at least 3 bytes long."""
    return F.slice(F.filter(F.split(text, _SPLIT_KEEP_UNDERSCORE), lambda w: F.octet_length(w) >= 3), 1, limit)


def fts_query(text: Column, limit: int = 12) -> Column:
    """The terms quoted and joined by OR."""
    return F.array_join(F.transform(fts_terms(text, limit), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def ordered_tokens(text: Column) -> Column:
    """Lower-cased tokens of 3 characters or more that aren't all digits, in order."""
    words = F.filter(F.split(text, _SPLIT), lambda w: (F.char_length(w) >= 3) & ~w.rlike("^[0-9]+$"))
    return F.transform(words, lambda w: F.lower(w))


def tokens(text: Column) -> Column:
    return F.array_distinct(ordered_tokens(text))


def bigrams(ordered: Column) -> Column:
    """The set of adjacent pairs of an array of tokens."""
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(ordered) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def numbers(text: Column) -> Column:
    """The sorted set of runs of ASCII digits."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))))


def has_negation(text: Column) -> Column:
    words = F.transform(F.split(text, _SPLIT), lambda w: F.lower(w))
    return F.exists(words, lambda w: w.isin(NEGATIONS)) | F.lower(text).contains("n't")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def features(text: Column) -> Column:
    """All that the two predicates need of a text, computed once for a row."""
    ordered = ordered_tokens(text)
    return F.struct(ordered.alias("ordered"), F.array_distinct(ordered).alias("tokens"), bigrams(ordered).alias("bigrams"), numbers(text).alias("numbers"), has_negation(text).alias("negated"))


def near_duplicate(x: Column, y: Column) -> Column:
    """Of two features(): restates the same with the same numbers and polarity."""
    order = (F.size(x["ordered"]) < 2) | (F.size(y["ordered"]) < 2) | (jaccard(x["bigrams"], y["bigrams"]) >= 0.6)
    some = (F.size(x["tokens"]) > 0) & (F.size(y["tokens"]) > 0)
    return some & (jaccard(x["tokens"], y["tokens"]) >= 0.9) & order & (x["numbers"] == y["numbers"]) & (x["negated"] == y["negated"])


def conflict(x: Column, y: Column) -> Column:
    """Of two features(): about the same, with other numbers or the opposite polarity."""
    some = (F.size(x["tokens"]) > 0) & (F.size(y["tokens"]) > 0)
    values = (F.size(x["numbers"]) > 0) & (F.size(y["numbers"]) > 0) & (x["numbers"] != y["numbers"])
    return some & (jaccard(x["tokens"], y["tokens"]) >= 0.4) & (values | (x["negated"] != y["negated"]))


def preview(text: Column, chars: int = 120) -> Column:
    return F.substring(text, 1, chars)


def paths_in(text: Column) -> Column:
    """Path-like candidates: backtick spans first, then words; a slash or a known extension, at most 256 bytes."""
    ext = rf"\.(?:{'|'.join(PATH_EXTENSIONS)})$"
    spans = F.transform(F.regexp_extract_all(text, F.lit("`([^`]*)`"), F.lit(1)), lambda w: F.regexp_replace(w, r"^\s+|\s+$", ""))
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, "^[^A-Za-z0-9/._-]+|[^A-Za-z0-9/._-]+$", ""))
    like = lambda w: (w.contains("/") | w.rlike(ext)) & (F.octet_length(w) <= 256)
    return F.array_distinct(F.filter(F.concat(spans, words), like))
