"""Text analysis as Column expressions: normal form, tokens, similarity, direction, spans."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that a normal form drops, turns to a space, or folds.
DIACRITICS = r"[ؐ-ًؚ-ٰٟۖ-ۭـ]"
ZERO_WIDTH = r"[‌‍⁠﻿]"
# A term; possessive, as nothing after a part may give it back (Java matches other repeated groups by recursion).
CANDIDATE = r"@?[a-z0-9\p{L}\p{N}]++(?:[._/+:-][a-z0-9\p{L}\p{N}]++)*+"
SEPARATORS = "[._/+:-]+"
# Fixed value: what counts as white space at the ends of a text.
WHITE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(text: Column) -> Column:
    """Without the white space of any kind at its ends (Spark's own ``trim`` takes U+0020 only)."""
    return F.btrim(text, F.lit(WHITE))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"[{WHITE}]+", " "))


# Characters that composition leaves as they are, whatever stands beside them: ASCII, the letters of most
# European languages and of Arabic script, dashes and quotation marks.
STABLE = "\\x00-\\x7F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏء-ي٠-٩ٱ-ٴٹ-ۓ–—‘-„•"


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition, which Spark has no function for.

    Only texts with a character that it could change go through Python.  Where a caller knows
    that texts are composed already, the operators take ``composed=True``.
    """

    @F.arrow_udf("string")
    def composed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    some = (F.octet_length(text) > F.length(text)) & text.rlike(f"[^{STABLE}]")
    return F.coalesce(composed(F.when(some, text)), text)


def canonicalize(text: Column, composed: bool = False) -> Column:
    lowered = F.lower(text if composed else nfkc(text))
    spaced = F.regexp_replace(F.regexp_replace(lowered, DIACRITICS, ""), ZERO_WIDTH, " ")
    # most texts hold none of the characters that are folded, and one search for any of them tells
    folded = (F.octet_length(lowered) > F.length(lowered)) & lowered.rlike(f"[{DIACRITICS[1:-1]}{ZERO_WIDTH[1:-1]}ىيك]")
    return F.when(folded, F.translate(spaced, "ىيك", "ییک")).otherwise(lowered)


def normalize_text(text: Column, composed: bool = False) -> Column:
    """The search form: terms in their order, one space between."""
    return F.array_join(F.regexp_extract_all(canonicalize(text, composed), F.lit(CANDIDATE), 0), " ")


def terms(normal: Column) -> Column:
    """The terms of a search form; none for the empty one."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def parts_of_term(term: Column) -> Column:
    """A term, and if it is compound its parts and the parts joined."""
    bare = F.filter(F.split(F.regexp_replace(term, "^@", ""), SEPARATORS), lambda p: p != "")
    joined = F.array_join(bare, "")
    compound = term.startswith("@") | term.rlike(SEPARATORS)
    more = F.when((joined != "") & (joined != term), F.concat(bare, F.array(joined))).otherwise(bare)
    return F.concat(F.array(term), F.when(compound, more).otherwise(F.array().cast("array<string>")))


def tokens_of(normal: Column) -> Column:
    """The tokens of a search form, compound terms before their parts.

    Texts without compound terms, which are most, are only split.
    """
    whole = F.flatten(F.transform(terms(normal), parts_of_term))
    return F.when(normal.rlike("[@._/+:-]"), whole).when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def tokenize(text: Column, composed: bool = False) -> Column:
    return tokens_of(normalize_text(text, composed))


def unique_tokens(tokens: Column) -> Column:
    """Distinct tokens, first seen first."""
    return F.array_distinct(tokens)


def counted(ordered: Column) -> Column:
    """Structs of token and n from a sorted array of tokens: where each run of equal ones begins, up to the next."""
    first = F.filter(
        F.transform(ordered, lambda t, i: F.when((i == 0) | ~t.eqNullSafe(F.get(ordered, i - 1)), i)), lambda i: i.isNotNull()
    )
    # an array of one, so that the places are worked out once
    return F.flatten(
        F.transform(
            F.array(first),
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(F.get(ordered, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long").alias("n")),
            ),
        )
    )


def token_frequencies(df: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """Rows of id, token and how often it occurs.

    Each row counts its own tokens.  A first look at the ids alone tells whether any has several
    rows; only then are counts of one id added up, which moves them all.
    """
    rows = df.select(id_col, F.sort_array(tokens_col).alias("_ordered"))
    each = rows.select(id_col, F.inline(counted(F.col("_ordered"))))
    if df.groupBy(id_col).count().where("count > 1").isEmpty():
        return each
    return each.groupBy(id_col, "token").agg(F.sum("n").alias("n"))


def frequency_map(df: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """As :func:`token_frequencies`, as one map for each id that has tokens."""
    return token_frequencies(df, id_col, tokens_col).groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("frequencies")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


# Letters of the two directions.
RTL, LATIN = r"[\p{IsArabic}\p{IsHebrew}]", r"\p{IsLatin}"


def text_direction(text: Column) -> Column:
    """``rtl`` or ``ltr``: which letters are more; at a tie the first of them; none: ``ltr``."""
    right, left = F.regexp_count(text, F.lit(RTL)), F.regexp_count(text, F.lit(LATIN))
    first = F.regexp_extract(text, f"({RTL}|{LATIN})", 1)
    return F.when(right > left, "rtl").when(left > right, "ltr").when(first.rlike(RTL), "rtl").otherwise("ltr")


def is_persian(question: Column, preferred: Column) -> Column:
    wish = F.lower(strip(F.coalesce(preferred, F.lit(""))))
    return F.when(wish != "", (wish == "fa") | wish.startswith("fa-") | (wish == "persian")).otherwise(
        F.coalesce(question.rlike("[؀-ۿ]"), F.lit(False))
    )


# Fixed value: links, drive paths, absolute paths and addresses inside prose.
TECHNICAL = r"https?://[^\s<>()]+|www\.[^\s<>()]+|[a-zA-Z]:\\[^\s]+|(?:/[\w.@~:+-]++)++|\b\d{1,3}(?:\.\d{1,3}){3}\b"


def technical_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TECHNICAL), 0)


# Fixed value: a fenced block with its language.
FENCE = r"```([^\n]*)\n([\s\S]*?)```"


def fenced_code(text: Column) -> Column:
    """Structs of language (``text`` where none is named) and code, without the last line feed."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(FENCE), 1).alias("lang"), F.regexp_extract_all(text, F.lit(FENCE), 2).alias("code")
    )
    return F.transform(
        zipped,
        lambda x: F.struct(
            F.when(strip(x["lang"]) == "", "text").otherwise(strip(x["lang"])).alias("lang"),
            F.regexp_replace(x["code"], r"\n$", "").alias("code"),
        ),
    )


def estimated_tokens(text: Column, n_tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4), F.ceil(n_tokens * F.lit(1.3))).cast("int")
