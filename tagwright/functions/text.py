"""Column -> Column functions for names, descriptions and category paths.

All are built-in expressions, so they stay in the JVM and Catalyst can prune around them. Word
characters are spelled as Unicode classes because Java's ``\\w`` covers ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.functions.words import KARATS, UNITS, WORD, stop_words

NO_DESCRIPTION = "no description yet"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, both arrays, with ``value`` computed once per row. An expression used inside a
    lambda is otherwise computed again for every element."""
    return F.flatten(F.transform(F.array(value), body))


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of doubles, which computes by decimal numbers: here only where the product by a power
    of ten cannot tell, that is near a half and beyond 1e9."""
    product = value * float(10**digits)
    told = (F.abs(product) < 1e9) & (F.abs(product - F.rint(product)) < 0.499)
    return F.when(told, F.rint(product) / float(10**digits) + 0.0).otherwise(F.round(value, digits))


# ---- categories -------------------------------------------------------------------------------

def split_category(path: Column, levels: int = 3) -> list[Column]:
    """The first levels of an ``a/b/c`` path. A null path gives 'No Label'; a level the path does
    not have is null, for the missing-value step to fill; levels beyond are ignored."""
    parts = F.split(path, "/", -1)
    return [F.when(path.isNull(), "No Label").otherwise(F.get(parts, F.lit(i))) for i in range(levels)]


def split_category4(path: Column) -> list[Column]:
    """First, second, third level and 'first/second'; all 'other' when there are fewer than three."""
    parts = F.split(path, "/", -1)
    deep = F.size(parts) >= 3
    level = [F.when(deep, F.get(parts, F.lit(i))).otherwise("other") for i in range(3)]
    return [*level, F.concat_ws("/", level[0], level[1])]


def category_paths(path: Column) -> Column:
    """Lower-case, drop all whitespace, list every prefix: ``a``, ``a/b``, ``a/b/c``."""
    levels = F.split(F.regexp_replace(F.lower(path), r"[\s\p{Z}]+", ""), "/", -1)

    def prefixes(parts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
        )

    return F.filter(bound(levels, prefixes), lambda p: p != "")


# ---- words ------------------------------------------------------------------------------------

def normalized_words(text: Column, stop: Sequence[str] | None = None) -> Column:
    """ASCII letters and digits only, lower case, words of two or more characters, no stop words."""
    stop = stop_words() if stop is None else list(stop)
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{2,}"), F.lit(0))
    return F.filter(F.transform(runs, F.lower), lambda w: ~w.isin(stop))


def normalize_text(text: Column, stop: Sequence[str] | None = None) -> Column:
    return F.array_join(normalized_words(text, stop), " ")


def tokenize_words(text: Column) -> Column:
    """Lower case, everything that is no word character separates, in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))


def words_of_two(text: Column, lowercase: bool = True) -> Column:
    """Runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def letter_words(text: Column) -> Column:
    """Lower-case runs of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def _ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    # Single elements are looked up: a slice copies its whole array first, for every gram of a text.
    grams = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - n),
        lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]),
    )
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space."""
    return bound(tokens, lambda t: _ngrams(t, n))


def ngrams_upto(tokens: Column, n: int) -> Column:
    """All runs of 1 to n tokens."""
    return bound(tokens, lambda t: F.concat(*[_ngrams(t, i) for i in range(1, n + 1)]))


def bucket(gram: Column, size: int) -> Column:
    """A stable hash bucket: the first 32 bits of md5, so any engine can recompute it."""
    return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long") % F.lit(size)


def hash_sign(gram: Column) -> Column:
    """+1 or -1 from another byte of the same hash, for signed hashing."""
    odd = F.conv(F.substring(F.md5(gram), 9, 2), 16, 10).cast("int") % 2
    return F.when(odd == 1, -1.0).otherwise(1.0)


# ---- cleaning ---------------------------------------------------------------------------------

def brand_slug(brand: Column) -> Column:
    return F.replace(F.lower(brand), F.lit(" "), F.lit("_"))


def normalize_karats(text: Column) -> Column:
    """'14 karats ' -> '14k '."""
    return F.regexp_replace(text, KARATS, "$1k$4")


def glue_units(text: Column) -> Column:
    """'10 oz ' -> '10oz '. Meant to run after ``normalize_karats``."""
    return F.regexp_replace(text, UNITS, "$1$2$3")


def lower_or_empty(text: Column, empty: str = "") -> Column:
    return F.lower(F.coalesce(text, F.lit(empty)))


def blank_description(text: Column, literal: bool = False) -> Column:
    """Drop the site's placeholder from lower-cased text. ``literal=True`` looks for the
    capitalised spelling, which lower-cased text never contains."""
    mark = NO_DESCRIPTION.capitalize() if literal else NO_DESCRIPTION
    return F.when(text == mark, "").otherwise(text)


# ---- numbers about text -----------------------------------------------------------------------

def text_stats(text: Column) -> dict[str, Column]:
    """Counts of words, upper-case letters and letters, the length, and length per each of them
    (0 where there is nothing to divide by)."""
    length = F.length(text)
    counts = {
        "n_words": F.size(F.filter(F.split(text, r"[\s\p{Z}]+", -1), lambda w: w != "")),
        "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")),
        "n_alpha": F.length(F.regexp_replace(text, r"[^\p{L}]", "")),
    }
    ratios = {
        "mean_len_words": counts["n_words"],
        "mean_upper": counts["n_upper"],
        "mean_alpha": counts["n_alpha"],
    }
    return {
        **counts,
        "n_chars": length,
        **{k: F.coalesce(F.try_divide(length.cast("double"), v), F.lit(0.0)) for k, v in ratios.items()},
    }


def char_codes(text: Column, length: int) -> Column:
    """Code points of the first characters, 0 past the end."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(length)), lambda i: F.ascii(F.substring(text, i, F.lit(1)))
    )
