"""Secrets in texts, with DataFrame functions only: fixed formats, and strings that look random.

Every candidate string (a long run of key characters) is read once. A window of ``WINDOW``
characters slides over it; leaving and entering characters change the counts of one character class
at a time, and the sum of ``c * log2(c)`` changes by the two counts touched, so that the entropy of
the next window costs no second look at its characters. A string is reported if some window reaches
the threshold of its class, unless an allow-list explains it.
"""

from __future__ import annotations

from math import log2 as _log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.spans import counted, let, matches, written

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "entropy"]

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
VALUE = r"^[A-Za-z_]+[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)$"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KEY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

WINDOW = 20
# Alphabet and bits per character that a window must reach; a string belongs to the first class
# that holds all its characters.
CLASSES = [
    ("0123456789abcdef", 3.2),
    ("0123456789ABCDEF", 3.2),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=", 3.7),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.9),
]
# Explained otherwise: words and names joined by separators, numbers, paths, identifiers in one case
# without digits, universally unique ids, digests of content ("sha256-...") no longer than in hex.
ALLOWED = [
    r"^[A-Za-z]+(?:[_/+=-]+[A-Za-z]+)*[_/+=-]*$",
    r"^[0-9_/+=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:md5[-=_].{0,32}|sha1[-=_].{0,40}|sha256[-=_].{0,64}|sha384[-=_].{0,96}|sha512[-=_].{0,128})$",
]
# Rows of one sign. What stands between them is judged by itself.
ROW = r"(.)\1{7,}+"


def _log(count: Column) -> Column:
    """``c * log2(c)``, 0 for no character."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)


def peak_entropy(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits per character) of any window of ``string``; 0 if it is
    shorter than the window. All characters must be in ``alphabet``."""
    head = F.transform(F.split(F.left(string, F.lit(window)), ""), lambda c: F.instr(F.lit(alphabet), c))
    first = F.transform(
        F.sequence(F.lit(1), F.lit(len(alphabet))), lambda k: F.size(F.filter(head, lambda c: c == k))
    )
    bits = lambda s: F.lit(_log2(window)) - s / window

    def slide(acc: Column, step: Column) -> Column:
        """The next window: the character coded ``gone`` leaves, the one coded ``came`` enters."""
        gone, came = step["gone"], step["came"]
        minus, plus = F.get(acc["counts"], gone - 1), F.get(acc["counts"], came - 1)
        change = _log(minus - 1) - _log(minus) + _log(plus + 1) - _log(plus)
        counts = F.transform(
            acc["counts"],
            lambda c, k: c + (k + 1 == came).cast("int") - (k + 1 == gone).cast("int"),
        )
        moved = lambda s: F.struct(
            counts.alias("counts"), s.alias("s"), F.greatest(acc["top"], bits(s)).alias("top")
        )
        return F.when(gone == came, acc).otherwise(let(acc["s"] + change, moved))

    def run(counts: Column) -> Column:
        s = F.aggregate(counts, F.lit(0.0), lambda a, c: a + _log(c))
        start = let(s, lambda s: F.struct(counts.alias("counts"), s.alias("s"), bits(s).alias("top")))
        codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c))
        steps = let(
            codes,
            lambda codes: F.transform(
                F.slice(codes, F.lit(window + 1), F.size(codes)),
                lambda came, i: F.struct(F.get(codes, i).alias("gone"), came.alias("came")),
            ),
        )
        return F.aggregate(steps, start, slide, lambda a: a["top"])

    return F.when(F.length(string) >= window, let(first, run)).otherwise(0.0)


def _allowed(string: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | string.rlike(pattern)
    return allowed


def random_looking(string: Column) -> Column:
    """Whether a candidate string reaches its class's threshold and no allow-list explains it.

    A string with rows of one sign is also judged by the parts between them; as a whole it counts only
    if some part is not explained.
    """

    def over(part: Column) -> Column:
        found = F.when(F.lit(False), False)
        for alphabet, bits in CLASSES:
            inside = part.rlike("^[" + alphabet.replace("-", "") + ("-" if "-" in alphabet else "") + "]+$")
            found = found.when(inside, peak_entropy(part, alphabet) >= bits)
        return F.when(_allowed(part), False).otherwise(F.coalesce(found, F.lit(False)))

    open_parts = F.filter(F.split(string, ROW), lambda p: (p != "") & ~_allowed(p))
    with_rows = F.when(F.size(open_parts) > 0, F.concat(open_parts, F.array(string))).otherwise(open_parts)
    return F.exists(F.when(string.rlike(ROW), with_rows).otherwise(F.array(string)), over)


def _spans(kind: str, found: Column) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")),
    )


def base_spans(text: Column) -> Column:
    long_value = lambda m: F.length(F.regexp_extract(m["hit"], VALUE, 1)) >= 6
    lowered = F.lower(text)
    named = F.contains(lowered, F.lit("passw")) | F.contains(lowered, F.lit("secret"))
    named = named | F.contains(lowered, F.lit("token")) | F.contains(lowered, F.lit("api"))
    return F.concat(
        _spans("assign", F.filter(matches(text, ASSIGN, named & text.rlike("[:=]")), long_value)),
        _spans(
            "access",
            F.filter(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda m: F.length(m["hit"]) >= 20),
        ),
        _spans("hex", matches(text, HEX, text.rlike("[0-9a-f]{24}"))),
    )


def entropy_spans(text: Column) -> Column:
    gate = text.rlike(r"[A-Za-z0-9+/_=-]{20}")
    return _spans("entropy", F.filter(matches(text, KEY, gate), lambda m: random_looking(m["hit"])))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, the digest of the base spans and all spans (base and entropy).

    Null and empty texts have no spans; repeated rows are scanned each; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", base_spans(text).alias("base"), entropy_spans(text).alias("more"))
    return found.select(
        "doc_id",
        *[
            counted("base", i).alias(f"n_{k}") for i, k in enumerate(BASE)
        ],
        F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"),
        written(F.concat("base", "more"), KINDS).alias("spans"),
    )
