from pyspark.sql import functions as F

from tagwright.functions import text as tx
from tagwright.operators import clean
from tagwright.operators.porter import stem_words
from tagwright.operators.stats import scaled


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(fn(F.col("t")).alias("out")).first()["out"]


def test_category_depth(spark):
    rows = spark.createDataFrame([("A/B/C/D",), ("A/B",), (None,)], "category_name string")
    got = clean.with_categories(rows).fillna("missing", clean.LEVELS).collect()
    assert [tuple(r[c] for c in clean.LEVELS) for r in got] == [
        ("A", "B", "C"), ("A", "B", "missing"), ("No Label", "No Label", "No Label"),
    ]
    four = clean.with_categories4(rows).collect()
    assert four[1]["gen_subcat1"] == "other/other" and four[0]["gen_subcat1"] == "A/B"


def test_category_paths(spark):
    assert one(spark, "Men/Tops/T-shirts", tx.category_paths) == ["men", "men/tops", "men/tops/t-shirts"]


def test_karats_then_units(spark):
    fix = lambda c: tx.glue_units(tx.normalize_karats(c))
    assert one(spark, "14 karats gold 10 oz box", fix) == "14k gold 10oz box"
    assert one(spark, "14 karaté", tx.normalize_karats) == "14 karaté"


def test_words_keep_accents(spark):
    assert one(spark, "Élan_1, vital!", tx.tokenize_words) == ["élan_1", "vital"]
    assert one(spark, "The X-ray isn't 4U2 ok", tx.normalize_text) == "ray 4u2 ok"
    assert one(spark, "  ", tx.tokenize_words) == []


def test_ngrams_of_short_rows(spark):
    grams = lambda c: tx.ngrams_upto(F.filter(F.split(c, " "), lambda w: w != ""), 3)
    assert one(spark, "a b c", grams) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, "a", grams) == ["a"]
    assert one(spark, "", grams) == []


def test_placeholder_description(spark):
    lowered = lambda c: tx.blank_description(F.lower(c))
    assert one(spark, "No description yet", lowered) == ""
    literal = lambda c: tx.blank_description(F.lower(c), literal=True)
    assert one(spark, "No description yet", literal) == "no description yet"


def test_text_stats_divide_by_nothing(spark):
    row = spark.createDataFrame([("abc 12",)], "t string").select(
        *[c.alias(n) for n, c in tx.text_stats(F.col("t")).items()]
    ).first()
    assert (row["n_words"], row["n_upper"], row["n_alpha"]) == (2, 0, 3)
    assert row["mean_upper"] == 0.0 and row["mean_len_words"] == 3.0


def test_char_codes(spark):
    assert one(spark, "aé😀", lambda c: tx.char_codes(c, 5)) == [97, 233, 128512, 0, 0]


def test_constant_column_scales_to_minus_one(spark):
    got = spark.range(1).select(
        scaled(F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("a"), scaled(F.lit(8.0), F.lit(2.0), F.lit(6.0)).alias("b")
    ).first()
    assert (got["a"], got["b"]) == (-1.0, 2.0)


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin",
    "adjustable": "adjust", "replacement": "replac", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll",
    "dying": "die", "is": "is", "say": "say", "enjoy": "enjoy", "cried": "cri", "died": "die",
}


def test_porter_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "token string")
    got = {r["token"]: r["stem"] for r in stem_words(rows).collect()}
    assert got == STEMS


def test_stemmer_equals_its_sql(spark):
    """Every ending of the rules on stems of several shapes, next to the known words."""
    import duckdb

    from tagwright.plans import stem_oracle

    ends = [e for part in (stem_oracle.SECOND, stem_oracle.THIRD, stem_oracle.FOURTH) for e, _ in stem_oracle.pairs(part)]
    ends += ["logi", "ing", "ed", "eed", "ied", "ies", "sses", "s", "y", "e", "ll", "tting", "lled", "ying", ""]
    stems = ["", "b", "a", "y", "by", "say", "toy", "tr", "hop", "fall", "relat", "yell", "adopt", "syzyg", "été", "x2y", "buyer"]
    words = sorted({s + e for s in stems for e in ends} - {""} | set(STEMS))
    rows = spark.createDataFrame([(w,) for w in words], "token string")
    got = {r["token"]: r["stem"] for r in stem_words(rows).collect()}
    listed = ", ".join(f"('{w}')" for w in words)
    steps = stem_oracle.stem_steps(f"SELECT token FROM (VALUES {listed}) v(token)")
    head = ", ".join(f"{k} AS ({v})" for k, v in steps.items())
    want = dict(duckdb.connect().sql(f"WITH {head} SELECT token, stem FROM stems").fetchall())
    assert got == want
    assert {w: want[w] for w in STEMS} == STEMS
