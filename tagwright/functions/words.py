"""Word lists and constants that results depend on."""

# English stop words as shipped with Spark's StopWordsRemover.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
"""


def stop_words(text: str = ENGLISH) -> list[str]:
    """The list plus the pieces its entries fall into when text is cut at apostrophes."""
    listed = text.split()
    pieces = {piece for word in listed for piece in word.split("'") if piece}
    return sorted(pieces | set(listed))


# The short stop list of the n-gram blocks for the ridge model.
SHORT_STOP_WORDS = ["the", "a", "an", "is", "it", "this"]

# Characters a brand word may consist of (inside a regex class).
BRAND_CHARS = "a-z0-9*/+\\-'’?!.,|&%®™ôèéü"

# Characters of a word (inside a regex class).
WORD = r"\p{L}\p{N}_"

# A number with a unit of gold, and a number with a unit of two letters.
KARATS = r"(\p{Nd})([\s-]?)(karat|karats|carat|carats|kt)([^\p{L}\p{N}_])"
UNITS = r"(\p{Nd}+)[\s-]([a-z]{2})(\s)"

# Spellings that a reader of delimited text takes as missing.
NA_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The price used when no estimate exists.
FALLBACK_PRICE = 26.7
