"""Shared pieces of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

from tagwright.functions.words import stop_words

# Fixed values, written out here so that a slip in ``functions.words`` shows as a difference.
WORD = r"\p{L}\p{N}_"
KARATS = r"(\p{Nd})([\s-]?)(karat|karats|carat|carats|kt)([^\p{L}\p{N}_])"
UNITS = r"(\p{Nd}+)[\s-]([a-z]{2})(\s)"

LISTINGS = """
SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_quantity AS INT)) AS listing_id,
  CASE WHEN l.l_orderkey % 20 = 0 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN l.l_partkey % 53 = 0 THEN NULL
       WHEN l.l_partkey % 3 = 0 THEN concat(b.brand, ' ', p.p_name, ' ', CAST(p.p_size AS VARCHAR), ' oz ')
       ELSE concat(p.p_name, ' ', CAST(p.p_size AS VARCHAR), ' karat gold') END AS name,
  CASE WHEN l.l_partkey % 47 = 0 THEN NULL
       WHEN l.l_partkey % 31 = 0 THEN concat_ws('/', r.r_name, n.n_name, p.p_type, 'EXTRA')
       ELSE concat_ws('/', r.r_name, n.n_name, p.p_type) END AS category_name,
  CASE WHEN p.p_size % 3 = 0 THEN NULL ELSE b.brand END AS brand_name,
  CASE WHEN l.l_partkey % 41 = 0 THEN NULL
       WHEN l.l_partkey % 43 = 0 THEN 'No description yet' ELSE t.text END AS item_description,
  CAST(1 + l.l_linenumber % 5 AS INT) AS item_condition_id,
  CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS shipping,
  CASE WHEN l.l_discount = 0 AND l.l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE l.l_extendedprice END AS price
FROM lineitem l
JOIN part p ON p.p_partkey = l.l_partkey
JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN replace(p_brand, '#', ' ')
                             ELSE replace(p_brand, '#', '-') END AS brand FROM part) b
  ON b.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN conversations t
  ON t.conv_id = l.l_partkey % (SELECT max(conv_id) + 1 FROM conversations)
 AND t.turn = (l.l_linenumber + l.l_suppkey) % (SELECT max(turn) + 1 FROM conversations)
"""


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOP = "[" + ", ".join(text(w) for w in stop_words()) + "]"
SHORT_STOP = "['the', 'a', 'an', 'is', 'it', 'this']"
BRAND_WORD = "[a-z0-9*/+\\-'’?!.,|&%®™ôèéü]+"


def normalized(t: str) -> str:
    cut = f"string_split(trim(lower(regexp_replace({t}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    return f"list_filter({cut}, lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


def tokenized(t: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({t}), '[^{WORD}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def words_of_two(t: str) -> str:
    return f"regexp_extract_all({t}, '[{WORD}]{{2,}}')"


def grams(t: str, n: int) -> str:
    if n == 1:
        return t
    parts = " || ' ' || ".join(f"{t}[i + {j}]" if j else f"{t}[i]" for j in range(n))
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: {parts})"


def bucket(g: str, size: int) -> str:
    return f"CAST(CAST(concat('0x', substr(md5({g}), 1, 8)) AS BIGINT) % {size} AS VARCHAR)"


def units(t: str) -> str:
    karats = f"regexp_replace({t}, {text(KARATS)}, '\\1k\\4', 'g')"
    return f"regexp_replace({karats}, {text(UNITS)}, '\\1\\2\\3', 'g')"


def levels4(c: str) -> str:
    part = lambda i: f"CASE WHEN len(string_split({c}, '/')) >= 3 THEN string_split({c}, '/')[{i}] ELSE 'other' END"
    return (
        f"{part(1)} AS general_cat, {part(2)} AS subcat_1, {part(3)} AS subcat_2, "
        f"concat({part(1)}, '/', {part(2)}) AS gen_subcat1"
    )


# Named steps; each may use the ones before it.
STEPS = {
    "listings": LISTINGS,
    "priced": "SELECT * FROM listings WHERE split = 'test' OR price > 0",
    "filled": """
        SELECT listing_id, split, coalesce(name, 'unkname') AS name,
          coalesce(category_name, 'unk_cat') AS category_name, coalesce(brand_name, 'unk_brand') AS brand_name,
          coalesce(item_description, 'nodesc') AS item_description, item_condition_id, shipping, price,
          ln(1 + price) AS log_price FROM priced""",
    "train": "SELECT * FROM filled WHERE split = 'train'",
    "test": "SELECT * FROM filled WHERE split = 'test'",
    "cats": """
        SELECT *, CASE WHEN category_name IS NULL THEN 'No Label' ELSE string_split(category_name, '/')[1] END AS general_cat,
          CASE WHEN category_name IS NULL THEN 'No Label' ELSE string_split(category_name, '/')[2] END AS subcat_1,
          CASE WHEN category_name IS NULL THEN 'No Label' ELSE string_split(category_name, '/')[3] END AS subcat_2
        FROM listings""",
    "tagged": """
        SELECT listing_id, split, name, item_condition_id, shipping, price,
          coalesce(general_cat, 'missing') AS general_cat, coalesce(subcat_1, 'missing') AS subcat_1,
          coalesce(subcat_2, 'missing') AS subcat_2, coalesce(brand_name, 'missing') AS brand_name,
          coalesce(item_description, 'missing') AS item_description FROM cats""",
    "lowered": """
        SELECT listing_id, split, price, item_condition_id, shipping, brand_name IS NOT NULL AS has_brand,
          lower(coalesce(category_name, 'other/other/other')) AS category_name, lower(coalesce(name, '')) AS name,
          lower(coalesce(brand_name, '')) AS brand_name,
          CASE WHEN lower(item_description) = 'no description yet' THEN ''
               ELSE lower(coalesce(item_description, '')) END AS item_description
        FROM priced""",
    "unified": f"""
        SELECT * REPLACE ({units('name')} AS name, {units('item_description')} AS item_description)
        FROM lowered""",
    "cats4": f"SELECT *, {levels4('category_name')} FROM unified",
    "brand_words": "SELECT brand_name AS brand, count(*) AS n FROM unified WHERE brand_name <> '' GROUP BY 1",
    "means": """
        SELECT 'category_name' AS feature, category_name AS key, avg(log_price) AS mean, count(*) AS n FROM train GROUP BY 2
        UNION ALL SELECT 'item_condition_id', CAST(item_condition_id AS VARCHAR), avg(log_price), count(*) FROM train GROUP BY 2
        UNION ALL SELECT 'brand_name', brand_name, avg(log_price), count(*) FROM train GROUP BY 2
        UNION ALL SELECT 'shipping', CAST(shipping AS VARCHAR), avg(log_price), count(*) FROM train GROUP BY 2""",
    "encoded": """
        SELECT f.*, c.mean AS cat_mean, i.mean AS cond_mean, b.mean AS brand_mean, s.mean AS ship_mean
        FROM filled f
        LEFT JOIN means c ON c.feature = 'category_name' AND c.key = f.category_name
        LEFT JOIN means i ON i.feature = 'item_condition_id' AND i.key = CAST(f.item_condition_id AS VARCHAR)
        LEFT JOIN means b ON b.feature = 'brand_name' AND b.key = f.brand_name
        LEFT JOIN means s ON s.feature = 'shipping' AND s.key = CAST(f.shipping AS VARCHAR)""",
    "dense": """
        SELECT listing_id, split, price, log_price, item_condition_id, shipping,
          coalesce(cat_mean, 0) AS cat_mean, coalesce(cond_mean, 0) AS cond_mean,
          coalesce(brand_mean, 0) AS brand_mean, coalesce(ship_mean, 0) AS ship_mean,
          CAST(length(item_description) AS DOUBLE) AS len_desc, CAST(length(name) AS DOUBLE) AS len_name
        FROM encoded""",
    "docs": "SELECT CAST(doc_id AS VARCHAR) AS listing_id, text AS item_description, lang, source FROM documents",
}

NEEDS = {
    "priced": ["listings"], "filled": ["priced"], "train": ["filled"], "test": ["filled"],
    "cats": ["listings"], "tagged": ["cats"], "lowered": ["priced"], "unified": ["lowered"],
    "cats4": ["unified"], "brand_words": ["unified"], "means": ["train"],
    "encoded": ["filled", "means"], "dense": ["encoded"],
}


def over(step: str | list[str], select: str, **more: str) -> str:
    """``select`` after the named steps, what they need, and further steps of its own."""
    wanted: set[str] = set()
    queue = [step] if isinstance(step, str) else list(step)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue.extend(NEEDS.get(name, []))
    steps = {k: v for k, v in STEPS.items() if k in wanted} | more
    head = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in steps.items())
    return f"WITH {head}\n{select}" if steps else select


def plain(select: str, **more: str) -> str:
    return over([], select, **more)


def scaled(column: str, low: str, high: str) -> str:
    return f"({column} - {low}) / (CASE WHEN {high} = {low} THEN 1.0 ELSE {high} - {low} END) * 2.0 - 1.0"
