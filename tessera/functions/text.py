"""Scalar text functions as Column expressions, and the same definitions as SQL text.

``*_sql`` functions return DuckDB expressions over an SQL expression; the registered
oracles are built from them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# Stop words of the scoring tokenizer.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall "
    "should may might must can could of in to for with on at from by about as into "
    "through during before after above below between and but or nor not so yet both either "
    "neither each every all any few more most other some such no only own same than too "
    "very just because if when where how what which who whom this that these those it its"
).split()

# Stop words of the attribution terms.
ATTRIBUTION_STOP_WORDS = (
    "a an the and or but in on at to for of with by from is was were are be been being have "
    "has had do does did will would could should may might shall can need dare it its this that "
    "these those i me my we us our you your he him his she her they them their what which who "
    "whom how when where why not no nor so if then than too very just about above after again "
    "all also am any as because before between both each few more most other own same some "
    "such through up down out off over under until while into during only"
).split()


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strings_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- tokens -------------------------------------------------------------------------------


def bm25_tokens(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, split at blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"\s+"), lambda x: x != "")


def bm25_tokens_sql(e: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({e}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda x: x <> '')"


def scoring_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: ~t.isin(STOP_WORDS))


def scoring_tokens_sql(e: str) -> str:
    return f"list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), lambda t: NOT list_contains({strings_sql(STOP_WORDS)}, t))"


def stem(token: Column) -> Column:
    """-ing and -ed off words of over five letters; else -ies to -y; else a plural -s."""
    n = F.length(token)
    cut = lambda k: token.substr(F.lit(1), n - k)
    return (
        F.when((n > 5) & token.endswith("ing"), cut(3))
        .when((n > 5) & token.endswith("ed"), cut(2))
        .when((n > 4) & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )


def stem_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 5 AND ends_with({t}, 'ing') THEN left({t}, length({t}) - 3) "
        f"WHEN length({t}) > 5 AND ends_with({t}, 'ed') THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 4 AND ends_with({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def terms(text: Column) -> Column:
    """Distinct stemmed scoring tokens."""
    return F.array_distinct(F.transform(scoring_tokens(text), stem))


def terms_sql(e: str) -> str:
    return f"list_distinct(list_transform({scoring_tokens_sql(e)}, lambda t: {stem_sql('t')}))"


_WORDS = "(?<![A-Za-z0-9_])[a-zA-Z]{2,}(?![A-Za-z0-9_])"


def key_terms(text: Column) -> Column:
    """Distinct runs of two or more letters, without the attribution stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(_WORDS), 0), lambda t: ~t.isin(ATTRIBUTION_STOP_WORDS)))


# --- set measures -------------------------------------------------------------------------


def share(a: Column, b: Column) -> Column:
    """|A & B| / |A|; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """|A & B| / |A | B|; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap_ratio(needle: Column, haystack: Column) -> Column:
    return share(terms(needle), terms(haystack))


def keyword_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(scoring_tokens(a)), F.array_distinct(scoring_tokens(b)))


def claim_support(claim: Column, context: Column) -> Column:
    return F.least(keyword_jaccard(claim, context) * 3.0, F.lit(1.0))


def share_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0.0::DOUBLE END"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0::DOUBLE END"


# --- sentences ----------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Split after . ! ? at blanks; trimmed, no empty ones."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def chunk_sentences(text: Column) -> Column:
    """Split after . ! ? before a capital, or at a blank line; trimmed, no empty ones."""
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*(?=\n)"), strip), lambda s: s != "")


def claims(text: Column) -> Column:
    """Sentences of three words or more."""
    return F.filter(sentences(text), lambda s: F.size(F.split(s, r"\s+")) >= 3)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def best_excerpt(text: Column, query: Column, most: int = 200) -> Column:
    """The sentence with most of the query's key terms, the first among equals; short texts whole."""
    wanted = key_terms(query)
    ranked = F.transform(sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(key_terms(s), wanted))).alias("o"), i.alias("i"), s.alias("s")))
    best = F.array_min(ranked)["s"]
    long = F.when(F.length(best) > most, F.concat(F.trim(F.substring(best, 1, most)), F.lit("..."))).otherwise(best)
    return F.when(F.length(text) <= most, F.trim(text)).when(F.size(sentences(text)) == 0, F.trim(F.substring(text, 1, most))).otherwise(long)


# --- density ------------------------------------------------------------------------------


def technical_density(text: Column) -> Column:
    """0 .. 1: code characters, urls, numbers and long words, weighted."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    capped = lambda x: F.least(x, F.lit(1.0))
    code = capped(F.regexp_count(text, F.lit(r"[{}\[\]();=<>]")) / n)
    url = capped(F.regexp_count(text, F.lit("https?://")) / F.greatest(n / 20, F.lit(1.0)))
    number = capped(F.regexp_count(text, F.lit(r"\d+[.,:;]\d+")) / F.greatest(n / 10, F.lit(1.0)))
    length = capped(F.greatest(letters / n - 5, F.lit(0.0)) / 5)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(capped(0.35 * code + 0.20 * url + 0.25 * number + 0.20 * length))


def technical_density_sql(e: str) -> str:
    words = f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda w: w <> '')"
    n = f"greatest(len({words}), 1)::DOUBLE"
    count = lambda rx: f"len(regexp_extract_all({e}, '{rx}'))"
    letters = f"coalesce(list_sum(list_transform({words}, lambda w: length(w))), 0)::DOUBLE"
    return (
        f"CASE WHEN coalesce(length({e}), 0) = 0 THEN 0.0::DOUBLE ELSE least(0.35::DOUBLE * least({count(r'[{}\[\]();=<>]')} / {n}, 1.0::DOUBLE) "
        f"+ 0.20::DOUBLE * least({count('https?://')} / greatest({n} / 20, 1.0::DOUBLE), 1.0::DOUBLE) "
        f"+ 0.25::DOUBLE * least({count(r'\d+[.,:;]\d+')} / greatest({n} / 10, 1.0::DOUBLE), 1.0::DOUBLE) "
        f"+ 0.20::DOUBLE * least(greatest({letters} / {n} - 5, 0.0::DOUBLE) / 5, 1.0::DOUBLE), 1.0::DOUBLE) END"
    )


def adaptive_max(density: Column, most: int = 512, least: int = 50) -> Column:
    return F.greatest(F.floor(F.lit(float(most)) * (1.0 - 0.5 * density)).cast("int"), F.lit(least))


# --- entities and names -------------------------------------------------------------------

#: Date forms, identifiers, cue words.
DATE_FORMS = (
    r"\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2})|(?:\d{1,2}[-/]\d{1,2}[-/]\d{4})"
    r"|(?:\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})"
    r"|(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})"
)
NAME_FORMS = r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b|\b(?:[A-Z][a-z]+-[A-Z0-9]+)\b|\b(?:[A-Z]{2,}[-_]\d{2,})\b"
#: The same matches by a possessive group, whose every word ends at an edge: the regex engine loops over it, where it calls itself for each
#: word of the plain form and overflows its stack at some 2,000 words. A capital is looked for before any edge. The SQL keeps the plain form.
_NAMES = r"(?=[A-Z])\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+\b)++|[A-Z][a-z]+-[A-Z0-9]+\b|[A-Z]{2,}[-_]\d{2,}\b)"
ORDER_IDS, MACHINE_IDS = r"\b((?:ORD|PO|SO|INV|REQ)[-#]?\d{3,10})\b", r"\b((?:MCH|MACH|EQP|LINE|UNIT)[-#]?\d{2,10})\b"
QUOTED = r'"([^"]{2,60})"'
CONCEPTS = (
    "delay failure shortage defect quality compliance shipment delivery production downtime maintenance "
    "cancellation escalation resolution inspection recall cost overdue penalty backorder outage"
).split()
NAME_STOPS = (
    "The This That These Those Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March "
    "April May June July August September October November December"
).split()
SUPPLIERS = (
    r"(?i)(?:supplier|vendor|manufacturer|provider)\s+([A-Z][A-Za-z0-9&\s\-]{1,40}?)(?:\s+(?:delayed|shipped|supplied|failed|caused|reported|delivered|received|was|has|had|is))",
    r"(?i)(?:from|by|with|to)\s+(?:supplier|vendor)\s+([A-Z][A-Za-z0-9&\s\-]{1,40}?)(?:\.|,|\s+(?:and|or|which|who|that))",
)
LOCATIONS = r"(?i)(?:in|at|from|to|near|located\s+(?:in|at))\s+([A-Z][A-Za-z\s]{2,30}?)(?:\.|,|\s+(?:and|or|which|where|facility|plant|warehouse|office))"


#: A word edge for ASCII letters, digits and _ whatever the regex engine's own notion is.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    return pattern.replace(r"\b", _EDGE)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct trimmed matches, first-seen order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ascii_edges(pattern)), group), lambda x: F.trim(x)))


def dates(text: Column) -> Column:
    return F.filter(found(text, "(?i)" + DATE_FORMS), lambda x: x != "")


def names(text: Column) -> Column:
    return F.filter(found(text, _NAMES), lambda x: (F.length(x) >= 3) & ~x.isin(NAME_STOPS))


def extracted(text: Column) -> Column:
    """The seven kinds of entities that follow-up questions are made from."""
    first, second = (F.filter(found(text, rx, 1), lambda x: F.length(x) > 1) for rx in SUPPLIERS)
    low = F.lower(text)
    upper = lambda c: F.array_distinct(F.transform(c, lambda x: F.upper(x)))
    month = r"(?i)\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"
    return F.struct(
        F.array_union(first, second).alias("suppliers"),
        found(text, month).alias("dates"),
        upper(F.regexp_extract_all(text, F.lit(ascii_edges("(?i)" + ORDER_IDS)), 1)).alias("order_ids"),
        upper(F.regexp_extract_all(text, F.lit(ascii_edges("(?i)" + MACHINE_IDS)), 1)).alias("machine_ids"),
        F.filter(found(text, LOCATIONS, 1), lambda x: F.length(x) > 2).alias("locations"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(QUOTED), 1)).alias("quoted_entities"),
        F.filter(strings(CONCEPTS), lambda k: F.contains(low, k)).alias("concepts"),
    )


def normalise_entity(name: Column) -> Column:
    """Trimmed, trailing punctuation off, blanks to underscores."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"[.,;:!?]+$", ""), r"\s+", "_")


def fold_entity(name: Column) -> Column:
    """Lower case with blanks and hyphens as underscores: one form for nodes and questions."""
    return F.lower(F.regexp_replace(F.trim(name), r"[\s\-]+", "_"))


def spans_and_numbers(text: Column) -> Column:
    """Capitalised spans (lower-cased), numbers and percentages, distinct."""
    caps = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+"), 0), lambda x: F.lower(x))
    return F.array_union(caps, F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?%?"), 0))


def in_order(by: list[str], order: str) -> WindowSpec:
    """A window over each group in an order."""
    return Window.partitionBy(*by).orderBy(order)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def doc_id(source: Column, ordinal: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, ordinal.cast("string")), 256), 1, 12)


SLUG = 50
# Words for yes and no, and words that open a request.
YES = ["true", "yes", "y", "1", "relevant"]
NO = ["false", "no", "n", "0", "not relevant", "irrelevant", "not_relevant"]
REQUESTS = "show|display|give|get|find|list|what|which|how"
UNTITLED = "Query Results"


def slug(text: Column) -> Column:
    """A name for files: lower case, words joined by underscores, at most SLUG characters."""
    words = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(words, r"(?U)[\s_]+", "_"), "^_+|_+$", ""), 1, SLUG)


def title(question: Column) -> Column:
    """A chart's title: the question without the words that open a request, its first letter as a capital."""
    rest = F.trim(F.regexp_replace(question, rf"(?i)^({REQUESTS})\s+(me\s+)?", ""))
    return F.when(F.coalesce(rest, F.lit("")) == "", UNTITLED).otherwise(F.concat(F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2))))


def truth(value: Column) -> Column:
    """A lenient boolean: null for null, an error for a word that is neither yes nor no."""
    x = F.lower(F.trim(value))
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(x.isin(YES), True).when(x.isin(NO), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), value)))


# --- vectors ------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product as a double fold; 0 over empty arrays."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-12, F.lit(0.0)).otherwise(dot(a, b) / norm)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
