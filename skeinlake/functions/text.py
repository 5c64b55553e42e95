"""Text expressions: tokens, lexical scores, names, spans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script and the underscore; ``\\w`` is ASCII in Java.
WORD = r"[\p{L}\p{N}_]+"
# fixed values: English words that lexical search leaves out
STOP_WORDS = tuple(
    "a an the and or but is are was were in on at to for with by about of from as that this these those it its them they their he she his her him we our you your not be been being have has had do does did can could will would shall should may".split()
)


def tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Lower-case words in order, duplicates kept, without stop words; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)
    stop = [F.lit(w) for w in stop_words]
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def word_set(text: Column, least: int = 2) -> Column:
    """Distinct words of at least ``least`` characters."""
    return F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def bm25_idf(documents: Column, containing: Column) -> Column:
    return F.log(F.lit(1.0) + (documents - containing + 0.5) / (containing + 0.5))


def bm25_term(idf: Column, frequency: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * frequency * (k1 + 1) / (frequency + k1 * (1 - b + b * length / mean_length))


def exact_match(a: Column, b: Column) -> Column:
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double")


def edge_text(text: Column, relationship: Column) -> Column:
    """The first of both that is not blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), relationship)


def name_key(name: Column) -> Column:
    """Letters and digits of a name in lower case: the form in which duplicates meet."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def match_tier(name: Column, term: Column) -> Column:
    """3 for the name itself, 2 for its last part after a dot or slash, 1 for a part of it, -1 otherwise."""
    low, t = F.lower(name), F.lower(term)
    return F.when(low == t, 3).when(low.endswith(F.concat(F.lit("."), t)) | low.endswith(F.concat(F.lit("/"), t)), 2).when(low.contains(t), 1).otherwise(-1)


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral, null for anything else."""
    low = F.upper(F.trim(text))
    digit = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0)
    values = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), digit)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    folded = F.aggregate(F.reverse(values), start, lambda s, v: F.struct((s["sum"] + F.when(v < s["last"], -v).otherwise(v)).alias("sum"), F.greatest(s["last"], v).alias("last")))
    return F.when(low.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(low) > 0), folded["sum"])


def row_text(number: Column, columns: list[str]) -> Column:
    """``Row N:`` with ``name: value`` pairs, as tables are rendered for search."""
    pairs = F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(":\n"), pairs, F.lit("\n"))


def folded_quote(text: Column) -> Column:
    """Curly quotes to straight ones, control characters and white space to single blanks, lower case."""
    straight = F.translate(text, "‘’“”", "''\"\"")
    return F.lower(F.trim(F.regexp_replace(straight, r"[\p{Cntrl}\s]+", " ")))


def quote_found(quote: Column, text: Column) -> Column:
    """Whether a quote occurs in a text after folding; a blank quote does not."""
    q = folded_quote(quote)
    return (F.length(q) > 0) & folded_quote(text).contains(q)


def plain_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, white space folded (entities stay)."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
