"""Text as columns: tokens, sentences, decades, query decomposition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same, one by one.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed values.
HOP = r"(?i)^(?:what links|how do|how does|what connects)\s+(.+)"
COMBINES = r"(?i)^which .+ combines (.+?) with (.+)"

TAIL = r"(?<![?.,])[?.,]++$"


def strip(x: Column) -> Column:
    """Without white space at the ends, by Unicode's notion of it. What lies between isn't looked at."""
    return F.btrim(x, F.lit(SPACES))


def raw_tokens(x: Column) -> Column:
    """Maximal runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def space_tokens(x: Column) -> Column:
    return F.filter(F.split(x, f"{SPACE}+"), lambda t: t != "")


def sentences(x: Column, most: int = 0) -> Column:
    """Parts of the stripped text between white space that follows a full stop, an exclamation or a question mark: all, or the
    first `most`, for which the rest isn't split."""
    parts = F.split(strip(x), r"(?<=[.!?])\s+", most + 1 if most else -1)
    return F.filter(F.slice(parts, 1, most) if most else parts, lambda s: s != "")


def decade(t: Column) -> Column:
    """Ten years for a token that starts with four digits and an s, else the token alone."""
    year = F.regexp_extract(t, r"^(\d{4})s", 1)
    years = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (year.cast("int") + i).cast("string"))
    return F.when(year != "", years).otherwise(F.array(t))


def is_year_like(t: Column) -> Column:
    return t.rlike(r"^\d{4}(?:s|$)")


def decompose(q: Column) -> Column:
    """Sub-queries of a multi-hop question; otherwise the query as it is."""
    s = strip(q)
    rest = F.regexp_extract(s, HOP, 1)
    long = F.filter(F.split(rest, r",\s+(?:and\s+)?|\s+and\s+"), lambda p: F.length(strip(p)) > 5)
    parts = F.transform(long, lambda p: F.regexp_replace(strip(p), TAIL, ""))
    pair = F.array(strip(F.regexp_extract(s, COMBINES, 1)), F.regexp_replace(strip(F.regexp_extract(s, COMBINES, 2)), TAIL, ""))
    return F.when((rest != "") & (F.size(parts) >= 2), parts).when(s.rlike(COMBINES), pair).otherwise(F.array(q))


def bigrams(tokens: Column) -> Column:
    heads = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    tails = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: F.concat_ws("_", a, b))
