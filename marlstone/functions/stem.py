"""Suffix stemmer as a chain of SQL columns, run once per distinct term.

A word is mirrored by a mask of its letters, c or v: aeiou are v, digits and other letters c, and y is c at the start or
after a v. A word's beginning has the beginning of its mask. The rules' measure is over 0 if the mask of what precedes
the suffix holds a c, and over 1 if it holds cv. The chain is plain SQL, so the same text runs on Spark and in the
oracle. `stem` says the same of one word, for tasks that meet words in texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (suffix, replacement), in the order in which they are tried.
SECOND = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
OVER_0, OVER_1 = "%c%", "%cv%"


def _mask(w: str) -> str:
    m = f"translate({w}, 'aeioubcdfghjklmnpqrstvwxz0123456789', 'vvvvv{'c' * 30}')"
    m = f"regexp_replace({m}, '^y', 'c')"
    for _ in range(4):
        m = f"replace(replace({m}, 'cy', 'cv'), 'vy', 'vc')"
    return m


def _less(w: str, n: int) -> str:
    return f"substr({w}, 1, greatest(length({w}) - {n}, 0))"


def _swap(w: str, mask: str, rules: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{a}' AND {_less(mask, len(a))} LIKE '{OVER_0}' THEN {_less(w, len(a))} || '{b}'" for a, b in rules)
    return f"CASE {cases} ELSE {w} END"


def chain(term: str = "term") -> list[tuple[str, str]]:
    """(column, SQL) in order; the last column is `stem`."""
    cut = "CASE WHEN s1 LIKE '%eed' THEN '' WHEN s1 LIKE '%ed' AND substr(m1, 1, greatest(length(s1) - 2, 0)) LIKE '%v%' THEN 'ed' WHEN s1 LIKE '%ing' AND substr(m1, 1, greatest(length(s1) - 3, 0)) LIKE '%v%' THEN 'ing' ELSE '' END"
    twice = "length(s2) > 1 AND substr(s2, length(s2), 1) = substr(s2, length(s2) - 1, 1) AND NOT substr(s2, length(s2), 1) IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z')"
    fourth = " ".join(
        f"WHEN s6 LIKE '%{a}' AND {_less('m6', len(a))} LIKE '{OVER_1}' THEN " + (f"CASE WHEN {_less('s6', 3)} LIKE '%s' OR {_less('s6', 3)} LIKE '%t' THEN {_less('s6', 3)} ELSE s6 END" if a == "ion" else _less("s6", len(a)))
        for a in FOURTH
    )
    return [
        ("s1", f"CASE WHEN {term} LIKE '%sses' OR {term} LIKE '%ies' THEN {_less(term, 2)} WHEN {term} LIKE '%s' AND NOT {term} LIKE '%ss' THEN {_less(term, 1)} ELSE {term} END"),
        ("m1", _mask("s1")),
        ("cut", cut),
        ("s2", f"CASE WHEN s1 LIKE '%eed' AND {_less('m1', 3)} LIKE '{OVER_0}' THEN {_less('s1', 1)} ELSE substr(s1, 1, length(s1) - length(cut)) END"),
        ("s3", f"CASE WHEN cut = '' THEN s2 WHEN s2 LIKE '%at' OR s2 LIKE '%bl' OR s2 LIKE '%iz' THEN s2 || 'e' WHEN {twice} THEN {_less('s2', 1)} ELSE s2 END"),
        ("m3", _mask("s3")),
        ("s4", f"CASE WHEN s3 LIKE '%y' AND {_less('m3', 1)} LIKE '%v%' THEN {_less('s3', 1)} || 'i' ELSE s3 END"),
        ("m4", _mask("s4")),
        ("s5", _swap("s4", "m4", SECOND)),
        ("m5", _mask("s5")),
        ("s6", _swap("s5", "m5", THIRD)),
        ("m6", _mask("s6")),
        ("s7", f"CASE {fourth} ELSE s6 END"),
        ("s8", f"CASE WHEN s7 LIKE '%e' AND substr(m6, 1, greatest(length(s7) - 1, 0)) LIKE '{OVER_0}' THEN {_less('s7', 1)} ELSE s7 END"),
        ("stem", f"CASE WHEN length({term}) <= 2 THEN {term} WHEN s8 LIKE '%ll' AND substr(m6, 1, length(s8)) LIKE '{OVER_1}' THEN {_less('s8', 1)} ELSE s8 END"),
    ]


_KINDS = str.maketrans("aeioubcdfghjklmnpqrstvwxz0123456789", "vvvvv" + "c" * 30)
_RULES = [re.compile(f"(?:{'|'.join(a for a, *_ in rules)})$") for rules in (SECOND, THIRD, [(a,) for a in FOURTH])]  # whether any rule can apply


def _kinds(w: str) -> str:
    m = w.translate(_KINDS)
    if "y" in m:
        m = "c" + m[1:] if m[0] == "y" else m
        for _ in range(4):
            m = m.replace("cy", "cv").replace("vy", "vc")
    return m


def _swapped(w: str, rules: list[tuple[str, str]]) -> str:
    m = _kinds(w)
    return next((w[: -len(a)] + b for a, b in rules if w.endswith(a) and "c" in m[: -len(a)]), w)


def stem(w: str) -> str:
    """The chain for one word of a-z and 0-9."""
    if len(w) <= 2:
        return w
    s = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if s.endswith("eed"):
        s = s[:-1] if "c" in _kinds(s)[:-3] else s
    elif cut := next((n for a, n in (("ed", 2), ("ing", 3)) if s.endswith(a) and "v" in _kinds(s)[:-n]), 0):
        s = s[:-cut]
        if s.endswith(("at", "bl", "iz")):
            s += "e"
        elif len(s) > 1 and s[-1] == s[-2] and s[-1] not in "aeiouylsz":
            s = s[:-1]
    if s.endswith("y") and "v" in _kinds(s)[:-1]:
        s = s[:-1] + "i"
    for rules, any_rule in zip((SECOND, THIRD), _RULES, strict=False):
        s = _swapped(s, rules) if any_rule.search(s) else s
    m = _kinds(s)
    if _RULES[2].search(s) and (a := next((a for a in FOURTH if s.endswith(a) and "cv" in m[: -len(a)]), "")):
        s = s[: -len(a)] if a != "ion" or s[:-3].endswith(("s", "t")) else s
    if s.endswith("e") and "c" in m[: len(s) - 1]:
        s = s[:-1]
    return s[:-1] if s.endswith("ll") and "cv" in m[: len(s)] else s


def with_stem(terms: DataFrame, term: str = "term") -> DataFrame:
    """terms with a column `stem`; call it on distinct terms."""
    columns = terms.columns
    for name, sql in chain(term):
        terms = terms.withColumn(name, F.expr(sql))
    return terms.select(*columns, "stem")


def duckdb_sql(source: str, term: str = "term") -> str:
    """The same chain over a table of distinct terms."""
    out = f"SELECT {term} FROM {source}"
    for name, sql in chain(term):
        out = f"SELECT *, {sql} AS {name} FROM ({out})"
    return f"SELECT {term}, stem FROM ({out})"
