"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

Kinds `assign`, `access` and `hex` are the base; `github` and `npm` (prefix, 30 base-62 characters, their CRC-32 as six
more) and `jwt` (a header that decodes to JSON with an `alg`) are added where they validate. One pass of the automaton
over a lower-cased text finds every place where a pattern can start; a pattern is tried only there, from left to right,
past the end of its previous match, which equals leftmost non-overlapping search. Runs of hex digits have no keyword: a
linear scan selects the texts that hold one of 24 digits, and only those are searched.

Edge cases: a null text is empty and has no spans; an empty table gives an empty result; repeated rows are scanned one
by one; other columns are ignored. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base kinds in their order, then the added ones.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z_])")
NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z_])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt"}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: str) -> str:
    """CRC-32 of the body in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def _checked(m: re.Match) -> bool:
    return checksum(m[1][:30]) == m[1][30:]


def _header(m: re.Match) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError):
        return False


TRY = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 20),
    "github": (GITHUB, _checked),
    "npm": (NPM, _checked),
    "jwt": (JWT, _header),
}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def spans_of(text: str, lowered: str, has_hex: bool) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    found = []
    hits = sorted({(end - n + 1, kind) for end, (kind, n) in automaton().iter(lowered)})
    past = dict.fromkeys(TRY, 0)
    for start, kind in hits:
        if start < past[kind]:
            continue
        pattern, valid = TRY[kind]
        if m := pattern.match(text, start):
            past[kind] = m.end()
            if valid(m):
                found.append((start, KINDS.index(kind), m.end()))
    if has_hex:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), a row for each row of docs, spans by start, then kind as listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = part.column("text")
                hexes = np.asarray(pc.match_substring_regex(texts, "[0-9a-f]{24}"))
                rows = [spans_of(t, low, h) for t, low, h in zip(texts.to_pylist(), pc.ascii_lower(texts).to_pylist(), hexes, strict=True)]
                flat = [x for r in rows for x in r]
                fields = pa.StructArray.from_arrays([pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())], ["kind", "start", "end"])
                ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, fields)], ["doc_id", "spans"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
