"""Fill-in-the-middle: texts cut in three at token boundaries and put in prefix-suffix-middle or suffix-prefix-middle order.

Tokens are the isolated matches of a pattern by the tokenizers library's Split pre-tokenizer, which needs no vocabulary and no
training. It gives each match's code-point offsets: the length of the array of offsets is n, and the offsets ranked by two
hashes of the document's id are the cuts. A text is handed over in pieces of about `PIECE` characters that end before a
character that is no letter, which begins a token wherever it stands, so that only the array of offsets, eight bytes for a
token, grows with a text.

Edge cases: a null text is empty and plain; one that holds a marker is plain; a null id is the empty string in the hash;
repeated rows stay, each with the same result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1 << 16
_other = re.compile("[^A-Za-z]")


@functools.cache
def _split() -> Callable[[str], list[tuple[str, tuple[int, int]]]]:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(TOKEN), "isolated").pre_tokenize_str


def offsets(text: str, piece: int = PIECE) -> np.ndarray:
    """Where each token starts, in code points."""
    split, found, at = _split(), [np.empty(0, np.int64)], 0
    while at < len(text):
        end = min(at + piece, len(text))
        if end < len(text):
            stop = _other.search(text, end)
            end = stop.start() if stop else len(text)
        found.append(np.array([a for _, (a, _) in split(text[at:end])], np.int64) + at)
        at = end
    return np.concatenate(found)


def transformed(doc_id: int | None, text: str, seed: int, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, characters of prefix and middle, output) of a text."""
    start = offsets(text)
    n = len(start)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= 100 - plain or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(start[k]) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each row of docs; plain: percent of the texts that stay
    as they are, spm: percent of the others in suffix-prefix-middle order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = [transformed(i, t or "", seed, plain, spm) for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
                n, form, before, within, output = zip(*rows, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(common.tidy(of), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form: no marker can begin within another, so splitting finds those that were put in."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back)
