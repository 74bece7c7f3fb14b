"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned spans. A conversation that fits the budget is one window. A longer one is
cut greedily: a span takes turns as long as its sum keeps within the budget less the system turn and the history that are
repeated before it (the first span has neither). A window holds the retained system turn, the last turns of the span
before (at most `history` tokens, as context) and its own turns. Only assistant texts that are new in the window are under
the loss mask, so each is a target once. No window exceeds the budget: a turn that no span could hold is cut between
tokens into parts, each under its mask in its window; of a system turn over its reserve the first `system` tokens are
repeated.

Prefix sums and spans are taken within blocks of turn numbers and over the blocks of a conversation, so that a very long
conversation is spread over tasks; a span ends with its block.

Template: <|turn|>role<|text|>text<|end|> and a line feed; a part that continues a turn begins with <|cont|>, one that is
continued ends with <|more|> and a line feed. In roles and texts a backslash is doubled and `<|` becomes `<\\|`, which a
reader undoes by dropping the backslash before any character.

Edge cases: null roles and texts are empty; a null conv_id is a conversation of its own; null turns come first; rows
that tie on the turn come in the order of role and text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TURN, CONT, TEXT, END, MORE = "<|turn|>", "<|cont|>", "<|text|>", "<|end|>\n", "<|more|>\n"
#: Tokens that the template adds to a turn.
FRAME = 4
SPACE = " \t\n\x0b\f\r"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


@dataclasses.dataclass(frozen=True)
class Budget:
    tokens: int = 2048
    history: int = 256
    system: int = 256
    block: int = 512
    target: str = "assistant"

    @property
    def longest(self) -> int:
        """Tokens that every span can hold."""
        return self.tokens - self.history - self.system


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Words and single marks, and those of the template."""
    return (F.regexp_count(text, F.lit(TOKEN)) + FRAME).cast("long")


def parts_of(text: Column, size: int) -> Column:
    """text in parts of at most `size` tokens with the template's: array of (text, n)."""
    room, body = size - FRAME, F.rtrim(text, F.lit(SPACE))

    def cut(every: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(every) - 1, F.lit(0)), F.lit(room))
        rest = F.substr(text, F.length(body) + 1)
        part = lambda s: F.array_join(F.slice(every, s + 1, F.lit(room)), "")
        return F.transform(starts, lambda s: F.struct(F.concat(part(s), F.when(s + room >= F.size(every), rest).otherwise("")).alias("text"), (F.least(F.size(every) - s, F.lit(room)) + FRAME).cast("long").alias("n")))

    return common.let(F.regexp_extract_all(body, F.lit(rf"\s*+(?:{TOKEN})"), F.lit(0)), cut)


def cuts(counts: Column, first: Column, rest: Column) -> Column:
    """Where spans begin, as places in an array of token counts: the first span holds `first`, every other one `rest`."""
    begin = F.struct(F.lit(0).cast("long").alias("sum"), first.cast("long").alias("room"), F.array(F.lit(0)).alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["sum"] + n > acc["room"]) & (acc["i"] > 0)
        return F.struct((F.when(full, n).otherwise(acc["sum"] + n)).alias("sum"), F.when(full, rest.cast("long")).otherwise(acc["room"]).alias("room"), F.when(full, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"))

    return F.aggregate(counts, begin, step, lambda acc: acc["at"])


def spans(convs: DataFrame, b: Budget) -> DataFrame:
    """Rows of turns or their parts with the window `at` they belong to: (conv, block, nth, part, role, text, n, more, at,
    last, is_system, s_n)."""
    c = F.col
    order = ["turn", "role", "text"]
    rows = convs.select(F.struct(c("conv_id").cast("long").alias("id")).alias("conv"), c("turn").cast("long").alias("turn"), F.coalesce(c("role").cast("string"), F.lit("")).alias("role"), common.text_of().alias("text"))
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 40))) / b.block)).withColumn("n", tokens(c("text")))
    key = ["conv", "block"]
    rows = common.stage(rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))), "chat-turns")
    head = F.max(F.when(c("nth") == 1, F.struct((c("role") == "system").alias("is"), F.least("n", F.lit(b.system)).alias("n"))))
    whole, before = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy("block")
    blocks = rows.groupBy(*key).agg(F.sum("n").alias("sum"), head.alias("head"))
    lead = F.first("head").over(before)
    blocks = blocks.select(*key, F.sum("sum").over(whole).alias("total"), (F.row_number().over(before) == 1).alias("lead"), lead["is"].alias("has_system"), F.when(lead["is"], lead["n"]).otherwise(0).alias("s_n"))
    rows = rows.join(blocks, key).withColumn("fits", c("total") <= b.tokens)
    one = F.array(F.struct("text", "n"))
    rows = rows.withColumn("parts", F.when(c("fits") | (c("n") <= b.longest), one).otherwise(parts_of(c("text"), b.longest)))
    rows = rows.select(*key, "nth", "role", F.size("parts").alias("of"), F.posexplode("parts").alias("part", "p"), "lead", "fits", "s_n", (c("lead") & (c("nth") == 1) & c("has_system")).alias("is_system"))
    rows = rows.select(*key, "nth", "part", "role", "p.text", "p.n", (c("part") + 1 < c("of")).alias("more"), "lead", "fits", "s_n", "is_system")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("nth", "part")) - 1
    rows = rows.withColumn("place", place)
    rest = F.lit(b.tokens - b.history) - c("s_n")
    counts = F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"])
    cut = rows.where(~c("fits")).groupBy(*key, "lead", "s_n").agg(counts.alias("counts"))
    cut = cut.select(*key, cuts(c("counts"), F.when(c("lead"), F.lit(b.tokens).cast("long")).otherwise(rest), rest).alias("begins"))
    numbered = cut.select(*key, F.size("begins").alias("many"))
    numbered = numbered.select(*key, (F.sum("many").over(before) - c("many")).alias("first"), F.sum("many").over(whole).alias("windows"))
    rows = rows.join(cut.join(numbered, key), key, "left")
    at = F.coalesce(c("first") + F.size(F.filter("begins", lambda x: x <= c("place"))) - 1, F.lit(0))
    return rows.select(*key, "nth", "part", "role", "text", "n", "more", at.alias("at"), (F.coalesce("windows", F.lit(1)) - 1).alias("last"), "is_system", "s_n")


def windows(convs: DataFrame, b: Budget | None = None) -> DataFrame:
    """convs (conv_id, turn, role, text) -> (conv_id, window, formatted, n_context, loss, n_tokens); loss: code-point ranges."""
    b = b or Budget()
    c = F.col
    rows = spans(convs, b)
    tail = Window.partitionBy("conv", "at").orderBy(F.desc("block"), F.desc("nth"), F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    again = (F.sum("n").over(tail) <= b.history) & ~c("is_system") & (c("at") < c("last"))
    rows = common.stage(rows.withColumn("again", again), "chat-spans")  # read for the turns and for the system turns
    entry = lambda place, *of: F.struct(F.lit(place).alias("place"), *of)
    own = ("block", "nth", "part", "role", "text", "n", "more")
    new, known = F.struct(c("at").alias("at"), entry(2, *own).alias("e")), F.struct((c("at") + 1).alias("at"), entry(1, *own).alias("e"))
    turns = rows.select("conv", F.explode(F.when(c("again"), F.array(new, known)).otherwise(F.array(new))).alias("x")).select("conv", "x.at", "x.e")
    system = rows.where(c("is_system") & (c("part") == 0) & (c("last") > 0)).withColumn("p", parts_of(c("text"), b.system)[0])
    system = system.select("conv", F.explode(F.sequence(F.lit(1).cast("long"), c("last"))).alias("at"), entry(0, "block", "nth", "part", "role", F.when(c("n") <= b.system, c("text")).otherwise(c("p.text")).alias("text"), F.least("n", "p.n").alias("n"), (c("more") | (c("n") > b.system)).alias("more")).alias("e"))
    held = turns.unionByName(system).groupBy("conv", "at").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    piece = F.transform("entries", lambda e: F.struct(e["place"].alias("place"), e["role"].alias("role"), F.concat(F.when(e["part"] > 0, CONT).otherwise(TURN), escape(e["role"]), F.lit(TEXT)).alias("head"), escape(e["text"]).alias("body"), F.when(e["more"], MORE).otherwise(END).alias("tail")))
    held = held.select("conv", "at", "entries", piece.alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"]))
    marks = F.zip_with("pieces", common.running(sizes, F.lit(0), lambda x, y: x + y), lambda p, at: F.struct(((p["place"] == 2) & (p["role"] == b.target)).alias("target"), (at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["body"])).alias("end")))
    return held.select(
        c("conv.id").alias("conv_id"),
        c("at").cast("long").alias("window"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.size(F.filter("pieces", lambda p: p["place"] < 2)).alias("n_context"),
        F.transform(F.filter(marks, lambda m: m["target"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("loss"),
        F.aggregate("entries", F.lit(0).cast("long"), lambda acc, e: acc + e["n"]).alias("n_tokens"),
    )


def read_windows(formatted: DataFrame) -> DataFrame:
    """The turns (or parts) that are new in each window and the text under its mask, read back from the formatted text:
    (conv_id, window, turns array<struct<role, text, cont, more>>, targets array<string>, chars)."""
    tails = F.regexp_extract_all("formatted", F.lit(r"<\|(end|more)\|>\n"), F.lit(1))
    both = F.zip_with(F.slice(F.split("formatted", r"<\|(?:end|more)\|>\n"), F.lit(1), F.size(tails)), tails, lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    new = F.slice(both, F.col("n_context") + 1, F.greatest(F.size(both) - F.col("n_context"), F.lit(0)))

    def parse(x: Column) -> Column:
        parts = F.split(F.substring(x["p"], len(TURN) + 1, 1 << 30), r"<\|text\|>")
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"), F.startswith(x["p"], F.lit(CONT)).alias("cont"), (x["t"] == "more").alias("more"))

    targets = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    return formatted.select("conv_id", "window", F.transform(new, parse).alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars"))


def said(turns: Column) -> Column:
    """Role, line feed, text, line feed of each turn, its parts joined."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.when(t["cont"], "").otherwise(F.concat(t["role"], F.lit("\n"))), t["text"], F.when(t["more"], "").otherwise("\n"))), "")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's digest needs its whole text in one place; the windows themselves do not."""
    convs = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    read = read_windows(windows(convs.unionByName(more)))
    parts = read.select("conv_id", F.struct("window", said(F.col("turns")).alias("said"), F.array_join("targets", "").alias("loss")).alias("w"), F.size(F.filter("turns", lambda t: ~t["cont"])).cast("long").alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda f: F.array_join(F.transform("ws", lambda w: w[f]), "")
    whole = whole.select("conv_id", "n_turns", "formatted_chars", joined("said").alias("said"), joined("loss").alias("loss"))
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
