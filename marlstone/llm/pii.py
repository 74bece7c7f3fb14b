"""Personal data by weak supervision, in DataFrame functions only.

Base spans are the validated matches of four patterns. Candidates for more come from wider patterns (emails spelt with
`at` and `dot`, local phone numbers, social security numbers, persons, streets). Every candidate, base or not, gets votes (1, 0, or 2 for
abstention) from a regex labeler (strict form), a gazetteer labeler (top-level domains, calling codes, card issuers,
reserved networks, given names and forms of address, street words) and a context labeler (cue words before and after the span). Expectation-maximisation over the counted vote
patterns (a table of bounded size) estimates each labeler's reliability and each candidate's probability; those
probabilities train the final span classifier, a naive Bayes over span features. Candidates that it accepts are added;
base spans stay whatever it says.

The base patterns are written with possessive repeats and run starts, which find the same matches in linear time.

Edge cases: a null text is empty and has no spans; an empty table gives an empty result and the priors as the model;
repeated rows are labelled one by one; other columns are ignored. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order of reports, the base ones first.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email_spelt", "phone_local", "ssn", "person", "street")
#: Gazetteers of the wider kinds.
HONOURS = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Señor|Señora"
GIVEN = "James|John|Robert|Michael|David|William|Richard|Thomas|Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Sarah|Karen|Anna|Maria|Peter|Paul|Hans|Klaus|Pierre|Jean|Marie|Juan|Carlos|Ahmed|Wei|Yuki"
WAYS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Place"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_spelt": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": rf"(?=[A-Z])\b(?:(?:{HONOURS})\.? |(?:{GIVEN}) )(?:[A-Z]\. ?)?[A-Z][a-z]++(?:[ -][A-Z][a-z]++)?",
    "street": rf"\b[0-9]{{1,5}} (?:[A-Z][a-z]++ ){{1,3}}(?:{WAYS})\b\.?",
}
#: Tested before a pattern is tried: a text without it has no match. What needs a digit is tried in texts with one only.
GUARDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike("[0-9][ -]?[0-9]"),
    "phone": lambda text: F.contains(text, F.lit("+")),
    "email_spelt": lambda text: F.contains(F.lower(text), F.lit("dot")),
    "phone_local": lambda text: text.rlike("[0-9]{3}[ .-][0-9]{4}"),
    "ssn": lambda text: text.rlike("[0-9]-[0-9]{2}-[0-9]"),
    "person": lambda text: text.rlike(rf"(?=[A-Z])(?<![A-Za-z])(?:{HONOURS}|{GIVEN})\b"),
    "street": lambda text: text.rlike(rf" (?=[A-Z])(?:{WAYS})\b"),
}
DIGITS = {"ip", "card", "phone", "phone_local", "ssn", "street"}
CUES = {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address|client|login", "card": "card|visa|master|amex|credit|debit|paid", "phone": "phone|tel|call|mobile|cell|fax|contact", "ssn": r"ssn|social|security", "person": r"\bname\b|dear|regards|signed|author|contact|attn|from|by\b|i am|i'm", "street": r"address|lives?\b|live at|ship|deliver|mail|office|located|visit"}
AGAINST = r"version|release|order|invoice|isbn|ticket|serial|part no|section|chapter|figure"
AFTER = r"^\W*(?:is|was|are) (?:my|our|his|her|the) (?:e?-?mail|address|phone|number|card|server)"
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "de", "fr", "es", "uk", "eu", "us", "ca", "it", "nl", "ch", "at", "se", "pl", "ru", "cn", "jp", "br", "in", "au")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|3(?:0|6|8)|35|62)"
RESERVED = r"^(?:0|127|255|22[4-9]|23[0-9]|24[0-9])\."
LABELERS = ("regex", "gazetteer", "context")
ABSTAIN = 2
SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
#: Characters of context on either side, up to the next match of the same kind.
NEAR = 32
#: Stands around matches while a text is cut; where a text has it itself, it reads as MARK_READ, which is in no match.
MARK, MARK_READ = "\ue000", "\ue001"


def found(text: Column, kind: str, digit: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a kind's pattern with what stands around them. The text is searched once and cut
    at its matches; nothing is looked up by its place in the whole text, so the cost is linear in text and matches."""
    cut = F.split(F.regexp_replace(F.translate(text, MARK, MARK_READ), f"({PATTERNS[kind]})", f"{MARK}$1{MARK}"), MARK, -1)

    def spans(parts: Column) -> Column:
        ends = common.running(F.transform(parts, F.length), F.lit(0), lambda a, b: a + b)
        gap = lambda x: F.struct(F.right(x, F.lit(NEAR)).alias("before"), F.left(x, F.lit(NEAR)).alias("after"))
        n = F.size(parts)
        every = F.arrays_zip(F.slice(parts, 2, n - 1).alias("m"), F.slice(ends, 2, n - 1).alias("start"), F.transform(F.slice(parts, F.lit(1), n - 1), gap).alias("left"), F.transform(F.slice(parts, 3, n - 1), gap).alias("right"))
        at = F.transform(F.filter(every, lambda x, i: i % 2 == 0), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["left"]["before"].alias("before"), F.coalesce(x["right"]["after"], F.lit("")).alias("after")))
        return at

    guard = GUARDS[kind](text)
    return F.when(digit & guard if kind in DIGITS and digit is not None else guard, common.let(cut, spans)).otherwise(F.array().cast(SPAN))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def worth(i: Column) -> Column:
        x = F.substring(F.reverse(d), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def votes(kind: str, x: Column) -> list[Column]:
    """Votes of LABELERS on a candidate."""
    m, d = x["m"], digits(x["m"])
    yes_no = lambda c: F.when(c, 1).otherwise(0)
    base = kind.partition("_")[0]
    strict = {
        "email": F.length(m) <= 254,
        "ip": valid("ip", m),
        "card": luhn(d),
        "phone": F.length(d).between(10, 15),
        "email_spelt": m.rlike(r"(?i)(?:\[|\()(?:at|dot)(?:\]|\))"),
        "phone_local": m.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9]"),
        "ssn": ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        "person": F.size(F.split(m, "[ -]")) >= 3,
        "street": m.rlike(rf"^[1-9].* (?:{WAYS})\.?$"),
    }[kind]
    listed = {
        "email": F.when(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), 1).otherwise(ABSTAIN),
        "ip": F.when(m.rlike(RESERVED), 0).otherwise(ABSTAIN),
        "card": yes_no(d.rlike(ISSUERS)),
        "phone": F.when(m.rlike(r"^\+[1-9]"), 1).otherwise(0),
        "ssn": F.when(F.substring(m, 1, 3).cast("int") < 773, 1).otherwise(ABSTAIN),
        "person": F.when(m.rlike(rf"^(?:{HONOURS})\b.* [A-Z]"), 1).when(m.rlike(rf"^(?:{GIVEN}) "), 1).otherwise(ABSTAIN),
        "street": F.when(m.rlike("(?:Street|Road|Avenue|Boulevard|Lane|Drive)$"), 1).otherwise(ABSTAIN),
    }[base]
    before, after = F.lower(x["before"]), F.lower(x["after"])
    around = F.when(before.rlike(AGAINST), 0).when(before.rlike(CUES[base]) | after.rlike(AFTER), 1).otherwise(ABSTAIN)
    return [yes_no(strict), listed, around]


def candidates(kind: str, spans: Column) -> Column:
    def of(x: Column) -> Column:
        n = F.least(F.length(digits(x["m"])), F.lit(20))
        keep = valid(kind, x["m"]) if kind in BASE else F.lit(False)
        v = votes(kind, x)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), keep.alias("base"), *(c.cast("int").alias(n_) for c, n_ in zip(v, LABELERS, strict=True)), n.alias("digits"))

    return F.transform(spans, of)


def with_candidates(docs: DataFrame, text: str, out: str = "__pii_cands") -> DataFrame:
    """docs with an array of candidates of all kinds."""
    raw = docs.withColumn("__pii_digit", F.col(text).rlike("[0-9]"))
    raw = raw.select("*", *(found(F.col(text), k, F.col("__pii_digit")).alias(f"__pii_{k}") for k in PATTERNS))
    every = F.concat(*(candidates(k, F.col(f"__pii_{k}")) for k in PATTERNS))
    return raw.select(*docs.columns, every.alias(out))


@dataclasses.dataclass
class Model:
    """reliability: of each labeler's votes; weights: log odds by feature and value; prior: log odds by kind."""

    reliability: dict[str, float]
    prior: dict[str, float]
    weights: dict[str, dict[str, float]]

    def chance(self, x: Column) -> Column:
        look = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key), F.lit(0.0)) if table else F.lit(0.0)
        odds = look(self.prior, x["kind"])
        for name, key in features(x).items():
            odds = odds + look(self.weights.get(name, {}), key)
        return 1 / (1 + F.exp(-odds))


def features(x: Column) -> dict[str, Column]:
    return {n: F.concat_ws("|", x["kind"], x[n].cast("string")) for n in (*LABELERS, "digits")}


def fit(docs: DataFrame, text: str = "text", rounds: int = 40) -> Model:
    """Reliabilities by expectation-maximisation over counted vote patterns, then the classifier's weights."""
    spans = with_candidates(docs.select(F.col(text).alias("text")), "text").select(F.explode("__pii_cands").alias("x")).select("x.*")
    table = spans.groupBy("kind", *LABELERS, "digits").agg(F.count("*").alias("n")).collect()  # 9 kinds * 27 votes * 21 at most
    trust = dict.fromkeys(LABELERS, 0.8)
    prior = dict.fromkeys(PATTERNS, 0.6)
    chance: list[float] = []
    for _ in range(rounds):
        chance = []
        for r in table:
            odds = math.log(prior[r.kind] / (1 - prior[r.kind]))
            for name in LABELERS:
                if r[name] != ABSTAIN:
                    odds += math.log(trust[name] / (1 - trust[name])) * (1 if r[name] else -1)
            chance.append(1 / (1 + math.exp(-odds)))
        for name in LABELERS:
            cast = [(r.n, p if r[name] else 1 - p) for r, p in zip(table, chance, strict=True) if r[name] != ABSTAIN]
            trust[name] = min(0.99, max(0.55, (8 + sum(n * p for n, p in cast)) / (10 + sum(n for n, _ in cast))))
        for kind in prior:
            own = [(r.n, p) for r, p in zip(table, chance, strict=True) if r.kind == kind]
            prior[kind] = min(0.99, max(0.01, (3 + sum(n * p for n, p in own)) / (5 + sum(n for n, _ in own))))
    weights: dict[str, dict[str, float]] = {}
    for name in (*LABELERS, "digits"):
        sums: dict[str, list[float]] = {}
        totals: dict[str, list[float]] = {}
        for r, p in zip(table, chance, strict=True):
            for to, key in ((sums, f"{r.kind}|{r[name]}"), (totals, r.kind)):
                pair = to.setdefault(key, [0.0, 0.0])
                pair[0] += r.n * p
                pair[1] += r.n * (1 - p)
        for key, (yes, no) in sums.items():
            all_yes, all_no = totals[key.partition("|")[0]]
            weights.setdefault(name, {})[key] = math.log((yes + 1) / (all_yes + 3)) - math.log((no + 1) / (all_no + 3))
    return Model(trust, {k: math.log(p / (1 - p)) for k, p in prior.items()}, weights)


def label(docs: DataFrame, model: Model, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with `out`: array<struct<start, rank, kind, end, base>>, sorted; rank is the kind's place in the list."""
    order = F.create_map(*[F.lit(v) for i, k in enumerate(PATTERNS) for v in (k, i)])
    df = with_candidates(docs, text)
    taken = F.filter("__pii_cands", lambda x: x["base"] | (x["kind"].isin(*ADDED) & (model.chance(x) >= 0.5)))
    spans = F.array_sort(F.transform(taken, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))))
    return df.select(*docs.columns, spans.alias(out))


def redact(text: Column, spans: Column, block: int = 64) -> Column:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first is named."""

    def of(xs: Column) -> Column:
        done = common.running(F.transform(xs, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))  # how far the spans before reach
        return common.let(F.zip_with(xs, done, lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))), pieces)

    def pieces(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(xs) - 1, F.lit(block))
        last = F.greatest(F.element_at(xs, -1)["at"], F.element_at(xs, -1)["end"])
        # a text is cut for a block of spans first, since a cut costs its distance from the text's start
        cut = F.transform(starts, lambda s: common.let(F.slice(xs, s + 1, F.lit(block)), lambda some: common.let(F.substring(text, some[0]["at"] + 1, F.element_at(some, -1)["start"] - some[0]["at"]), lambda near: F.array_join(F.transform(some, lambda x: one(x, near, some[0]["at"])), ""))))
        return F.concat(F.array_join(cut, ""), F.substring(text, last + 1, F.length(text)))

    def one(x: Column, near: Column, base: Column) -> Column:
        return F.when(x["start"] >= x["at"], F.concat(F.substring(near, x["at"] - base + 1, x["start"] - x["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")

    return F.when(F.size(spans) > 0, common.let(spans, of)).otherwise(text)


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    found_ = label(docs, fit(docs))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found_.select("doc_id", *(count(k) for k in BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
