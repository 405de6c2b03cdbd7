"""Operator 6: personal data, by patterns, checksums and context words. DataFrame functions only.

A regular expression proposes spans of a kind, a validator confirms them (Luhn for card
numbers, mod 97 for IBANs, value and digit bounds for addresses and phones), and whole words
shortly before or after a span raise its score. The base kinds (email, ip, card, phone) have fixed
meanings and always stay; iban and ssn count from a score of `THRESHOLD` on.

Patterns are written so that a scan stays linear on any text: quantifiers are possessive
where nothing after them could match less, and a span may start inside a run of its
characters only where the span before it ended (\\G).

Nulls and edges: a null text counts as empty; empty texts have no spans; repeated rows
are rows of their own; an empty table gives an empty result; input columns that bear the
name of an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in the order of ties, with their patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
# Score of a confirmed span, and words that raise it when one stands shortly before.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
BOOST, THRESHOLD = 0.3, 0.5
#: Code points before and after a span in which context words count, as far as the next span of its kind.
WINDOW = 48
#: Matches whose offsets are summed up one by one.
SLICE = 256
SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int,score:double>>"


def may_hold(kind: str, text: Column) -> Column:
    """A cheap test that keeps most texts from the pattern."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]")


def confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(value, F.lit(" "), F.lit(""))
        turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
        number = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(turned, F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97))
        return F.length(plain).between(15, 34) & (rest == 1)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(before, F.lit(" | "), after)).rlike("(?<![a-z])(?:" + "|".join(CONTEXT[kind]) + ")s?(?![a-z])")
    return F.least(F.lit(SCORES[kind]) + F.when(near, BOOST).otherwise(0.0), F.lit(1.0))


def in_slices(items: Column) -> Column:
    """An array cut into arrays of at most SLICE elements: what grows an array step by step stays within one of them, since each step copies it."""

    def cut(held: Column) -> Column:
        last = F.greatest(F.ceil(F.size(held) / F.lit(SLICE)), F.lit(1)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(held, i * SLICE + 1, SLICE))

    # As the variable of a lambda the array is made once, not for every slice.
    return F.transform(F.array(items), cut)[0]


def starts_of(lengths: Column) -> Column:
    """For each element the sum of those before it."""
    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def kind_spans(kind: str, found: Column, pieces: Column) -> Column:
    """Spans of one kind. found: the matches in order; pieces: the text between them. The offset of a match is the length of all before it: within its slice, and of the slices before."""
    no = list(PATTERNS).index(kind)
    pairs = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"), F.slice(pieces, 2, F.size(found)).alias("q"))
    placed = F.transform(
        in_slices(pairs),
        lambda part: F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["p"])).alias("start"), (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"), F.right(x["p"], F.lit(WINDOW)).alias("before"), F.left(x["q"], F.lit(WINDOW)).alias("after"))).alias("out"),
            ),
        ),
    )

    def confirmed_spans(part: Column, base: Column) -> Column:
        good = F.filter(part["out"], lambda s: confirmed(kind, s["value"]))
        spans = F.transform(good, lambda s: F.struct((base + s["start"]).alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), (base + s["end"]).alias("end"), score(kind, s["before"], s["after"]).alias("score")))
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)

    # The slices' starts are held beside them; a lambda then sees one slice and its start.
    held = F.transform(F.array(placed), lambda p: F.arrays_zip(p.alias("part"), starts_of(F.transform(p, lambda x: x["at"])).alias("base")))
    spans = F.flatten(F.transform(held[0], lambda x: confirmed_spans(x["part"], x["base"])))
    return F.when(F.size(found) > 0, spans.cast(SPANS)).otherwise(F.array().cast(SPANS))


def unused(docs: DataFrame, name: str) -> str:
    """name, with marks in front until no column begins with it."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    return name


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii: the spans of all kinds by start, then kind: start, kind_no, kind, end (code points, exclusive) and score."""
    docs = docs.drop("pii")
    own = unused(docs, "_match")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    held = docs.withColumns({f"{own}_m_{k}": F.when(may_hold(k, text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()})
    split = held.withColumns({f"{own}_p_{k}": F.when(F.size(f"{own}_m_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in PATTERNS.items()})
    spans = F.array_sort(F.concat(*[kind_spans(k, F.col(f"{own}_m_{k}"), F.col(f"{own}_p_{k}")) for k in PATTERNS]))
    return split.withColumn("pii", spans).drop(*[f"{own}_{x}_{k}" for x in "mp" for k in PATTERNS])


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; of spans that overlap, the first stands for both."""
    text, spans = F.col(text_col), unused(docs, "_spans")
    # The spans get a name of their own, so that a column pii of the input stays what it is.
    kept = docs.withColumnRenamed("pii", f"{spans}_kept")
    found = find_spans(kept, text_col).withColumnRenamed("pii", spans).withColumnRenamed(f"{spans}_kept", "pii")
    reach, parts = f"{spans}_reach", f"{spans}_parts"
    # Where the spans of the slices before end, and with it where each slice's stretch of text begins.
    furthest = F.transform(in_slices(F.col(spans)), lambda part: F.array_max(F.transform(part, lambda s: s["end"])))
    ends = F.aggregate(furthest, F.array(F.lit(0)), lambda acc, e: F.array_append(acc, F.greatest(F.element_at(acc, -1), F.coalesce(e, F.lit(0)))))
    held = found.withColumn(reach, F.when(F.size(spans) > 0, ends))
    stretch = F.zip_with(in_slices(F.col(spans)), F.sequence(F.lit(1), F.size(reach) - 1), lambda part, i: F.struct(part.alias("spans"), F.element_at(reach, i).alias("from"), F.substr(text, F.element_at(reach, i) + 1, F.element_at(reach, i + 1) - F.element_at(reach, i)).alias("text")))
    held = held.withColumn(parts, F.when(F.size(spans) > 0, stretch))
    cut = F.transform(
        F.col(parts),
        lambda p: F.aggregate(
            p["spans"],
            F.struct(p["from"].alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
                F.struct(s["end"].alias("at"), F.array_append(F.array_append(acc["out"], F.substr(p["text"], acc["at"] - p["from"] + 1, s["start"] - acc["at"])), F.concat(F.lit("<"), s["kind"], F.lit(">"))).alias("out"))
            ),
            lambda acc: F.array_join(acc["out"], ""),
        ),
    )
    whole = F.concat(F.array_join(cut, ""), F.substr(text, F.element_at(reach, -1) + 1))
    return held.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).select(*docs.columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("pii")
    counts = [F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    base = F.filter(spans, lambda s: s["kind_no"] < len(BASE))
    return find_spans(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
