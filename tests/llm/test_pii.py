"""Operator 6 against a plain reading of its contract."""

import hashlib
import random
import re

import pytest

from penlight.llm import pii

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def keeps(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def brute(text):
    found = []
    for no, (kind, pattern) in enumerate(BASE):
        found += [(m.start(), no, kind, m.end()) for m in re.finditer(pattern, text or "") if keeps(kind, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def random_text(rng):
    bits = ["a@b.co", "x.y@z", "b.c_d@e.f.g", "@", "+1 (456) 555-2186", "4944339490429605", "4111 1111-1111 1111", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "99", "é", "𝒳", " ", "-", ".", "+", "abc", "12-", "0000001.2.3.255", "\n", "token"]
    return "".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(0, 25)))


def outcome(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.find_spans(docs).collect()}


def test_base_spans_match_a_plain_reading(spark):
    rng = random.Random(5)
    texts = [None, "", " ", *[random_text(rng) for _ in range(400)]]
    for i, row in outcome(spark, texts).items():
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.pii if s.kind in pii.BASE)
        assert base == brute(texts[i]), texts[i]


def test_whole_table_matches(spark):
    rows = pii.op6_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == (brute(texts[r.doc_id]).count(",") + 1 if brute(texts[r.doc_id]) else 0)


def test_long_runs_stay_linear(spark):
    texts = ["7" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "1 " * 100_000]
    rows = outcome(spark, texts)
    assert all("card" not in {s.kind for s in r.pii} for r in rows.values())


@pytest.mark.parametrize(("text", "kinds"), [("pay to iban GB82 WEST 1234 5698 7654 32 now", ["iban"]), ("GB82 WEST 1234 5698 7654 33", []), ("ssn 123-45-6789", ["ssn"]), ("part 123-45-6789", [])])
def test_added_kinds(spark, text, kinds):
    assert [s.kind for s in outcome(spark, [text])[0].pii] == kinds


def test_context_raises_the_score(spark):
    rows = outcome(spark, ["card 4111111111111111", "4111111111111111"])
    assert rows[0].pii[0].score > rows[1].pii[0].score


def test_mask_keeps_the_rest_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "é a@b.co or +1 (456) 555-2186.", "kept"), (2, None, None), (2, "x", "y")], "doc_id long, text string, pii string")
    rows = sorted(pii.masked(docs.withColumnRenamed("pii", "note")).collect(), key=str)
    assert {(r.doc_id, r.text, r.note) for r in rows} == {(1, "é <email> or <phone>.", "kept"), (2, None, None), (2, "x", "y")}


def test_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("slice_", [256, 3])
def test_slices_change_nothing(spark, monkeypatch, slice_):
    """Texts with more matches than a slice has, spans that overlap across slices, and text between and after them."""
    monkeypatch.setattr(pii, "SLICE", slice_)
    texts = ["é 10.0.0.1 " * 40 + "tail", "+1 (456) 555-2186 4111111111111111 a@b.co " * 9, "a@b.co", "none", " +4111111111111111+4111111111111111+4111111111111111 x", "4111 1111 1111 1111 10.1.1.1 " * 7 + "ü"]
    rows = outcome(spark, texts)
    for i, text in enumerate(texts):
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in rows[i].pii if s.kind in pii.BASE)
        assert base == brute(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.masked(docs).collect():
        out, at = [], 0
        for s in rows[r.doc_id].pii:
            if s.start >= at:
                out += [texts[r.doc_id][at : s.start], f"<{s.kind}>"]
            at = max(at, s.end)
        assert r.text == "".join(out) + texts[r.doc_id][at:]


def test_a_hundred_thousand_matches(spark):
    import time

    n = 100_000
    text = " ".join(f"10.{i % 250}.{i // 250 % 250}.7" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    assert len(pii.find_spans(docs).head().pii) == n
    assert pii.masked(docs).head().text == " ".join(["<ip>"] * n)
    # Two passes; steps that grew with the square of the matches took hours.
    assert time.monotonic() - began < 120
