"""Operators against plain second implementations: language scores, quality scores, differencing, added spans, all code points."""

import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from penlight.llm import bpe, language_id, ngram_join, pii, quality_crf, sharding

TABLES = "/root/testdata/sf0.001"


def test_language_scores_word_by_word(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    model = language_id.LanguageModel([(lang, text) for _, text, lang in rows if lang and text][:60])
    grams = {g: model.piece_rows[i] for g, i in model.pieces.items()}
    for _, text, _ in rows[60:]:
        sums = [0.0] * len(model.languages)
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        for word in letters.split():
            if word in model.known:
                row = model.known_rows[model.known[word]]
            else:
                marked, row, n = f"<{word}>", np.zeros(len(sums)), 0
                for i in range(len(marked)):
                    best = next((grams[marked[i : i + k]] for k in (4, 3, 2, 1) if marked[i : i + k] in grams), None)
                    if best is not None:
                        row, n = row + best, n + 1
                row = row / max(n, 1)
            sums = [a + b for a, b in zip(sums, row)]
        expected = model.languages[max(range(len(sums)), key=lambda i: (sums[i], -i))] if letters.split() else "und"
        lang, score = model.predict(text)
        assert lang == expected
        if letters.split():
            assert math.isclose(score, 1 / sum(math.exp(max(x - max(sums), -700)) for x in sums), rel_tol=1e-6)


def test_numbers_are_no_letters():
    model = language_id.LanguageModel([("x", "some words here some words"), ("y", "other ones there other ones")])
    assert all(model.predict(t) == ("und", 0.0) for t in ("² ½ Ⅷ", "12 ٣", "_ _", ""))
    assert model.predict("words²")[0] == "x"


def plain_features(line, times):
    words = line.split()
    if not words:
        return [0.0] * 12
    n, size = len(words), len(line)
    odd = [c for c in line if not (c.isalnum() or c == "_" or c.isspace())]
    return [
        math.log(1 + n), sum(w.isupper() for w in words) / n, len(odd) / size, sum(c in "0123456789" for c in line) / size, len(set(words)) / n, len({w.lower() for w in words}) / n**0.9,
        sum(a == b for a, b in zip(words, words[1:])) / n, line.count("|") / n, len(re.findall(r"[^\w\s.,]{2,}|[^\w\s]{3,}", line)) / n, min(size / n, 40.0), float(times > 1), float(line.rstrip()[-1] in ".!?"),
    ]


def plain_score(field, text):
    """The document's score by enumerating all labellings of its lines."""
    lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
    own = [[min(max((v - m) / s, -4), 4) for v, m, s in zip(plain_features(x, lines.count(x)), field.mean, field.spread)] for x in lines]
    none = [0.0] * 12
    design = [[1.0, *f, *[v * v for v in f], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), float(i == 0), float(i == len(own) - 1)] for i, f in enumerate(own)]
    emission = np.array(design) @ field.weights
    total, good = 0.0, np.zeros(len(lines))
    for labels in itertools.product((0, 1), repeat=len(lines)):
        p = math.exp(sum(emission[i, y] for i, y in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:])))
        total += p
        good += p * np.array(labels)
    weights = [max(len(x), 1) for x in lines]
    mean = min(max(float(good / total @ weights / sum(weights)), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(field.slope * math.log(mean / (1 - mean)) + field.shift)))


def test_quality_scores_by_enumeration(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.learn(docs, labels)
    short = [(r.doc_id, r.text) for r in docs.collect() if (r.text or "").count("\n") < 8] + [(-1, None), (-2, "| a | b |\n\n$$$ !!!\n \nA line. Another.")]
    rows = spark.createDataFrame(short + short[:1], "doc_id long, text string")
    found = [(r.doc_id, r.score) for r in quality_crf.scored(rows, field).collect()]
    assert len(found) == len(short) + 1
    texts = dict(short)
    for i, score in found:
        assert math.isclose(score, plain_score(field, texts[i]), rel_tol=1e-6, abs_tol=1e-9)


def test_moves_inside_documents_are_learned():
    good, bad = "A fine line of plain words here.", "BAD!! $$$ |x| |y| !!!"
    texts = ["\n".join([good] * 6)] * 20 + ["\n".join([good] * 3 + [bad] * 6)] * 20
    field = quality_crf.fit(texts, [1] * 20 + [0] * 20)
    batch = quality_crf.Batch([texts[-1]])
    marginals, _ = field.chain(field.design(batch) @ field.weights, batch)
    assert marginals[0, 1] > 0.5 > marginals[-1, 1]
    assert batch.cut(4).sizes.tolist() == [4, 4, 1]


def test_differencing_against_plain_lists():
    rng = random.Random(2)
    for _ in range(30):
        shards, n = rng.choice((2, 3, 8)), rng.randrange(1, 40)
        sizes = [rng.randrange(1, 10**12) for _ in range(n)]
        single = [[0] * (shards - 1) + [x] for x in sizes]
        waiting = [sorted(p) for p in single]
        while len(waiting) > 1:
            waiting.sort(key=lambda p: p[0] - p[-1])
            a, b = waiting.pop(0), waiting.pop(0)
            waiting.append(sorted(x + y for x, y in zip(a, reversed(b))))
        sums = [0] * shards
        for x, at in zip(sizes, sharding.differenced(single, shards)):
            sums[at[-1]] += x
        assert sorted(sums) == waiting[0]


def plain_spans(text, kind):
    """iban and ssn spans: pattern, checksum, and whole context words in the text between spans of the kind."""
    found = list(re.finditer(pii.PATTERNS[kind], text))
    out = []
    for k, m in enumerate(found):
        before = text[found[k - 1].end() if k else 0 : m.start()][-pii.WINDOW :]
        after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)][: pii.WINDOW]
        if kind == "iban":
            plain = m[0].replace(" ", "")
            if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
                continue
        elif re.search("^(?:000|666|9)|-00-|-0000$", m[0]):
            continue
        near = any(re.search(rf"(?<![a-z]){w}s?(?![a-z])", f"{before} | {after}".lower()) for w in pii.CONTEXT[kind])
        if pii.SCORES[kind] + pii.BOOST * near >= pii.THRESHOLD:
            out.append((m.start(), kind, m.end()))
    return out


def test_added_spans_against_plain_python(spark):
    rng = random.Random(4)
    parts = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013001", "123-45-6789", "000-12-3456", "078-05-1120", "ssn", "my iban", "social", "shipssn", "accounts", "x", "é", "\n", "security number is", ", and"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(150)]
    for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for kind in ("iban", "ssn"):
            assert [(s["start"], s["kind"], s["end"]) for s in r.pii if s["kind"] == kind] == plain_spans(r.text, kind)


def test_masking_keeps_a_column_of_the_spans_name(spark):
    rows = spark.createDataFrame([(1, "write to a@b.cc", "kept", 5), (2, None, None, 6)], "doc_id long, text string, pii string, _m_email int")
    assert sorted(map(tuple, pii.masked(rows).collect())) == [(1, "write to <email>", "kept", 5), (2, None, None, 6)]


def test_many_candidates_in_one_text(spark):
    text = " ".join(f"4111 1111 1111 {1000 + k % 9000}," for k in range(3000))
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    expected = [(m.start(), m.end()) for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text) if luhn(re.sub("[^0-9]", "", m[0]))]
    assert [(s["start"], s["end"]) for s in row.pii if s["kind"] == "card"] == expected


def test_all_code_points_encode_as_the_library_does():
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    own = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    points = [c for c in itertools.chain(range(0x33480), range(0xE0000, 0xE0200), range(0xF0000, 0xF0010)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}B {chr(c)}1 " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids, decoded = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == found.ids
        assert decoded == library.decode(found.ids, skip_special_tokens=False)


def test_long_texts_and_clashing_columns_of_the_join(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(30000)]
    near = list(words)
    for k in range(0, 30000, 3000):
        near[k] = "other"
    rows = [(1, " ".join(words), 7), (2, " ".join(near), 8), (3, "alone in here with some words", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert sorted(map(tuple, ngram_join.one_of_each(docs).select("doc_id", "component_id").collect())) == [(1, 7), (3, 9)]


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 33, 200, 1500):
        for shared in (0.2, 0.8, 1.0):
            pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            a, b = pool[:n], pool[int(n * (1 - shared)) : int(n * (1 - shared)) + max(1, int(n * 0.9))]
            x, y = ngram_join.parities(a).view(np.uint64), ngram_join.parities(b).view(np.uint64)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
