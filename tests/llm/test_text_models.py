"""Operators 1, 5 and 10: held-out accuracy, brute force and the tokenizers library."""

import hashlib
import itertools
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from penlight.llm import bpe, language_id, quality_crf

TABLES = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    rows = language_id.op1_language_id(spark, TABLES).collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "the the", None), (4, None, "en")], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 -- 3", 1), (4, "the", 1), (5, "und", 1), (6, "x" * 100_000, 1), (4, "the", 1)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in language_id.identified(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"] and rows[1].score == 0
    assert rows[6].lang_pred in ("en", "de")
    none = language_id.learn(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.identified(odd, none).collect()} == {"und"}
    assert language_id.identified(odd.limit(0), model).count() == 0


def test_unseen_words_back_off():
    model = language_id.LanguageModel([("a", "zaza zazu zaka " * 9), ("b", "bobo bobu boka " * 9)])
    assert model.predict("zazaza")[0] == "a" and model.predict("bobobo")[0] == "b"


def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_bpe_equals_the_library():
    t, c = library(), bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    texts = ["", " ", "It's WE'LL I'D", "ΑΣ ΣΑΣ<|endoftext|>x <|startoftext|> y", "a\x1cb \x1f c\x85d e​f", "é é İ ǅ ß", "中文 かな 한국 🙂", "x" * 5000, "a1b22-c_d!?.. «»", "<|endoftext|", "퟿"]
    texts += [f"Ab{chr(i)}cS {chr(i)}" for i in range(1, 0x3000, 7) if i not in (0x558, 0x58B, 0x58C, 0x88F, 0xC5C, 0xCDC)]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == (struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)), text[:50]


def test_bpe_joins_by_rank_and_place():
    c = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))

    def plain(piece):
        s = [bpe.byte_symbols()[b] for b in piece.encode()]
        ids = [c.vocab[x] for x in [*s[:-1], s[-1] + c.end]]
        while pairs := [(c.ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in c.ranks]:
            rank, i = min(pairs)
            ids[i : i + 2] = [c.joined[rank]]
        return ids

    for piece in map("".join, itertools.product("theain", repeat=5)):
        assert c.merged(piece) == plain(piece)


def test_bpe_remembers_words_in_little_memory():
    c = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    words = [f"{a}{b}ing" for a in map("".join, itertools.product("bdklmprst", repeat=3)) for b in ("ea", "oa", "ui", "au", "ie")]
    tracemalloc.start()
    c.encode(" ".join(words))
    held_bytes = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(c) == len(words) == len(c.pieces_known)
    assert held_bytes < 250 * len(words)


def test_bpe_with_few_words_remembered():
    t, c = library(), bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), (3, 2))
    for text in ("The cat, the dog; THE end. naïve ΑΣ", "a b c d e f g a b c d e f g", "the<|endoftext|>the cat"):
        ids = t.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == (struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False))
        assert len(c) <= 3 and len(c.pieces_known) <= 2
    encode = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY), 0, (3, 2))
    texts = ["the cat sat on the mat", None, "a dog and a cat"]
    model = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    for batch in encode(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])] * 2)):
        assert len(model) <= 3 and len(model.pieces_known) <= 2
        expected = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in batch.column(1).to_pylist()] == expected
    assert not model and not model.pieces_known


def test_bpe_query(spark):
    t = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe.op5_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "a", None)], "doc_id long, text string, ids string")
    assert sorted(r.n_tokens for r in bpe.digests(odd).collect()) == [0, 0, 1]
    assert bpe.tokenized(odd.limit(0)).count() == 0


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    rows = quality_crf.op10_quality_crf(spark, TABLES).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in tested) >= 0.95 * len(tested)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    texts = ["One line. here\nAND ANOTHER!!\n| x | y |", "single", "a a a a\nb"]
    batch = quality_crf.Batch(texts)
    field = quality_crf.LineField(batch.own.mean(axis=0), np.ones(batch.own.shape[1]), None, rng.normal(size=(2, 2)))
    emission = rng.normal(size=(len(batch.own), 2))
    marginals, counted = field.chain(emission, batch)
    moves = np.zeros((2, 2))
    for start, n in zip(batch.starts, batch.sizes):
        total, seen, pairs = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(emission[start + t, y] for t, y in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            for t, y in enumerate(labels):
                seen[t, y] += p
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] += p
        assert np.allclose(marginals[start : start + n], seen / total)
        moves += pairs / total
    assert np.allclose(counted, moves)


def test_quality_of_odd_texts(spark):
    field = quality_crf.fit(["Fine words here. And so on.\nMore of it."] * 20 + ["BAD!! BAD!! BAD!!\n| x | x |"] * 20, [1] * 20 + [0] * 20)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "\n \n", 1), (4, "A fine line. It is.\n" * 5000, 1), (5, "BAD!! BAD!!", 1)], "doc_id long, text string, predicted int")
    rows = {r.doc_id: r for r in quality_crf.scored(odd, field).collect()}
    assert rows[1].score == rows[2].score == rows[3].score and rows[4].score > rows[5].score and len(rows) == 5
    assert quality_crf.scored(odd.limit(0), field).count() == 0
    assert list(quality_crf.fit([], []).scores(["x"])) == [0.5] and list(quality_crf.fit(["a", None], [1, 1]).scores(["x"])) == [1.0]
