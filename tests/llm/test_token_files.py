"""Operator 9: exact round trips, and the query against the tokenizers library."""

import json
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from penlight.llm import token_files as tf
from penlight.llm._shared import new_folder


def round_trip(blocks):
    rows = tf.encode_blocks(blocks)
    return tf.decode_blocks([r | {"lengths": np.array([len(b)], "<u4").tobytes()} for r, b in zip(rows, blocks)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), min_size=1, max_size=300), min_size=1, max_size=5))
def test_any_ids_come_back(blocks):
    blocks = [np.array(b, "<u2") for b in blocks]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(round_trip(blocks), blocks))


def test_lanes_of_several_lengths():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, k, n).astype("<u2") for k, n in ((49408, 9000), (2, 4096), (40, 4097), (1, 20_000), (300, 1))]
    assert all((x == y).all() for x, y in zip(round_trip(blocks), blocks))


def test_repeats_cost_little():
    block = np.tile(np.random.default_rng(2).integers(0, 49408, 60), 400).astype("<u2")
    assert len(tf.encode_blocks([block])[0]["code"]) < len(block) // 4


def expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path(tf.VOCABULARY))
    start, out = 0, []
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, tf.END]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, tf.op9_token_files(spark, "/root/testdata/sf0.001").collect())) == expected(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [(3, None), (1, ""), (2, "x\x1cy  é Σ <|endoftext|>z"), (9, "word " * 3000), (5, " "), (5, " ")]
    folder = new_folder(spark, "odd")
    tf.write_tokens(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int"), folder)
    found = tf.read_tokens(spark, folder).orderBy("part", "block", "place").collect()
    assert [(r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids)) for r in found] == [(i, n, c) for i, _, n, c in expected([(i, t or "") for i, t in rows])]


def test_damage_is_noticed(spark):
    folder = new_folder(spark, "damaged")
    tf.write_tokens(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), folder)
    rows = [r.asDict() | {"crc32": 1} for r in spark.read.parquet(folder).collect()]
    spark.createDataFrame(rows, tf.BLOCK_SCHEMA).write.parquet(folder + "-2")
    with pytest.raises(Exception, match="checksum"):
        tf.read_tokens(spark, folder + "-2").collect()


def test_empty_table(spark):
    folder = new_folder(spark, "none")
    tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert tf.read_tokens(spark, folder).count() == 0


def test_signs_beside_other_symbols(spark):
    rng = np.random.default_rng(5)
    parts = ["yes", "done", "a", "5", "Ab1", "é", "ß", "中", "²", "Σ", "'s", "'", "“", "”", "…", "–", "€", "»", "«", "‘", "’", "🙂", "̸", "​", ".", ",", "!", "(", ")", "-", "\"", "*", "/", "<|endoftext|>", " ", " ", "\n"]
    texts = ["“yes”.", "done…)", "a–,", "5€.", "»ja«.", "(‘a’)", "🙂!"]
    texts += ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(1, 9, 100_000)]
    t, chunks = Tokenizer.from_file(public_tokenizers.path(tf.VOCABULARY)), tf.ChunkIds(public_tokenizers.path(tf.VOCABULARY))
    for at in range(0, len(texts), 5_000):
        some = texts[at : at + 5_000]
        for text, mine, theirs in zip(some, chunks.encode(some), t.encode_batch(some, add_special_tokens=False)):
            assert mine.tolist() == [*theirs.ids, tf.END], text


class Counted:
    """A tokenizer that counts the characters it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.characters = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.characters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def assert_library(texts, path=None):
    path = path or public_tokenizers.path(tf.VOCABULARY)
    chunks = tf.ChunkIds(path)
    for mine, theirs in zip(chunks.encode(texts), Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert mine.tolist() == [*theirs.ids, tf.END]


def test_words_skip_what_leaves_them_as_they_are():
    chunks = tf.ChunkIds(public_tokenizers.path(tf.VOCABULARY))
    chunks.tokenizer = counted = Counted(chunks.tokenizer)
    words = ["".join(x) for x in np.random.default_rng(6).choice(list("aeinrstéüßñ"), (3_000, 7))]
    chunks.encode([" ".join(words), " ".join(f"({w.title()})," for w in words)])
    assert counted.characters < 100  # signs alone


def test_every_letter_of_words():
    letters = [chr(c) for c in range(0x21, 0x250)]
    texts = [t for c in letters for t in (c, f"x{c}y", f"({c}{c}),", f"A{c}B {c}'s", f"{c}\u0301", f"{c} \u4e2d")]
    texts += [unicodedata.normalize("NFD", t) for t in texts] + [" ".join(texts), "\x85a\xa0b\u2003c\x1cd\x0be", "<|ENDOFTEXT|> <|endoftext|>", "<|endoftext|>É", "É<|Ab", "", " ", None]
    assert_library(texts)


def test_other_vocabularies(tmp_path):
    with open(public_tokenizers.path(tf.VOCABULARY), encoding="utf-8") as file:
        spec = json.load(file)
    texts = ["Some Words, É and (Ünder) don't", "Plain WORDS 12", "xabx (cabs) ab"]
    letters = [spec["added_tokens"][0] | {"content": "ab"}]
    for k, change in enumerate(({"normalizer": None}, {"added_tokens": []}, {"added_tokens": letters}, {"normalizer": {"type": "NFC"}, "added_tokens": []})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        assert_library(texts, str(path))


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 40)
    chunks, t = tf.ChunkIds(public_tokenizers.path(tf.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(tf.VOCABULARY))
    rng = np.random.default_rng(7)
    for _ in range(60):
        text = " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i, j in rng.integers(0, 26, (15, 2)))
        assert chunks.encode([text])[0].tolist() == [*t.encode(text, add_special_tokens=False).ids, tf.END]
        assert len(chunks.young) + len(chunks.old) <= 80


def test_long_batches_go_in_steps(monkeypatch):
    monkeypatch.setattr(tf, "STEP", 10)
    texts = pa.array(["abc", None, "d" * 35, "", "e", "ab", "f" * 9])
    parts = list(tf.steps(texts))
    assert [x for p in parts for x in p.to_pylist()] == texts.to_pylist() and len(parts) > 2
    assert list(tf.steps(texts.slice(0, 0))) == []
