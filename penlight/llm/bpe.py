"""Operator 5: byte-pair encoding and decoding of whole texts.

A text falls into chunks at white space; a chunk into pieces by the vocabulary's
pattern; a piece into symbols that are joined in the order of merge ranks. The ranks
wait in a priority queue, the symbols form a doubly linked list, and queue entries whose
symbols have changed meanwhile are skipped. Ids of chunks are remembered during a task,
up to a bound; nothing else is, so that what a worker holds stays small. Decoding looks
up the ids of a whole text and concatenates the vocabulary's strings with the separator
of the tokenizer (it has no decoder, so a blank).

Nulls and edges: a null text counts as empty and has no ids; a text of white space has
none either; special tokens that stand in a text get their own ids; repeated rows are
rows of their own; an empty table gives an empty result; other columns pass through,
except that input columns named ids or decoded are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from penlight.llm._shared import give_back, small_batches

VOCABULARY = "word_bpe_49k.json"
#: Most chunks and pieces that a task remembers, and those of a task whose executor holds much already: less memory, more time. LONGEST: the longest of them.
REMEMBERED, FEW, LONGEST = (400_000, 500_000), (50_000, 100_000), 48
#: Rows in a batch that goes back to Spark.
ROWS_OUT = 200
#: What str.split() takes for white space and the vocabulary's pattern does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Characters on whose case, class and normal form all versions of Unicode agree; only capital I with a dot changes its length.
LATIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec(dict):
    """Ids (little-endian unsigned 32-bit) of a chunk; a dict of those already seen."""

    def __init__(self, path: str, remembered: tuple[int, int] = REMEMBERED):
        super().__init__()
        self.remembered = remembered
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        known = self.vocab | self.special
        #: The string of each id, and the id as bytes, one object for all words that it stands for.
        self.strings = np.full(max(known.values(), default=-1) + 1, None, dtype=object)
        self.strings[list(known.values())] = list(known)
        self.single = [struct.pack("<I", i) for i in range(len(self.strings))]
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        #: The symbol that each rank makes.
        self.joined = [new for _, _, new in merges]
        #: Ids of each byte inside a piece and at its end.
        symbols = byte_symbols()
        self.inner_ids, self.last_ids = [self.vocab.get(s) for s in symbols], [self.vocab.get(s + self.end) for s in symbols]
        # Only what it knows of Unicode is asked for: normal forms, and the classes of letters outside LATIN. So it gets no vocabulary.
        bare = {"added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(spec | bare))
        self.pieces_known: dict[str, bytes] = {}

    def merged(self, piece: str) -> list[int]:
        """The ids of one piece."""
        data, ranks, joined = piece.encode(), self.ranks, self.joined
        ids = [*map(self.inner_ids.__getitem__, data[:-1]), self.last_ids[data[-1]]]
        if None in ids:  # bytes that the vocabulary lacks
            ids = [x for x in ids if x is not None]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # An entry is one number: the rank above the place, so that the least is the lowest rank furthest to the left.
        bits = n.bit_length()
        places = (1 << bits) - 1
        queue = [rank << bits | i for i, rank in enumerate(map(ranks.get, zip(ids, ids[1:]))) if rank is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> bits, entry & places
            j = after[i]
            if j < 0 or ids[i] < 0 or ranks.get((ids[i], ids[j])) != rank:
                continue  # stale: one of the two symbols has been joined to another since
            new = joined[rank]
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (found := ranks.get((new, ids[k]))) is not None:
                    heapq.heappush(queue, found << bits | i)
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))) is not None:
                heapq.heappush(queue, found << bits | h)
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        if found := self.pieces_known.get(piece):
            return found
        ids = self.merged(piece)
        made = self.single[ids[0]] if len(ids) == 1 else struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            if len(self.pieces_known) >= self.remembered[1]:
                self.pieces_known.clear()
            self.pieces_known[piece] = made
        return made

    def special_or_plain(self, part: str) -> list[bytes]:
        if part in self.special:
            return [self.single[self.special[part]]]
        if LATIN.fullmatch(part):
            plain = low if (low := part.lower()) != part else part  # one string as chunk and piece
            return [self.piece(x) for x in ((plain,) if plain.isalpha() else self.pieces.findall(plain))]
        plain = self.library.normalizer.normalize_str(part)
        return [self.piece(plain[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def decode(self, ids: bytes) -> str:
        return " ".join(self.strings[np.frombuffer(ids, "<u4")].tolist())

    def __missing__(self, chunk: str) -> bytes:
        parts = self.split_special.split(chunk) if self.split_special and "<" in chunk else (chunk,)
        found = [x for part in parts if part for x in self.special_or_plain(part)]
        made = found[0] if len(found) == 1 else b"".join(found)
        if len(chunk) <= LONGEST:
            if len(self) >= self.remembered[0]:
                self.clear()
            self[chunk] = made
        return made

    def forget(self) -> None:
        self.clear()
        self.pieces_known.clear()

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids of a whole text as bytes, and the text decoded from them."""
        chunks = text.split() if text and not SEPARATORS.search(text) else regex.split(r"\s+", text or "")
        ids = b"".join(map(self.__getitem__, chunks))
        return ids, self.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and path."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def tokenized(docs: DataFrame, text_col: str = "text", path: str | None = None, remembered: tuple[int, int] = REMEMBERED) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers) and decoded (string). path: the vocabulary file on every machine. remembered: most chunks and pieces that a task remembers; it changes time and memory only."""
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(encoder(path, docs.columns.index(text_col), remembered), schema)


def encoder(path: str, text_at: int, remembered: tuple[int, int] = REMEMBERED):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What earlier stages have freed in this worker goes back first.
        give_back()
        model = codec(path)
        model.remembered = remembered
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                done = [model.encode(x) for x in part.column(text_at).to_pylist()]
                made = [pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "ids", "decoded"])
        # Workers outlive their tasks; what they remember should not fill the memory of other stages.
        model.forget()
        give_back()

    return encode


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remembered: tuple[int, int] = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    coded = tokenized(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), remembered=remembered)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
