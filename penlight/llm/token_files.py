"""Operator 9: token ids in compressed binary files, written and read back.

Ids (16 bits each) go to files in ascending document order. A file is a Parquet file
whose rows are blocks; Spark's commit protocol keeps lost tasks from leaving half files.
A block holds whole documents of about `BLOCK` ids and decodes on its own: document ids
and lengths, a table of its ids with frequencies that add up to 65536, the checksum of
its ids, and its code. A block is coded in lanes of `LANE` ids with a model and a range
coder of their own each, so that the lanes of many blocks advance together in arrays.
On the given texts the files take 0.53 of the 16 bits an id; lanes of 4,096 ids would
take 0.52, and twice the time.

Model: a lane remembers the id that last followed each two ids (order 2) and each id
(order 1), with a confidence; the block's table is order 0. Given both confidences and
whether the predictions agree, adaptive weights mix the three: the next id is coded as
order 2's, order 1's or another, and another one by its frequency in the table, in one
step of the coder. The range coder is carry-less, with 48 bits and 16-bit words.

Nulls and edges: a null text counts as empty and has the end id alone; documents of one
id keep some order among themselves; rows with a null id come first; an empty table
gives no files' rows and an empty result; a block that does not match its checksum
raises an error.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from penlight.llm._shared import give_back, new_folder, with_offsets, written
from penlight.llm.bpe import byte_symbols

# Spark runs a task on every core; the tokenizer must not start threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "word_bpe_49k.json"
END = 1
BLOCK, LANE = 65_536, 1_024
#: Blocks up to which their starts are sent to all tasks.
BROADCAST_BLOCKS = 200_000
#: Ids whose blocks are coded together.
TOGETHER = 6_000_000
#: Chunks of text that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1_200_000, 40
#: Bytes of text whose chunks are looked up together, and words that the tokenizer gets as one text.
STEP, TOGETHER_WORDS = 8_000_000, 8_000
#: Slots (a power of two) of a lane's memory of each order, and contexts of the weights.
SLOT_BITS, CONTEXTS = 9, 32
MASK, WORD, LEAST_RANGE = np.uint64(2**48 - 1), np.uint64(16), np.uint64(2**32 - 1)
#: Frequencies of classes add up to 2**12, those of a table to 2**16, both together to 2**28.
CLASS_BITS, ALL_BITS = 12, np.uint64(28)
#: Signs that are no part of a piece with letters or digits; the apostrophe may be, as in 's. Beside any other symbol they are one piece with it.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters on whose case, class and normal form all versions of Unicode agree; capital I with a dot becomes two characters.
LATIN = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+"
LETTERS = re.compile(LATIN)
#: A word with signs around it (RE2).
WITH_SIGNS = f"^(?P<head>[{re.escape(SIGNS)}]*)(?P<word>{LATIN})(?P<tail>[{re.escape(SIGNS)}]*)$"
#: In texts without them letters may be lowered before a chunk is looked up (RE2).
NOT_LATIN = "[^\\x{00}-\\x{12F}\\x{131}-\\x{24F}]"
#: What the vocabulary does before it joins symbols; lower-case words of LETTERS pass it as they are, one piece each.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BLOCK_SCHEMA = "part int, block int, doc_ids binary, lengths binary, ids binary, frequencies binary, lanes binary, code binary, crc32 long, n_ids long"


def words_only(path: str) -> tuple[Tokenizer, np.ndarray] | None:
    """For lower-case words of LETTERS: the library's tokenizer with the same merges, without the steps that leave such words as they are, and for each id whether it ends a piece. None where the vocabulary has other steps, lacks a byte or has special tokens of letters."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    end = model.get("end_of_word_suffix")
    same = (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS and [x["type"] for x in split] == ["Split", "ByteLevel"]
    if not same or not end or split[0] != {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True} or split[1]["add_prefix_space"] or split[1]["use_regex"]:
        return None
    # A special token that begins with letters could stand inside a word.
    if any(x["content"][:2].strip(SIGNS) for x in spec["added_tokens"]) or any(x not in model["vocab"] for b in byte_symbols() for x in (b, b + end)):
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for x, i in model["vocab"].items() if x.endswith(end)]] = True
    lean = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "truncation": None, "padding": None}
    return Tokenizer.from_str(json.dumps(lean)), ends


class ChunkIds:
    """Ids (16 bits each) of the chunks that white space separates; no piece of the tokenizer crosses white space."""

    def __init__(self, path: str):
        #: Chunks met of late, and those of the time before; what is met again moves to the first.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = words_only(path)
        #: Bytes as the vocabulary writes them; the blank stays between words.
        self.symbols = dict(enumerate(byte_symbols())) | {32: " "}
        # Stands between chunks that are encoded together; chunks that might hold a special token are encoded alone.
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        self.mark, self.mark_id = special[0] if special else ("", -1)
        self.alone = "|".join(re.escape(t[:2]) for t, _ in special) or r"[^\s\S]"
        self.as_it_stands = f"{NOT_LATIN}|{self.alone}"

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of whole texts with the end id; what was not seen before goes to the tokenizer together."""
        whole = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.words:
            # The tokenizer lowers letters, but special tokens are matched as they stand.
            whole = pc.if_else(pc.match_substring_regex(whole, self.as_it_stands), whole, pc.utf8_lower(whole))
        parts = pc.ascii_split_whitespace(whole)
        chunks = parts.flatten().dictionary_encode()
        ids = self.chunk_ids(chunks.dictionary).take(chunks.indices)
        if not len(ids):
            return [np.full(1, END, "<u2") for _ in range(len(parts))]
        ends = np.frombuffer(ids.buffers()[1], "<i4")[parts.offsets.to_numpy()] // 2
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u2")
        out = np.full(ends[-1] + len(parts), END, "<u2")
        for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            out[a + i : b + i] = flat[a:b]
        return np.split(out, (ends + np.arange(len(ends)))[1:-1])

    def chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks. Signs at either end of a word are pieces of their own; the word is encoded once for all signs and cases around it."""
        if not self.words:
            return self.ids(chunks)
        split = pc.extract_regex(chunks, WITH_SIGNS)
        word, head, tail = (pc.if_else(pc.match_substring_regex(chunks, self.alone), None, pc.struct_field(split, x)) for x in ("word", "head", "tail"))
        key = pc.coalesce(pc.utf8_lower(word), chunks)
        return pc.binary_join_element_wise(self.ids(pc.fill_null(head, "")), self.ids(key), self.ids(pc.fill_null(tail, "")), b"")

    def ids(self, strings: pa.Array) -> pa.Array:
        """Ids of strings, each encoded on its own."""
        coded = strings.dictionary_encode()
        # to_pylist would take many times as long.
        return pa.array(self.found(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(coded.indices)

    def found(self, strings: list[str]) -> list[bytes]:
        """Ids of distinct strings, from memory where they were met before."""
        young = self.young
        young[""] = b""
        lacking = [x for x, known in zip(strings, map(young.get, strings)) if known is None]
        young.update((x, known) for x, known in zip(lacking, map(self.old.get, lacking)) if known is not None)
        new = [x for x in lacking if x not in young]
        words = list(filter(LETTERS.fullmatch, new)) if self.words else []
        self.encode_words(words, young)
        if len(words) < len(new):
            others = [x for x in new if x not in young]
            alone = {x for x in others if re.search(self.alone, x)}
            self.encode_chunks(list(alone), [x for x in others if x not in alone], young)
        found = list(map(young.__getitem__, strings))
        for x in new:
            if len(x) > LONGEST:
                del young[x]
        if len(young) > REMEMBERED // 2:
            self.old, self.young = young, {}
        return found

    def encode_words(self, words: list[str], into: dict[str, bytes]) -> None:
        """Ids of lower-case words of LETTERS, each one piece, which an id that ends a piece closes."""
        if not words:
            return
        tokenizer, is_end = self.words
        texts = [" ".join(words[at : at + TOGETHER_WORDS]) for at in range(0, len(words), TOGETHER_WORDS)]
        texts = [t if t.isascii() else t.encode().decode("latin-1").translate(self.symbols) for t in texts]
        ids = np.concatenate([np.array(x.ids, np.int64) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends, whole, at = 2 * np.flatnonzero(is_end[ids]) + 2, ids.astype("<u2").tobytes(), 0
        for word, end in zip(words, ends.tolist(), strict=True):
            into[word] = whole[at:end]
            at = end

    def encode_chunks(self, alone: list[str], together: list[str], into: dict[str, bytes]) -> None:
        """One text of many chunks, with marks between, is much faster to encode than each chunk alone."""
        if not self.mark:
            alone, together = alone + together, []
        if together:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.mark} ".join(together)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = 2 * np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            whole, at = ids.astype("<u2").tobytes(), 0
            for chunk, end in zip(together, ends.tolist(), strict=True):
                into[chunk] = whole[at:end]
                at = end + 2
        for chunk, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            into[chunk] = np.array(found.ids, dtype="<u2").tobytes()


def steps(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole texts, of some STEP bytes each, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // STEP)) + 1).tolist(), len(texts)]
    yield from (texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


_chunks: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One for each worker process and path."""
    if path not in _chunks:
        _chunks[path] = ChunkIds(path)
    return _chunks[path]


class Lanes:
    """Model and coder states of many lanes; lanes with most ids come first, so that the active ones are a prefix. Products with a condition stand for a choice: they are faster than np.where."""

    def __init__(self, n: int):
        self.base = np.arange(n, dtype=np.int64) << SLOT_BITS
        #: id * 8 + confidence; id -1 stands for none.
        self.after1, self.after2 = np.full(n << SLOT_BITS, -8, np.int32), np.full(n << SLOT_BITS, -8, np.int32)
        self.context_base = np.arange(n, dtype=np.int32) * np.int32(CONTEXTS)
        #: Weight (of 4096) of order 2 times 65536, plus that of order 1.
        self.weights = np.full(n * CONTEXTS, (256 << 16) + 256, np.int32)
        self.last1, self.last2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, MASK, np.uint64)
        self.words_at = np.zeros(n, np.int64)

    def predict(self, a: int) -> None:
        """Predictions of both orders for the first a lanes, and where the classes end (of 4096): order 2's id, order 1's id."""
        m = self.last1[:a] * np.uint32(0x9E3779B1)
        self.at1 = self.base[:a] + (m >> np.uint32(32 - SLOT_BITS))
        self.at2 = self.base[:a] + ((m + self.last2[:a] * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS))
        self.held1, self.held2 = self.after1[self.at1], self.after2[self.at2]
        self.guess1, self.guess2, self.sure1, self.sure2 = self.held1 >> 3, self.held2 >> 3, self.held1 & 7, self.held2 & 7
        self.context = self.context_base[:a] + (np.minimum(self.sure2, 3) << 3) + (np.minimum(self.sure1, 3) << 1) + (self.guess1 == self.guess2)
        held = self.weights[self.context]
        self.weight2, self.weight1 = held >> 16, held & 0xFFFF
        self.first = self.weight2
        self.second = self.first + (((4096 - self.first) * self.weight1) >> CLASS_BITS)

    def learn(self, a: int, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        """What the ids (32 bits) teach; which of them order 1 and order 2 had foretold."""
        w2 = self.weight2 + (((hit2 * np.int32(1 << CLASS_BITS)) - self.weight2) >> 4)
        w1 = self.weight1 + (((hit1 * np.int32(1 << CLASS_BITS)) - self.weight1) >> 4) * ~hit2
        self.weights[self.context] = (np.maximum(np.minimum(w2, 3800), 24) << 16) + np.maximum(np.minimum(w1, 3800), 24)
        fresh = (ids << 3) + 1
        for after, at, held, sure, hit in ((self.after1, self.at1, self.held1, self.sure1, hit1), (self.after2, self.at2, self.held2, self.sure2, hit2)):
            # A guess that was right gains confidence, up to 7; a wrong one loses half of it, or gives way.
            kept = held + hit * (sure < 7) - ((sure + 1) >> 1) * ~hit
            after[at] = fresh + (kept - fresh) * (hit | (sure > 1))
        self.last2[:a] = self.last1[:a]
        self.last1[:a] = ids

    def narrow(self, a: int, start: np.ndarray, size: np.ndarray, move) -> None:
        """Takes part [start, start + size) of 2**28 of the first a ranges; move(rows, low) shifts a word out or in."""
        part = self.range[:a] >> ALL_BITS
        low, extent = self.low[:a] + part * start.astype(np.uint64), part * size.astype(np.uint64)
        self.low[:a], self.range[:a] = low, extent
        rows = np.flatnonzero((extent <= LEAST_RANGE) | ((low ^ (low + extent)) <= LEAST_RANGE))
        while len(rows):
            low, extent = self.low[rows], self.range[rows]
            # Either the first word is settled, or the range ends where it would change.
            extent = np.where((low ^ (low + extent)) <= LEAST_RANGE, extent, (~low + np.uint64(1)) & LEAST_RANGE)
            move(rows, low)
            low, extent = (low << WORD) & MASK, extent << WORD
            self.low[rows], self.range[rows] = low, extent
            rows = rows[(extent <= LEAST_RANGE) | ((low ^ (low + extent)) <= LEAST_RANGE)]


def lane_table(blocks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks' numbers of ids: for each lane its block, first id in the block and number of ids; most ids first."""
    block = np.concatenate([np.full(-(-n // LANE), b, np.int64) for b, n in enumerate(blocks)])
    first = np.concatenate([np.arange(0, n, LANE, dtype=np.int64) for n in blocks])
    size = np.minimum(LANE, np.array(blocks)[block] - first)
    order = np.argsort(-size, kind="stable")
    return block[order], first[order], size[order]


def by_step(values: np.ndarray, base: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each step the value of every lane (a column) that still has one; lanes begin at base."""
    rows = np.zeros((len(base), length[0]), values.dtype)
    for row, at, n in zip(rows, base.tolist(), length.tolist()):
        row[:n] = values[at : at + n]
    return np.ascontiguousarray(rows.T)


def active(length: np.ndarray) -> np.ndarray:
    """How many lanes still have an id at each step; lengths are descending."""
    return len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 65536."""
    room = 65536 - len(counts)
    scaled = 1 + counts * room // counts.sum()
    scaled[np.argmax(scaled)] += 65536 - scaled.sum()
    return scaled


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of a block, each id's place among them, and how often they occur."""
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    places = np.zeros(len(counts), np.uint16)
    places[known] = np.arange(len(known))
    return known, places[ids], counts[known]


def encode_blocks(blocks: list[np.ndarray]) -> list[dict]:
    """ids, frequencies, lanes and code of each block."""
    tables = [table_of(ids) for ids in blocks]
    sizes = [scaled_frequencies(t[2]) for t in tables]
    block, first, length = lane_table([len(x) for x in blocks])
    lanes = Lanes(len(block))
    base = np.cumsum([0, *map(len, blocks)])[block] + first
    # Ids and their parts of the tables, step by step.
    ids = by_step(np.concatenate(blocks), base, length)
    starts = by_step(np.concatenate([(np.cumsum(x) - x).astype("<u2")[t[1]] for x, t in zip(sizes, tables)]), base, length)
    wides = by_step(np.concatenate([(x - 1).astype("<u2")[t[1]] for x, t in zip(sizes, tables)]), base, length)
    out = np.zeros((len(block), 2 * LANE + 8), np.uint16)

    def move(rows, low):
        out[rows, lanes.words_at[rows]] = (low >> np.uint64(32)).astype(np.uint16)
        lanes.words_at[rows] += 1

    for t, a in enumerate(active(length)):
        lanes.predict(a)
        now = ids[t, :a].astype(np.int32)
        hit2, hit1 = lanes.guess2 == now, lanes.guess1 == now
        only1, other = hit1 & ~hit2, ~(hit1 | hit2)
        first2, rest = lanes.first << 16, (4096 - lanes.second) * other
        low = only1 * first2 + other * (lanes.second << 16) + starts[t, :a] * rest
        wide = hit2 * first2 + only1 * ((lanes.second - lanes.first) << 16) + (wides[t, :a] + np.int32(1)) * rest
        lanes.narrow(a, low, wide, move)
        lanes.learn(a, now, hit1, hit2)
    for _ in range(3):
        rows = np.arange(len(block))
        move(rows, lanes.low)
        lanes.low = (lanes.low << WORD) & MASK
    made = []
    for b, table in enumerate(tables):
        mine = np.flatnonzero(block == b)
        mine = mine[np.argsort(first[mine])]
        words = lanes.words_at[mine]
        made.append({"ids": table[0].astype("<u2").tobytes(), "frequencies": (sizes[b] - 1).astype("<u2").tobytes(), "lanes": words.astype("<u4").tobytes(), "code": b"".join(out[i, :n].astype("<u2").tobytes() for i, n in zip(mine, words))})
    return made


def decode_blocks(rows: list[dict]) -> list[np.ndarray]:
    """The ids of each block; rows hold its lengths, ids, frequencies, lanes and code."""
    counts = [int(np.frombuffer(r["lengths"], "<u4").sum()) for r in rows]
    tables = [np.frombuffer(r["ids"], "<u2").astype(np.int32) for r in rows]
    sizes = [np.frombuffer(r["frequencies"], "<u2").astype(np.int64) + 1 for r in rows]
    offsets = np.cumsum([0, *map(len, sizes)])
    known, size = np.concatenate(tables), np.concatenate(sizes)
    start = np.concatenate([np.cumsum(s) - s for s in sizes])
    # For each block and value below 65536 the place of its id in the block's table.
    place = np.concatenate([np.repeat(np.arange(len(s), dtype=np.uint16), s) for s in sizes])
    block, first, length = lane_table(counts)
    lanes = Lanes(len(block))
    code_words = np.concatenate([*(np.frombuffer(r["code"], "<u2") for r in rows), np.zeros(8, np.uint16)])
    words = [np.frombuffer(r["lanes"], "<u4").astype(np.int64) for r in rows]
    of_block = np.cumsum([0, *(int(w.sum()) for w in words)])
    starts = np.concatenate([of_block[b] + np.cumsum(w) - w for b, w in enumerate(words)])
    first_lane = np.cumsum([0, *map(len, words)])
    lanes.words_at = starts[first_lane[block] + first // LANE]
    code = np.zeros(len(block), np.uint64)

    def move(at, low):
        code[at] = ((code[at] << WORD) & MASK) | code_words[lanes.words_at[at]].astype(np.uint64)
        lanes.words_at[at] += 1

    for _ in range(3):
        move(np.arange(len(block)), None)
    # An entry of a table: its id, where it starts and its size less 1, 16 bits each.
    entries = known.astype(np.int64) + (start << 16) + ((size - 1) << 32)
    table_at, place_at = offsets[block], block << 16
    found = np.zeros((length[0], len(block)), np.uint16)
    for t, a in enumerate(active(length)):
        lanes.predict(a)
        # Quotients of numbers below 2**48, rounded down rightly in doubles; below 2**28 where the code is not damaged.
        value = np.minimum(((code[:a] - lanes.low[:a]) & MASK).astype(np.float64) / (lanes.range[:a] >> ALL_BITS).astype(np.float64), 2.0**28 - 1).astype(np.int32)
        share = value >> 16
        hit2, other = share < lanes.first, share >= lanes.second
        only1 = ~(hit2 | other)
        rest = 4096 - lanes.second
        inner = ((value - (lanes.second << 16)) * other / rest).astype(np.int32)
        entry = entries[table_at[:a] + place[place_at[:a] + inner]]
        first2, rest = lanes.first << 16, rest * other
        low = only1 * first2 + other * (lanes.second << 16) + ((entry >> 16) & 0xFFFF).astype(np.int32) * rest
        wide = hit2 * first2 + only1 * ((lanes.second - lanes.first) << 16) + ((entry >> 32).astype(np.int32) + 1) * rest
        now = hit2 * lanes.guess2 + only1 * lanes.guess1 + other * (entry & 0xFFFF).astype(np.int32)
        lanes.narrow(a, low, wide, move)
        lanes.learn(a, now, lanes.guess1 == now, lanes.guess2 == now)
        found[t, :a] = now
    ends = np.cumsum([0, *counts])
    out = np.zeros(ends[-1], np.uint16)
    for lane, at, n in zip(np.ascontiguousarray(found.T), (ends[block] + first).tolist(), length.tolist()):
        out[at : at + n] = lane[:n]
    return [out[ends[b] : ends[b + 1]] for b in range(len(rows))]


def file_blocks(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one partition's documents, which come in order."""
        chunks = chunk_ids(path)
        number, held = 0, 0
        full: list[tuple[list, list]] = []
        ids, texts, size = [], [], 0

        def coded() -> pa.RecordBatch:
            nonlocal number
            blocks = [np.concatenate(t) for _, t in full]
            rows = []
            for (docs, parts), whole, made in zip(full, blocks, encode_blocks(blocks)):
                known = np.array([-(2**63) if x is None else x for x in docs], "<i8")
                rows.append({"part": part_no, "block": number, "doc_ids": known.tobytes(), "lengths": np.array([len(p) for p in parts], "<u4").tobytes(), "crc32": zlib.crc32(whole.tobytes()), "n_ids": len(whole)} | made)
                number += 1
            full.clear()
            return pa.RecordBatch.from_pylist(rows, schema=OUT)

        for batch in batches:
            part_no = batch.column(2)[0].as_py() if batch.num_rows else 0
            encoded = (x for some in steps(batch.column(1)) for x in chunks.encode(some))
            for i, found in zip(batch.column(0).to_pylist(), encoded):
                ids.append(i)
                texts.append(found)
                size += len(found)
                if size >= BLOCK:
                    full.append((ids, texts))
                    held += size
                    ids, texts, size = [], [], 0
                    if held >= TOGETHER:
                        yield coded()
                        held = 0
        if ids:
            full.append((ids, texts))
        if full:
            yield coded()
        # The worker keeps what it remembers, but not the arrays of this task.
        give_back()

    return write


OUT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), ("frequencies", pa.binary()), ("lanes", pa.binary()), ("code", pa.binary()), ("crc32", pa.int64()), ("n_ids", pa.int64())])


def block_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: part, block, place, doc_id, offset (ids before it in the block), ids as unsigned 32-bit little-endian integers."""
    for batch in batches:
        waiting: list[dict] = []
        rows = batch.to_pylist()
        for k, row in enumerate(rows):
            waiting.append(row)
            if k + 1 < len(rows) and sum(len(r["code"]) for r in waiting) < TOGETHER:
                continue
            for r, ids in zip(waiting, decode_blocks(waiting)):
                if zlib.crc32(ids.astype("<u2").tobytes()) != r["crc32"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} does not match its checksum")
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                known = np.frombuffer(r["doc_ids"], "<i8")
                wide, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths) * 4
                n = len(known)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, r["part"], np.int32)),
                        pa.array(np.full(n, r["block"], np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(known, mask=known == -(2**63)),
                        pa.array(np.cumsum(lengths) - lengths),
                        pa.array([wide[e - 4 * k : e] for e, k in zip(ends, lengths)], pa.binary()),
                    ],
                    names=["part", "block", "place", "doc_id", "offset", "ids"],
                )
            waiting = []


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> None:
    """Writes the ids of all texts, with the end id after each, in ascending order of id_col."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(file_blocks(path), BLOCK_SCHEMA).write.parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, place, doc_id, offset and ids (binary) of every document of a folder."""
    return read_blocks(spark, folder).mapInArrow(block_documents, "part int, block int, place int, doc_id long, offset long, ids binary")


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, block and first: the ids of all blocks before."""
    return with_offsets(read_blocks(spark, folder).select("part", "block", "n_ids"), "part", ["block"], "first", "n_ids").select("part", "block", "first")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    rows = read_tokens(spark, folder).select("part", "block", "doc_id", "offset", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    starts = written(block_starts(spark, folder), "starts")
    few = starts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    joined = rows.join(F.broadcast(starts) if few else starts.hint("merge"), ["part", "block"])
    return joined.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
