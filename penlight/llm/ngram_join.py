"""Operator 7: joining documents by the Jaccard similarity of their word 5-grams.

Method: prefix filters under several global token orders. Two sets of similarity t or
more share a token among the first n - ceil(t n) + 1 of each, whatever the order of
tokens. All orders here put frequent shingles last (by powers of two of their frequency,
counted over all documents); ties fall to a hash, another one for each order. The first
order makes candidates from an inverted index of prefixes, thinned by size and by the
places of the shared token. The other two orders are then intersected with it on
signatures: a document's prefixes under both, and the parities of its shingles in a
bitmap, which bound the difference of two sets from below. Only pairs that pass all of it
have their whole sets brought together and counted exactly.

Copies never meet each other: documents of equal sets form a class that its smallest id
stands for. Links are sought until every candidate pair is either verified or already in
one component: rounds of stars (all holders of a token against one of them) join the
large groups with work linear in their size; the last round then takes, for each token,
the holders outside its largest component, and compares their signatures with those of
all of any other component that holds the token, in blocks. Of what passes there, one
pair for each document and component is verified first, and the others only where that
one is no link.

Frequent tokens are never dealt to one task: their postings are salted in the search for
lone tokens, and joins on them leave skew to Spark's splitting of skewed joins. Texts
with very many copies find their class in a table of at most `HOT` rows.

Sets are 64-bit hashes of the shingles.

Nulls and edges: a null text and a text without words have an empty set, n_shingles 0,
and link with nothing; a text of fewer than five words has one shingle; a row with a null
id links with nothing and has a null component; rows of one id are one document, which
links where any of them does; an empty table gives an empty result; input columns that
bear the name of an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penlight.llm._shared import forget, give_back, small_batches, written

WORDS = 5
#: Least similarity as a fraction.
LEAST = (3, 4)
#: Most tokens that count as frequent, their least frequency, and the level (power of two) from which their postings are salted. They only shape the orders: no token or pair is left out.
FREQUENT, FREQUENT_FROM, SALTED_FROM = 200_000, 4, 4
#: Classes that a task remembers, bytes and documents that it hashes at once, tokens that it counts at once.
REMEMBERED, STEP_BYTES, STEP, COUNTED = 150_000, 250_000, 1_000, 1_200_000
#: Salts of a frequent token's postings.
SALTS = 1_009
#: Rows up to which ids and pairs are sent to all tasks; beyond, a shuffle joins them.
BROADCAST_ROWS = 300_000
STAR_ROUNDS = 1
#: Documents on either side of a block of signatures, and documents that meet one other's set in a task, on average.
BLOCK, PARTNERS = 1_000, 256
#: A text is hot if its copies are more than this part of all rows, so there are at most so many hot texts.
HOT = 1_000
#: Holders of a token up to which each is compared with all others before its postings are kept; the postings of more holders are all kept.
HOLDERS = 64
#: Bits of a signature's bitmap: the power of two from twice the set's size on, but at least this.
LEAST_BITS = 64
MULTIPLIER, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: One for each order.
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (x ^ seed) * MULTIPLIER
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


#: A random number for each byte.
BYTES = mixed(np.arange(256, dtype=np.uint64), np.uint64(0x452821E638D01377))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of MULTIPLIER and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((MULTIPLIER, INVERSE)):
            row = np.full(max(n, STEP_BYTES), base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data: differences of running sums over bytes, shifted back to their start."""
    raw = np.frombuffer(data, np.uint8)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * up[: len(raw)], out=sums[1:])
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return mixed((sums[ends] - sums[starts]) * down[starts], (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, ascending within a text, and where each text's begin (with the end of all)."""
    parts = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]
    hashes, starts = word_hashes(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    last = np.searchsorted(starts, ends, side="left")
    first = np.concatenate([[0], last[:-1]])
    count = last - first
    h = np.full(max(len(hashes) - WORDS + 1, 0), WORDS, np.uint64)
    for k in range(WORDS):
        h = (h ^ (h >> np.uint64(31))) * MULTIPLIER + hashes[k : k + len(h)]
    h = mixed(h, np.uint64(1))
    sets = []
    for a, n in zip(first.tolist(), count.tolist()):
        if n >= WORDS:
            own = h[a : a + n - WORDS + 1]
            own.sort()
            sets.append(own)
        elif n:
            short = np.uint64(n)
            for x in hashes[a : a + n]:
                with np.errstate(over="ignore"):
                    short = (short ^ (short >> np.uint64(31))) * MULTIPLIER + x
            sets.append(mixed(np.array([short]), np.uint64(2)))
        else:
            sets.append(hashes[:0])
    tokens = np.concatenate(sets) if sets else hashes[:0]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    keep = np.ones(len(tokens), dtype=bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return tokens[keep], kept[np.concatenate([[0], np.cumsum(sizes)])]


def fingerprints(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set."""
    out = []
    for seed in SEEDS[:2]:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens, seed), dtype=np.uint64)])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about STEP_BYTES of text (its second column), whole rows each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        n = max(1, min(STEP, int(np.searchsorted(sizes, done + STEP_BYTES, side="right")) - at))
        yield batch.slice(at, n)
        at += n
    # Gives memory back to the machine between batches.
    give_back()


def distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Steps: ids, tokens, bounds, fingerprints, and which rows are the first of their class in this task (and not empty)."""
    seen: set[int] = set()
    for batch in batches:
        for part in steps(batch):
            ids = part.column(0).to_pylist()
            tokens, at = shingle_sets(part.column(1).to_pylist())
            c1, c2 = fingerprints(tokens, at)
            fresh = []
            for k, one in enumerate(c1.tolist()):
                if at[k] == at[k + 1] or one in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(one)
                fresh.append(k)
            yield ids, tokens, at, c1, c2, fresh


def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (kind 0) for each document, and rows (kind 1) for the tokens that several of this task's classes hold, with their number."""
    names = ["kind", "doc_id", "n", "c1", "c2"]
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        tokens = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
        held.clear()
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
        times = np.diff(np.append(first, len(tokens)))
        tokens, times = tokens[first[times > 1]].view(np.int64), times[times > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), pa.nulls(len(tokens), pa.int64()), pa.array(times, pa.int64()), pa.array(tokens, pa.int64()), pa.nulls(len(tokens), pa.int64())], names=names)

    for ids, tokens, at, c1, c2, fresh in distinct_sets(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(c1), pa.array(c2)], names=names)
        held += [tokens[at[k] : at[k + 1]] for k in fresh]
        if sum(map(len, held)) > COUNTED:
            yield counted()
    yield counted()


class Orders:
    """The global orders of tokens."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.levels = tokens[order], levels[order].astype(np.uint64)

    def level(self, tokens: np.ndarray) -> np.ndarray:
        """0 for tokens that are not frequent, below 64 for all."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, tokens.view(np.int64)), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens.view(np.int64), self.levels[at], np.uint64(0))

    def keys(self, tokens: np.ndarray, level: np.ndarray, no: int) -> np.ndarray:
        """Numbers by which order `no` sorts tokens: the level, then a hash. Where they tie, the token decides."""
        return (mixed(tokens, SEEDS[no]) >> np.uint64(6)) | (level << np.uint64(58))


def prefix(keys: np.ndarray) -> np.ndarray:
    """Places of a set's prefix in the order of keys; the set's tokens ascend."""
    n, (a, b) = len(keys), LEAST
    return np.argsort(keys, kind="stable")[: n - -(-a * n // b) + 1]


def posting_rows(orders: Orders):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, at, c1, _, fresh in distinct_sets(batches):
            level = orders.level(tokens)
            keys = orders.keys(tokens, level, 0)
            if not fresh:
                continue
            places = [prefix(keys[at[k] : at[k + 1]]) + at[k] for k in fresh]
            sizes = np.array([len(p) for p in places])
            place, rows = np.concatenate(places), np.array(fresh)
            doc = np.array([ids[k] for k in fresh], np.int64)
            often = level[place] >= SALTED_FROM
            who = np.repeat(doc, sizes)
            columns = [
                tokens[place].view(np.int64),
                np.where(often, (who & 0x7FFFFFFF) % SALTS + 1, 0).astype(np.int32),
                np.repeat(c1[rows], sizes),
                who,
                np.repeat(np.diff(at)[rows], sizes).astype(np.int32),
                (np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "salt", "c1", "doc_id", "n", "pos"])

    return post


def may_link(nx, ny, px, py):
    """Sizes allow the similarity, and so do the places of a shared token (the first one of a pair that links always passes)."""
    a, b = LEAST
    return (np.minimum(nx, ny) * b >= np.maximum(nx, ny) * a) & (np.minimum(nx - px, ny - py) * (a + b) >= (nx + ny) * a)


def linkable(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Of postings sorted by token, one for each token and class: which may link with another holder of their token."""
    token, n, pos = rows["token"], rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    keep = np.repeat(size > HOLDERS, size)
    # after[k]: holders of the same token that come after row k.
    after = np.repeat(first + size, size) - np.arange(len(token)) - 1
    after[keep] = 0
    at, shift = np.flatnonzero(after > 0), 1
    while len(at):
        good = at[may_link(n[at], n[at + shift], pos[at], pos[at + shift])]
        keep[good] = keep[good + shift] = True
        shift += 1
        at = at[after[at] >= shift]
    return keep


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token, class and id: one row for each token and class, where another class of the token may link with it. Salted rows, of tokens known to be frequent, all stay."""
    columns = ("token", "c1", "doc_id", "n", "pos")
    out = [c for c in columns if c != "c1"]
    waiting: list[dict[str, np.ndarray]] = []

    def shared(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.ones(len(rows["token"]), dtype=bool)
        new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["c1"][1:] != rows["c1"][:-1])
        rows = {c: x[new] for c, x in rows.items()}
        keep = linkable(rows)
        return pa.RecordBatch.from_arrays([pa.array(rows[c][keep]) for c in out], names=out)

    def together() -> dict[str, np.ndarray]:
        return {c: np.concatenate([w[c] for w in waiting]) for c in columns}

    for batch in batches:
        rows = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("salt", *columns)}
        often = rows.pop("salt") > 0
        if often.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][often]) for c in out], names=out)
            rows = {c: x[~often] for c, x in rows.items()}
        token = rows["token"]
        if not len(token):
            continue
        # The last token's rows wait for those in the next batch.
        done = int(np.searchsorted(token == token[-1], True)) if token[0] != token[-1] else 0
        if done or waiting and waiting[-1]["token"][-1] != token[-1]:
            waiting.append({c: x[:done] for c, x in rows.items()})
            yield shared(together())
            waiting.clear()
        waiting.append({c: x[done:] for c, x in rows.items()})
    if waiting:
        yield shared(together())


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and the set of each text."""
    for batch in batches:
        for part in steps(batch):
            tokens, at = shingle_sets(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), lists(tokens.view(np.int64), np.diff(at))], names=["id", "tokens"])


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of a set: each bit tells whether an odd number of tokens falls on it. Halves combine by exclusive or to the bitmap of half the size."""
    size = LEAST_BITS
    while size < 2 * len(tokens):
        size *= 2
    odd = np.bincount((mixed(tokens, SEEDS[1]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def signature_rows(orders: Orders):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, size of the set, its bitmap, and 16 bits of each token of its prefixes under the second and third order."""
        for batch in batches:
            for part in steps(batch):
                tokens, at = shingle_sets(part.column(1).to_pylist())
                bits = [parities(tokens[at[k] : at[k + 1]]) for k in range(part.num_rows)]
                made = [part.column(0), pa.array(np.diff(at).astype(np.int32)), lists(np.concatenate([np.zeros(0, np.int64), *bits]), np.array([len(x) for x in bits]))]
                level = orders.level(tokens)
                for no in (1, 2):
                    keys = orders.keys(tokens, level, no)
                    found = [keys[at[k] : at[k + 1]][prefix(keys[at[k] : at[k + 1]])] for k in range(part.num_rows)]
                    made.append(lists(np.concatenate([keys[:0], *found]).astype(np.uint16).view(np.int16), np.array([len(x) for x in found])))
                yield pa.RecordBatch.from_arrays(made, names=["id", "n", "bits", "p2", "p3"])

    return rows


SIGNATURE = "id long, n int, bits array<long>, p2 array<short>, p3 array<short>"


def arrays_of(table: pa.Table, name: str) -> list[np.ndarray]:
    rows = table.column(name).combine_chunks()
    ends = np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False))
    return np.split(pc.list_flatten(rows).to_numpy(zero_copy_only=False), ends[:-1]) if len(rows) else []


def alike_in_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of a document on the right (u) and one on the left (v) that pass all filters, with the difference (of 1000) that their bitmaps show."""
    a, b = LEAST
    found: list[tuple[int, int, int]] = []
    if left.num_rows and right.num_rows:
        label = left.column("label")[0].as_py()
        ids, sizes = left.column("id").to_numpy(), left.column("n").to_numpy().astype(np.int64)
        # Without a sign, since bitwise_count takes absolute values.
        bits, p2, p3 = [x.view(np.uint64) for x in arrays_of(left, "bits")], arrays_of(left, "p2"), arrays_of(left, "p3")
        widths = np.array([len(x) for x in bits])
        # For each width that occurs on the right: the left rows that it can be compared with, folded to it.
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        theirs = zip(right.column("id").to_pylist(), right.column("n").to_pylist(), [x.view(np.uint64) for x in arrays_of(right, "bits")], arrays_of(right, "p2"), arrays_of(right, "p3"))
        for u, n, own, own2, own3 in theirs:
            w = len(own)
            if w not in tables:
                at = np.flatnonzero((widths == w) | (widths == 2 * w))
                tables[w] = at, np.array([bits[k] if widths[k] == w else bits[k][:w] ^ bits[k][w:] for k in at], dtype=np.uint64).reshape(len(at), w)
            at, table = tables[w]
            differ = np.bitwise_count(table ^ own).sum(axis=1, dtype=np.int64)
            if w % 2 == 0:
                half = np.flatnonzero(widths * 2 == w)
                narrow = own[: w // 2] ^ own[w // 2 :]
                at = np.concatenate([at, half])
                differ = np.concatenate([differ, [int(np.bitwise_count(bits[k] ^ narrow).sum()) for k in half]]).astype(np.int64)
            fits = (differ * (a + b) <= (sizes[at] + n) * (b - a)) & (np.minimum(sizes[at], n) * b >= np.maximum(sizes[at], n) * a) & (ids[at] != u)
            for k, d in zip(at[fits].tolist(), differ[fits].tolist()):
                if np.isin(own2, p2[k]).any() and np.isin(own3, p3[k]).any():
                    found.append((u, int(ids[k]), 1000 * d // (n + int(sizes[k]))))
    else:
        label = None
    return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64()), "label": pa.array([label] * len(found), pa.int64()), "differ": pa.array([x[2] for x in found], pa.int64())})


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node it can reach) for the nodes of edges (u, v), by alternating large and small stars."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "edges")
        forget(edges)
        forget(large)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def stars(edges: DataFrame) -> bool:
    """Whether every u has one v that is no u itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    return nodes.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def small_or_merged(rows: DataFrame) -> DataFrame:
    """rows with the hint to send them to all tasks where they are at most BROADCAST_ROWS, and to merge them by a shuffle beyond."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows.hint("merge")


def folded(bits: str, words) -> Column:
    """A bitmap brought to a number of words, its own one or half of it."""
    whole = F.col(bits)
    return F.when(F.size(whole) == words, whole).otherwise(F.zip_with(F.slice(whole, 1, words), F.slice(whole, words + 1, words), lambda x, y: x.bitwiseXOR(y)))


class NgramJoin:
    """The steps of the join over one table: doc_id (long) and text."""

    def __init__(self, docs: DataFrame):
        small_batches(docs.sparkSession)
        self.docs = docs
        marks = written(docs.mapInArrow(class_rows, "kind int, doc_id long, n long, c1 long, c2 long"), "classes")
        self.orders = self.frequent(marks.where("kind = 1"))
        self.members = written(self.classes(marks.where("kind = 0")), "members")
        forget(marks)

    @staticmethod
    def classes(rows: DataFrame) -> DataFrame:
        """doc_id, n and rep, the smallest id of the documents of the same set (null for empty sets and null ids)."""
        known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        full = rows.where(known)
        classes = written(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
        hot = F.broadcast(classes.where(F.col("copies") > F.lit(rows.count()) / HOT).select("c1", "c2", "rep"))
        others = full.join(hot, ["c1", "c2"], "left_anti").join(classes.select("c1", "c2", "rep").hint("merge"), ["c1", "c2"])
        return full.join(hot, ["c1", "c2"]).select("doc_id", "n", "rep").unionByName(others.select("doc_id", "n", "rep")).unionByName(rows.where(~known).select("doc_id", "n", F.lit(None).cast("long").alias("rep")))

    @staticmethod
    def frequent(counts: DataFrame) -> Orders:
        """The most frequent tokens: at most FREQUENT of them come to the driver and go to the tasks."""
        tokens = written(counts.groupBy(F.col("c1").alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM).withColumn("level", F.floor(F.log2("n")).cast("int")), "frequent")
        total, least = 0, None
        for level, n in sorted(((r[0], r[1]) for r in tokens.groupBy("level").count().collect()), reverse=True):
            total += n
            if total > FREQUENT:
                break
            least = level
        if least is None:
            return Orders(np.zeros(0, np.int64), np.zeros(0, np.int64))
        rows = tokens.where(F.col("level") >= least).select("token", "level").toArrow()
        forget(tokens)
        return Orders(rows.column("token").to_numpy(), rows.column("level").to_numpy())

    def postings(self) -> DataFrame:
        """token, rep, n and pos: the prefixes under the first order, without tokens that only one class has."""
        sent = self.docs.sparkSession.sparkContext.broadcast(self.orders)
        # A row without an id would stand for its class in a task, and then not be posted.
        rows = self.docs.where("doc_id is not null").mapInArrow(lambda batches: posting_rows(sent.value)(batches), "token long, salt int, c1 long, doc_id long, n int, pos int")
        dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "c1", "doc_id")
        shared = dealt.mapInArrow(shared_rows, "token long, doc_id long, n int, pos int")
        copies = written(self.members.where("rep <> doc_id").select("doc_id", "rep").distinct(), "copies")
        found = shared.join(small_or_merged(copies), "doc_id", "left")
        return written(found.select("token", F.coalesce("rep", "doc_id").alias("rep"), "n", "pos"), "postings")

    def texts(self, ids: DataFrame) -> DataFrame:
        """id and text of the documents of a written table of ids."""
        return self.docs.join(small_or_merged(ids), F.col("doc_id") == F.col("id")).select("id", "text")

    def signatures(self, ids: DataFrame) -> DataFrame:
        sent = self.docs.sparkSession.sparkContext.broadcast(self.orders)
        return written(self.texts(written(ids.distinct(), "ids")).mapInArrow(lambda batches: signature_rows(sent.value)(batches), SIGNATURE), "signatures")

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose signatures pass all filters."""
        made = self.signatures(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
        side = lambda x: made.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits", "p2", "p3")])
        parts, keyed = self.dealt(pairs)
        left = side("a").join(small_or_merged(parts), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = side("b").join(small_or_merged(keyed), "b").join(left.hint("merge"), ["a", "part"])
        a, b = LEAST
        words = F.least(F.size("bits_a"), F.size("bits_b"))
        near = F.greatest(F.size("bits_a"), F.size("bits_b")) <= 2 * words
        differ = F.aggregate(F.zip_with(folded("bits_a", words), folded("bits_b", words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        good = F.when(near & F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"), differ * (a + b) <= (F.col("n_a") + F.col("n_b")) * (b - a))
        kept = written(both.where(good).select("a", "b").distinct(), "passing")
        for table in (made, parts, keyed):
            forget(table)
        return kept

    @staticmethod
    def dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of pairs (a, b): a with the number of its parts, about one for PARTNERS pairs, and the pairs with their part. A centre of many pairs is spread by them."""
        parts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")), "parts")
        keyed = pairs.join(small_or_merged(parts), "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
        return parts, written(keyed, "keyed")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links (u, v): of a written table of pairs (a, b) those of similarity LEAST or more, by their whole sets.

        The sets of the b of one a meet its set in parts (see dealt).
        """
        ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
        sets = written(self.texts(ids).mapInArrow(set_rows, "id long, tokens array<long>"), "sets")
        parts, keyed = self.dealt(pairs)
        right = sets.join(small_or_merged(keyed), F.col("id") == F.col("b")).select("a", "part", "b", F.col("tokens").alias("tokens_b"))
        left = sets.join(small_or_merged(parts.select(F.col("a").alias("id"), "parts")), "id").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("tokens").alias("tokens_a"))
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        union = F.size("tokens_a") + F.size("tokens_b") - common
        found = written(right.join(left.hint("merge"), ["a", "part"]).where(common * LEAST[1] >= union * LEAST[0]).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        for table in (ids, sets, parts, keyed):
            forget(table)
        return found

    @staticmethod
    def labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
        """Postings with label and size of the component (a document without links: itself and 1)."""
        sizes = labels.groupBy("label").agg((F.count("*") + 1).alias("size"))
        nodes = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
        known = written(nodes.join(sizes.hint("merge"), "label").select(F.col("node").alias("rep"), "label", "size"), "known")
        rows = postings.join(small_or_merged(known), "rep", "left")
        return rows.select("token", "rep", "n", "pos", F.coalesce("label", "rep").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))

    @staticmethod
    def open_rows(rows: DataFrame) -> DataFrame:
        """Labelled postings of tokens whose holders have several labels, with major: the label of the largest component among them."""
        tokens = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("size", "label")).alias("m"))
        tokens = written(tokens.where("low <> high").select("token", F.col("m.label").alias("major")), "open_tokens")
        return rows.join(small_or_merged(tokens), "token")

    @staticmethod
    def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
        """Candidate pairs (a, b) of each token's centre and its other holders. The centre is the holder with least before the token at first, which is nearest to what all share; later one by hash."""
        rank = F.col("pos") if turn == 0 else F.lit(0)
        centres = rows.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n", "pos", "label")).alias("c"))
        left = centres.select("token", *[F.col(f"c.{c}").alias(f"x_{c}") for c in ("rep", "n", "pos", "label")])
        right = rows.select("token", *[F.col(c).alias(f"y_{c}") for c in ("rep", "n", "pos", "label")])
        a, b = LEAST
        nx, ny = F.col("x_n"), F.col("y_n")
        fits = (F.least(nx, ny) * b >= F.greatest(nx, ny) * a) & (F.least(nx - F.col("x_pos"), ny - F.col("y_pos")) * (a + b) >= (nx + ny) * a)
        pairs = right.join(left.hint("merge"), "token").where(F.col("x_label") != F.col("y_label")).where(fits)
        return written(pairs.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).distinct(), "pairs")

    @staticmethod
    def open_components(rows: DataFrame) -> DataFrame:
        """x, label and size: documents outside a token's major component, and components of other holders that sizes and places allow a link with.

        Of two components outside the major one, the holders in that of larger label ask for the other.
        """
        a, b = LEAST
        held = rows.groupBy("token", "label").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("size").alias("size"))
        minor = rows.where("label <> major").select("token", "major", F.col("rep").alias("x"), F.col("label").alias("own"), "n", "pos")
        both = minor.join(held.hint("merge"), "token").where((F.col("label") < F.col("own")) | ((F.col("label") == F.col("major")) & (F.col("label") != F.col("own"))))
        fits = (F.col("most") * b >= F.col("n") * a) & (F.col("n") * b >= F.col("least") * a) & (F.least(F.col("n") - F.col("pos"), F.col("rest")) * (a + b) >= (F.col("n") + F.col("least")) * a)
        return written(both.where(fits).select("x", "label", "size").distinct(), "open")

    def passing_in_blocks(self, wanted: DataFrame, labels: DataFrame) -> DataFrame:
        """u, v, label, differ: each x (u) of wanted (x, label) with the members (v) of its components whose signatures pass all filters."""
        counts = written(wanted.groupBy("label").agg(F.count("*").alias("xs")), "counts")
        nodes = labels.select("node", "label").unionByName(counts.select(F.col("label").alias("node"), "label"))
        members = written(nodes.join(small_or_merged(counts), "label").select("node", "label"), "block_members")
        sizes = members.groupBy("label").agg(F.count("*").alias("ys")).join(counts.hint("merge"), "label")
        plan = small_or_merged(written(sizes.select("label", F.ceil(F.col("ys") / BLOCK).cast("int").alias("ny"), F.ceil(F.col("xs") / BLOCK).cast("int").alias("nx")), "sizes"))
        made = self.signatures(members.select(F.col("node").alias("id")).unionByName(wanted.select(F.col("x").alias("id"))))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = members.join(plan, "label").select(F.col("node").alias("id"), "label", own("node", "ny").alias("yb"), every("nx").alias("xb"))
        right = wanted.join(plan, "label").select(F.col("x").alias("id"), "label", own("x", "nx").alias("xb"), every("ny").alias("yb"))
        keys = ["label", "yb", "xb"]
        # The sides are made by explode: they are written out, so that their size is known.
        columns = lambda: [F.col(c).alias(c) for c in made.columns]
        sides = [made.select(*columns()).join(small_or_merged(written(side, "side")), "id").groupBy(*keys) for side in (left, right)]
        found = written(sides[0].cogroup(sides[1]).applyInArrow(alike_in_block, "u long, v long, label long, differ long"), "alike")
        forget(made)
        return found

    def last_links(self, wanted: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (u, v), at least one for each x and component of wanted that have any."""
        pair = self.passing(wanted.where("size = 1").select(F.col("label").alias("a"), F.col("x").alias("b")))
        alike = self.passing_in_blocks(wanted.where("size > 1").select("x", "label"), labels)
        best = alike.groupBy("u", "label").agg(F.min_by("v", F.struct("differ", "v")).alias("v"))
        first = self.verified(written(pair.unionByName(best.select(F.col("v").alias("a"), F.col("u").alias("b"))), "first"))
        done = first.select(F.col("u").alias("v"), F.col("v").alias("u"))
        tried = best.select("u", "label", F.col("v").alias("tried")).join(done.withColumn("linked", F.lit(True)).withColumnRenamed("v", "tried").hint("merge"), ["u", "tried"], "left")
        left = alike.join(tried.hint("merge"), ["u", "label"]).where("linked is null and v <> tried")
        rest = written(left.select(F.col("v").alias("a"), F.col("u").alias("b")), "rest")
        return first if rest.isEmpty() else first.unionByName(self.verified(rest))

    def links(self) -> DataFrame:
        """node and label of all classes that have links."""
        postings = self.postings()
        labels = None
        for turn in range(STAR_ROUNDS):
            rows = postings.withColumns({"label": F.col("rep"), "size": F.lit(1)}) if labels is None else self.open_rows(self.labelled(postings, labels))
            labels = self.joined(self.verified(self.passing(self.star_pairs(rows, turn))), labels)
        wanted = self.open_components(self.open_rows(self.labelled(postings, labels)))
        labels = self.joined(self.last_links(wanted, labels), labels)
        forget(postings)
        return labels

    @staticmethod
    def joined(found: DataFrame, labels: DataFrame | None) -> DataFrame:
        return components(found if labels is None else found.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))

    def result(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every document."""
        labels = small_or_merged(self.links().select(F.col("node").alias("rep"), "label"))
        out = self.members.join(labels, "rep", "left")
        alone = F.coalesce("label", "rep", "doc_id")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return NgramJoin(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).result()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that another one stands for: of each component the smallest id stays, and of several rows with that id the first by their hash. Rows with a null id all stay."""
    found = written(near_duplicates(docs, id_col, text_col), "found")
    key = F.col(id_col).cast("long")
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = docs.join(small_or_merged(gone), key == gone["_gone"], "left_anti")
    again = written(found.groupBy(F.col("doc_id").alias("_again")).count().where("count > 1 and _again is not null").select("_again"), "again")
    if again.isEmpty():
        return kept
    several = small_or_merged(again)
    alone = kept.join(several, key == again["_again"], "left_anti")
    rows = kept.join(several, key == again["_again"], "left_semi")
    order = Window.partitionBy(key).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))), F.to_json(F.struct(*docs.columns)))
    return alone.unionByName(rows.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
