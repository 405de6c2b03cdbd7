"""Operator 11: ranked lexical search, term at a time with a limited set of accumulators.

Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Two scans
of the texts, neither of which moves a text or a posting: the first counts documents, terms
and, for the terms of the items, documents that hold them; the second ranks. In the second
a task turns its documents into shards of about `SHARD` occurrences, each with a list of
postings for every term of the items. An item's terms come rarest first. Each adds its part
of the score to an accumulator for every document of its list, as long as what the terms
from there on can add at most reaches the k-th best partial score (or the k-th best score
of the task's shards before). Once it does not, no accumulator is made any more, and those
that can still reach the k-th are brought up to date by looking their documents up in the
rest of the lists. A task returns the k best documents of each item; they are merged
in two levels.

Items go to the tasks in blocks of about `BLOCK` terms, each with two scans of its own, so
that no task and not the driver holds all of a large table of items.

Nulls and edges: a null text has no terms, nor has one of separators only; documents
without a term of an item and items without terms give no rows; rows of one item id are
one item with the terms of all its distinct texts, a null id is an id; repeated documents
are documents of their own; of equal scores the smaller id comes first, a null id last;
very long texts are read whole, in steps; an empty table gives an empty result; columns
other than the ids and the texts are not looked at.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP = 20
#: Terms of a block of items, on average; occurrences of them in a shard; bytes of text that are cut into terms at once.
BLOCK, SHARD, STEP = 1_000_000, 3_000_000, 4_000_000
#: Tasks' results of one item meet in so many groups before the last.
GROUPS = 64
#: Stands for a null id among numbers.
NO_ID = 2**63 - 1


def byte_table() -> bytes:
    """Letters in lower case, digits and bytes beyond ASCII as they are, everything else a blank."""
    return bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


TABLE = byte_table()


def term_lists(data: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in steps that end between terms."""
    data = (data or b"").translate(TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STEP)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Shard:
    """Documents with the occurrences of known terms in them."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.doc_ids, self.sizes, self.ends, self.found = array("q"), array("q"), array("q"), array("i")

    def add(self, doc_id: int | None, data: bytes | None) -> None:
        size, known = 0, self.vocabulary.get
        for terms in term_lists(data):
            size += len(terms)
            self.found.extend([v for v in map(known, terms) if v is not None])
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(size)
        self.ends.append(len(self.found))

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, place of the document and number of occurrences, by term and then place."""
        n = len(self.doc_ids)
        places = np.repeat(np.arange(n, dtype=np.int64), np.diff(np.frombuffer(self.ends, np.int64), prepend=0))
        keys = np.sort(np.frombuffer(self.found, np.int32).astype(np.int64) * n + places) if len(self.found) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first] // n, keys[first] % n, np.diff(np.append(first, len(keys)))


def shards(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[Shard]:
    shard = Shard(vocabulary)
    for batch in batches:
        # One row of the batch at a time: texts stay in Arrow's memory until they are read.
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard.add(doc_id, data.as_py())
            if len(shard.found) >= SHARD:
                yield shard
                shard = Shard(vocabulary)
    if len(shard.doc_ids):
        yield shard


class Items:
    """A block of items: terms by number, and of each item its terms with the times they stand in it."""

    def __init__(self, rows: list[tuple[int | None, str, int]]):
        self.vocabulary = {t.encode(): i for i, t in enumerate(sorted({r[1] for r in rows}))}
        self.asked: dict[int | None, list[tuple[int, int]]] = {}
        for item, term, times in rows:
            self.asked.setdefault(item, []).append((self.vocabulary[term.encode()], times))

    def weigh(self, n_docs: int, n_terms: int, holding: dict[int, int]) -> None:
        """Weights of terms, and every item's terms with the rarest first."""
        self.n_docs, self.n_terms = n_docs, n_terms
        df = [holding.get(i, 0) for i in range(len(self.vocabulary))]
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df], dtype=np.int64)
        self.order = {item: np.array(sorted(terms, key=lambda t: (df[t[0]], t[0])), dtype=np.int64).reshape(-1, 2) for item, terms in self.asked.items()}


class Lists:
    """The postings of a shard with each document's part of the score."""

    def __init__(self, shard: Shard, items: Items):
        terms, self.places, times = shard.postings()
        m = 100 - 25 + 25 * np.frombuffer(shard.sizes, np.int64) * items.n_docs // max(items.n_terms, 1)
        self.parts = items.weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * m[self.places]))
        self.starts = np.searchsorted(terms, np.arange(len(items.vocabulary) + 1))
        filled = np.flatnonzero(np.diff(self.starts))
        self.most = np.zeros(len(items.vocabulary), np.int64)
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.parts, self.starts[filled])
        self.scores = np.zeros(len(shard.doc_ids), np.int64)

    def best(self, terms: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that may be among the k best with a score of `least` or more; all of those that are."""
        terms = terms[self.most[terms[:, 0]] > 0]
        # What the terms from each place on can add at most, none after the last.
        left = np.append(np.cumsum((self.most[terms[:, 0]] * terms[:, 1])[::-1])[::-1], 0)
        scores, at = self.scores, 0
        scores.fill(0)
        while at < len(terms) and left[at] >= least:
            term, times = terms[at]
            span = slice(self.starts[term], self.starts[term + 1])
            scores[self.places[span]] += self.parts[span] * times
            at += 1
            if at < len(terms):
                least = max(least, kth(scores[scores > 0], k))
        places = np.flatnonzero(scores > 0)
        found = scores[places]
        for term, times in terms[at:]:
            able = found + left[at] >= least
            places, found, at = places[able], found[able], at + 1
            span = slice(self.starts[term], self.starts[term + 1])
            mine = self.places[span]
            here = np.minimum(np.searchsorted(mine, places), len(mine) - 1)
            found = found + np.where(mine[here] == places, self.parts[span][here] * times, 0)
            least = max(least, kth(found, k))
        able = found >= least
        return places[able], found[able]


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def statistics(docs: DataFrame, items: Items) -> None:
    """Counts documents with terms, all terms and the documents that hold each term of the items, and weighs the terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0, 0]
        holding = np.zeros(len(items.vocabulary), np.int64)
        for shard in shards(batches, items.vocabulary):
            sizes = np.frombuffer(shard.sizes, np.int64)
            n = [n[0] + int((sizes > 0).sum()), n[1] + int(sizes.sum())]
            holding += np.bincount(shard.postings()[0], minlength=len(holding))
        terms = np.flatnonzero(holding)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *terms.tolist()], pa.int32()), "n": pa.array([*n, *holding[terms].tolist()], pa.int64())})

    # At most one row for each term of the block.
    counted = {r["term"]: r["n"] for r in docs.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    items.weigh(counted.get(-2, 0), counted.get(-1, 0), counted)


def ranked_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """item_id, doc_id, score and group: the k best of every task."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item in items.order}
        seen = 0
        for shard in shards(batches, items.vocabulary):
            lists, ids = Lists(shard, items), np.frombuffer(shard.doc_ids, np.int64)
            seen += len(ids)
            for item, terms in items.order.items():
                before, at = held[item]
                places, scores = lists.best(terms, max(kth(before, k), 1), k)
                if len(places):
                    scores, at = np.append(before, scores), np.append(at, ids[places])
                    chosen = first(scores, at, k)
                    held[item] = scores[chosen], at[chosen]
        for item, (scores, ids) in held.items():
            if len(ids):
                n = len(ids)
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * n, pa.int64()), "doc_id": pa.array(ids, mask=ids == NO_ID), "score": pa.array(scores), "group": pa.array(np.full(n, seen % GROUPS, np.int32))})

    return docs.mapInArrow(rank, "item_id long, doc_id long, score long, group int")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).dropDuplicates()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for terms in term_lists(data):
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(terms), pa.int64()), "term": pa.array([t.decode() for t in terms], pa.string())})

    terms = asked.mapInArrow(cut, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))
    blocks = max(-(-terms.count() // BLOCK), 1)
    found = []
    for block in range(blocks):
        # About BLOCK rows: the items are dealt to blocks by their ids.
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if rows:
            mine = Items([(r["item_id"], r["term"], r["times"]) for r in rows])
            statistics(texts, mine)
            found.append(ranked_block(texts, mine, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = union.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "group").orderBy(*order))).where(F.col("place") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
with item_terms as (
  select item_id, term, count(*) as times
  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from (select distinct item_id, text from benchmark))
  group by item_id, term),
numbered as (select row_number() over () as place, doc_id, text from documents),
doc_terms as (
  select place, doc_id, term, count(*) as tf
  from (select place, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from numbered)
  group by place, doc_id, term),
sizes as (select place, cast(sum(tf) as bigint) as n from doc_terms group by place),
everything as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from sizes),
holding as (select term, count(*) as df from doc_terms group by term),
scored as (
  select i.item_id, d.place, d.doc_id,
         cast(sum(i.times * cast(floor(1000 * ln(cast(2 * e.n_docs + 2 as double) / (2 * h.df + 1))) as bigint)
                  * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (100 - 25 + (25 * s.n * e.n_docs) // e.n_terms)))) as bigint) as score
  from item_terms i join doc_terms d on i.term = d.term join holding h on h.term = d.term join sizes s on s.place = d.place cross join everything e
  group by i.item_id, d.place, d.doc_id),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
"""
