"""Operator 13: toxicity by the distance of compressed lengths under two dictionaries.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is
cut into windows, each a word with the blanks around it, and every window is compressed
with either dictionary. A window is toxic if its length under the toxic dictionary is at
most `most` and the ordinary dictionary's length is longer by at least `gap`; both
thresholds are calibrated on the labelled sample, by the likelihood of its labels. The
share and the number of toxic windows give the score, by two fitted weights.

Windows go to the compressor as UTF-32: a match costs as much as before, a letter left
over four times as much, so that lengths tell a whole match from a part of one. The
dictionaries are used as raw content, since windows are too short for tables of entropy.
Toxic documents consist of ordinary words for the most part, so the toxic dictionary is
trained on windows that toxic documents have more often than chance allows (likelihood
ratio `LEAST` or more), as often as they occur; the ordinary one on all others of ordinary
documents. Near copies of one document are no further evidence: a document counts for
a window only if it has it between two neighbours that no document before had it between.

Fitting takes at most `TOXIC` and `ORDINARY` labelled documents of smallest id hash,
none above `LONGEST_LEARNED` bytes, and `LEARNED_BYTES` bytes of each kind; weights put
both kinds back to their share. Scoring has no such bounds.

Nulls and edges: a text that is null or has no letter has no windows and gets their
score; words of more than `PIECE` letters are several windows; labels other than 0 and 1
and labels without a document are not learned from; with labels of one kind or with no
window that tells them apart the score is the share of label 1 (0.5 with none); repeated
rows are rows of their own; an empty table gives an empty result; input columns that
bear the name of an output column are replaced; very long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlight.llm._shared import held_out, sample_limit
from penlight.llm.quality_crf import portions

TOXIC, ORDINARY, LEARNED_BYTES, LONGEST_LEARNED = 2_000, 3_000, 12_000_000, 1_000_000
#: From this score on a document is predicted toxic.
BAD = 0.3
LEAST = 20.0
TOXIC_DICTIONARY, ORDINARY_DICTIONARY, SEGMENT = 16_384, 131_072, 400
#: How often one window may stand in the ordinary training text, and windows there in all.
REPEATS, TRAINED = 50, 200_000
PIECE = 60
#: Windows that a worker remembers.
REMEMBERED = 300_000
WORDS = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[str]:
    found = WORDS.findall((text or "").lower())
    if any(len(w) > PIECE for w in found):
        return [w[at : at + PIECE] for w in found for at in range(0, len(w), PIECE)]
    return found


def coded(window: str) -> bytes:
    return f" {window} ".encode("utf-32-le")


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def compressor(content: bytes):
    p = zstandard.ZstdCompressionParameters(window_log=18, chain_log=18, hash_log=18, search_log=6, min_match=6, target_length=0, strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=0, write_content_size=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


class Distance:
    """Both dictionaries, the thresholds and the weights; compressors and known windows stay in the process."""

    def __init__(self, toxic: bytes = b"", ordinary: bytes = b"", prior: float = 0.5):
        self.toxic, self.ordinary, self.prior = toxic, ordinary, prior
        self.most = self.gap = 0
        self.weights: np.ndarray | None = None
        self.compress, self.known = None, {}

    def __getstate__(self):
        return self.__dict__ | {"compress": None, "known": {}}

    def lengths(self, window: str) -> tuple[int, int]:
        """Of a window, under the toxic and under the ordinary dictionary."""
        if self.compress is None:
            self.compress = compressor(self.toxic), compressor(self.ordinary)
        data = coded(window)
        return len(self.compress[0](data)), len(self.compress[1](data))

    def is_toxic(self, window: str) -> bool:
        toxic, ordinary = self.lengths(window)
        return toxic <= self.most and ordinary - toxic >= self.gap

    def counts(self, text: str | None) -> tuple[int, int]:
        """Toxic windows, and all."""
        found = windows(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = self.is_toxic(w)
        return sum(map(known.__getitem__, found)), len(found)

    def score_counts(self, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(counts), self.prior)
        return 1 / (1 + np.exp(-np.clip(design(counts) @ self.weights, -30, 30)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return self.score_counts(np.array([self.counts(t) for t in texts], dtype=float).reshape(-1, 2))


def design(counts: np.ndarray) -> np.ndarray:
    toxic, every = counts[:, 0], np.maximum(counts[:, 1], 1)
    return np.stack([np.log1p(toxic), np.log1p(1_000 * toxic / every), np.ones(len(counts))], axis=1)


def ratio(toxic: int, ordinary: int, n_toxic: int, n_ordinary: int) -> float:
    """Likelihood ratio statistic of a window that so many documents of either kind have; 0 where it is no sign of toxic ones."""
    expected = n_toxic * (toxic + ordinary) / (n_toxic + n_ordinary)
    if toxic <= expected:
        return 0.0
    rest = n_ordinary * (toxic + ordinary) / (n_toxic + n_ordinary)
    return 2 * (toxic * math.log(toxic / expected) + (ordinary * math.log(ordinary / rest) if ordinary else 0.0))


def telling(docs: list[tuple[list[str], int]]) -> Counter:
    """The windows that tell toxic documents, with the number of those that have them among neighbours of their own."""
    n = Counter(y for _, y in docs)
    having = (Counter(), Counter())
    for found, y in docs:
        having[y].update(set(found))
    maybe = {w for w, k in having[1].items() if ratio(k, having[0][w], n[1], n[0]) >= LEAST}
    seen: set = set()
    having = (Counter(), Counter())
    for found, y in docs:
        fresh = {(y, a, w, b) for a, w, b in zip(["", *found], found, [*found[1:], ""]) if w in maybe} - seen
        seen |= fresh
        having[y].update({w for _, _, w, _ in fresh})
    return Counter({w: k for w, k in having[1].items() if ratio(k, having[0][w], n[1], n[0]) >= LEAST})


def log_likelihood(toxic: float, ordinary: float) -> float:
    p = (toxic + 0.5) / (toxic + ordinary + 1)
    return toxic * math.log(p) + ordinary * math.log(1 - p)


def calibrate(model: Distance, docs: list[tuple[list[str], int]], weights: tuple[float, float]) -> None:
    """Thresholds of the best likelihood of the labels, given whether a document has a toxic window; then the weights of the score (Newton steps)."""
    lengths = {w: model.lengths(w) for w in {w for found, _ in docs for w in found}}
    # Of each document: for every length under the toxic dictionary the largest gap.
    gaps: list[dict[int, int]] = []
    for found, _ in docs:
        best: dict[int, int] = {}
        for w in set(found):
            t, o = lengths[w]
            best[t] = max(best.get(t, -99), o - t)
        gaps.append(best)
    y = np.array([y for _, y in docs])
    n = [float((y == k).sum()) for k in (0, 1)]
    shortest = min(t for t, _ in lengths.values())
    largest, choices = np.full(len(docs), -99), []
    for most in range(shortest, shortest + 24):
        largest = np.maximum(largest, [b.get(most, -99) for b in gaps])
        for gap in range(1, 24):
            hit = largest >= gap
            t, o = float(hit[y == 1].sum()), float(hit[y == 0].sum())
            fit = log_likelihood(t * weights[1], o * weights[0]) + log_likelihood((n[1] - t) * weights[1], (n[0] - o) * weights[0])
            choices.append((fit, -most, gap))
    _, most, gap = max(choices)
    model.most, model.gap = -most, gap
    toxic = {w for w, (t, o) in lengths.items() if t <= model.most and o - t >= gap}
    x = design(np.array([(sum(w in toxic for w in found), len(found)) for found, _ in docs], dtype=float))
    of_row = np.array(weights)[y]
    fitted, penalty = np.zeros(x.shape[1]), np.diag([0.1, 0.1, 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ fitted, -30, 30)))
        bend = (x * (of_row * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        fitted -= np.linalg.solve(bend, x.T @ (of_row * (p - y)) + penalty @ fitted)
    model.weights = fitted


def fit(texts: list[str | None], labels: list[int], totals: tuple[int, int] | None = None) -> Distance:
    """totals: how many documents of label 0 and 1 the sample stands for; its own numbers if not given."""
    docs = [(windows(t), int(y)) for t, y in zip(texts, labels)]
    n = Counter(y for _, y in docs)
    totals = totals or (n[0], n[1])
    prior = totals[1] / sum(totals) if sum(totals) else 0.5
    if not n[0] or not n[1]:
        return Distance(prior=prior)
    signs = telling(docs)
    if not signs:
        return Distance(prior=prior)
    common = Counter(w for found, y in docs if not y for w in set(found) if w not in signs)
    # A fixed order that mixes the windows: the trainer looks at them in parts.
    order = np.random.default_rng(13)
    toxic = [coded(w) for w, k in sorted(signs.items()) for _ in range(k)]
    ordinary = [coded(w) for w, k in sorted(common.items(), key=lambda x: (-x[1], x[0])) for _ in range(min(k, REPEATS))][:TRAINED]
    toxic, ordinary = ([x[i] for i in order.permutation(len(x))] for x in (toxic, ordinary))
    model = Distance(dictionary(toxic, TOXIC_DICTIONARY), dictionary(ordinary, ORDINARY_DICTIONARY), prior)
    calibrate(model, docs, (totals[0] / n[0], totals[1] / n[1]))
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = (ORDINARY, TOXIC)) -> Distance:
    """The distance fitted to a bounded sample of the labelled documents; labels: id and label, only of rows that may be learned from."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    numbers = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    texts: list[str | None] = []
    known: list[int] = []
    for label in (0, 1):
        kind = usable.where(F.col("_label") == label)
        limit = sample_limit(kind.select("_id"), "_id", most[label])
        if limit is None:
            continue
        chosen = kind.where(F.xxhash64("_id") <= limit)
        rows = docs.where((F.xxhash64(id_col) <= limit) & (F.coalesce(F.octet_length(text_col), F.lit(0)) <= LONGEST_LEARNED)).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
        # Both sides hold about most[label] rows of the hash range.
        joined = rows.join(chosen.hint("shuffle_hash"), F.col("_doc") == F.col("_id")).select(F.xxhash64("_id").alias("_hash"), "_text")
        size = 0
        for r in joined.orderBy("_hash", "_text").limit(most[label]).toLocalIterator():
            size += len((r["_text"] or "").encode())
            if size > LEARNED_BYTES:
                break
            texts.append(r["_text"])
            known.append(label)
    return fit(texts, known, (numbers.get(0, 0), numbers.get(1, 0)))


def scored(docs: DataFrame, model: Distance, text_col: str = "text") -> DataFrame:
    """docs with score and predicted. The dictionaries that go to the tasks have at most 150 KB."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *map(model.scores, portions(texts))]))

    kept = docs.drop("score", "predicted")
    return kept.withColumn("score", score(text_col)).withColumn("predicted", (F.col("score") >= BAD).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.where(~held_out()))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return scored(rows, model).select("doc_id", "held_out", "score", "predicted")
