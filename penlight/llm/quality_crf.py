"""Operator 10: document quality from a linear-chain conditional random field over lines.

Every line of a text gets features of its own and of its neighbours; the field labels it
bad (0) or good (1) given the lines around it. A document's score is the mean of its
lines' forward-backward marginals for good, weighted by the lines' lengths, on a scale
of probabilities that is fitted to the documents' labels.

Fitting: labels exist for documents only, so the labels of lines are latent. A
document's label is evidence for each of its lines that is right with probability
`EVIDENCE`: the field is fitted by the difference between the expected counts of labels
and of moves given that evidence and those without it, so a bad document may keep good
lines and the moves between labels inside a document are learned. It sees a bounded
sample of documents (`SAMPLE` labelled ones of smallest id hash) with all their lines;
in fitting a chain longer than `RUN` lines is cut there, its lines all stay. The scale is
fitted on whole chains, as scoring uses them.

Nulls and edges: a null, empty or blank text is one empty line and gets that line's
marginal; labels other than 0 and 1 and labels without a document are not learned from;
with no labels of both kinds the score is the share of label 1 (0.5 with none); repeated
rows are rows of their own; an empty table gives an empty result; input columns that
bear the name of an output column are replaced; very long texts are read whole, in
steps of bounded size.
"""

from __future__ import annotations

import operator
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlight.llm._shared import give_back, held_out, sample_limit, small_batches

SAMPLE, EVIDENCE, RUN = 2_500, 0.6, 256
ROUNDS, STEP, PENALTY = 140, 0.1, 1e-3
#: From this score on a document is predicted good.
GOOD = 0.7
#: Texts and bytes of text that are scored together.
TEXTS, BYTES = 512, 300_000
SYMBOLS, DIGITS, RUNS = re.compile(r"[^\w\s]"), re.compile(r"[0-9]"), re.compile(r"[^\w\s.,]{2,}|[^\w\s]{3,}")
FEATURES = 12


def line_features(line: str, times: int) -> tuple[float, ...]:
    """times: how often the document has this line."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return (0.0,) * FEATURES
    return (
        float(np.log1p(n)),
        sum(map(str.isupper, words)) / n,
        len(SYMBOLS.findall(line)) / size,
        len(DIGITS.findall(line)) / size,
        len(set(words)) / n,
        len(set(map(str.lower, words))) / n**0.9,
        sum(map(operator.eq, words, words[1:])) / n,
        line.count("|") / n,
        len(RUNS.findall(line)) / n,
        min(size / n, 40.0),
        float(times > 1),
        float(line.rstrip()[-1] in ".!?"),
    )


def document_lines(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


class Chains:
    """Runs of lines, one after another: where each begins and how many lines it has."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int) if len(sizes) else sizes
        # Chains with most lines first: at step t the active ones are a prefix.
        self.order = np.argsort(-sizes, kind="stable")
        self.active = [int((sizes > t).sum()) for t in range(int(sizes.max(initial=0)))]

    def at(self, t: int) -> np.ndarray:
        """Row numbers of the t-th line of the active chains."""
        return self.starts[self.order[: self.active[t]]] + t

    def cut(self, most: int) -> Chains:
        """The same lines in chains of at most `most`."""
        return Chains(np.array([min(most, n - k) for n in self.sizes.tolist() for k in range(0, n, most)], dtype=int))


class Batch(Chains):
    """The lines of several documents with their features and lengths; a chain for each document."""

    def __init__(self, texts):
        rows, weights, sizes = array("d"), array("d"), []
        for text in texts:
            lines = document_lines(text)
            times = Counter(lines)
            for line in lines:
                rows.extend(line_features(line, times[line]))
                weights.append(max(len(line), 1))
            sizes.append(len(lines))
        super().__init__(np.array(sizes, dtype=int))
        self.own = np.array(rows).reshape(-1, FEATURES)
        self.weights = np.array(weights)


class LineField:
    """weights: features by label; moves: label to label."""

    def __init__(self, mean, spread, weights, moves, prior: float | None = None):
        self.mean, self.spread, self.weights, self.moves, self.prior = mean, spread, weights, moves, prior
        self.slope, self.shift = 1.0, 0.0

    def design(self, batch: Batch) -> np.ndarray:
        own = np.clip((batch.own - self.mean) / self.spread, -4, 4)
        n = len(own)
        previous, following = np.zeros_like(own), np.zeros_like(own)
        previous[1:], following[:-1] = own[:-1], own[1:]
        first, last = np.zeros((n, 1)), np.zeros((n, 1))
        first[batch.starts], last[batch.starts + batch.sizes - 1] = 1, 1
        previous[batch.starts], following[batch.starts + batch.sizes - 1] = 0, 0
        return np.hstack([np.ones((n, 1)), own, own**2, previous, following, first, last])

    def chain(self, emission: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels by line, and the expected number of moves; by forward-backward with scaled sums."""
        e = np.exp(emission - emission.max(axis=1, keepdims=True))
        m = np.exp(self.moves)
        ahead, back, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e))
        for t in range(len(chains.active)):
            i = chains.at(t)
            a = e[i] if t == 0 else (ahead[i - 1] @ m) * e[i]
            scale[i] = a.sum(axis=1)
            ahead[i] = a / scale[i][:, None]
        counted = np.zeros((2, 2))
        for t in range(len(chains.active) - 1, 0, -1):
            i = chains.at(t)
            right = e[i] * back[i] / scale[i][:, None]
            back[i - 1] = right @ m.T
            counted += (ahead[i - 1].T @ right) * m
        marginals = ahead * back
        return marginals / marginals.sum(axis=1, keepdims=True), counted

    def logits(self, batch: Batch) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each document."""
        marginals, _ = self.chain(self.design(batch) @ self.weights, batch)
        sums = np.add.reduceat(marginals[:, 1] * batch.weights, batch.starts)
        mean = np.clip(sums / np.add.reduceat(batch.weights, batch.starts), 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def calibrate(self, batch: Batch, y: np.ndarray) -> None:
        """Fits the odds of the documents' labels to their mean marginals (two numbers, Newton steps)."""
        z = np.stack([self.logits(batch), np.ones(len(y))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.1, 0.1])
            w -= np.linalg.solve(bend, z.T @ (p - y) + 0.1 * (w - [1.0, 0.0]))
        if w[0] > 0:
            self.slope, self.shift = w

    def scores(self, texts) -> np.ndarray:
        batch = Batch(texts)
        if not len(batch.sizes):
            return np.zeros(0)
        if self.weights is None:
            return np.full(len(batch.sizes), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(batch) + self.shift, -30, 30)))


def fit(texts: list[str | None], labels: list[int]) -> LineField:
    """Penalised maximum likelihood of the documents' labels, the lines' labels latent, by Adam steps on the whole sample."""
    y = np.array(labels, dtype=int)
    if not len(y) or y.min() == y.max():
        return LineField(None, None, None, None, float(y.mean()) if len(y) else 0.5)
    batch = Batch(texts)
    chains = batch.cut(RUN)
    spread = batch.own.std(axis=0)
    field = LineField(batch.own.mean(axis=0), np.where(spread > 0, spread, 1.0), None, np.zeros((2, 2)))
    x = field.design(batch)
    field.weights = np.zeros((x.shape[1], 2))
    evidence = np.log(EVIDENCE / (1 - EVIDENCE)) * np.eye(2)[np.repeat(y, batch.sizes)]
    total = len(x)
    moment = [np.zeros_like(field.weights), np.zeros((2, 2))]
    square = [np.zeros_like(field.weights), np.zeros((2, 2))]
    for k in range(1, ROUNDS + 1):
        emission = x @ field.weights
        free, counted = field.chain(emission, chains)
        given, seen = field.chain(emission + evidence, chains)
        slopes = [x.T @ (free - given) / total + PENALTY * field.weights, (counted - seen) / total + PENALTY * field.moves]
        for j, (value, slope) in enumerate(((field.weights, slopes[0]), (field.moves, slopes[1]))):
            moment[j] = 0.9 * moment[j] + 0.1 * slope
            square[j] = 0.999 * square[j] + 0.001 * slope**2
            value -= STEP * (moment[j] / (1 - 0.9**k)) / (np.sqrt(square[j] / (1 - 0.999**k)) + 1e-9)
    field.calibrate(batch, y)
    return field


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> LineField:
    """The field fitted to a sample of the labelled documents; labels: id and label, only of rows that may be learned from."""
    usable = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    limit = sample_limit(usable.select("_id"), "_id", sample)
    if limit is None:
        return fit([], [])
    chosen = usable.where(F.xxhash64("_id") <= limit)
    texts = docs.where(F.xxhash64(id_col) <= limit).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    # Both sides hold about `sample` rows of the hash range.
    rows = texts.join(chosen.hint("shuffle_hash"), F.col("_doc") == F.col("_id")).orderBy("_id", "_text", "_label").limit(sample).select("_text", "_label")
    found = [(r[0], r[1]) for r in rows.toLocalIterator()]
    return fit([t for t, _ in found], [y for _, y in found])


def portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """Parts of at most TEXTS texts and about BYTES bytes, whole texts each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        n = max(1, min(TEXTS, int(np.searchsorted(ends, done + BYTES, side="right")) - at))
        yield texts.slice(at, n).to_pylist()
        at += n
    # Gives memory back to the machine between batches.
    give_back()


def scored(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """docs with score and predicted. The field that goes to the tasks has some dozens of numbers."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *map(field.scores, portions(texts))]))

    small_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    return kept.withColumn("score", score(text_col)).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = learn(docs, labels.where(~held_out()))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return scored(rows, field).select("doc_id", "held_out", "score", "predicted")
