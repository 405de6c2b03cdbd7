"""Operator 1: language identification by words, backing off to character n-grams.

A known word scores its log frequency in each language. An unseen word is read from left
to right: at each place the longest known n-gram (four letters down to one, with marks
for the word's ends) gives its log frequencies, and the word scores their mean, scaled
to a word. The language with the highest sum wins; its score is the posterior share.

The model is fitted on a bounded sample of labelled documents (`SAMPLE`, those of
smallest id hash among the ones that may be learned from) and keeps all words and n-grams
of that sample.

Nulls and edges: `und` with score 0 for a null text or one without letters, and for all
texts when there is nothing to learn from; rows with a null lang are not learned from;
a tie goes to the language first in code-point order; repeated rows are rows of their
own; an empty table gives an empty result; input columns that bear the name of an output
column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlight.llm._shared import held_out, sample_limit

SAMPLE = 3_000
ORDER = 4
#: What an unseen event counts as, and the words that a worker remembers between documents.
ADDED, REMEMBERED = 0.5, 300_000
UNKNOWN = "und"
#: Letters, and the numbers among \\w that are no digits: superscripts, fractions, Roman numerals.
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Runs of letters in lower case. The rare run with a number in it is no run of letters and is cut there."""
    found = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams(word: str) -> Iterator[str]:
    marked = f"<{word}>"
    for n in range(1, ORDER + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


class LanguageModel(dict):
    """Log frequencies by language; a dict from words already scored to their rows."""

    def __init__(self, texts: list[tuple[str, str]]):
        super().__init__()
        self.languages = sorted({lang for lang, _ in texts})
        at = {lang: i for i, lang in enumerate(self.languages)}
        words: dict[str, Counter] = {lang: Counter() for lang in self.languages}
        for lang, text in texts:
            words[lang].update(letters(text))
        pieces: dict[str, Counter] = {lang: Counter() for lang in self.languages}
        for lang, counts in words.items():
            for word, n in counts.items():
                for g in grams(word):
                    pieces[lang][g] += n
        self.known, self.known_rows = self.table(words, at)
        self.pieces, self.piece_rows = self.table(pieces, at)
        self.rows = np.zeros((1024, len(self.languages)))

    def table(self, counts: dict[str, Counter], at: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
        """The place of every word or n-gram seen, and a row for each with its log frequencies, less their mean."""
        kept = sorted(set().union(*counts.values()))
        sums = np.array([sum(counts[lang].values()) for lang in self.languages], dtype=float)
        made = np.array([[counts[lang][k] for lang in self.languages] for k in kept], dtype=float).reshape(len(kept), len(at))
        logs = np.log((made + ADDED) / (sums + ADDED * (len(kept) + 1)))
        # Only differences between languages matter; this keeps long texts within range.
        return {k: i for i, k in enumerate(kept)}, (logs - logs.mean(axis=1, keepdims=True) if kept else logs)

    def backed_off(self, word: str) -> np.ndarray:
        marked, get, rows = f"<{word}>", self.pieces.get, []
        for i in range(len(marked)):
            for size in range(ORDER, 0, -1):
                if (found := get(marked[i : i + size])) is not None:
                    rows.append(found)
                    break
        return self.piece_rows[rows].sum(axis=0) / max(len(rows), 1)

    def __missing__(self, word: str) -> np.ndarray:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        found = self.known.get(word)
        self.rows[at] = self.backed_off(word) if found is None else self.known_rows[found]
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letters(text) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self) > REMEMBERED:
            self.clear()
            self.rows = self.rows[: 2 * REMEMBERED]
        found = list(map(self.__getitem__, words))  # may make room in rows
        sums = self.rows[found].sum(axis=0)
        best = int(np.argmax(sums))
        return self.languages[best], 1.0 / float(np.exp(np.maximum(sums - sums[best], -700.0)).sum())


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """The model of at most about `sample` labelled documents."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    limit = sample_limit(rows.select(id_col), id_col, sample)
    if limit is None:
        return LanguageModel([])
    chosen = rows.where(F.xxhash64(id_col) <= limit).orderBy(id_col, lang_col, text_col).limit(sample).select(lang_col, text_col)
    return LanguageModel([(r[0], r[1]) for r in chosen.toLocalIterator()])


def identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. The model goes to the tasks once: the words and n-grams of the sample, a row of numbers each."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    return kept.withColumn("_lang", predict(text_col)).select(*kept.columns, "_lang.lang_pred", "_lang.score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identified(rows, model).select("doc_id", "held_out", "lang_pred", "score")
