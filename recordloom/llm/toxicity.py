"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade >= k | x) = sigmoid(w.x - cut_k) with one weight vector for all thresholds and rising cuts, fitted on the
likelihood of the observed grades, P(grade = k) = P(grade >= k) - P(grade >= k + 1); the output is the expected
severity, sum over k of P(grade >= k).  Features are words (runs of letters, lower-cased)
and the first five and four letters of longer ones, for inflected forms that no label shows: x is log(1 + count) of the
selected ones.

Grades of the labelled documents: 0 if the label says clean; otherwise 1, 2 or 3 by how many of its words are
marked, where a word is marked if the smoothed share of toxic documents among the labelled ones that have it
is at least MARKED_SHARE; so grades above 1 are derived from words of the same labels, not judged by people (no marked word: 1, up to `GRADE_STEPS[0]`: 1, up to `GRADE_STEPS[1]`: 2, more: 3).

Fitting takes a bounded sample: about `max_labelled` labelled documents, chosen by a hash of the id.  Word counts
of the sample are aggregated on the executors; at most `max_features` words and the sample's sparse rows reach
the driver, both bounded by parameters.  Scoring reads every document whole.

Defined cases: null text has no words; very long texts are read whole; null ids are scored but never labelled; a document without selected words gets the intercepts only; repeated
labels of an id take the largest; null labels are left out; without both classes all documents score 0; an empty table gives
no rows; other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import bound_batches, free
from recordloom.llm.shingling import release
from recordloom.session import cut

WORD = re.compile(r"[^\W\d_]+")
MARKED_SHARE, GRADE_STEPS, GRADES = 0.8, (2, 8), 3
MAX_LABELLED, MAX_FEATURES, MIN_DOCS = 24_000, 4096, 6
#: Documents whose words are folded at once while fitting.
FOLDED = 500
STEMS = (5, 4)


def word_counts(text: str | None) -> Counter:
    """Counts of words and, marked by a trailing dash, of the starts of longer words."""
    c = Counter(WORD.findall(text.lower())) if text else Counter()
    for w, k in list(c.items()):
        for n in STEMS:
            if len(w) > n:
                c[w[:n] + "-"] += k
    return c


@dataclass
class OrdinalModel:
    """weights of the selected words and rising cuts, one for each grade from 1."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def score(self, text: str | None) -> tuple[float, float]:
        """Expected severity and P(grade >= 1)."""
        if not len(self.cuts):
            return 0.0, 0.0
        z = 0.0
        if text:
            vocabulary = self.vocabulary
            z = sum(float(self.weights[vocabulary[w]]) * float(np.log1p(c)) for w, c in word_counts(text).items() if w in vocabulary)
        p = 1 / (1 + np.exp(np.clip(self.cuts - z, -50, 50)))
        return float(p.sum()), float(p[0])


def likelihood(z: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the observed grades, and its derivatives by each z and each cut.

    With a = P(grade >= own) and b = P(grade > own), the probability of the own grade is a - b.
    """
    n, most = len(z), len(cuts)
    at = np.arange(n)
    above = np.ones((n, most + 2))
    above[:, 1:-1] = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -50, 50)))
    above[:, -1] = 0.0
    a, b = above[at, grades], above[at, grades + 1]
    p = np.maximum(a - b, 1e-12)
    by_cut = np.zeros(most + 2)
    np.add.at(by_cut, grades, a * (1 - a) / p)
    np.add.at(by_cut, grades + 1, -b * (1 - b) / p)
    return float(-np.log(p).sum()), a + b - 1, by_cut[1:-1]


def fit_ordinal(
    at: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, n_features: int, grades_max: int = GRADES, l2: float = 0.02, steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and rising cuts by full-batch Adam on the cumulative-link likelihood; (at, col, val) are the sparse rows."""
    n = max(1, len(grades))
    w = np.zeros(n_features)
    first, gaps = np.array([2.0]), np.zeros(max(0, grades_max - 1))
    state = [np.zeros(n_features + grades_max), np.zeros(n_features + grades_max)]
    for step in range(1, steps + 1):
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        _, by_z, by_cut = likelihood(np.bincount(at, val * w[col], minlength=len(grades)), cuts, grades)
        gw = np.bincount(col, val * by_z[at], minlength=n_features) / n + l2 * w / n
        gc = by_cut / n
        g_first, g_gaps = gc.sum(), np.array([np.exp(gaps[j]) * gc[j + 1 :].sum() for j in range(len(gaps))])
        g = np.concatenate([gw, [g_first], g_gaps])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w -= move[:n_features]
        first = first - move[n_features]
        gaps = np.clip(gaps - move[n_features + 1 :], -5, 5)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> DataFrame:
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
    # About max_labelled pairs of numbers, so a broadcast of known size.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> OrdinalModel:
    bound_batches(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_col, max_labelled)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words of the sample with the numbers of documents and toxic documents, folded some documents at a time."""
        for b in (part.iloc[i : i + FOLDED] for part in batches for i in range(0, len(part), FOLDED)):
            df, dt, n, t = Counter(), Counter(), len(b), int(b.toxic.sum())
            for text, toxic in zip(b.text, b.toxic, strict=True):
                ws = word_counts(text).keys()
                df.update(ws)
                if toxic:
                    dt.update(ws)
            yield pd.DataFrame({"word": ["", *df], "n": [n, *df.values()], "t": [t, *(dt[w] for w in df)]})
        release()

    per_word = cut(sample.select("text", "toxic").mapInPandas(pairs, "word string, n bigint, t bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
    total = per_word.filter("word = ''").collect()
    n, t = (int(total[0].n), int(total[0].t)) if total else (0, 0)
    if not 0 < t < n:
        return OrdinalModel({}, np.zeros(0), np.zeros(0))
    base = t / n
    # Deviation of the toxic share from the base rate in standard errors; the strongest words are the features.
    z: Column = F.abs(F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    picked = per_word.filter((F.col("word") != "") & (F.col("n") >= min(min_docs, max(1, t // 2)))).withColumn("z", z).filter("z >= 3").orderBy(F.desc("z"), "word").limit(max_features).collect()
    vocabulary = {r.word: i for i, r in enumerate(picked)}
    marked = {r.word for r in picked if (r.t + base) / (r.n + 1) >= MARKED_SHARE}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part.iloc[i : i + FOLDED] for part in batches for i in range(0, len(part), FOLDED)):
            ids, values, grades = [], [], []
            for text, toxic in zip(b.text, b.toxic, strict=True):
                c = word_counts(text)
                own = [(vocabulary[w], float(np.log1p(k))) for w, k in c.items() if w in vocabulary]
                hits = sum(k for w, k in c.items() if w in marked)
                ids.append(np.array([i for i, _ in own], np.int32))
                values.append(np.array([v for _, v in own], np.float32))
                grades.append((1 + sum(hits > s for s in GRADE_STEPS)) if toxic else 0)
            yield pd.DataFrame({"i": ids, "v": values, "grade": grades})
        release()

    got = sample.select("text", "toxic").mapInPandas(vectors, "i array<int>, v array<float>, grade int").toPandas()
    grades, at = got.grade.to_numpy(), np.repeat(np.arange(len(got), dtype=np.int32), got.i.map(len).to_numpy())
    col, val = (np.concatenate([*got.pop(c), np.zeros(0)], dtype=kind, casting="unsafe") for c, kind in (("i", np.int32), ("v", np.float32)))
    weights, cuts = fit_ordinal(at, col, val, grades, len(vocabulary))
    return OrdinalModel(vocabulary, weights, cuts)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs with severity (expected grade), p_toxic and toxic_pred."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            s = [model.score(t) for t in texts]
            yield pd.DataFrame({"severity": [a for a, _ in s], "p_toxic": [b for _, b in s]}, dtype="float64")
        release()

    udf = F.pandas_udf(run, "severity double, p_toxic double")
    bound_batches(docs.sparkSession)
    s = free("_s", docs)
    scored = docs.withColumn(s, udf(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumns({"severity": F.col(s)["severity"], "p_toxic": F.col(s)["p_toxic"], "toxic_pred": F.col(s)["p_toxic"] >= 0.5}).drop(s)
