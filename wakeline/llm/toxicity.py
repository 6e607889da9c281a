"""Toxicity by cumulative-link ordinal regression on sparse word features.

A text's words and their beginnings of 4 to 8 bytes, as far as they are in the vocabulary, each with the logarithm of
its count, give one linear score. The vocabulary has what is markedly more or less frequent in toxic rows. All
thresholds between the grades share its weights: P(grade > k) = sigmoid(score - threshold k). The weights are fitted
by proximal gradient steps with an L1 penalty, so only words that speak for or against keep one. The expected severity
is the sum of P(grade > k) over k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm._bytes import Rolling, pieces, words
from wakeline.llm._shared import keep, texts

_HASH = Rolling(21)
#: Bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6, 7, 8)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _word_counts(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, count) of the distinct words and beginnings of each text: each is its hash, or with ``known`` its
    place in it."""
    starts, ends, at = words(data, offsets, _BETWEEN)
    prefix = _HASH.prefix(_HASH.values[_FOLD[data]])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    longer = [np.flatnonzero(ends - starts > n) for n in BEGINNINGS]
    hashes = np.concatenate([_HASH.runs(prefix, starts, ends), *(_HASH.runs(prefix, starts[x], starts[x] + n) for n, x in zip(BEGINNINGS, longer, strict=True))])
    text = np.concatenate([text, *(text[x] for x in longer)])
    if known is not None:
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        use = known[place] == hashes
        hashes, text = place[use].astype(np.uint64), text[use]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], hashes[first], np.diff(np.append(first, len(hashes)))


@dataclass
class Severity:
    words: np.ndarray  # sorted hashes of the words with a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.words):
            return np.zeros(n)
        text, word, count = _word_counts(data, offsets, self.words)
        return np.bincount(text, self.weights[word.astype(np.int64)] * np.log1p(count), n)


def fit(row: np.ndarray, word: np.ndarray, value: np.ndarray, grade: np.ndarray, penalty: float = 3e-5, steps: int = 800) -> Severity:
    """The model for entries (row, word, value) and the grades, 0 to some K, of the rows."""
    names, place = np.unique(word, return_inverse=True)
    n, top = len(grade), int(grade.max(initial=0))
    if top == 0:
        return Severity(np.zeros(0, np.uint64), np.zeros(0), np.full(1, 40.0))
    share = np.array([(grade > k).mean() for k in range(top)])
    theta = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    theta = np.maximum(theta, 0.5 + np.arange(top))  # a text without any known word begins as clean, whatever the shares
    w = np.zeros(len(names))
    speed, theta_speed = np.full(len(names), 1e-8), np.full(top, 1e-4)
    for _ in range(steps):
        score = np.bincount(row, w[place] * value, n)
        sig = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40)))
        edge = np.concatenate([np.ones((n, 1)), sig, np.zeros((n, 1))], axis=1)
        a, b = edge[np.arange(n), grade], edge[np.arange(n), grade + 1]
        p = np.maximum(a - b, 1e-3)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        by_score = -(da - db) / n
        grad = np.bincount(place, by_score[row] * value, len(names))
        speed += grad**2
        rate = 0.5 / np.sqrt(speed)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        by_theta = np.zeros(top)
        np.add.at(by_theta, np.maximum(grade - 1, 0), np.where(grade > 0, da, 0) / n)
        np.add.at(by_theta, np.minimum(grade, top - 1), np.where(grade < top, -db, 0) / n)
        theta_speed += by_theta**2
        theta = theta - 0.2 * by_theta / np.sqrt(theta_speed)
        theta = np.maximum.accumulate(theta - 0.05 * np.arange(top)) + 0.05 * np.arange(top)  # apart by a little at least
    kept = np.flatnonzero(w)
    return Severity(names[kept], w[kept], theta)


def grades_from_flags(row: np.ndarray, word: np.ndarray, count: np.ndarray, toxic: np.ndarray, levels: int = 3) -> np.ndarray:
    """Grades 0 to ``levels`` where labels only say toxic or not: 0 for rows that are not; the others are ranked by how
    much of the text is words that are at least ten times as frequent among toxic rows, and cut into equal parts."""
    names, place = np.unique(word, return_inverse=True)
    flagged = toxic.astype(bool)
    with_word = np.bincount(place, flagged[row], len(names))
    clean_with = np.bincount(place, ~flagged[row], len(names))
    marks = (with_word >= 5) & (with_word / max(flagged.sum(), 1) >= 10 * (clean_with + 0.5) / max((~flagged).sum(), 1))
    share = np.bincount(row, count * marks[place], len(toxic)) / np.maximum(np.bincount(row, count, len(toxic)), 1)
    out = np.zeros(len(toxic), np.int64)
    ranked = np.flatnonzero(flagged)[np.argsort(share[flagged], kind="stable")]
    out[ranked] = 1 + np.arange(len(ranked)) * levels // max(len(ranked), 1)
    return out


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic",
    least_rows: int = 5, least_z: float = 2.5,
) -> Severity:
    """A model from about ``sample_rows`` labelled rows, drawn by a hash of the id, whole texts, repeated rows once. The vocabulary
    is what at least ``least_rows`` of them have and a z score of ``least_z`` tells apart. With grades
    beyond 1 these are the grades; with 0 and 1 alone severities are those of grades_from_flags."""
    graded = labels.select(F.col(id_col).alias("l_id"), F.col(grade_col).cast("int").alias("grade")).where("l_id is not null and grade >= 0").groupBy("l_id").agg(F.max("grade").alias("grade"))
    n = graded.count()
    top = (1 << 63) - 1
    drawn = lambda c: F.shiftrightunsigned(F.xxhash64(c.cast("string"), F.lit(3)), 1) <= min(top, (sample_rows + 40) * top // max(n, 1))
    rows = docs.where(drawn(F.col(id_col)) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = rows.join(graded.where(drawn(F.col("l_id"))), F.col("doc_id") == F.col("l_id")).select("doc_id", "grade", "text").dropDuplicates(["doc_id", "text"])

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flag = np.asarray(b.column(1)) > 0
            for i, _, data, offsets in pieces(b.column(2)):
                text, word, _ = _word_counts(data, offsets)
                names, place, n = np.unique(word, return_inverse=True, return_counts=True)
                toxic = np.bincount(place, flag[text + i], len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n, pa.int64()), pa.array(toxic)], ["word", "n", "toxic"])

    some = keep(some, "labelled")
    total, flagged = some.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("grade") > 0, 1)), F.lit(0))).first()
    if not flagged or flagged == total:
        return Severity(np.zeros(0, np.uint64), np.zeros(0), np.full(1, -40.0 if flagged else 40.0))
    share = F.col("n") / total
    odd = (F.col("toxic") / flagged - (F.col("n") - F.col("toxic")) / (total - flagged)) / F.sqrt(share * (1 - share) * (1 / flagged + 1 / (total - flagged)))
    chosen = (
        some.mapInArrow(by_word, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where((F.col("n") >= least_rows) & (F.col("n") < total) & (F.abs(odd) >= least_z)).select("word").toArrow()
    )
    known = np.sort(chosen.column("word").to_numpy().astype(np.int64).view(np.uint64))
    if not len(known):
        return Severity(known, np.zeros(0), np.full(1, 40.0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in pieces(b.column(2)):
                text, word, count = _word_counts(data, offsets, known)
                cut = pa.array(np.searchsorted(text, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (word, count)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.string()), b.column(1).slice(i, j - i), *lists], ["id", "grade", "word", "count"])

    got = some.mapInArrow(counted, "id string, grade int, word array<int>, count array<int>").toArrow().sort_by([("id", "ascending")])
    sizes = [len(x) for x in got.column("word")]
    row = np.repeat(np.arange(len(sizes)), sizes)
    word, count = (np.concatenate([np.asarray(x.values) for x in got.column(c)]) for c in ("word", "count"))
    word, grade = known[word], got.column("grade").to_numpy().astype(np.int64)
    if grade.max() <= 1:
        grade = grades_from_flags(row, word, count, grade)
    return fit(row, word, np.log1p(count), grade)


def grade_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic"
) -> DataFrame:
    """Per row of docs: doc_id, severity (expected grade), grade (the most probable), toxic (P(grade > 0) >= least).

    A null or empty text has no words and gets the severity of an empty score, which with any clean label is low.
    Rows with the same doc_id are graded each for itself; of labels repeated for a doc_id the highest counts, and
    null labels do not. Without a toxic label everything has severity 0. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    model = train(docs, labels, sample_rows, id_col, text_col, grade_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.concatenate([np.zeros(0), *(model.scores(data, offsets) for _, _, data, offsets in pieces(b.column(1)))])
            above = model.above(score)
            edge = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(above.sum(1)), pa.array((edge[:, :-1] - edge[:, 1:]).argmax(1), pa.int32()), pa.array(above[:, 0] >= least)],
                ["doc_id", "severity", "grade", "toxic"],
            )

    return rows.mapInArrow(graded, f"doc_id {id_type}, severity double, grade int, toxic boolean")
