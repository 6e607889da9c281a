"""Language identification in two steps: the family first, then one-versus-one linear SVMs among its languages.

Features are hashed byte trigrams of the whole text, ASCII in lower case and everything else that is no letter as a
blank. A linear SVM without bias decides on the sign of the sum of its trigrams' weights, so prediction is a table
look-up for each byte. The families of languages are told apart one-versus-one, too; a text is then seen by the SVMs
of its family only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm._bytes import pieces
from wakeline.llm._shared import draw

# Languages by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "baltic": ["lt", "lv"],
}
DIMS_BITS = 16
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each text, two blanks before and after it, and the offsets of each text's own."""
    n = len(offsets) - 1
    spaced = np.full(len(data) + 2 * n + 2, 32, np.uint32)
    spaced[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 2, np.diff(offsets))] = _FOLD[data]
    code = spaced[:-2] | spaced[1:-1] << np.uint32(8) | spaced[2:] << np.uint32(16)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - DIMS_BITS), offsets + 2 * np.arange(n + 1)


class Model:
    """pairs: for each of the two steps' pairs (a, b) the weights, positive for a, and the usual size of a margin."""

    def __init__(self, languages: list[str], family: dict[str, str], pairs: dict[tuple[str, str], tuple[np.ndarray, float]]) -> None:
        self.languages, self.family, self.pairs = languages, family, pairs

    def _vote(self, names: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text the index of the name with most wins (sum of chances on a tie), and its mean chance."""
        if len(names) == 1:
            return np.zeros(n, int), np.ones(n)
        wins, chance = np.zeros((n, len(names))), np.zeros((n, len(names)))
        for (a, b), m in margins.items():
            i, j = names.index(a), names.index(b)
            p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
            wins[:, i] += m >= 0
            wins[:, j] += m < 0
            chance[:, i] += p
            chance[:, j] += 1 - p
        chance /= len(names) - 1
        best = np.argmax(wins + 0.5 * chance, axis=1)
        return best, chance[np.arange(n), best]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams, at = trigrams(data, offsets)
        n = len(at) - 1
        families = sorted(set(self.family.values()))

        def margins(names: list[str], rows: np.ndarray) -> dict:
            if len(rows) == n:
                own, starts, lengths = grams[: at[-1]], at[:-1], np.diff(at)
            else:
                lengths = np.diff(at)[rows]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                own = grams[np.repeat(at[:-1][rows] - starts, lengths) + np.arange(lengths.sum())]
            return {p: np.add.reduceat(w[own], starts) / lengths / size * 3 for p in combinations(names, 2) for w, size in [self.pairs[p]]}

        first, score = self._vote(families, margins(families, np.arange(n)), n)
        out = np.empty(n, object)
        for k, f in enumerate(families):
            rows = np.flatnonzero(first == k)
            names = [x for x in self.languages if self.family[x] == f]
            if len(rows):
                best, s = self._vote(names, margins(names, rows), len(rows))
                out[rows] = np.array(names, object)[best]
                score[rows] *= s
        return out, score


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, epochs: int, strength: float) -> tuple[np.ndarray, float]:
    """A linear SVM without bias by averaged stochastic subgradients over the rows in a fixed random order."""
    w, total, scale, t = np.zeros(1 << DIMS_BITS), np.zeros(1 << DIMS_BITS), 1.0, 1
    order = np.random.default_rng(7)
    steps = 0
    for epoch in range(epochs):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            t += 1
            eta = 1 / (strength * (t + 1000))
            margin = signs[i] * scale * (w[index] @ value)
            scale *= 1 - eta * strength
            if margin < 1:
                w[index] += eta * signs[i] / scale * value
        if epoch >= epochs // 2:
            total += w * scale
            steps += 1
    weights = (total / max(steps, 1)).astype(np.float32)
    sizes = [abs(weights[i] @ v) / v.sum() for i, v in rows]
    return weights, float(np.median(sizes)) or 1.0


def train(docs: DataFrame, rows_each: int = 1500, epochs: int = 12, languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``rows_each`` rows of each of the ``languages`` languages that most rows have, drawn by a hash
    of id and text; the texts are counted whole, on the executors, and only their trigram counts come to the driver."""
    usable = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null and text rlike '\\\\p{L}'"
    )
    drawn = draw(usable, rows_each, [F.col("id"), F.col("text")], F.col("lang"), languages)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, value = [], []
            for _, _, data, offsets in pieces(b.column(2)):
                grams, at = trigrams(data, offsets)
                for i, j in zip(at[:-1], at[1:], strict=True):
                    k, c = np.unique(grams[i:j], return_counts=True)
                    index.append(k.astype(np.int32))
                    value.append((c / np.linalg.norm(c)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["id", "lang", "i", "v"])

    got = drawn.select("id", "lang", "text").mapInArrow(counted, "id string, lang string, i array<int>, v array<float>").toArrow()
    if not len(got):
        return Model([], {}, {})
    got = got.sort_by([("id", "ascending")])
    lang = np.array(got.column("lang").to_pylist(), object)
    rows = list(zip((np.asarray(x.values) for x in got.column("i")), (np.asarray(x.values) for x in got.column("v")), strict=True))
    learned = sorted(set(lang))
    family = {x: next((f for f, members in FAMILIES.items() if x in members), x) for x in learned}
    own = np.array([family[x] for x in lang], object)
    pairs = {}
    for labels, a, b in [
        *((own, a, b) for a, b in combinations(sorted(set(family.values())), 2)),
        *((lang, a, b) for a, b in combinations(learned, 2) if family[a] == family[b]),
    ]:
        chosen = np.flatnonzero((labels == a) | (labels == b))
        pairs[a, b] = _svm([rows[i] for i in chosen], np.where(labels[chosen] == a, 1.0, -1.0), epochs, 1e-4)
    return Model(learned, family, pairs)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (0 to 1). und and score 0 for a text that is null or has no letter,
    or if the model has learned no language."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = np.array(b.column(1).is_valid()) & bool(model.languages)
            lang, score = np.full(len(b), "und", object), np.zeros(len(b))
            for i, j, data, offsets in pieces(b.column(1)):
                if known[i:j].any():
                    found, s = model.predict(data, offsets)
                    lang[i:j] = np.where(known[i:j], found, "und")
                    score[i:j] = np.where(known[i:j], s, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predicted, f"doc_id {id_type}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = 1500) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, from a model that is trained on the rows not held out.

    A null or letterless text is und. Rows without a language take no part in training; with none labelled every text
    is und. Rows with the same doc_id are predicted each for itself; an empty table gives an empty result.
    """
    model = train(docs.where(~held_out(id_col)), rows_each, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that are und or have a lower score than ``least_score``, all columns kept, in one pass. Below a
    half the text is not taken for one of the language that is predicted.

    Where no row has a language to learn from, nothing is known of any row's and only null and letterless texts go."""
    model = train(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(len(names))
            stay = np.array(known.is_valid())
            for i, j, data, offsets in pieces(known) if model.languages else ():
                if stay[i:j].any():
                    stay[i:j] &= model.predict(data, offsets)[1] >= least_score
            yield b.filter(pa.array(stay)).select(names)

    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("__lettered")
    return docs.select(*names, lettered).mapInArrow(kept, docs.schema)
