"""Phrase collocations: a merged count-min sketch first, exact counts of its survivors second.

Every task adds the runs of one to ``most`` words that it reads to a count-min sketch of its own, of ``DEPTH`` rows of
cells. A cell stops counting at the least count that is asked for, so it is a byte; sketches are merged block by block,
each block by one task that has two of them in memory at a time. As a cell is never less than the count of any phrase
that falls into it, a phrase whose cells do not all reach the least count is not frequent, and every frequent one
survives. The second pass adds up the survivors' texts exactly; what is short of the least count goes only then.

The sketch has about a cell for every four runs of words, up to 2 ** MOST_BITS cells a row, 64 MB for each worker and 16
MB of bits that come to the driver and go back to the tasks. On a corpus that overfills it more phrases reach the
second pass, which is a shuffled sum like any other; the result is the same with any number of cells.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm._bytes import Rolling, mix, pieces, words
from wakeline.llm._shared import keep

DEPTH = 2
MOST_BITS = 25
#: Cells are sent and merged in blocks of 2 ** BLOCK_BITS.
BLOCK_BITS = 16
#: Texts are worked on this many bytes at a time, and up to the next mark that no phrase crosses.
STREAM_BYTES = 2 << 20
#: Phrases of one language that are ranked by one task before the best of all tasks are.
RANKED_ROWS = 500_000

# The marks that no phrase crosses, and what separates words within a piece.
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?\n\x0b\x0c\r")] = True
APART = MARKS.copy()
APART[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST, _SECOND = Rolling(12), Rolling(13)


def streams(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """(language, bytes) for the columns text and lang of a batch: the texts of each language one after another, parted by
    a mark, cut after marks into stretches of about STREAM_BYTES."""
    langs = pc.fill_null(batch.column(1), "und")
    for lang in pc.unique(langs).to_pylist():
        for i, j, data, offsets in pieces(batch.column(0).filter(pc.equal(langs, lang)), STREAM_BYTES):
            line = np.full(len(data) + j - i, 10, np.uint8)
            line[np.arange(len(data)) + np.repeat(np.arange(j - i), np.diff(offsets))] = _LOWER[data]
            at = 0
            while at < len(line):
                end = at + 2 * STREAM_BYTES
                if end < len(line):
                    mark = MARKS[line[end:]]
                    end += int(mark.argmax()) if mark.any() else len(mark)
                yield lang, line[at:end]
                at = end


def runs_of(data: np.ndarray, lang: str, most: int, rolling: Rolling = _FIRST) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Starts and ends of the words, and for each length from 1 to ``most`` the first words of the runs that cross no mark
    and the runs' hashes, which depend on the language, too."""
    starts, ends, _ = words(data, np.array([0, len(data)]), APART)
    hashed = rolling.runs(rolling.prefix(rolling.values[data]), starts, ends)
    piece = np.cumsum(MARKS[data], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))
    firsts, found = [np.arange(len(starts))], [mix(hashed + salt)]
    for n in range(2, most + 1):
        first = np.flatnonzero(piece[n - 1 :] == piece[: len(piece) - n + 1]) if len(piece) >= n else np.zeros(0, np.int64)
        longer = np.zeros(len(starts), np.uint64)
        longer[first] = mix(found[-1][first] * np.uint64(0x9E3779B97F4A7C15) + hashed[first + n - 1])
        firsts.append(first)
        found.append(longer)
    return starts, ends, firsts, [x[f] for x, f in zip(found, firsts, strict=True)]


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.uint32)


def sketch_bits(docs: DataFrame, most: int) -> int:
    """The sketch's size for the texts of docs, from their bytes: a run of words for each length and some six bytes."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return min(MOST_BITS, max(BLOCK_BITS, math.ceil(math.log2(total / 6 * most / 4 + 1))))


def frequent_cells(docs: DataFrame, most: int, least: int, bits: int) -> np.ndarray:
    """For each row of the sketch a bit for each cell, packed: whether the cell's count over all docs (text, lang) reaches
    ``least``. DEPTH * 2 ** bits bits are all that comes to the driver."""
    size, kind = 1 << BLOCK_BITS, np.uint8 if least < 256 else np.uint32
    per_row = 1 << (bits - BLOCK_BITS)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, 1 << bits), kind)
        for b in batches:
            for lang, data in streams(b):
                *_, hashes = runs_of(data, lang, most)
                for found in hashes:
                    for d in range(DEPTH):
                        at = np.sort(cells(found, d, bits))
                        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
                        cell, n = at[edge], np.diff(np.append(edge, len(at)))
                        sketch[d][cell] = np.minimum(sketch[d][cell] + n, least)
        packer = zstandard.ZstdCompressor(level=1)
        for k, block in enumerate(sketch.reshape(-1, size)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packer.compress(block.tobytes())], pa.binary())], ["block", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of neighbours of one block the sum; blocks come in order."""
        unpacker, block, total = zstandard.ZstdDecompressor(), -1, np.zeros(size, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != block:
                    if block >= 0:
                        yield done()
                    block, total = k, np.zeros(size, np.int64)
                total += np.frombuffer(unpacker.decompress(packed.as_buffer()), kind)
        if block >= 0:
            yield done()

    sent = docs.select("text", "lang").mapInArrow(sketched, "block int, cells binary")
    got = sent.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, bits binary").toArrow()
    out = np.zeros((DEPTH * per_row, size // 8), np.uint8)
    for k, packed in zip(got.column("block").to_pylist(), got.column("bits"), strict=True):
        out[k] = np.frombuffer(packed.as_buffer(), np.uint8)
    return out.reshape(DEPTH, -1)


def _grouped(hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair of hashes, and how often the pair is there."""
    order = np.argsort(hashes)
    a, b = hashes[order], check[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((check, hashes))
        a, b = hashes[order], check[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    edge = np.flatnonzero(np.concatenate([[True], ~same])) if len(a) else np.zeros(0, np.int64)
    return order[edge], np.diff(np.append(edge, len(a)))


def _phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words first to last of each run, joined by one space."""
    length = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(length)])
    line = np.full(at[-1], 32, np.uint8)
    inside = ~APART[data]
    spot = np.ones(at[-1], bool)
    spot[at[1:] - 1] = False
    line[spot] = data[inside]
    size = at[last + 1] - 1 - at[first]
    to = np.concatenate([[0], np.cumsum(size)])
    taken = line[np.arange(to[-1]) + np.repeat(at[first] - to[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(taken)]).cast(pa.string())


def count_survivors(docs: DataFrame, most: int, least: int, bits: int) -> DataFrame:
    """lang, n_words, phrase, f: the exact counts of all phrases of 1 to ``most`` words that are there ``least`` times, and
    the number of all words of each language as the phrase of no words."""
    wide = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, most, least, bits))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = wide.value
        for b in batches:
            for lang, data in streams(b):
                starts, ends, firsts, hashes = runs_of(data, lang, most)
                check = runs_of(data, lang, most, _SECOND)[3]
                columns = [(0, pa.array([""]), np.array([len(starts)]))]
                for n, (first, h, c) in enumerate(zip(firsts, hashes, check, strict=True), 1):
                    stay = np.ones(len(h), bool)
                    for d in range(DEPTH):
                        cell = cells(h, d, bits)
                        stay &= (frequent[d][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                    first, h, c = first[stay], h[stay], c[stay]
                    one, times = _grouped(h, c)
                    columns.append((n, _phrases(data, starts, ends, first[one], first[one] + n - 1), times))
                for n, phrase, times in columns:
                    for i in range(0, len(phrase), 20_000):
                        part = phrase.slice(i, 20_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), n, np.int32)), part, pa.array(times[i : i + 20_000].astype(np.int64))], ["lang", "n_words", "phrase", "f"]
                        )

    sums = docs.select("text", "lang").mapInArrow(counted, "lang string, n_words int, phrase string, f long").groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    return keep(sums.where((F.col("f") >= least) | (F.col("n_words") == 0)), "phrases")


def _whole(x: Column) -> Column:
    """A count as a number whose products with two others and a million stay exact."""
    return x.cast("decimal(14,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, n_words, a, l, r, score of every phrase of several words: of all cuts into two parts the one with the
    lowest score floor(1000000 a a / (l r)), then the shortest first part. Parts of a frequent phrase are frequent, too,
    so counts has them all."""
    long = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = long.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")).select(
        "lang", "phrase", "n_words", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, n_words - k)"), " ").alias("right")
    )
    part = counts.where("n_words > 0")
    both = cut.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]
    )
    both = both.withColumns({"top": _whole(F.col("a")) * _whole(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)"), "below": _whole(F.col("l")) * _whole(F.col("r"))})
    lowest = both.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct(F.expr("top div below").alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score")


def subsumed(counts: DataFrame, most: int) -> DataFrame:
    """lang, phrase, longest: of every phrase that is part of a longer one the count of the most frequent such."""
    long = counts.where("n_words > 2").select("lang", "f", "n_words", F.split("phrase", " ").alias("w"))
    parts = [F.expr(f"transform(sequence(1, n_words - {n} + 1), i -> array_join(slice(w, i, {n}), ' '))") for n in range(2, most)]
    inside = F.concat(*(F.when(F.col("n_words") > n, p).otherwise(F.array().cast("array<string>")) for n, p in zip(range(2, most), parts, strict=True))) if parts else F.array().cast("array<string>")
    return long.select("lang", "f", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def mine_phrases(
    docs: DataFrame, most: int = 3, least: int = 10, percent: int = 50, first: int = 2000, bits: int | None = None, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases of 2 to ``most`` words.

    A-Z count as a-z; phrases cross no mark and no text. A null or empty text has no words, a null language is ``und``.
    Phrases that are there at least ``least`` times are ranked by score, then count a, then by their bytes; one whose
    words lie within a longer one that has ``percent`` of a hundred of its count is left out. l and r are the counts of
    the two parts of the cut with the lowest score, n that of all words of the language. Repeated rows count each; a
    language without such a phrase, or an empty table, gives no row. ``bits`` sizes the sketch (by default by the
    texts' bytes) and has no influence on the result.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = count_survivors(rows, most, least, bits or sketch_bits(rows, most))
    found = scored(counts).join(subsumed(counts, most), ["lang", "phrase"], "left").where(F.coalesce(F.col("longest") * 100 < F.col("a") * percent, F.lit(True)))
    found = keep(found.select("lang", "phrase", "a", "l", "r", "score"), "scored")
    shares = max(1, -(-found.count() // RANKED_ROWS))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    best = found.withColumn("place", F.row_number().over(W.partitionBy("lang", share).orderBy(*order))).where(F.col("place") <= first)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
