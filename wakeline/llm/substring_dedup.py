"""Removal of passages that occur more than once, by level-wise doubling.

Every window of ``window`` words stands behind a short run of its words, first of an eighth of its length: the one with
the smallest hash in it, so equal windows stand behind equal runs, and consecutive windows mostly behind the same one.

1. Runs that occur once end there: no window behind them is repeated.
2. Repeated runs are extended to twice their length, to the right, or to the left where that would leave the window,
   and counted again; and so on, until none is repeated or twice the length would no longer fit.
3. The last doubling goes beyond the window: the stretch of words that all windows behind one run cover together. If
   two stretches are equal, all windows in them are repeated.
4. Where a run's stretches differ, the windows themselves are counted, one copy of each stretch for all equal ones.

Each level counts with 64-bit hashes within the groups of the level before, so a window is told apart by 128 bits and
more. Spark adds up counts before it sends them, and joins them back to the rows, so no group is ever gathered; both
sides of these joins are shuffled, so that Spark can split a very frequent run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm._bytes import Rolling, each, pieces, words
from wakeline.llm._shared import ROW, keep, near_keys, same_row, texts, with_row_key

_BYTES, _STRETCHES, _FINE, _FINE2, *_LEVELS = (Rolling(k) for k in range(1, 40))
_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)


def run_lengths(window: int) -> list[int]:
    """The lengths of the levels' runs: each twice the one before, as long as a run can be extended within its window,
    wherever in it it stands."""
    out = [window // 8 + 1]
    while 3 * out[-1] <= window + 1:
        out.append(2 * out[-1])
    return out


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = words(data, offsets)
    return _BYTES.runs(_BYTES.prefix(_BYTES.values[data]), starts, ends), at


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from those of powers of two."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs of each level, stretch, text, first, n, fresh): the n windows from word ``first`` on stand behind the same
    runs. Bit k of fresh tells that the row before has another place of the run of level k or k - 1."""
    lengths = run_lengths(window)
    hashes, at = _word_hashes(data, offsets)
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return [none] * len(lengths), none, none, none, none, none
    i = np.arange(len(hashes) - lengths[0] + 1)
    runs = _LEVELS[0].runs(_LEVELS[0].prefix(hashes), i, i + lengths[0])
    least = _sliding_least((runs >> _PLACE_BITS << _PLACE_BITS) | (i.astype(np.uint64) & _PLACE), window - lengths[0] + 1)
    i = np.arange(len(least))
    starts = [i + ((least & _PLACE).astype(np.int64) - i) % (1 << 28)]
    for n in lengths[1:]:
        starts.append(np.where(starts[-1] + n <= i + window, starts[-1], starts[-1] - n // 2))
    valid = i + window <= np.repeat(at[1:], np.diff(at))[: len(i)]
    begins = valid.copy()
    moved = [s[1:] != s[:-1] for s in starts]
    begins[1:] &= ~valid[:-1] | np.any(moved, axis=0)
    first = np.flatnonzero(begins)
    fresh = np.zeros(len(first), np.int64)
    for k in range(len(starts)):
        on = ~valid[:-1] | moved[k] | moved[max(k - 1, 0)]
        fresh |= np.where(first > 0, on[first - 1] if len(on) else True, True).astype(np.int64) << k
    n = np.diff(np.append(np.cumsum(valid)[first] - 1, valid.sum()))
    levels = [r.runs(r.prefix(hashes), s[first], s[first] + k).view(np.int64) for r, s, k in zip(_LEVELS, starts, lengths)]  # noqa: B905
    stretch = _STRETCHES.runs(_STRETCHES.prefix(hashes), first, first + n - 1 + window).view(np.int64)
    text = np.searchsorted(at, first, "right") - 1
    return levels, stretch, text, first - at[text], n, fresh


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, first): two hashes of each of the n windows from each ``first`` on, of one text."""
    hashes, _ = _word_hashes(data, offsets)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return tuple(r.runs(r.prefix(hashes), at, at + window).view(np.int64) for r in (_FINE, _FINE2)) + (at,)


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """ROW, spots: for each text with repeated windows the structs (first, n) that list them."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    row_type = f"doc_id {id_type}, text_a long, text_b long"
    levels = [f"run{k}" for k in range(len(run_lengths(window)))]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, offsets in pieces(b.column(3)):
                runs, stretch, text, first, n, fresh = anchors(data, offsets, window)
                own = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, runs), pa.array(stretch), *(b.column(c).take(own) for c in range(3)), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(fresh, pa.int32())],
                    [*levels, "stretch", *ROW, "first", "n", "fresh"],
                )

    live = rows.select(*ROW, "text").mapInArrow(found, f"{', '.join(f'{c} long' for c in levels)}, stretch long, {row_type}, first int, n int, fresh int")
    for k, run in enumerate(levels):
        on = levels[max(k - 1, 0) : k + 1]
        again = keep(live.groupBy(*on).agg(F.sum(F.getbit("fresh", F.lit(k))).alias("times")).where("times > 1").select(*on), "again")
        live = keep(live.hint("merge").join(again, on).drop(*levels[:k]), f"level{k}")
        if not again.limit(1).count():  # no candidate survives
            break
    stretches = keep(live.groupBy(run, "stretch").agg(F.count("*").alias("times"), F.min(F.struct(*ROW, "first", "n")).alias("one")), "stretches")
    settled = live.join(stretches.where("times > 1").select(run, "stretch"), [run, "stretch"]).select(*ROW, "first", "n")
    mixed = stretches.groupBy(run).agg(F.count("*").alias("kinds")).where("kinds > 1").select(run)
    opened = stretches.join(keep(mixed, "mixed"), run).groupBy(*(F.col(f"one.{c}").alias(f"o_{c}") for c in ROW)).agg(F.collect_list(F.struct("one.first", "one.n", "times")).alias("spots"))
    opened = keep(opened, "opened")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots = b.column(4)
            for i, data, offsets in each(b.column(3)):
                own = spots[i].values
                first, n, times = (np.asarray(own.field(k)) for k in ("first", "n", "times"))
                a, c, at = window_hashes(data, offsets, window, first.astype(np.int64), n.astype(np.int64))
                row = pa.array(np.full(len(a), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(c), *(b.column(k).take(row) for k in range(3)), pa.array(at, pa.int32()), pa.array(np.repeat(times, n), pa.int64())],
                    ["a", "b", *ROW, "first", "times"],
                )

    fine = keep(
        near_keys(rows, F.col("text_a"), opened.select("o_text_a")).join(opened, same_row("o_")).select(*ROW, "text", "spots").mapInArrow(hashed, f"a long, b long, {row_type}, first int, times long"), "windows"
    )
    twice = keep(fine.groupBy("a", "b").agg(F.sum("times").alias("total")).where("total > 1").select("a", "b"), "twice")
    single = fine.where("times = 1").hint("merge").join(twice, ["a", "b"]).select(*ROW, "first", F.lit(1).alias("n"))
    return settled.unionByName(single).groupBy(*(F.col(c).alias(f"s_{c}") for c in ROW)).agg(F.collect_set(F.struct("first", "n")).alias("spots"))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if one of the windows of ``window`` consecutive words that cover it also starts elsewhere, in this
    text or another; windows are those of the input. A null text has no words; a text of fewer words than a window
    keeps all. Rows repeated with one doc_id and text are two places for every window; rows without a doc_id, or with
    one doc_id and other texts, are told apart by their texts. An empty table gives an empty result. kept_text joins
    the kept words by one space.
    """
    rows = with_row_key(texts(docs, id_col, text_col))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    spots = keep(repeated_windows(rows, window), "spots")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, out = [], [], []
            for i, data, offsets in each(b.column(1)):
                starts, ends, _ = words(data, offsets)
                gone = np.zeros(len(starts) + 1, np.int64)
                if b.column(2)[i].is_valid:
                    own = b.column(2)[i].values
                    first, n = (np.asarray(own.field(k)).astype(np.int64) for k in ("first", "n"))
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + n - 1 + window, -1)
                stay = np.cumsum(gone)[:-1] == 0
                raw = data.tobytes()
                out.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
                n_words.append(len(starts))
                n_removed.append(len(starts) - int(stay.sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    # texts are shuffled only where something may go from them
    near, apart = (near_keys(rows, F.col("text_a"), spots.select("s_text_a"), apart=x) for x in (False, True))
    found = near.join(spots, same_row("s_"), "left").select("doc_id", "text", "spots")
    return found.unionByName(apart.select("doc_id", "text", F.lit(None).cast(spots.schema["spots"].dataType).alias("spots"))).mapInArrow(
        kept, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
