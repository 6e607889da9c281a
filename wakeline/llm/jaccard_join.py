"""Near duplicates: the join of all texts whose sets of word n-grams have a Jaccard similarity of a threshold or more.

Texts of the same words are one node with a number of copies. Nodes that agree in a band of MinHash values are
candidates; with 24 bands of 5 values, a pair at 0.8 is missed with a chance below 1 in 10,000. The nodes of one band's
value are a bucket; buckets of the same nodes are one. Pairs are compared within buckets, never beyond: those of a
bucket of many nodes by pairs of blocks, spread over the cluster. A pair that shares several buckets counts in the
first band that it agrees in. MinHash values are compared some at a time, and after each time the pairs are dropped for
which the posterior probability of reaching the threshold (uniform prior, binomial agreement) is below ``tolerance``;
for the rest the similarity is counted exactly. A task gets two blocks at most and returns, for each node with links,
their number and the least node it hangs together with, so the links of a large group are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm._bytes import Rolling, mix, pieces, words
from wakeline.llm._components import components
from wakeline.llm._shared import ROW, keep, near_keys, same_row, text_hashes, texts, with_row_key

_BYTES, _GRAMS, _TEXT, _TEXT2 = (Rolling(k) for k in range(11, 15))
BANDS, ROWS = 24, 5
#: MinHash values compared with the posterior, and how many at a time.
VALUES, STEP = 128, 16
#: Nodes of a block.
BLOCK = 512
_MULTIPLY = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(977)) | np.uint64(1)
_ADD = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(7919))


def _grams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the n-grams, offsets by text, two hashes of each text's words, number of words); a text of fewer
    words than an n-gram has is one."""
    starts, ends, at = words(data, offsets)
    own = _BYTES.runs(_BYTES.prefix(_BYTES.values[data]), starts, ends)
    prefix, count = _GRAMS.prefix(own), np.diff(at)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(at[:-1] - out[:-1], n) + np.arange(out[-1])
    grams = _GRAMS.runs(prefix, first, np.minimum(first + size, np.repeat(at[1:], n)))
    whole = [r.runs(r.prefix(own), at[:-1], at[1:]).view(np.int64) for r in (_TEXT, _TEXT2)]
    return grams, out, *whole, count


def _minhash(grams: np.ndarray, starts: np.ndarray, values: int) -> np.ndarray:
    out = np.empty((len(starts), values), np.uint32)
    for k in range(values):
        out[:, k] = np.minimum.reduceat(((grams * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(sign: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each of the first bands of MinHash values, for each text."""
    keys = np.empty((len(sign), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sign), band + 1, np.uint64)
        for k in range(ROWS):
            key = mix(key * np.uint64(31) + sign[:, band * ROWS + k])
        keys[:, band] = key
    return keys


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the least number of matches at which the posterior probability that the
    similarity reaches the threshold is at least the tolerance. With a uniform prior, m of n matches give
    P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, least: dict[int, int], band: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets (distinct sorted hashes) of numbers left x right, or all pairs of left if right is left, whose
    similarity reaches the threshold and that agree in no band before ``band``."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    grams = np.concatenate(sets)
    sign = _minhash(grams, starts, VALUES)
    same = right is left
    alive = np.minimum.outer(sizes[left], sizes[right]) >= threshold * np.maximum.outer(sizes[left], sizes[right]) - 1e-9
    if same:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    if band:
        keys = band_keys(sign[:, : band * ROWS].astype(np.uint64), band)
        for k in range(band):
            alive &= keys[left, k][:, None] != keys[right, k]
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int32)
    for n in range(STEP, VALUES + 1, STEP):
        matches += (sign[left[i], n - STEP : n] == sign[right[j], n - STEP : n]).sum(1, dtype=np.int32)
        stay = matches >= least[n]
        i, j, matches = i[stay], j[stay], matches[stay]
        if not len(i):
            return i, j
    a, b = left[i], right[j]
    if len(i) <= 40:
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
    else:  # counts of common members from products of slices of the sets' 0/1 matrix
        _, number, times = np.unique(grams, return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        use = times[number] > 1
        row, column = np.repeat(np.arange(len(sets)), sizes)[use], shared[number[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        counted = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            s, e = np.searchsorted(column, [lo, lo + 4096])
            x = np.zeros((len(sets), 4096), np.float32)
            x[row[s:e], column[s:e] - lo] = 1
            counted += x[left] @ x[right].T
        common = counted[i, j].astype(np.int64)
    ok = common / np.maximum(sizes[a] + sizes[b] - common, 1) >= threshold
    return a[ok], b[ok]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n numbers the least it hangs together with."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def _verified(groups: Iterator[tuple[int, tuple[list[int], list[int], list[int], list[np.ndarray]]]], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    least = least_matches(threshold, tolerance)
    nodes_out, links_out, root_out = [], [], []
    for band, (nodes, copies, side, sets) in groups:
        order = np.argsort(nodes, kind="stable")
        order = order[np.concatenate([[True], np.diff(np.array(nodes)[order]) > 0])] if len(order) else order
        nodes, copies, side = (np.array(x)[order] for x in (nodes, copies, side))
        sets = [sets[k] for k in order]
        left = np.flatnonzero(side != 2)
        right = left if not (side == 2).any() and not (side == 1).any() else np.flatnonzero(side == 2)
        if len(nodes) < 2 or not len(right):
            continue
        a, b = linked_pairs(sets, left, right, threshold, least, band)
        if not len(a):
            continue
        links = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
        low = _forest(len(nodes), a, b)
        has = np.flatnonzero(links)
        nodes_out.append(nodes[has])
        links_out.append(links[has].astype(np.int64))
        root_out.append(nodes[low[has]])
        if len(nodes_out) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (nodes_out, links_out, root_out)], ["node", "links", "root"])
            nodes_out, links_out, root_out = [], [], []
    if nodes_out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (nodes_out, links_out, root_out)], ["node", "links", "root"])


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, gram: int = 5, tolerance: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, class_id, n_links, class_size, kept.

    Words are what white space separates, unchanged; a text of fewer than ``gram`` words is one n-gram. Classes are the
    connected components of the links, named by their least doc_id, a null one last, whose row is the one kept; n_links
    counts the other rows linked to a row, copies included. Null, empty and blank texts have no n-grams and no links;
    each is a class of its own. Rows repeated with one doc_id are copies of each other, or nodes of their own if their
    texts differ. An empty table gives an empty result.
    """
    return _classes(docs, threshold, gram, tolerance, id_col, text_col).drop("text_a", "text_b")


def _classes(
    docs: DataFrame, threshold: float = 0.8, gram: int = 5, tolerance: float = 1e-5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of jaccard_classes, with the hashes of their texts."""
    rows = with_row_key(texts(docs, id_col, text_col))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in pieces(b.column(3)):
                grams, at, one, two, count = _grams(data, offsets, gram)
                keys = np.zeros((j - i, BANDS), np.uint64)
                full = np.flatnonzero(count)
                if len(full):
                    keys[full] = band_keys(_minhash(grams, at[:-1][full], BANDS * ROWS).astype(np.uint64))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in range(3)), pa.array(one), pa.array(two), pa.array(count, pa.int64()), bands],
                    [*ROW, "one", "two", "n_words", "bands"],
                )

    signatures = keep(
        rows.select(*ROW, "text")
        .mapInArrow(signed, f"doc_id {id_type}, text_a long, text_b long, one long, two long, n_words long, bands array<long>")
        .withColumn("row_id", F.monotonically_increasing_id()),
        "signatures",
    )
    of_rows = signatures.where("n_words > 0")
    nodes = keep(
        of_rows.groupBy("one", "two", "n_words")
        .agg(F.min("row_id").alias("node"), F.count("*").alias("copies"), F.min(F.struct("row_id", *ROW)).alias("row"), F.first("bands").alias("bands")),
        "nodes",
    )
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    # of buckets with the same nodes the first is enough; written down, so that the join to it is one of two shuffles, of
    # which Spark can split a very frequent value's
    buckets = banded.groupBy("value").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("b")).where("n > 1")
    buckets = keep(buckets.groupBy("n", "a", "b").agg(F.min(F.struct("band", "value")).alias("first")).select("first.value", "n"), "buckets")
    members = keep(
        banded.hint("merge").join(buckets, "value").groupBy("node").agg(F.collect_list(F.struct("band", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))).alias("buckets"))
        .join(nodes.select("node", "copies", *(F.col(f"row.{c}").alias(f"m_{c}") for c in ROW)), "node"),
        "members",
    )

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for i, j, data, offsets in pieces(b.column(3)):
                grams, at, *_ = _grams(data, offsets, gram)
                sets += [np.unique(grams[s:e]).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(sets, pa.binary())], ["node", "copies", "buckets", "grams"])

    here = F.pmod(F.xxhash64("node"), F.col("b.blocks")).cast("int")
    found = near_keys(rows, F.col("text_a"), members.select("m_text_a")).hint("merge").join(members, same_row("m_"))
    bucket_type = "array<struct<band:int,value:bigint,blocks:int>>"
    dealt = (
        found.dropDuplicates(["node"]).select("node", "copies", "buckets", "text")
        .mapInArrow(as_sets, f"node long, copies long, buckets {bucket_type}, grams binary")
        .select("node", "copies", "grams", F.explode("buckets").alias("b"))
        .withColumn("here", here)
        .withColumn("there", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)))
        .select(
            "b.band", "b.value", F.least("here", "there").alias("i"), F.greatest("here", "there").alias("j"), "node", "copies",
            F.when(F.col("here") == F.col("there"), 0).when(F.col("here") < F.col("there"), 1).otherwise(2).alias("side"), "grams",
        )
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            now, held = None, ([], [], [], [])
            for b in batches:
                keys = zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
                for key, node, copies, side, grams in zip(keys, b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), b.column(7), strict=True):
                    if key != now:
                        if now is not None:
                            yield now[0], held
                        now, held = key, ([], [], [], [])
                    for x, y in zip(held, (node, copies, side, np.frombuffer(grams.as_buffer(), np.uint64).copy()), strict=True):
                        x.append(y)
            if now is not None:
                yield now[0], held

        yield from _verified(groups(), threshold, tolerance)

    verified = keep(
        dealt.repartition("value", "i", "j").sortWithinPartitions("band", "value", "i", "j")
        .mapInArrow(compared, "node long, links long, root long"),
        "links",
    )
    classes = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = (
        nodes.select("one", "two", "n_words", "node", "copies")
        .join(linked, "node", "left").join(classes, "node", "left")
        .select("one", "two", "n_words", F.coalesce("component", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    placed = keep(
        of_rows.join(of_node, ["one", "two", "n_words"]).select(*ROW, "row_id", "class", "n_links")
        .unionByName(signatures.where("n_words = 0").select(*ROW, "row_id", F.col("row_id").alias("class"), F.lit(0).cast("long").alias("n_links"))),
        "placed",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    named = keep(placed.groupBy("class").agg(first.alias("first"), F.count("*").alias("class_size")), "classes")
    return placed.join(named, "class").select(
        *ROW, F.col("first.doc_id").alias("class_id"), "n_links", "class_size", (F.col("first.row_id") == F.col("row_id")).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, gram: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept row of each class alone, all columns kept; repeated rows are one row afterwards."""
    rows = keep(_classes(docs, threshold, gram, 1e-5, id_col, text_col).select(*ROW, "kept"), "classes")
    stays = rows.where("kept").select(*(F.col(c).alias(f"__{c}") for c in ROW)).distinct()
    a, b = text_hashes(F.col(text_col))
    left = docs.join(stays, F.col(id_col).eqNullSafe(F.col("__doc_id")) & (a == F.col("__text_a")) & (b == F.col("__text_b")), "left_semi")
    if rows.groupBy(*ROW).count().where("count > 1").limit(1).count():
        left = left.groupBy(F.col(id_col).alias("__id"), a.alias("__a"), b.alias("__b")).agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return left
