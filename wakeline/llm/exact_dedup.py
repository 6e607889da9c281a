"""Exact duplicates by a tree merge of sorted digest runs.

A run is one partition of digests in order, each once, with the best row so far and the number of rows. The first runs
are the input's own partitions. In each round the ``fan_in`` runs that differ only in one digit of their number exchange
slices: a digest moves to the run whose digit there is its own, and the slices that meet in a run are merged, of equal
digests the best row staying. After as many rounds as a run's number has digits each run holds one slice of the digests,
complete and without repeats. As every run is merged before it sends anything, a text that makes up a third of the rows
is one row of each run from the start, and no task ever holds more than its slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm._shared import SPACE, keep, texts

#: The columns that make two rows equal: the digest, and what verifies it.
IDENTITY = ["text_sha256", "verify", "norm_len"]
#: The order in which the best of equal rows comes first.
BEST = ["neg_chars", "no_id", "doc_id", "row_id"]
#: Rows of the input for each run.
RUN_ROWS = 1_000_000


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_id, n_chars and the identity of the normalised text of every row."""
    norm = F.regexp_replace("text", f"{SPACE}+", "")
    return (
        texts(docs, id_col, text_col)
        .select("doc_id", F.length("text").alias("n_chars"), norm.alias("norm"))
        .select(
            "doc_id", "n_chars",
            F.monotonically_increasing_id().alias("row_id"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.xxhash64("norm").alias("verify"),
            F.length("norm").alias("norm_len"),
        )
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of neighbours with one identity the first row, with the sum of n; the last is held until the next batch."""
    held = None
    for b in batches:
        rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not len(rows):
            continue
        same = np.ones(len(rows) - 1, bool)
        for c in IDENTITY:
            x = rows.column(c)
            same &= np.asarray(pc.equal(x.slice(1), x.slice(0, len(rows) - 1)))
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        n = pa.array(np.add.reduceat(np.asarray(rows.column("n")), first))
        out = pa.RecordBatch.from_arrays([n if f.name == "n" else rows.column(f.name).take(pa.array(first)) for f in b.schema], schema=b.schema)
        held = out.slice(len(out) - 1)
        if len(out) > 1:
            yield out.slice(0, len(out) - 1)
    if held is not None:
        yield held


def merge_runs(digests: DataFrame, fan_in: int = 8, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row for each identity: keep_id and keep_row (of the row that stays) and group_size.

    There are fan_in ** rounds runs, as many rounds as leave each run about ``run_rows`` rows, and two at least; the rows
    that come out are the same for any of them."""
    rounds = max(2, math.ceil(math.log(max(digests.count() / run_rows, 1), fan_in)))
    n_runs = fan_in**rounds

    def digit(number: Column, place: int) -> Column:
        return F.floor(number / F.lit(fan_in**place)).cast("int") % fan_in

    def in_order(runs: DataFrame) -> DataFrame:
        columns = [*IDENTITY, *BEST, "n"]
        return runs.select(*columns).sortWithinPartitions(*IDENTITY, *BEST).mapInArrow(_merged, runs.select(*columns).schema)

    place_of = F.pmod(F.conv(F.substring("text_sha256", 1, 12), 16, 10).cast("long"), F.lit(n_runs)).cast("int")
    runs = in_order(digests.select(*IDENTITY, (-F.col("n_chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", F.lit(1).cast("long").alias("n")))
    # a row's run: of the digits that were exchanged its digest's, of the others those of the partition it began in
    runs = runs.withColumn("run", F.spark_partition_id() % n_runs)
    for i in range(rounds):
        here, there = digit(F.col("run"), i), digit(place_of, i)
        moved = runs.withColumn("run", (F.col("run") + (there - here) * F.lit(fan_in**i)).cast("int"))
        runs = in_order(moved.repartitionById(n_runs, "run")).withColumn("run", F.spark_partition_id())
    return runs.select(*IDENTITY, F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, run_rows: int = RUN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting white space; null counts as empty, so null, empty and blank texts
    form one group. Of equal texts the row with the most characters stays, then the smallest doc_id, a null doc_id
    last; of rows repeated with the same doc_id exactly one has kept set. An empty table gives an empty result.
    """
    digests = keep(digest_rows(docs, id_col, text_col), "digests")
    merged = keep(merge_runs(digests, fan_in, run_rows), "merged")
    return digests.join(merged, IDENTITY).select("doc_id", "keep_id", "group_size", (F.col("keep_row") == F.col("row_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns kept; repeated rows are one row afterwards, null and
    empty texts too."""
    rows = exact_dedup(docs, id_col, text_col)
    kept = rows.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.sha2(F.regexp_replace(text, f"{SPACE}+", ""), 256)
    left = docs.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (own == F.col("__sha")), "left_semi")
    # a semi join keeps every row of a doc_id; only where one doc_id has several rows of one text is more to do
    if rows.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        one = left.groupBy(F.col(id_col).alias("__id"), own.alias("__sha")).agg(F.max_by(F.struct(*docs.columns), F.length(text)).alias("__row"))
        left = one.select("__row.*")
    return left
