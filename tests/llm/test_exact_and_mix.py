import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wakeline.llm.exact_dedup import drop_exact_copies, exact_dedup, merge_runs, digest_rows
from wakeline.llm.mixing import mix_sources


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_of_awkward_rows(awkward):
    rows = awkward.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r)
    got = exact_dedup(awkward).collect()
    assert len(got) == len(rows)
    by_sha = {}
    for r in got:
        by_sha.setdefault(r.text_sha256, []).append(r)
    assert len(by_sha) == len(groups)
    for text, members in groups.items():
        found = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert {r.keep_id for r in found} == {best.doc_id} and {r.group_size for r in found} == {len(members)}
        assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in members)
        assert sum(r.kept for r in found) == 1


@pytest.mark.parametrize(("fan_in", "run_rows"), [(2, 20), (2, 2), (3, 3), (8, 1)])
def test_runs_of_any_shape_agree(awkward, fan_in, run_rows):
    of = lambda d: sorted(map(tuple, d.drop("keep_row").collect()), key=str)
    digests = digest_rows(awkward)
    assert of(merge_runs(digests, fan_in, run_rows)) == of(merge_runs(digests))


def test_runs_are_merged_in_small_batches(spark):
    docs = spark.range(3000, numPartitions=7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise((F.col("id") % 500).cast("string")).alias("text"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = merge_runs(digest_rows(docs), 2, 1000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    groups = {}
    for i in range(3000):
        groups.setdefault("x" if i % 3 == 0 else str(i % 500), []).append(i)
    assert sorted((r.text_sha256, r.keep_id, r.group_size) for r in got) == sorted((hashlib.sha256(t.encode()).hexdigest(), min(i), len(i)) for t, i in groups.items())


def test_dropping_copies_keeps_columns_and_one_row_each(awkward, nothing):
    left = drop_exact_copies(awkward)
    assert left.columns == awkward.columns and left.count() == len({norm(r.text) for r in awkward.collect()})
    assert exact_dedup(nothing).count() == 0 and drop_exact_copies(nothing).count() == 0


def test_repeated_rows_without_a_text_stay_as_they_are(spark):
    rows = [(1, None, "en"), (1, None, "en"), (None, "", "fr"), (2, "a b", "en"), (2, "a  b", "de"), (2, "a  b", "de"), (3, "ab", None)]
    left = drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, None, "en"), (2, "a  b", "de")], key=str)


def test_mix_of_awkward_rows(awkward, nothing):
    rows = mix_sources(awkward).collect()
    assert len(rows) == awkward.count() and mix_sources(nothing).count() == 0
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert sorted(map(tuple, mix_sources(awkward).collect()), key=str) == sorted(map(tuple, rows), key=str)
    by_source = {r.source_size: r.target for r in rows}
    for size, target in by_source.items():
        assert abs(sum(r.taken for r in rows if r.source_size == size) - target) <= 1


def shared_out(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
        if not free:
            return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 50}, {"x": 0, "y": 30}, {"é": 5, "z": 5, "Z": 5, "a": 400, None: 1}])
def test_targets_against_a_loop(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(spark.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, source string"), "doc_id").collect()}
    want = shared_out(sizes)
    assert all(abs(got[s].target - want[s]) < 1e-6 for s in sizes)


def test_taken_words_are_exact_over_many_ranges(spark):
    from wakeline.llm import mixing

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    old, mixing.DOCS_PER_RANGE = mixing.DOCS_PER_RANGE, 10
    try:
        rows = mix_sources(docs).collect()
    finally:
        mixing.DOCS_PER_RANGE = old
    for size in {r.source_size for r in rows}:
        mine = [r for r in rows if r.source_size == size]
        assert sum(r.taken for r in mine) == int(mine[0].target)
