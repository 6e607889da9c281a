"""The pipeline, stage by stage, against brute force on its own input."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from tests.llm.test_exact_and_mix import norm, shared_out
    from tests.llm.test_spans import classes, contamination, words

    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(15, 60))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=15))) for i in range(4)]
    texts += [texts[i] + "  \n" for i in range(10)] + [t + " more" for t in texts[20:26]] + [texts[30] + " " + items[0][1].upper(), "1 2 3", "", None]
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/out/{name}"))
        docs = seen[name][1]
    ids = lambda df: {r.doc_id for r in df.collect()}
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == before.columns, name
    assert ids(seen["language_id"][1]) == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    before, after = seen["exact_dedup"]
    best = {}
    for r in before.collect():
        key = norm(r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert ids(after) == {i for _, i in best.values()}
    before, after = seen["jaccard_join"]
    assert ids(after) == {c for _, c, _, _ in classes([(r.doc_id, r.text) for r in before.collect()])}
    before, after = seen["benchmark_decontamination"]
    found = {r[0] for r in contamination([(r.doc_id, r.text) for r in before.collect()], items) if r[-1]}
    assert found and ids(after) == ids(before) - found
    before, after = seen["mix_sources"]
    size = {}
    for r in before.collect():
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    want = shared_out(size)
    source = {r.doc_id: r.source for r in before.collect()}
    got = after.collect()
    assert len(got) == before.count() and all(abs(r.target - want[source[r.doc_id]]) < 1e-6 for r in got)
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, got))


def test_texts_of_no_sure_language_go(spark):
    from pathlib import Path

    from wakeline.llm.language_id import identify

    data = "/root/testdata/sf0.01"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sure = {r.doc_id: r.lang_pred != "und" and r.score >= 0.5 for r in identify(docs).collect()}
    kept = {r.doc_id for r in pipeline.language(spark, docs, data).select("doc_id").collect()}
    assert kept == {i for i, x in sure.items() if x} and 0 < len(sure) - len(kept) < len(sure) / 100
