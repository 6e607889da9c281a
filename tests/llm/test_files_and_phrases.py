"""Token files, collocations and resampling against plain recomputations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import resampling
from wakeline.llm.collocations import mine_phrases
from wakeline.llm.resampling import resample
from wakeline.llm.token_files import FileReader, from_planes, read_tokens, to_planes, tokens_to_files, write_tokens

# --- token files


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    return path, tokenizers.Tokenizer.from_file(path)


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("most", [1, 2, 255, 256, 70_000, 2**32])
def test_planes_come_back(kind, most):
    for n in (0, 1, 7, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint32)
        planes = to_planes(ids, kind)
        assert (from_planes(planes, n, kind) == ids).all()
        assert len(planes) <= max(1, int(most - 1).bit_length())


def expected(rows, encoder):
    """start, n_tokens, crc of each row in the order given."""
    at, out = 0, []
    for text in rows:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_what_the_library_gives(spark, tokenizer):
    rng = random.Random(3)
    odd = ["<|endoftext|>", "a <|startoftext|>b", "é ́e ́", "ΑΣ ΟΔΟΣ", "I'm they'LL 'S", " x y\x1cz", "İ ß ﬁ", "ज़ 각", "a\x00b", "  ", "\n\n a"]
    texts = odd + ["".join(rng.choice("aB é'\t\n1٣中😀.,́ ") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in tokens_to_files(docs, tokenizer[0]).collect())
    assert got == [(i * 3, *x) for i, x in enumerate(expected(texts, tokenizer[1]))]


def test_awkward_rows_are_all_in_the_files(spark, awkward, nothing, tokenizer, tmp_path):
    rows = awkward.select("doc_id", "text").collect()
    got = tokens_to_files(awkward, tokenizer[0]).collect()
    n = {t: x[1:] for t, x in zip([r.text for r in rows], expected([r.text for r in rows], tokenizer[1]), strict=True)}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, *n[r.text]) for r in rows)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order)])[:-1].tolist()
    ids = [r.doc_id for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert tokens_to_files(nothing, tokenizer[0]).count() == 0
    named = awkward.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    assert tokens_to_files(named, tokenizer[0], id_col="name", text_col="body").dtypes[0] == ("doc_id", "string")


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_small_blocks_and_files_give_single_ids(spark, tokenizer, tmp_path, kind):
    texts = [" ".join(f"word{k} and {k * 7}" for k in range(i)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = write_tokens(docs, tokenizer[0], str(tmp_path / "out"), kind=kind, block_ids=64, file_bytes=20_000)
    want = [[*e.ids, 2] for e in tokenizer[1].encode_batch(texts, add_special_tokens=False)]
    got = read_tokens(spark, path).orderBy("file", "place").collect()
    assert [r.doc_id for r in got] == list(range(120)) and [r.ids for r in got] == want
    assert len({r.file for r in got}) > 1
    for part in (tmp_path / "out").glob("part-*"):
        file = FileReader(part.read_bytes())
        for r in got:
            if r.file == file.number:
                assert file.ids(r.first, r.n_tokens).tolist() == r.ids
        assert max(file.chunks.column("n_ids").to_pylist()) == 64
    with pytest.raises(ValueError):
        FileReader(part.read_bytes()[:-5])


def test_a_third_of_all_rows_without_an_id_spreads_over_the_files(spark, tokenizer, tmp_path):
    docs = spark.range(9000, numPartitions=6).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("some words of a text").alias("text"))
    path = write_tokens(docs, tokenizer[0], str(tmp_path / "out"), file_bytes=28 * 900)
    sizes = [r["count"] for r in read_tokens(spark, path).groupBy("file").count().collect()]
    assert sum(sizes) == 9000 and max(sizes) <= 2500


# --- collocations


def phrases(rows, most, least, percent, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, most + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, own in f.items():
        found = []
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            if any(100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items() if len(q) > len(p)):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def talk(seed, n=300, vocabulary=14):
    rng = random.Random(seed)
    words = [f"{'AbÉxß中'[i % 6]}{i}" for i in range(vocabulary)] + ["the", "New", "York", "city"]
    for _ in range(n):
        yield "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " - "]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und"])


@pytest.mark.parametrize(("most", "least", "percent", "first", "bits"), [(3, 10, 50, 2000, None), (3, 3, 30, 40, 16), (4, 2, 80, 2000, 16), (2, 5, 50, 5, None)])
def test_phrases_are_those_of_a_plain_count(spark, most, least, percent, first, bits):
    rows = list(talk(most * least))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = sorted(tuple(r) for r in mine_phrases(docs, most, least, percent, first, bits).collect())
    assert got == phrases(rows, most, least, percent, first) and len(got) > 4


def test_an_overfull_sketch_and_cut_streams_lose_nothing(spark, monkeypatch):
    from wakeline.llm import collocations

    rows = list(talk(9))
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    monkeypatch.setattr(collocations, "STREAM_BYTES", 100)  # on the driver; tasks import their own
    lines = [b for batch in [docs.toArrow().to_batches()[0]] for b in collocations.streams(batch)]
    assert len(lines) > 100
    f = Counter()
    for lang, data in lines:
        starts, ends, firsts, _ = collocations.runs_of(data, lang, 3)
        for n, first in enumerate(firsts, 1):
            f.update((lang, x) for x in collocations._phrases(data, starts, ends, first, first + n - 1).to_pylist())
    assert f[("en", "new york")] == sum(
        len(re.findall(r"(?<![^ \t.,\n])new[ \t]+york(?![^ \t.,\n])", t.lower())) for t, lang in rows if lang == "en"
    ) > 0
    frequent = collocations.frequent_cells(docs, 3, 3, 16)
    for (lang, phrase), n in f.items():
        if n >= 3:
            *_, hashes = collocations.runs_of(np.frombuffer(phrase.encode(), np.uint8), lang, 3)
            for d in range(collocations.DEPTH):
                cell = int(collocations.cells(hashes[phrase.count(" ")][:1], d, 16)[0])
                assert frequent[d][cell >> 3] >> (7 - cell % 8) & 1


def test_phrases_of_awkward_rows(spark, awkward, nothing):
    rows = [(r.text, r.lang) for r in awkward.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in mine_phrases(awkward, least=3).collect()) == phrases(rows, 3, 3, 50, 2000)
    assert mine_phrases(nothing).count() == 0


def test_the_best_of_a_language_with_a_third_of_all_phrases(spark, monkeypatch):
    from wakeline.llm import collocations

    rows = list(talk(21))
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "RANKED_ROWS", 20)
    assert sorted(tuple(r) for r in mine_phrases(docs, least=3, first=30).collect()) == phrases(rows, 3, 3, 50, 30)


# --- resampling


def drawn(rows, target, most=2, buckets=10_000, percent=25, least=20, seed="7"):
    def features(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    found = [features(t) for _, t in rows]
    s, t = Counter(b for _, x in found for b in x), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for (i, _), (n, x) in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((k for k in range(len(out)) if out[k][4] >= least), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    rank = {k: r for r, k in enumerate(order[: percent * len(order) // 100], 1)}
    return [(*x[:4], rank.get(k)) for k, x in enumerate(out)]


def some_texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "x1", "的"]) + str(rng.randrange(40)) for _ in range(rng.randrange(60))) + rng.choice(["", "!", " ."]) for _ in range(n)]


@pytest.mark.parametrize(("most", "buckets", "percent"), [(2, 10_000, 25), (1, 50, 60), (3, 997, 100)])
def test_draws_are_those_of_a_plain_count(spark, monkeypatch, most, buckets, percent):
    monkeypatch.setattr(resampling, "DOCS_PER_RANGE", 10)
    rows, target = list(enumerate(some_texts(most, 200))), some_texts(7, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), most, buckets, percent)
    assert sorted(tuple(r) for r in got.collect()) == drawn(rows, target, most, buckets, percent)


def test_ranks_over_many_ranges_are_one_row_of_numbers(spark):
    docs = spark.range(5000, numPartitions=4).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("x"), F.col("id").alias("y"))
    got = resampling.ranked(docs, [F.col("x").desc_nulls_last(), F.col("y")], "rank", docs_per_range=300).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    keys = [(r.x is None, -(r.x or 0), r.y) for r in got]
    assert keys == sorted(keys)


def test_draws_of_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    target = [r.text for r in awkward.select("text").limit(7).collect()] + [None]
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    got, want = resample(awkward, aims, percent=50, least_words=5).collect(), drawn(rows, target, percent=50, least=5)
    free = lambda all_rows: Counter(tuple(r)[:4] for r in all_rows)
    assert free(got) == free(want) and sorted(r.rank for r in got if r.rank) == list(range(1, sum(x[4] is not None for x in want) + 1))
    assert sorted((r.rank, r.score) for r in got if r.rank) == sorted((x[4], x[3]) for x in want if x[4])
    assert resample(nothing, aims).count() == 0
    assert {r.rank for r in resample(awkward, aims.limit(0), percent=50, least_words=5).collect()} > {None}
