"""Substrings, benchmark windows and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wakeline.llm import jaccard_join
from wakeline.llm.decontamination import drop_contaminated, find_contamination
from wakeline.llm.jaccard_join import jaccard_classes, keep_one_of_each, least_matches
from wakeline.llm.substring_dedup import remove_repeats, run_lengths


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def repeats(rows, window):
    seen = Counter(tuple(w[i : i + window]) for w in map(words, rows) for i in range(len(w) - window + 1))
    for t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def same_rows(got, rows, want):
    mine = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert mine == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in zip(rows, want, strict=True))


@pytest.mark.parametrize("window", [2, 5, 35])
def test_repeats_in_random_texts(spark, window):
    rng = random.Random(window)
    passages = [[str(rng.randrange(6 if window < 6 else 1000)) for _ in range(rng.randrange(1, 3 * window))] for _ in range(12)]
    texts = [" ".join(x for p in rng.choices(passages, k=rng.randrange(0, 6)) for x in p[rng.randrange(3) : len(p) - rng.randrange(3)]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same_rows(remove_repeats(docs, window).collect(), range(60), repeats(texts, window))


def test_repeats_of_awkward_rows(awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    same_rows(remove_repeats(awkward).collect(), [r.doc_id for r in rows], repeats([r.text for r in rows], 35))
    assert remove_repeats(nothing).count() == 0


def test_only_repeated_words_go_from_very_many_rows_without_an_id(spark):
    n = 200_000
    passage = " ".join(f"p{i}" for i in range(36))
    docs = spark.range(n, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(passage), F.lit(" own"), F.col("id").cast("string"), F.lit(" end")).alias("text"))
    got = remove_repeats(docs).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(r) for r in got] == [(38, 36, n)]


def test_levels_double_within_the_window():
    for window in range(1, 200):
        lengths = run_lengths(window)
        assert lengths[0] <= max(1, window // 8 + 1) and all(b == 2 * a for a, b in zip(lengths, lengths[1:])) and lengths[-1] <= window
    assert run_lengths(35) == [5, 10, 20]


def item_words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k : k + n])].add(i)
    for i, t in docs:
        w = item_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        names = ",".join(sorted(map(str, found)))
        yield i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def test_contamination_with_short_items_case_and_overlaps(spark, awkward, nothing):
    rng = random.Random(2)
    vocabulary = ["the", "of", "İstanbul", "É", "é", "a1", "K", "k", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([25, 12, 10, 9, 3, 1, 0, 14])]
    items += [(10, None), (11, "one two, three FOUR five six seven eight nine ten"), (12, "ünïcode ß words 中文"), (13, "Ünïcode ß words 中文")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(40)) + (items[i % 8][1].upper() if i % 3 else items[i % 8][1]).split() + ["end"])) for i in range(60)]
    docs += [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert Counter(map(tuple, got)) == Counter(contamination(docs, items))
    assert sum(r.contaminated for r in got) > 20
    assert find_contamination(nothing, bench).count() == 0
    assert not any(r.contaminated for r in find_contamination(awkward, bench.limit(0)).collect())
    left = drop_contaminated(awkward, bench)
    assert left.columns == awkward.columns


def test_short_items_are_found_wherever_they_stand(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "c"), (3, "x y z C d c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "c"), (2, "c d")], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.n_items) for r in find_contamination(docs, items).collect()} == {1: (2, 2), 2: (1, 1), 3: (3, 2)}


def test_words_whose_lower_case_depends_on_their_neighbours(spark):
    words = "Ε.Σ. ΔΕΗΣ.Α ΟΔΟΣ'Α Σ.Σ:Σ ΑΣ ΣΑΣ.Σ Α'Σ ΤΟΥΣ.Β ΜΕΣ:Γ ΛΑΟΣ.Δ"
    docs = [(1, f"ΑΡΧΗ {words} ΤΕΛΟΣ"), (2, words.replace(".", " ").replace(":", " - ").replace("'", "")), (3, words.lower()), (4, "Σ.Α Β")]
    items = [(1, words), (2, "Σ Α")]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(contamination(docs, items))
    assert {r.doc_id: r.contaminated for r in got}[1] and {r.doc_id: r.contaminated for r in got}[4]


def test_clean_rows_stay_beside_contaminated_ones_of_the_same_id(spark):
    leak = "one two three four five six seven eight nine ten"
    docs = [(None, leak), (None, "clean without an id"), (None, None), (7, f"and {leak} more"), (7, "clean with the id of a leak"), (7, ""), (8, leak), (9, "clean")]
    left = drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert Counter(map(tuple, left.collect())) == Counter(d for d in docs if leak not in (d[1] or ""))


def test_rows_without_an_id_are_judged_each_by_its_own_words(spark):
    leak = "one two three four five six seven eight nine ten"
    n = 5000
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit(leak + " x"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("clean x"), F.col("id").cast("string"))).alias("text"))
    got = find_contamination(docs, spark.createDataFrame([(1, leak)], "item_id long, text string")).groupBy("n_words", "n_hit", "contaminated").count().collect()
    assert sorted(map(tuple, got)) == [(2, 0, False, n * 9 // 10), (11, 10, True, n // 10)]


def test_shuffled_and_broadcast_benchmarks_agree(spark, monkeypatch):
    rng = random.Random(8)
    items = spark.createDataFrame([(i, " ".join(rng.choices("abcdef", k=14))) for i in range(20)] + [(99, "z z")], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefz", k=60))) for i in range(50)] + [(50 + i, r.text) for i, r in enumerate(items.collect())], "doc_id long, text string")
    want = sorted(map(tuple, find_contamination(docs, items).collect()))
    monkeypatch.setattr("wakeline.llm.decontamination.BROADCAST_BYTES", -1)
    assert sorted(map(tuple, find_contamination(docs, items).collect())) == want


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        name = min((rows[i][0] is None, rows[i][0] or 0) for i in members)
        out += [(rows[i][0], None if name[0] else name[1], links[i], len(members)) for i in members]
    return Counter(out)


def near(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = str(rng.randrange(10**6))
    return w


@pytest.mark.parametrize("block", [3, 512])
def test_classes_against_all_pairs(spark, awkward, block):
    rng = random.Random(block)
    base = [[str(rng.randrange(500)) for _ in range(rng.randrange(20, 200))] for _ in range(8)]
    texts = [near(rng, rng.choice(base), rng.randrange(0, 6)) for _ in range(120)] + [near(rng, base[0], 1) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(r.doc_id if r.doc_id is None else r.doc_id + 1000, r.text) for r in awkward.select("doc_id", "text").collect()]
    old, jaccard_join.BLOCK = jaccard_join.BLOCK, block
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = jaccard_classes(docs).collect()
        left = keep_one_of_each(docs)
        n_left = left.count()
    finally:
        jaccard_join.BLOCK = old
    assert Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got) == classes(rows)
    empty = [i for i, t in rows if not words(t)]  # of these, rows repeated with one id and text are one afterwards
    assert n_left == sum(r.kept for r in got) - (len(empty) - len(set(map(str, [(i, t or "") for i, t in rows if not words(t)])))) and left.columns == docs.columns


def test_no_rows_no_classes(nothing):
    assert jaccard_classes(nothing).count() == 0 and keep_one_of_each(nothing).count() == 0


def test_posterior_bound_grows_with_the_values():
    least = least_matches(0.8, 1e-5)
    assert all(0 <= least[n] < 0.8 * n for n in least) and sorted(least.values()) == list(least.values())
