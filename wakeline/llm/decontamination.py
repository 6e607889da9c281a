"""Benchmark decontamination by winnowing, in DataFrame operations only.

With windows of ``window`` words and k-grams of k = ``gram`` words, each window has window - k + 1 k-grams, and its
fingerprint is the smallest of their hashes. Equal windows have equal fingerprints, so every shared span of at least
``window`` words is found, and a document keeps few distinct fingerprints. The fingerprints of documents and benchmark
are joined; in the documents that have hits, the windows with these fingerprints alone are compared, word by word,
with the benchmark's windows, and all words that equal windows cover are hit. Items of fewer words are windows of
their own: for each such length that the benchmark has, a document's windows of that length are fingerprints, too.

Fingerprints and comparison both lower-case A-Z alone, so equal words have equal hashes. Full lower-casing depends on a
word's neighbours (a capital sigma's form does, across dots and apostrophes) and would part equal words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm._shared import ROW, keep, near_keys, same_row, text_hashes, texts, with_row_key

#: What separates words: ASCII other than digits and letters (applied to text with A-Z in lower case).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The benchmark's side of a join is broadcast up to this many bytes; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text whose A-Z are in lower case."""
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; where a text is ASCII, the faster function does the same."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def _places(n: Column) -> Column:
    """1 to n, or nothing for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def prints_of(rows: DataFrame, window: int, gram: int, short: list[int] = []) -> DataFrame:  # noqa: B006
    """rows with column prints for column h, the hashes of the words: for each length, first ``window``, then the short
    ones, an array of its windows' prints in turn.

    A window's print is the smallest hash of its k-grams, that of a short one the hash of its words. Each step is a
    column of its own, as an expression used within a lambda would be evaluated for every element.
    """
    carry = [c for c in rows.columns if c != "h"]
    grams = F.transform(_places(F.size("h") - (gram - 1)), lambda i: F.xxhash64(F.slice("h", i, gram)))
    of_windows = F.transform(_places(F.size("grams") - (window - gram)), lambda i: F.array_min(F.slice("grams", i, window - gram + 1)))

    def of_length(n: int) -> Column:
        """Windows of n words; a function of its own, as Spark gives further parameters of a lambda a meaning."""
        return F.transform(_places(F.size("h") - (n - 1)), lambda i: F.xxhash64(F.slice("h", i, n), F.lit(n)))

    return rows.select("*", grams.alias("grams")).select(*carry, F.array(of_windows, *(of_length(n) for n in short)).alias("prints"))


def _placed(prints: Column, lengths: list[int]) -> Column:
    """The prints of all lengths as structs (print, at, len), at from 1."""

    def of_length(k: int, n: int) -> Column:
        return F.transform(prints[k], lambda p, i: F.struct(p.alias("print"), (i + 1).alias("at"), F.lit(n).alias("len")))

    return F.concat(*(of_length(k, n) for k, n in enumerate(lengths)))


def _with_size_check(side: DataFrame, size: Column) -> DataFrame:
    """side, to be broadcast if its rows of ``size`` bytes are small together."""
    total = side.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(side) if total <= BROADCAST_BYTES else side


def benchmark_windows(benchmark: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, len, print, words: every distinct window of every item; an item of fewer words is one window."""
    words = benchmark.select(F.col(id_col).alias("item_id"), words_of(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).alias("w"))
    hashed = words.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    whole = prints_of(hashed.where(F.size("w") >= window), window, gram)
    long = whole.select("item_id", "w", F.explode(_placed(F.col("prints"), [window])).alias("p")).select(
        "item_id", "p.len", "p.print", F.expr("slice(w, p.at, p.len)").alias("words")
    )
    short = hashed.where(F.size("w").between(1, window - 1)).select(
        "item_id", F.size("w").alias("len"), F.xxhash64("h", F.size("h")).alias("print"), F.col("w").alias("words")
    )
    return long.unionByName(short).distinct()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits; a null or empty item has no window. Items with a null id count as
    none. Of rows with the same doc_id, each is judged by its own words. An empty benchmark hits nothing, and an
    empty table of documents gives an empty result.
    """
    rows = with_row_key(texts(docs, id_col, text_col))
    found = _found(rows, benchmark, window, gram, item_id_col, item_text_col)
    sized = rows.select(*ROW, F.size(words_of(ascii_lower(F.col("text")))).cast("long").alias("n_words"))
    return sized.join(found, same_row("f_"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _found(rows: DataFrame, benchmark: DataFrame, window: int, gram: int, item_id_col: str, item_text_col: str) -> DataFrame:
    """ROW (with f_ before the names), n_hit, n_items, items_sha256 for the keys of contaminated rows."""
    windows = keep(benchmark_windows(benchmark.where(F.col(item_id_col).isNotNull()), window, gram, item_id_col, item_text_col), "windows")
    short = sorted(r["len"] for r in windows.where(F.col("len") < window).select("len").distinct().collect())
    lengths = [window, *short]

    known = _with_size_check(windows.select("print").distinct(), F.lit(8))
    loose = rows.select(*ROW, F.transform(words_of(ascii_lower(F.col("text"))), lambda x: F.xxhash64(x)).alias("h"))
    hits = keep(
        prints_of(loose, window, gram, short)
        .select(*ROW, F.explode(F.array_distinct(F.flatten("prints"))).alias("print"))
        .join(known, "print", "left_semi")
        .groupBy(*(F.col(c).alias(f"h_{c}") for c in ROW)).agg(F.collect_set("print").alias("hit_prints")),
        "hits",
    )
    # texts are shuffled only where they have hits, but for the few that share the last bits of a hash
    near = near_keys(rows, F.col("text_a"), hits.select("h_text_a")).join(hits, same_row("h_"))
    words = near.select(*ROW, "hit_prints", words_of(ascii_lower(F.col("text"))).alias("w"))
    judged = (
        prints_of(words.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))), window, gram, short)
        .select(*ROW, "w", F.filter(_placed(F.col("prints"), lengths), lambda s: F.array_contains("hit_prints", s["print"])).alias("near"))
        .select(*ROW, F.explode(F.transform("near", lambda s: F.struct(s["print"].alias("print"), s["at"].alias("at"), s["len"].alias("len"), F.slice("w", s["at"], s["len"]).alias("words")))).alias("f"))
    )
    items = windows.select("item_id", F.col("print").alias("i_print"), F.col("words").alias("i_words"))
    items = _with_size_check(items, F.octet_length(F.array_join("i_words", "")) + 8 * F.size("i_words") + F.octet_length(F.col("item_id").cast("string")) + 16)
    same = (F.col("f.print") == F.col("i_print")) & (F.col("f.words") == F.col("i_words"))
    return (
        judged.join(items, same)
        .groupBy(*(F.col(c).alias(f"f_{c}") for c in ROW))
        .agg(F.collect_set(F.struct("f.at", "f.len")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select(
            *(f"f_{c}" for c in ROW),
            F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))).cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated documents, all columns kept; of rows with one doc_id, or none, only those go whose text
    is contaminated."""
    bad = _found(with_row_key(texts(docs, id_col, text_col)), benchmark, window, gram, "item_id", "text").select(*(F.col(f"f_{c}").alias(f"__{c}") for c in ROW))
    a, b = text_hashes(F.col(text_col))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__doc_id")) & (a == F.col("__text_a")) & (b == F.col("__text_b")), "left_anti")
