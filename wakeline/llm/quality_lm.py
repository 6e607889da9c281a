"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

An n-gram of up to five characters is one 64-bit number, the last character lowest, so its context and its ending are
shifts and masks. Trusted texts are counted within each task first; counts of all orders then meet their contexts and
shorter n-grams in joins that Spark shards by n-gram. The model is a table of what each n-gram adds to the logarithm of
a character's probability, as the last one (gain) and as what stands before it (weight), so a text's logarithm is a sum
of look-ups, each on its own.

Each text's n-grams are counted and joined to this table, sharded by n-gram. Two things keep that join small, at every
size alike: n-grams that are more than ``hot_share`` of all are added up before anything is sent, so no very frequent key
is left in the join and its rows grow with the text, and n-grams that are surely in no row of the table, by a bitmap of fixed size, are not sent. Each text's
perplexity is compared with a quantile of the trusted texts' perplexities in its own language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm._bytes import mix
from wakeline.llm._shared import keep, near_keys

ORDER, BITS = 5, 12
START = 0
#: Least share of an order's occurrences for a row of the model that every task gets, at most ORDER / HOT_SHARE rows of 24
#: bytes, whatever the data; bits of the bitmap of all the others.
HOT_SHARE, MAP_BITS = 1 / 3_000_000, 26
#: Characters worked on at a time; distinct n-grams that a task holds before it sends them.
PIECE_CHARS, HELD = 1 << 20, 2_000_000
_MASK = [np.uint64((1 << BITS * k) - 1) for k in range(ORDER + 1)]
#: Where an n-gram's order stands in its key.
_ORDER_AT = BITS * ORDER


def codes_of(text: str) -> np.ndarray:
    """A code of 12 bits for each character: its number below 2048, else a hash from 2048 on; any control or white space
    character is a blank."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.where(c < 2048, np.maximum(c, 32), 2048 + (mix(c) & np.uint64(2047)))


def _grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, n-grams of full order that end at each character, offsets by text) for pieces of the texts."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE_CHARS):
            size += len(texts[j])
            j += 1
        lengths = np.array([len(t) for t in texts[i:j]])
        at = np.concatenate([[0], np.cumsum(lengths)])
        place = np.arange(size) + np.repeat(np.arange(1, j - i + 1) * (ORDER - 1), lengths)
        code = np.full(size + (j - i) * (ORDER - 1), START, np.uint64)
        code[place] = codes_of("".join(texts[i:j]))
        gram = np.zeros(size, np.uint64)
        for k in range(ORDER):
            gram |= code[place - k] << np.uint64(BITS * k)
        yield i, j, gram, at
        i = j


def count_grams(texts: DataFrame) -> DataFrame:
    """gram, n of full order for a column text, added up within each task before they are sent."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        for b in batches:
            for _, _, gram, _ in _grams(b.column(0).to_pylist()):
                held.append(np.unique(gram, return_counts=True))
            if held:
                held = [merged()]
            if held and len(held[0][0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["gram", "n"])
                held = []
        if held:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])

    return texts.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _key(k: int, gram: Column) -> Column:
    return gram.bitwiseOR(F.lit(k << _ORDER_AT))


def train(trusted: DataFrame) -> tuple[DataFrame, float] | None:
    """The model for the texts of a column text: rows (key, gain, weight, heat), and the logarithm of the probability of
    a character never seen; None without a text. key is an n-gram with its order. gain: what an n-gram that occurs adds
    to the logarithm that its contexts' weights and its shorter endings give. weight: the logarithm of the weight that
    it, as a context, gives to shorter ones. heat: how often it occurs."""
    mask = lambda k: F.lit((1 << BITS * k) - 1).cast("long")
    counts = {ORDER: keep(count_grams(trusted), "grams")}
    if not counts[ORDER].limit(1).count():
        return None
    for k in range(ORDER - 1, 0, -1):  # the number of different characters before it
        counts[k] = counts[k + 1].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count("*").alias("n"))
    found, rows, rest = None, None, 0.0
    for k in range(1, ORDER + 1):
        n1, n2, n3, n4, kinds = counts[k].agg(*[F.coalesce(F.sum((F.col("n") == i).cast("int")), F.lit(0)) for i in (1, 2, 3, 4)], F.count("*")).first()
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a and b else i * 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        # a context's key: the characters before the last
        keyed = counts[k].withColumn("context", F.shiftrightunsigned("gram", BITS)).withColumn("discount", discount)
        contexts = keep(keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum("discount").alias("given")), "contexts")
        share = (F.col("n") - F.col("discount")) / F.col("total")
        gamma = F.col("given") / F.col("total")
        joined = keyed.join(contexts, "context")
        if k == 1:
            total, given = contexts.select("total", "given").first()  # one row: the empty context
            rest = float(np.log(given / total / (kinds + 1)))
            now = joined.select("gram", (share + gamma / (kinds + 1)).alias("p")).withColumn("gain", F.log("p") - rest)
        else:
            shorter = found.select(F.col("gram").alias("shorter"), F.col("p").alias("p_shorter"))
            now = joined.withColumn("shorter", F.col("gram").bitwiseAND(mask(k - 1))).join(shorter, "shorter").select(
                "gram", (share + gamma * F.col("p_shorter")).alias("p"), (F.log(share + gamma * F.col("p_shorter")) - F.log(gamma * F.col("p_shorter"))).alias("gain")
            )
            weights = contexts.select(_key(k - 1, F.col("context")).alias("key"), F.lit(0.0).alias("gain"), F.log(gamma).alias("weight"), F.lit(0).cast("long").alias("heat"))
            rows = rows.unionByName(weights)
        found = keep(now, f"order{k}")
        heat = counts[ORDER].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.sum("n").alias("heat"))
        gains = found.join(heat, "gram").select(_key(k, F.col("gram")).alias("key"), "gain", F.lit(0.0).alias("weight"), "heat")
        rows = gains if rows is None else rows.unionByName(gains)
    return keep(rows.groupBy("key").agg(F.sum("gain").alias("gain"), F.sum("weight").alias("weight"), F.sum("heat").alias("heat")), "model"), rest


def _bit(key, bits: int):
    """The place of a key in the bitmap, for columns and arrays alike."""
    if isinstance(key, Column):
        return key.bitwiseXOR(F.shiftrightunsigned(key, 23)).bitwiseXOR(F.shiftrightunsigned(key, 41)).bitwiseAND(F.lit((1 << bits) - 1))
    return (key ^ (key >> np.uint64(23)) ^ (key >> np.uint64(41))) & np.uint64((1 << bits) - 1)


def _shared_parts(model: DataFrame, hot_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, gains, weights) of the most frequent rows, sorted by key, and the bitmap of the others: at most
    ORDER / ``hot_share`` rows and 2 ** MAP_BITS bits come to the driver, as the heats of an order add up to all characters."""
    cut = hot_share * model.agg(F.sum("heat")).first()[0] / ORDER
    got = model.where(F.col("heat") >= cut).select("key", "gain", "weight").toArrow().sort_by("key")
    hot = [got.column(c).to_numpy() for c in ("key", "gain", "weight")]
    bit = _bit(F.col("key"), MAP_BITS)
    size = 1 << 15
    marks = model.where(F.col("heat") < cut).groupBy(F.floor(bit / size).alias("page")).agg(F.bitmap_construct_agg(bit % size).alias("bits"))
    bitmap = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in marks.toLocalIterator():
        bitmap[r.page * size // 8 : (r.page + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return hot[0].view(np.uint64), hot[1], hot[2], bitmap


def score(rows: DataFrame, model: DataFrame, rest: float, hot_share: float = HOT_SHARE) -> DataFrame:
    """row, logp, n, least_b, most_b for the texts of rows (row, row_b, text), row and row_b two hashes that tell them apart:
    the sum of the logarithms of all characters, and their number. row alone is sent with every n-gram; where different
    texts share it, least_b and most_b differ and the sum is that of all of them."""
    names_out = ["row", "row_b", "key", "last", "before", "logp", "n"]
    shared = rows.sparkSession.sparkContext.broadcast(_shared_parts(model, hot_share))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, gains, weights, bitmap = shared.value
        for b in batches:
            row, row_b = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, gram, at in _grams(b.column(2).to_pylist()):
                names, place = np.unique(gram, return_inverse=True)
                value = np.full(len(names), rest)
                open_ = []  # (n-gram's number, key, whether as a context) of what is not among the hot rows
                for k in range(1, ORDER + 1):
                    for before in (False, True) if k < ORDER else (False,):
                        keys = ((names >> np.uint64(BITS)) if before else names) & _MASK[k] | np.uint64(k << _ORDER_AT)
                        spot = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
                        hit = hot[spot] == keys if len(hot) else np.zeros(len(keys), bool)
                        value[hit] += (weights if before else gains)[spot[hit]]
                        bit = _bit(keys, MAP_BITS)
                        left = np.flatnonzero(~hit & ((bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0))
                        open_.append((left, keys[left], before))
                sums = np.concatenate([[0], np.cumsum(value[place])])
                n = np.diff(at)
                zero = np.zeros(j - i, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row[i:j]), pa.array(row_b[i:j]), pa.array(row[i:j]), pa.array(zero), pa.array(zero), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(n)], names_out)
                if any(len(x) for x, _, _ in open_):
                    yield from _to_join(row[i:j], place, np.repeat(np.arange(j - i), n), open_, len(names))

    def _to_join(row: np.ndarray, place: np.ndarray, text: np.ndarray, open_: list, n_names: int) -> Iterator[pa.RecordBatch]:
        """The keys of each text that are to be joined, each once."""
        for left, keys, before in open_:
            number = np.full(n_names, -1)
            number[left] = np.arange(len(left))
            use = np.flatnonzero(number[place] >= 0)
            if not len(use):
                continue
            distinct, spot = np.unique(keys, return_inverse=True)
            pair, times = np.unique(text[use] * len(distinct) + spot[number[place[use]]], return_counts=True)
            times, none = times.astype(np.int32), np.zeros(len(pair), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[pair // len(distinct)]), pa.nulls(len(pair), pa.int64()), pa.array(distinct[pair % len(distinct)].view(np.int64)), pa.array(none if before else times), pa.array(times if before else none), pa.array(np.zeros(len(pair))), pa.array(np.zeros(len(pair), np.int64))],
                names_out,
            )

    asked = rows.select("row", "row_b", "text").mapInArrow(counted, "row long, row_b long, key long, last int, before int, logp double, n long")
    # a text's own sum has the row as its key and counts nothing there
    found = asked.join(model.select("key", "gain", "weight").hint("shuffle_hash"), "key", "left")
    added = F.col("logp") + F.col("last") * F.coalesce("gain", F.lit(0.0)) + F.col("before") * F.coalesce("weight", F.lit(0.0))
    return found.groupBy("row").agg(F.sum(added).alias("logp"), F.sum("n").alias("n"), F.min("row_b").alias("least_b"), F.max("row_b").alias("most_b"))


def perplexities(rows: DataFrame, model: DataFrame, rest: float, hot_share: float = HOT_SHARE, bits: int = 64) -> DataFrame:
    """doc_id, lang, perplexity of rows (doc_id, lang, text), null for an empty text.

    Rows alike in id and text share their sums, which leaves their mean. Texts are told apart by a hash of ``bits`` bits; the
    few that share one with another text, as a second hash tells, are taken once more by other hashes, until none do."""
    parts, turn = [], 0
    while True:
        row, row_b = (F.xxhash64(F.lit(2 * turn + k), F.col("doc_id"), F.col("text")) for k in (0, 1))
        hashed = rows.withColumns({"row": F.shiftrightunsigned(row, 64 - bits) if bits < 64 else row, "row_b": row_b})
        sums = keep(score(hashed.select("row", "row_b", "text"), model, rest, hot_share), "sums")
        same = F.col("least_b") == F.col("most_b")
        found = hashed.select("doc_id", "lang", "row").join(sums.where(same), "row")
        parts.append(found.select("doc_id", "lang", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))).alias("perplexity")))
        shared = sums.where(~same).select("row")
        if not shared.limit(1).count():
            break
        rows, turn = keep(hashed.join(shared, "row", "left_semi").select("doc_id", "lang", "text"), "shared"), turn + 1
    return reduce(DataFrame.unionByName, parts)


def classify_quality(
    docs: DataFrame, labels: DataFrame, quantile: float = 0.99, hot_share: float = HOT_SHARE,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trust_col: str = "quality",
) -> DataFrame:
    """Per row of docs: doc_id, perplexity, threshold, keep.

    Trusted are the rows that a label has trust_col 1 for; one in five of them, by a hash of the id, does not train the
    model but sets the thresholds. A row is kept if its perplexity is at most its language's threshold, the quantile of
    these rows in that language; a language without any takes the quantile of all of them. A null or empty text has no
    perplexity and is not kept; a null language is a language of its own; without trusted rows nothing has a perplexity
    and nothing is kept. Rows with the same doc_id are judged each for itself; control characters count as blanks, and
    characters from number 2048 on share 2048 codes. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    trusted_ids = labels.where(F.col(trust_col) == 1).select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    sets_limit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(5)) == 0
    teachers = keep(trusted_ids.where(~sets_limit), "teachers")
    # texts are shuffled to their labels only where there may be one
    near = near_keys(rows.where("text != '' and doc_id is not null"), F.xxhash64("doc_id"), teachers.select(F.xxhash64("doc_id")))
    made = train(near.hint("merge").join(teachers, "doc_id", "left_semi").select("text"))
    scored = perplexities(rows, *made, hot_share) if made else rows.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"))
    scored = keep(scored, "perplexities")
    judged = scored.join(trusted_ids.where(sets_limit), "doc_id", "left_semi").where("perplexity is not null")
    limits = judged.groupBy(F.col("lang").alias("t_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    overall = judged.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("overall"))
    return (
        scored.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")), "left").join(F.broadcast(overall))
        .select("doc_id", "perplexity", F.coalesce("own", "overall").alias("threshold"))
        .withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
    )
