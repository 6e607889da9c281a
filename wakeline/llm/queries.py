"""The queries of these operators, with production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm._shared import table
from wakeline.llm.collocations import mine_phrases
from wakeline.llm.decontamination import find_contamination
from wakeline.llm.exact_dedup import exact_dedup
from wakeline.llm.jaccard_join import jaccard_classes
from wakeline.llm.language_id import identify
from wakeline.llm.mixing import mix_sources
from wakeline.llm.quality_lm import classify_quality
from wakeline.llm.resampling import resample
from wakeline.llm.secret_scan import scan_secrets
from wakeline.llm.substring_dedup import remove_repeats
from wakeline.llm.token_counts import count_tokens
from wakeline.llm.token_files import tokens_to_files
from wakeline.llm.toxicity import grade_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_language_id, op4_substring_dedup, op5_exact_dedup, op6_benchmark_decontamination, op7_secret_scan, op8_mix_sources, op9_quality_classifier, op10_jaccard_join, op11_token_files, op12_collocations, op13_importance_resampling)}

ORACLE_SQL = {
    "op4_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, unnest(h) AS h, unnest(generate_series(1, len(h))) AS i
            FROM (SELECT doc_id, list_transform(generate_series(1, len(w) - 34), lambda i: md5(array_to_string(w[i : i + 34], ' '))) AS h FROM d WHERE len(w) >= 35)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
        ), word AS (
            SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN (
            SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY text_sha256
        ) USING (text_sha256)
    """,
    "op6_benchmark_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), wins AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS len, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)
        ), spots AS (
            SELECT doc_id, w, n AS len, unnest(generate_series(1, len(w) - n + 1)) AS i
            FROM dw, (SELECT DISTINCT len AS n FROM wins) WHERE len(w) >= n
        ), hits AS (
            SELECT doc_id, i, s.len, item_id FROM (SELECT doc_id, i, len, array_to_string(w[i : i + len - 1], ' ') AS gram FROM spots) s JOIN wins USING (len, gram)
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + len - 1)) AS p FROM hits) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op8_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
        ), w AS (
            SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(place - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS limit_words FROM s
        ), r AS (
            SELECT *, limit_words / weight AS ratio, row_number() OVER (ORDER BY limit_words / weight, source NULLS LAST) AS rnk FROM w
        ), l AS (
            SELECT a.rnk, a.ratio, ((SELECT sum(source_size) FROM r) * 1.5::DOUBLE - (SELECT coalesce(sum(limit_words), 0) FROM r b WHERE b.rnk < a.rnk))
                / ((SELECT sum(weight) FROM r) - (SELECT coalesce(sum(weight), 0) FROM r b WHERE b.rnk < a.rnk)) AS level FROM r a
        ), t AS (
            SELECT source, source_size, coalesce(least(limit_words, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY rnk LIMIT 1)), limit_words) AS target FROM r
        ), p AS (
            SELECT doc_id, size, source_size, target, floor(target) AS budget,
                CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) AS BIGINT) AS taken FROM p
    """,
    "op13_importance_resampling": r"""
        WITH bit AS (
            SELECT list(c ORDER BY i) AS crc FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(i)
            )
        ), dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), bw AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), df AS (
            SELECT doc_id, unnest(list_concat(w, list_transform(list_zip(w, w[2:], true), lambda x: x[1] || ' ' || x[2]))) AS gram FROM dw
        ), bf AS (
            SELECT unnest(list_concat(w, list_transform(list_zip(w, w[2:], true), lambda x: x[1] || ' ' || x[2]))) AS gram FROM bw
        ), hashed AS (
            SELECT gram, xor(list_reduce(
                list_prepend(4294967295, list_transform(range(0, strlen(gram)), lambda i: CAST('0x' || hex(encode(gram))[2 * i + 1 : 2 * i + 2] AS BIGINT))),
                lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])
            ), 4294967295) % 10000 AS bucket
            FROM (SELECT gram FROM df UNION SELECT gram FROM bf), bit
        ), s AS (
            SELECT bucket, count(*) AS s FROM df JOIN hashed USING (gram) GROUP BY bucket
        ), t AS (
            SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (gram) GROUP BY bucket
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket)
        ), weights AS (
            SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM df JOIN hashed USING (gram) JOIN gains USING (bucket) GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight,
                CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
            FROM dw LEFT JOIN weights USING (doc_id)
        ), drawn AS (
            SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) END AS place FROM scored
        )
        SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank FROM drawn
    """,
    "op12_collocations": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents
        ), word AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
        ), gram AS (
            SELECT lang, 1 AS size, unnest(w) AS phrase FROM word
            UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w, w[2:], true), lambda x: x[1] || ' ' || x[2])) FROM word
            UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w, w[2:], w[3:], true), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) FROM word
        ), f AS (
            SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL
        ), n AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
        ), cand AS (
            SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10
        ), cut AS (
            SELECT lang, phrase, size, a, k, l, r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score
            FROM (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM cand))
            JOIN (SELECT lang, phrase AS first_part, f AS l FROM f WHERE f >= 10) USING (lang, first_part)
            JOIN (SELECT lang, phrase AS rest, f AS r FROM f WHERE f >= 10) USING (lang, rest)
        ), low AS (
            SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inner_part AS (
            SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE size = 3) GROUP BY ALL
        ), kept AS (
            SELECT low.* FROM low LEFT JOIN inner_part USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a
        )
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
    """,
}
