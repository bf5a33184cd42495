"""Importance resampling towards a target distribution of hashed word n-grams, scored without exploding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ASCII_LOWER, ASCII_UPPER, lower_ascii, materialise, number_in_order, table

NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{NOT_WORD}]+"
#: Buckets that features are hashed to. Counts and gains have an entry for each: this bounds all that goes to the driver.
BUCKETS = 10_000
#: Features are runs of 1 to MOST_WORDS consecutive words.
MOST_WORDS = 3
#: Documents of fewer words are scored but never drawn.
LEAST_WORDS = 20
#: Percent of those documents that are drawn.
PERCENT = 5
SEED = 42
MILLI = 1000
H_RANGE = 1 << 32


def words_of(text: Column) -> Column:
    """The words of a text: what stands between the separators, of which one may begin or end it."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"[{NOT_WORD}]+"), "")


def _bucket(feature: Column) -> Column:
    return (F.crc32(feature) % BUCKETS).cast("int")


def bucketed(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The columns keep, with n_words and buckets: of each feature of a text its bucket, repeats counted.

    Higher-order functions over the array of words; longer runs are put together
    from the shorter ones, so that each is one concatenation.
    """
    grams = docs.select(*[c.alias(k) for k, c in keep.items()], words_of(F.col("__text")).alias("g1"))
    n = F.size("g1")
    for k in range(2, MOST_WORDS + 1):
        runs = F.greatest(n - (k - 1), F.lit(0))
        longer = F.zip_with(F.slice(f"g{k - 1}", 1, runs), F.slice("g1", F.lit(k), runs), lambda a, b: F.concat(a, F.lit(" "), b))
        grams = grams.withColumn(f"g{k}", longer)
    return grams.select(*keep, n.alias("n_words"), F.concat(*[F.transform(f"g{k}", _bucket) for k in range(1, MOST_WORDS + 1)]).alias("buckets"))


def bucket_counts(hashed: DataFrame) -> list[int]:
    """Features in each bucket over all rows. Tasks sum up their own features first: only counts, BUCKETS a task at most, are shuffled."""
    found = hashed.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()  # at most BUCKETS rows
    counts = [0] * BUCKETS
    for b, n in found:
        counts[b] = n
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds: its log ratio of smoothed frequencies, target over source, in thousandths, rounded down."""
    all_source, all_target = sum(source), sum(target)
    return [math.floor(MILLI * math.log((t + 1) * (all_source + BUCKETS) / ((s + 1) * (all_target + BUCKETS)))) for s, t in zip(source, target, strict=True)]


def gain_literal(values: list[int]) -> Column:
    """The gains as one array that the optimiser folds into a literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A draw from the Gumbel distribution in thousandths, which the seed and the id decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(MILLI)) * F.log(-F.log((h + 0.5) / float(H_RANGE))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank.

    A document's features are the runs of 1 to MOST_WORDS of its words, hashed to
    BUCKETS. Its weight is the sum of the gains of their buckets; a Gumbel draw by
    the seed and the id is added for its score, so that the best scores are a
    sample without replacement in proportion to exp(weight / 1000). Of the N
    documents of least_words words or more, floor(percent * N / 100) are drawn;
    rank numbers them by score, the smaller id first among equals. The others have
    a null rank.

    Texts are read once: the arrays of buckets, two bytes a feature, are written to
    the shared folder, counted, and then scored in place by a sum over elements of
    a literal array of gains. Texts and features are never shuffled, only counts of
    buckets, and four numbers a document for the ranks, by a range sort.

    Null and wordless texts have no features and weight 0. A null id draws as the
    empty string and is last among equals. Repeated rows are documents of their
    own, with equal scores. An empty target, or an empty docs, counts nothing: gains
    are then smoothed alone. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    hashed = materialise(bucketed(own, {"doc_id": F.col("doc_id")}), "buckets")
    wanted = bucketed(target.select(F.col(target_text_col).alias("__text")), {})
    gain = gain_literal(gains(bucket_counts(hashed), bucket_counts(wanted)))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda held, b: held + F.element_at(gain, b + 1))
    scored = hashed.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    scored = materialise(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    open_ = F.col("n_words") >= least_words
    drawn = percent * scored.where(open_).count() // 100
    ordered = scored.where(open_).select("*", (-F.col("score")).alias("__down"), F.col("doc_id").isNull().alias("__last"))
    ranked = number_in_order(ordered, ["__down", "__last", "doc_id", "n_features", "weight"], "__place")
    ranked = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("__place") < drawn, F.col("__place") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~open_).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The remainders of a byte and the checksum of bytes, as DuckDB has none: 3988292384 is the polynomial, reversed.
SQL_CRC_TABLE = """
crc_table AS MATERIALIZED (SELECT list(r ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r FROM (SELECT unnest(range(256)) AS i)))"""


def sql_crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, where crc_table is in scope."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda k: (strpos('0123456789ABCDEF', substr({digits}, 2 * k + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr({digits}, 2 * k + 2, 1)) - 1)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)"


def _sql_features(of: str, key: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{WORD}')"
    runs = [f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in range(1, MOST_WORDS + 1)]
    return f"SELECT {key}, len(w) AS n_words, {' || '.join(runs)} AS f FROM (SELECT {key}, {words} AS w FROM {of})"


OP13_SQL = f"""
WITH {SQL_CRC_TABLE},
d AS MATERIALIZED ({_sql_features("documents", "doc_id")}),
b AS MATERIALIZED ({_sql_features("benchmark", "item_id")}),
each_d AS MATERIALIZED (SELECT doc_id, f FROM (SELECT doc_id, unnest(f) AS f FROM d)),
each_b AS MATERIALIZED (SELECT unnest(f) AS f FROM b),
hashed AS MATERIALIZED (SELECT f, {sql_crc32("f")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM each_d UNION ALL SELECT f FROM each_b)), crc_table),
s AS (SELECT bucket, count(*) AS s FROM each_d JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM each_b JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor({MILLI} * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE
         / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
weighed AS (SELECT doc_id, sum(gain) AS weight FROM each_d JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, n_words, len(f) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-{float(MILLI)} * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / {H_RANGE}::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weighed ON d.doc_id = weighed.doc_id
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT s.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
