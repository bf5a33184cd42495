"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import ASCII_LOWER, ASCII_UPPER, lower_ascii, materialise, table, with_row_key, without_rows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and of a shingle: the tokens of the set join.
WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: Shingles, windows and windows of items (about 100 bytes each) are broadcast up to this many, each counted by itself; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(array: str, at: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(F.col(array), at + 1, n), " ")


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, w, len): every run of so many item words; a shorter item is one window."""
    w = items.select("item_id", words(F.col("text")).alias("all")).where(F.size("all") > 0)
    n = F.size("all")
    starts = w.select("item_id", "all", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("at"))
    cut = F.slice(F.col("all"), F.col("at") + 1, window)
    return starts.select("item_id", F.array_join(cut, " ").alias("window"), cut.alias("w"), F.size(cut).alias("len")).distinct()


def _judged(own: DataFrame, items: DataFrame, item_id_col: str, item_text_col: str, window: int, shingle: int, most: int, written: bool) -> DataFrame:
    """own(rid, doc_id, text) as (rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated); written says whether own is a table."""
    bench = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    of_items = materialise(benchmark_windows(bench, window), "windows")
    wins = of_items.select("window", "w", "len").distinct()
    k = F.least(F.lit(shingle), F.col("len"))
    grams = materialise(
        wins.select("window", "w", "len", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
        .select("window", "len", "k", "off", _gram("w", F.col("off"), F.col("k")).alias("gram")),
        "grams",
    )
    vocabulary = grams.select(F.col("gram").alias("known")).distinct()

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= most else df

    small = vocabulary.count() <= most
    sizes = sorted(r.k for r in grams.select("k").distinct().collect()) or [shingle]  # at most `shingle` of them
    if not small and not written:
        own = materialise(own, "rows")  # read twice below, with the same row keys

    # One row per place whose shingle the benchmark has, and one with a null shingle per document.
    read = own.select("rid", "doc_id", words(F.col("text")).alias("w"))
    n = F.size("w")

    def places(size: int) -> Column:
        some = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("pos"), _gram("w", i, size).alias("gram")))
        return F.when(n >= size, some).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))

    whole = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram")))
    exploded = read.select("rid", "doc_id", n.cast("long").alias("n_words"), F.explode(F.concat(*[places(s) for s in sizes], whole)).alias("p")).select("rid", "doc_id", "n_words", "p.pos", "p.gram")
    if small:
        kept = exploded.join(F.broadcast(vocabulary), F.col("gram") == F.col("known"), "left").where("known is not null or gram is null").drop("known")
    else:
        kept = exploded.where("gram is not null").join(vocabulary, F.col("gram") == F.col("known"), "left_semi").unionByName(exploded.where("gram is null"))
    marked = materialise(kept, "marked")
    hits = marked.where("gram is not null").select("rid", "n_words", "pos", "gram")

    rarity = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    prefix = materialise(
        grams.join(rarity, "gram")
        .groupBy("window", "len", "k")
        .agg(F.min(F.struct("df", "off", "gram")).alias("rarest"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.col("len") - F.col("k") + 1)
        .select("window", "len", "k", "rarest.off", "rarest.gram"),
        "prefix",
    )
    start = F.col("pos") - F.col("off")
    candidates = (
        hits.join(near(prefix), "gram")
        .where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        .select("rid", start.alias("q"), "window", "len", "k", "off")
    )
    # Shingles at 0, k, 2k, ... and at the end cover the window; the prefix itself is known to match.
    cover = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("len") - F.col("k"), F.col("k")), F.array(F.col("len") - F.col("k"))))
    needed = candidates.select("rid", "q", "window", "len", F.size(cover).alias("need"), F.explode(cover).alias("at"), F.col("k").alias("kk")).select("rid", "q", "window", "len", "need", (F.col("q") + F.col("at")).alias("pos"), F.array_join(F.slice(F.split("window", " "), F.col("at") + 1, F.col("kk")), " ").alias("gram"))
    found = materialise(
        needed.join(hits.select("rid", "pos", "gram"), ["rid", "pos", "gram"])
        .groupBy("rid", "q", "window", "len", "need")
        .agg(F.count(F.lit(1)).alias("got"))
        .where("got = need")
        .select("rid", "q", "window", "len"),
        "occurrences",
    )
    by_place = Window.partitionBy("rid").orderBy("q", "len")
    before = F.max(F.col("q") + F.col("len")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        found.select("rid", "q", "len").distinct()
        .withColumn("fresh", F.greatest(F.lit(0), F.col("q") + F.col("len") - F.greatest(F.col("q"), F.coalesce(before, F.lit(0)))))
        .groupBy("rid").agg(F.sum("fresh").alias("n_hit"))
    )
    listed = (
        found.select("rid", "window").distinct()
        .join(near(of_items.select("window", "item_id")), "window")
        .groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    none = F.array().cast("array<string>")
    out = marked.where("gram is null").join(covered, "rid", "left").join(listed, "rid", "left").withColumn("items", F.coalesce("items", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    return out.select("rid", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    The set join: a window of an item is the set of its shingles, a document the
    set of its own, and the window must be contained whole. Shingles are ordered
    by how often the whole corpus has them; as all of a window's shingles must
    occur, its rarest one alone is the necessary prefix, and a window with a
    shingle that no document has is left out at once. Documents that have the
    prefix shingle at a place are candidates; the place fixes where the window
    would begin, which must be at or after the first word (position) and leave
    room for the window (length). Candidates are then held against the shingles
    that cover the window without gaps, word for word.

    One pass over the texts keeps only shingles that the benchmark has, so that
    all later steps handle matches, not texts. The benchmark's shingles, its
    windows and the items' windows are each counted first and broadcast only up to
    broadcast_rows; beyond, they are joined by a shuffle.

    Null and wordless texts have no words, hits or items; an item without words
    has no window. A null item id contaminates but is not listed; items that
    repeat an id count once. Repeated rows of docs each give a row, null ids
    included. An empty benchmark leaves all clean. Other columns are ignored.
    """
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(own, items, item_id_col, item_text_col, window, shingle, broadcast_rows, written=False).drop("rid")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows, which are told apart by a key of their own, not by their ids."""
    keyed, key = with_row_key(docs)
    own = keyed.select(F.col(key).alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    judged = _judged(own, items, "item_id", "text", WINDOW_WORDS, SHINGLE_WORDS, BROADCAST_ROWS, written=True)
    return without_rows(keyed, key, materialise(judged.where("contaminated").select("rid"), "gone"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{WORD}')"


OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW_WORDS - 1}], ' ') AS win, least(len(w), {WINDOW_WORDS}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW_WORDS - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
place AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
),
occ AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM place p JOIN win w ON p.win = w.win AND p.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
