"""Retrieval: BM25, vectors, rank fusion with proximity, entity lookup."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.text import name_tier
from factloom.functions.vectors import cosine
from factloom.operators.graph import SRC, TGT, graph_distance, neighbours, touching
from factloom.operators.ranking import global_rank, shared_folder
from factloom.operators.temporal import scope

K1, B = 1.2, 0.75
RRF_K = 60
#: What touching an anchor, or a neighbour of one, adds to a score.
NEAR_BONUS, NEXT_BONUS = 0.125 / 61, 0.0625 / 61
LEAST_COSINE = 0.4
NAME_COSINE = 0.75
ANCHOR_COSINE, MOST_ANCHORS = 0.7, 3


#: Tokens whose terms are counted at once: what a Python worker holds beside its batch.
TOKENS_AT_ONCE = 1_000_000


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring documents of at most so many tokens together, or one that has more, as (first, number)."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield first, i - first
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes) - first


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_keys, all_lists = batch.columns
        sizes = pc.fill_null(pc.list_value_length(all_lists), 0).to_numpy(zero_copy_only=False)
        for first, number in _parts(sizes, TOKENS_AT_ONCE):
            keys, lists, size = all_keys.slice(first, number), all_lists.slice(first, number), sizes[first : first + number]
            dl = pc.list_value_length(lists).cast(pa.int32())
            coded = lists.flatten().dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, tf = np.unique(code * number + np.repeat(np.arange(number), size), return_counts=True)  # by term, then document
            pairs, tf = pairs[pairs >= 0], tf[pairs >= 0]  # a token that is null is no term
            term, doc = pairs // number, pairs % number
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            terms = pa.concat_arrays([coded.dictionary.take(pa.array(term[starts])), pa.nulls(1, coded.dictionary.type)])
            doc, tf = np.concatenate([doc, np.arange(number)]), np.concatenate([tf, np.zeros(number, np.int64)])
            offsets = pa.array(np.concatenate([starts, [len(pairs), len(doc)]]).astype(np.int32))
            columns = [keys.take(pa.array(doc)), dl.take(pa.array(doc)), pa.array(tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([terms, *[pa.ListArray.from_arrays(offsets, c) for c in columns]], ["term", "keys", "dls", "tfs"])


def term_lists(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(term, keys, dls, tfs): what a few documents have of a term as one row, and as one row of no term all of them.

    A task counts the terms of its documents without a shuffle, and each text is read once.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, tokens).mapInArrow(_count_terms, f"term string, keys array<{kind}>, dls array<int>, tfs array<int>")


def _unpacked(lists: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, dl, term, tf) of lists, a row for each document of each."""
    rows = lists.select("term", *more, F.inline(F.arrays_zip("keys", "dls", "tfs")))
    return rows.select(F.col("keys").alias(key), F.col("dls").alias("dl"), "term", F.col("tfs").cast("long").alias("tf"), *more)


def postings(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, dl, term, tf): the inverted index of docs, to be written once, clustered by term."""
    return _unpacked(term_lists(docs, key, tokens).where("term is not null"), key)


def corpus_stats(docs: DataFrame, tokens: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens)).alias("avg_len"))


#: Folders of an index by the hash of a term: a query reads those of its terms alone.
INDEX_FOLDERS = 64
#: Parts of a folder by the hash of a document, so that a frequent term is no single task; bounds the files of an index too.
FOLDER_PARTS = 16
#: The folder of the rows without a term.
NO_TERM = -1


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


class Index:
    """Postings (key, term, tf, dl) under a folder, by term, the length of each document, and one row of corpus statistics.

    Written once, as lists of some documents for a term, with one shuffle of the lists by folder
    and part. A query reads only the files of its terms' folders, where the terms are sorted, so
    that their row groups are skipped too.
    """

    def __init__(self, spark, path: str, key: str = "uuid", folders: int = INDEX_FOLDERS):
        self.spark, self.path, self.key, self.folders = spark, path.rstrip("/"), key, folders

    def write(self, docs: DataFrame, tokens: str = "tokens") -> Index:
        lists = term_lists(docs, self.key, tokens).withColumn("folder", F.when(F.col("term").isNull(), NO_TERM).otherwise(_folder(F.col("term"), self.folders)))
        dealt = lists.repartition("folder", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(FOLDER_PARTS)))
        dealt.sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/postings")
        held = self.spark.read.schema(lists.schema).parquet(f"{self.path}/postings").where(F.col("folder") == NO_TERM)
        _unpacked(held, self.key).select(self.key, "dl").write.mode("overwrite").parquet(f"{self.path}/lengths")
        lengths = self.spark.read.parquet(f"{self.path}/lengths")
        lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len")).write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def postings(self) -> DataFrame:
        lists = self.spark.read.parquet(f"{self.path}/postings").where(F.col("folder") != NO_TERM)
        return _unpacked(lists, self.key, "folder")

    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lengths")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats")

    def bm25(self, terms: list[str], k1: float = K1, b: float = B, within: DataFrame | None = None) -> DataFrame:
        """(key, score) as bm25() gives it, from the postings of the query's terms.

        within(key) are the documents that a search sees: scores and statistics are
        then of those alone, which is a join of ids; no text is read.
        """
        weights = self.spark.createDataFrame([(t, float(n)) for t, n in sorted(Counter(terms).items())], "term string, weight double")
        numbers = [r[0] for r in weights.select(_folder(F.col("term"), self.folders)).distinct().collect()]
        own = self.postings().where(F.col("folder").isin(numbers) & F.col("term").isin(sorted(set(terms))))
        stats = self.stats()
        if within is not None:
            seen = within.select(self.key)
            own = own.join(seen, self.key, "left_semi")
            stats = self.lengths().join(seen, self.key, "left_semi").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len"))
        df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a term
        joined = own.join(F.broadcast(df.join(weights, "term")), "term").crossJoin(F.broadcast(stats))  # one row
        idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        length = F.when(F.col("avg_len") > 0, F.col("dl") / F.col("avg_len")).otherwise(F.lit(0.0))
        part = F.col("weight") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
        return joined.groupBy(self.key).agg(F.sum(part).alias("score")).where("score > 0")


class LiveIndex(Index):
    """An index that follows its documents: a base, and for each change since the postings of what it wrote and the ids of what it removed.

    apply() writes one change, whose cost is that of its documents; a posting counts
    if no later change names its document. A query reads its terms' folders of the
    base and of each change, and the ids that changed. Every merge_after changes
    all are merged into a new base, from which on the older ones are not read. A change
    or a base is there once its marker is: repeated ones and half-written ones
    change nothing.
    """

    def __init__(self, spark, path: str, key: str = "uuid", folders: int = INDEX_FOLDERS, merge_after: int = 16):
        super().__init__(spark, path, key, folders)
        self.merge_after = merge_after

    def _numbers(self, prefix: str) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/lengths/_SUCCESS"))
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and done(n))

    def _parts(self) -> tuple[list[str], list[int]]:
        bases = self._numbers("base=")
        last = bases[-1] if bases else -1
        return ([f"base={last}"] if bases else []), [v for v in self._numbers("change=") if v > last]

    def apply(self, version: int, docs: DataFrame, tokens: str = "tokens") -> LiveIndex:
        """Takes in docs(key, tokens[, deleted]) as one change: new and changed documents, and deleted ones."""
        if version in self._numbers("change=") or version <= max(self._numbers("base="), default=-1):
            return self
        gone = F.coalesce("deleted", F.lit(False)) if "deleted" in docs.columns else F.lit(False)
        folder = f"{self.path}/change={version}"
        rows = postings(docs.where(~gone), self.key, tokens).withColumn("folder", _folder(F.col("term"), self.folders))
        rows.sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{folder}/postings")
        docs.select(self.key, F.when(~gone, F.size(tokens)).alias("dl")).write.mode("overwrite").parquet(f"{folder}/lengths")  # its marker comes last
        if len(self._parts()[1]) >= self.merge_after:
            self.merge(version)
        return self

    def merge(self, version: int) -> None:
        """Writes what all changes up to a version have made of the index as a new base."""
        folder = f"{self.path}/base={version}"
        self.postings().sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{folder}/postings")
        self.lengths().write.mode("overwrite").parquet(f"{folder}/lengths")

    def _read(self, what: str) -> DataFrame | None:
        """The rows of a base and its changes, with the number of each."""
        bases, changes = self._parts()
        kind = dict(self._kind())[self.key]
        schema = f"{self.key} {kind}, " + ("dl int" if what == "lengths" else "dl int, term string, tf bigint, folder int")
        own = None
        for n, part in [(-1, p) for p in bases] + [(v, f"change={v}") for v in changes]:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}/{what}").withColumn("__n", F.lit(n))
            own = rows if own is None else own.unionByName(rows)
        return own if own is not None else self.spark.createDataFrame([], schema).withColumn("__n", F.lit(0))

    def _kind(self) -> list[tuple[str, str]]:
        bases, changes = self._parts()
        parts = bases + [f"change={v}" for v in changes]
        return self.spark.read.parquet(f"{self.path}/{parts[0]}/lengths").dtypes if parts else [(self.key, "string")]

    def _last(self) -> DataFrame:
        """(key, __last): the last change of each document that changes name."""
        return self._read("lengths").where("__n >= 0").groupBy(self.key).agg(F.max("__n").alias("__last"))

    def _current(self, rows: DataFrame) -> DataFrame:
        kept = rows.join(self._last(), self.key, "left").where(F.col("__last").isNull() | (F.col("__n") == F.col("__last")))
        return kept.drop("__n", "__last")

    def postings(self) -> DataFrame:
        return self._current(self._read("postings"))

    def lengths(self) -> DataFrame:
        return self._current(self._read("lengths")).where("dl is not null")

    def stats(self) -> DataFrame:
        return self.lengths().agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len"))


def search_tokens(facts: DataFrame, entities: DataFrame | None = None, tokens: str = "tokens") -> DataFrame:
    """facts with the tokens that a search looks in: of the relation, the text and, with entities, the names of both ends; rows that have tokens keep them."""
    said = F.concat_ws(" ", F.regexp_replace("name", "_", " "), "fact")
    own = facts
    if entities is not None:
        names = entities.select(F.col("uuid").alias("__id"), F.col("name").alias("__name"))
        for end, col in (("__s", SRC), ("__t", TGT)):
            own = own.join(names.select(F.col("__id").alias(f"{end}i"), F.col("__name").alias(end)), F.col(col) == F.col(f"{end}i"), "left").drop(f"{end}i")
        said = F.concat_ws(" ", F.regexp_replace("name", "_", " "), "fact", "__s", "__t")
    held = F.col(tokens) if tokens in facts.columns else F.lit(None).cast("array<string>")
    plain = F.octet_length(said) == F.length(said)  # in ASCII the built-in rule is the same
    made = F.when(plain, X.latin_tokens(said)).otherwise(X.tokenize(said))
    return own.withColumn(tokens, F.coalesce(held, made)).drop("__s", "__t")


def _term(term: str):
    return lambda x: F.when(x == term, 1)


def bm25(docs: DataFrame, terms: list[str], key: str = "uuid", tokens: str = "tokens", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of docs with a query term; a term that the query repeats counts as often.

    Documents are not exploded: for each query term its frequency is counted in
    place, so the only shuffles are those of the corpus statistics, one row.
    """
    weights = Counter(terms)
    order = sorted(weights)
    tf = {t: F.size(F.array_compact(F.transform(F.col(tokens), _term(t)))) for t in order}
    own = docs.select(key, F.size(tokens).cast("double").alias("dl"), *[tf[t].alias(f"tf_{i}") for i, t in enumerate(order)])
    stats = own.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(order))])
    joined = own.where(sum((F.col(f"tf_{i}") for i in range(len(order))), F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for i, t in enumerate(order):
        df, f = F.col(f"df_{i}"), F.col(f"tf_{i}")
        idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
        length = F.when(F.col("avg") > 0, F.col("dl") / F.col("avg")).otherwise(F.lit(0.0))
        score = score + F.lit(float(weights[t])) * idf * f * (k1 + 1) / (f + k1 * (1 - b + b * length))
    return joined.select(key, score.alias("score")).where("score > 0")


def vector_scores(rows: DataFrame, query: list[float], key: str = "uuid", vector: str = "embedding") -> DataFrame:
    """(key, cosine), exact, over all rows with a vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), q).alias("cosine"))


def ranked(scores: DataFrame, score: str, ties: list[str], depth: int | None = None) -> DataFrame:
    """scores above 0 with rank from 1; a depth keeps the first so many, by a top-k before the numbering."""
    found = scores.where(F.col(score) > 0)
    order = [F.col(score).desc(), *ties]
    if depth is None:
        return global_rank(found, order)
    return found.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(rankings: list[DataFrame], key: str = "uuid", k: int = RRF_K) -> DataFrame:
    """(key, score): the sum of 1 / (k + rank) over rankings(key, rank)."""
    out = rankings[0].select(key, "rank")
    for more in rankings[1:]:
        out = out.unionByName(more.select(key, "rank"))
    return out.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def rerank(candidates: DataFrame, limit: int | None = 10, least_cosine: float = LEAST_COSINE, k: int = RRF_K) -> DataFrame:
    """candidates(uuid, created_at, kw_rank, vec_rank, cosine, distance) with score, cut and ordered.

    A candidate without a keyword rank and without proximity stays only if its
    cosine is at least least_cosine.
    """
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    bonus = F.when(F.col("distance") == 0, NEAR_BONUS).when(F.col("distance") == 1, NEXT_BONUS).otherwise(0.0)
    kept = F.col("kw_rank").isNotNull() | (bonus > 0) | (F.coalesce("cosine", F.lit(-1.0)) >= least_cosine)
    out = candidates.where(kept).withColumn("score", part("kw_rank") + part("vec_rank") + bonus)
    order = [F.col("score").desc(), F.col("created_at").desc(), "uuid"]
    return out.orderBy(*order).limit(limit) if limit is not None else out


def naming_entities(entities: DataFrame, text: str, folded: bool = False) -> DataFrame:
    """Entities that a text names: whole words for Latin names, anywhere for scripts without spaces; folded: whatever the width of characters."""
    low = X.fold(text) if folded else text.lower()
    by_rule = (X.mentioned_folded if folded else X.mentioned)(F.lit(text), F.col("name"))
    if not low.isascii():
        return entities.where(by_rule)
    # The rule for names in ASCII, in whole-stage code; others go to Python, if they can stand in such a text at all.
    name = F.lower("name")
    quoted = F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    whole = F.concat(F.lit(r"(?<![\p{IsLatin}\p{M}\p{N}_])\Q"), quoted, F.lit(r"\E(?![\p{IsLatin}\p{M}\p{N}_])"))
    plain = F.octet_length("name") == F.length("name")
    found = entities.where(plain & (F.length("name") >= 2) & F.lit(low).contains(name)).where(F.regexp_like(F.lit(low), whole))
    return found.unionByName(entities.where(~plain).where(by_rule)) if folded else found


def anchors(entities: DataFrame, query: str, vector: list[float] | None = None) -> DataFrame:
    """Entities that the query names; if none, up to three with a near name vector."""
    named = naming_entities(entities, query, folded=True)
    if vector is None or "name_embedding" not in entities.columns or not named.isEmpty():
        return named.select("uuid")
    q = F.array(*[F.lit(float(x)) for x in vector])
    near = entities.where(F.col("name_embedding").isNotNull()).withColumn("c", cosine(F.col("name_embedding"), q)).where(F.col("c") >= ANCHOR_COSINE)
    return near.orderBy(F.col("c").desc(), "uuid").limit(MOST_ANCHORS).select("uuid")


#: Digits after which scores of two rows count as equal, and their order is that of creation and id.
SCORE_DIGITS = 9
#: Rows whose exact rank is looked up at most before the rankings are read further down; a bound on what goes to the driver.
MOST_OPEN = 2000


def _bonus() -> Column:
    return F.when(F.col("distance") == 0, NEAR_BONUS).when(F.col("distance") == 1, NEXT_BONUS).otherwise(0.0)


def _places(rows: DataFrame, score: str, wanted: list) -> dict:
    """The rank by a score of each of wanted rows(uuid, created_at, score), which are few: one pass that counts the rows before each, and no sort."""
    keys = sorted((-getattr(r, score), r.created_at or datetime.min, r.uuid, r) for r in wanted)
    if not keys:
        return {}
    kind = {c: t for c, t in rows.dtypes}
    schema = f"s double, c {kind['created_at']}, u {kind['uuid']}"
    listed = rows.sparkSession.createDataFrame([(s, r.created_at, u) for s, _, u, r in keys], schema).agg(F.collect_list(F.struct("s", "c", "u")).alias("__wanted"))  # one row
    own = F.struct((-F.col(score)).alias("s"), F.col("created_at").alias("c"), F.col("uuid").alias("u"))
    behind = rows.where((F.col(score) > 0) & (-F.col(score) <= keys[-1][0])).crossJoin(F.broadcast(listed)).select(F.size(F.filter("__wanted", lambda w: own < w)).alias("n"))
    counts = dict(behind.groupBy("n").count().collect())  # a row before n of the wanted ones is before the last n
    return {r.uuid: 1 + sum(c for n, c in counts.items() if n >= len(keys) - k) for k, (*_, r) in enumerate(keys)}


def fused_topk(rows: DataFrame, limit: int, least_cosine: float = LEAST_COSINE, k: int = RRF_K, depth: int | None = None) -> list[tuple[object, float]]:
    """The first rows of a fusion as (uuid, score), without ranking all: exact, by a threshold.

    rows(uuid, created_at, kw, cosine, distance) should be a table, as they are read
    several times. Both rankings are read down to a depth; what is below it adds
    less than 1 / (k + depth) by each. With the limit-th best of what the rows have
    for sure as the threshold, only rows that may still reach it are open; their
    ranks are counted. If too many are open, the rankings are read further down.
    The driver gets the open rows, MOST_OPEN at most, and two rankings' heads.
    """
    depth = depth or max(4 * limit, 64)
    held = rows.withColumn("bonus", _bonus()).withColumn("kw", F.when(F.col("kw") > 0, F.col("kw")))
    held = held.withColumn("vec", F.when(F.col("cosine") > 0, F.round("cosine", SCORE_DIGITS)))
    held = held.withColumn("kw", F.round("kw", SCORE_DIGITS)).withColumn("vec", F.when(F.col("vec") > 0, F.col("vec")))
    kept = F.col("kw").isNotNull() | (F.col("bonus") > 0) | (F.coalesce("cosine", F.lit(-1.0)) >= least_cosine)
    spark = rows.sparkSession
    uuid_kind = dict(rows.dtypes)["uuid"]
    order = lambda r: (-r[1], float("inf") if r[2] is None else -r[2].timestamp(), r[0])
    while True:
        placed, out_of = held, {}
        for score in ("kw", "vec"):
            head = held.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), "created_at", "uuid").limit(depth).select("uuid").collect()
            ranks = spark.createDataFrame([(r.uuid, n) for n, r in enumerate(head, 1)], f"uuid {uuid_kind}, {score}_rank int")
            placed = placed.join(F.broadcast(ranks), "uuid", "left")  # depth rows
            out_of[score] = 1.0 / (k + depth + 1) if len(head) == depth else 0.0
        sure = lambda score: F.coalesce(1.0 / (F.lit(k) + F.col(f"{score}_rank")), F.lit(0.0))
        more = lambda score: F.when(F.col(score).isNotNull() & F.col(f"{score}_rank").isNull(), out_of[score]).otherwise(0.0)
        own = placed.where(kept).withColumn("low", sure("kw") + sure("vec") + F.col("bonus")).withColumn("open", more("kw") + more("vec"))
        best = own.orderBy(F.col("low").desc()).limit(limit).select("low").collect()
        threshold = best[-1].low if len(best) == limit else -1.0
        closed = own.where("open = 0").orderBy(F.round("low", 12).desc(), F.col("created_at").desc(), "uuid").limit(limit).collect()
        open_ = own.where((F.col("open") > 0) & (F.col("low") + F.col("open") >= threshold - 1e-12)).limit(MOST_OPEN + 1).collect()
        if len(open_) <= MOST_OPEN:
            break
        depth *= 4
    lacking = lambda score: [r for r in open_ if getattr(r, score) is not None and getattr(r, f"{score}_rank") is None]
    ranks = {score: _places(held, score, lacking(score)) for score in ("kw", "vec")}
    final = [(r.uuid, r.low, r.created_at) for r in closed]
    final += [(r.uuid, r.low + sum(1.0 / (k + ranks[s][r.uuid]) for s in ("kw", "vec") if r.uuid in ranks[s]), r.created_at) for r in open_]
    final = [(u, round(s, 12), c) for u, s, c in final]
    return [(u, s) for u, s, _ in sorted(final, key=order)[:limit]]


def hybrid_search(
    facts: DataFrame, entities: DataFrame, query: str, terms: list[str], vector: list[float] | None, at, as_of=None, group: str | None = None, history: bool = False, limit: int | None = 10,
    least_cosine: float = LEAST_COSINE, index: Index | None = None,
) -> DataFrame:
    """Keyword and vector rankings fused, with proximity to the named entities and a relevance cut.

    facts need tokens, or an index of them, and embedding. Without a vector, as
    when the query could not be embedded, the search is by keywords (and
    proximity) alone, and degraded is true. All visible facts are candidates; there
    is no cap. Scores that agree to SCORE_DIGITS digits tie; the older fact, and then
    the smaller id, ranks first.

    With a limit, each visible fact's scores are computed once, written as four
    numbers, and the first rows found by fused_topk(): nothing is sorted. Without,
    both rankings are numbered whole.
    """
    seen = scope(facts, group, at, as_of, history)
    words = index.bm25(terms, within=seen) if index is not None else bm25(seen, terms)
    own = anchors(entities if group is None else entities.where(F.col("group_id") == group), query, vector)
    ends = seen.select("uuid", "created_at", SRC, TGT, *(["embedding"] if vector is not None else []))
    placed = graph_distance(ends, own, neighbours(ends, own))
    cos = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])) if vector is not None else F.lit(None).cast("double")
    scored = placed.select("uuid", "created_at", "distance", F.when(F.col("embedding").isNotNull(), cos).alias("cosine") if vector is not None else cos.alias("cosine"))
    scored = scored.join(words.select("uuid", F.col("score").alias("kw")), "uuid", "left")
    if limit is not None:
        spark, path = facts.sparkSession, shared_folder(facts.sparkSession, "scores")
        scored.where("kw > 0 or cosine > 0 or distance is not null").write.parquet(path)
        first = fused_topk(spark.read.schema(scored.schema).parquet(path), limit, least_cosine)
        ranked_ = spark.createDataFrame(first, f"uuid {dict(scored.dtypes)['uuid']}, score double")  # limit rows
        out = facts.join(F.broadcast(ranked_), "uuid")
        return out.orderBy(F.col("score").desc(), F.col("created_at").desc(), "uuid").withColumn("degraded", F.lit(vector is None))
    numbered = scored.withColumn("kw", F.round("kw", SCORE_DIGITS)).withColumn("vec", F.round("cosine", SCORE_DIGITS))
    kw = ranked(numbered, "kw", ["created_at", "uuid"]).select("uuid", F.col("rank").alias("kw_rank"))
    vec = ranked(numbered, "vec", ["created_at", "uuid"]).select("uuid", F.col("rank").alias("vec_rank"))
    all_ = seen.join(scored.drop("created_at"), "uuid").join(kw, "uuid", "left").join(vec, "uuid", "left")
    return rerank(all_, None, least_cosine).withColumn("degraded", F.lit(vector is None))


def find_entities(entities: DataFrame, query: str, limit: int | None = 10, vector: list[float] | None = None) -> DataFrame:
    """Entities by name: equal, then beginning, then inside; shorter names first; near vectors fill up unless one is equal."""
    q = query.strip().lower()
    tiers = entities.withColumn("tier", name_tier(F.col("name"), q)).where("tier < 3") if q else entities.withColumn("tier", F.lit(3)).limit(0)
    order = ["tier", F.length("name"), "created_at", "uuid"]
    found = tiers.orderBy(*order).limit(limit) if limit is not None else tiers
    if vector is None or "name_embedding" not in entities.columns:
        return found
    head = found.select("tier").collect() if limit is not None else tiers.where("tier = 0").limit(1).collect()
    if any(r.tier == 0 for r in head) or limit is not None and len(head) >= limit:
        return found
    v = F.array(*[F.lit(float(x)) for x in vector])
    rest = entities.where(F.col("name_embedding").isNotNull()).join(tiers.select("uuid"), "uuid", "left_anti").withColumn("c", cosine(F.col("name_embedding"), v)).where(F.col("c") >= NAME_COSINE)
    rest = rest.orderBy(F.col("c").desc(), "uuid")
    rest = rest.limit(limit - len(head)) if limit is not None else rest
    return found.unionByName(rest.withColumn("tier", F.lit(4)).drop("c").select(*found.columns))


def candidates(entities: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """The matches of a name in order, with chosen: whether they bear the best match's name, in whatever group."""
    found = find_entities(entities, name, limit)
    order = ["tier", F.length("name"), "created_at", "uuid"]
    first = F.first(F.lower("name")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # at most limit rows
    return found.withColumn("position", F.row_number().over(Window.orderBy(*order))).withColumn("chosen", F.lower("name") == first)


def facts_about(facts: DataFrame, entities: DataFrame, name: str, at, as_of=None, group: str | None = None, history: bool = False, limit: int | None = 50) -> DataFrame:
    """Facts of the best match for a name (of all groups' entities of that name), the latest start first."""
    pool = entities if group is None else entities.where(F.col("group_id") == group)
    best = find_entities(pool, name, 1).select(F.lower("name").alias("__best"))
    own = pool.join(best, F.lower("name") == F.col("__best"), "left_semi").select("uuid")
    seen = scope(touching(facts, own), group, at, as_of, history)
    order = [F.coalesce("valid_at", "created_at").desc(), "uuid"]
    return seen.orderBy(*order).limit(limit) if limit is not None else seen
