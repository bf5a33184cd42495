"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import ASCII_LOWER, ASCII_UPPER, LOWER_BYTES, bound_batches, connected_components, discard, holds, join_groups, join_keys, materialise, table, width, with_row_key, without_rows

SHINGLE_WORDS = 5
#: Percent of the union that the intersection must have.
SIMILARITY = 75
#: Signature: BANDS x ROWS coordinates over a universe of 2**UNIVERSE_BITS places.
#: A pair at the similarity itself shares no band with a chance of (1 - 0.75**4)**32, or 5 in a million.
BANDS, ROWS = 32, 4
UNIVERSE_BITS = 20
#: Rounds in which buckets are held against one member before the rest is paired.
STAR_ROUNDS = 2
#: Nodes (five numbers each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_NODES = 200_000
#: Pairs of one node that are confirmed by one part; more make more parts.
PAIRS_A_PART = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown to its bound, which only costs time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = value
        return value


WORD_HASHES = _WordHashes()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    return x ^ (x >> np.uint64(27))


def shingles(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle."""
    words = (text or b"").translate(LOWER_BYTES).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    take = min(size, len(words))
    n = len(words) - take + 1
    acc = np.full(n, take, np.uint64) * MIX
    for k in range(take):
        acc = _stir(acc * MIX + hashed[k : k + n])
    return np.unique(acc)


class CirculantMinHash:
    """All coordinates from two permutations of a universe of places.

    The first permutation deals shingles over the places. The second one is
    shifted circularly by k for coordinate k, so that the values of one shingle
    for all coordinates stand side by side in its table.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = UNIVERSE_BITS, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.mask = np.uint64((1 << bits) - 1)
        self.first = rng.permutation(1 << bits).astype(np.int32)
        second = rng.permutation(1 << bits).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.r_[second, second[: self.k]], self.k)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = self.first[(hashes & self.mask).astype(np.int64)]
        out = np.full(self.k, np.iinfo(np.int32).max, np.int32)
        for at in range(0, len(places), 1024):
            np.minimum(out, self.windows[places[at : at + 1024]].min(axis=0), out=out)
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, with the band's number in it."""
        parts = self.signature(hashes).reshape(self.bands, self.rows).astype(np.uint64)
        acc = (np.arange(self.bands, dtype=np.uint64) + np.uint64(1)) * MIX
        for k in range(self.rows):
            acc = _stir((acc ^ parts[:, k]) * MIX)
        return acc.view(np.int64)


_MINHASH: dict[tuple, CirculantMinHash] = {}


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _lists(sets: list[np.ndarray]) -> pa.Array:
    """Sets as a column of lists; null where a set is empty."""
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    values = pa.array(np.concatenate([np.empty(0, np.int64), *sets]))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([not len(x) for x in sets], pa.bool_()))


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays, without a copy."""
    values, ends = column.values.to_numpy(zero_copy_only=True), column.offsets.to_numpy()
    return [values[a:b].view(np.uint64) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("shingles", lambda: (_MINHASH.clear(), WORD_HASHES.clear()))
        if (bands, rows) not in _MINHASH:
            _MINHASH[bands, rows] = CirculantMinHash(bands, rows)
        minhash = _MINHASH[bands, rows]
        for batch in batches:
            found = [shingles(text, size) for text in batch.column(2).cast(pa.binary()).to_pylist()]
            digests = pa.array([_digest(x) if len(x) else None for x in found], pa.binary())
            keys = _lists([minhash.keys(x) if len(x) else x.view(np.int64) for x in found])
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), digests, keys]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n_shingles", "digest", "keys"])

    return run


def _full_sets(size: int):
    """Rows (node, text) with the whole set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("shingles", lambda: (_MINHASH.clear(), WORD_HASHES.clear()))
        for batch in batches:
            found = [shingles(text, size) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([x.view(np.int64) for x in found])], ["node", "hashes"])

    return run


def _compare(percent: int):
    """Rows (a, part, b, hashes), sorted: of each a and part first a's own set with a null b, then the sets that are held against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            good = []
            for k, (b, found) in enumerate(zip(batch.column(2).to_pylist(), _sets(batch.column(3)), strict=True)):
                if b is None:
                    own = found.copy()
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(found) - both):
                    good.append(k)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at)], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets(node, hashes) are similar enough.

    A node that many pairs name as a has its set sent once to each of the parts
    that its pairs are dealt over, not once a pair; b's set travels with the pair.
    Whoever needs a set is listed first, so that sets meet one list, once.
    """
    spark = pairs.sparkSession
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_PART).cast("int").alias("parts"))
    owners = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    many = materialise(parts.where("parts > 1"), "parts")
    dealt = join_groups(pairs, many.withColumn("__n", F.col("parts") * PAIRS_A_PART), "a", "__n")
    members = dealt.select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "b", F.col("b").alias("node"))
    ends = materialise(owners.unionByName(members), "ends")
    rows = _beside(sets, ends).select("a", "part", "b", "hashes").repartition(width(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_compare(percent), "a long, b long")


def _cross_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of left(key, node, n, comp) in different components that may be linked.

    Nothing that the percentage allows is lost, and members of a bucket are not
    paired with each other. A link needs an intersection of at least percent / (100
    + percent) of both sizes together. Only shingles that another component has as
    well can be in it: the s of them that a node has bound the size of a partner,
    most = s x (100 + percent) / percent - n. A node whose most is below its own
    size can only be the larger of a pair; one with too few for the least partner
    that its buckets leave it is out, and what it alone shared with others no
    longer counts. Of the shingles of a node, rarest first, so few can be missing
    from a partner that one of the first must be in it: that prefix is looked up
    among the shingles of larger components, and among those nodes alone that can
    take the other role: nodes that can only be the larger never meet each other.
    The shingles that a whole group has in common come last in that order, so a
    large group of near copies gives no pairs by them.
    """
    whole = 100 + percent
    need = lambda x, y: F.ceil(F.lit(percent) * (x + y) / F.lit(whole))
    most = F.floor(F.col("s") * whole / percent) - F.col("n")
    nodes = left.groupBy("node").agg(F.first("comp").alias("comp"), F.first("n").alias("n"))
    rows = materialise(_beside(sets, nodes).select("node", "comp", "n", F.explode("hashes").alias("token")), "tokens")
    keys = left.select("key", "node")
    tables = [rows]
    for _ in range(2):
        of_same = Window.partitionBy("token")  # one shuffle, where a join with the counted tokens takes two
        ends = rows.withColumn("lo", F.min("comp").over(of_same)).withColumn("hi", F.max("comp").over(of_same))
        shared = materialise(ends.where("lo <> hi").drop("lo", "hi"), "shared")
        counted = shared.groupBy("node").agg(F.count(F.lit(1)).alias("s"), F.first("n").alias("n")).withColumn("most", most)
        counted = materialise(counted, "counted")
        # The least partner: of the sizes in a bucket, only those of nodes that can be the smaller one of a pair count, or the node's own as the smaller.
        smaller = keys.join(counted.where("most >= n"), "node").groupBy("key").agg(F.min("n").alias("least"))
        least = keys.join(smaller, "key").groupBy("node").agg(F.min("least").alias("least"))
        alive = counted.join(least, "node").withColumn("least", F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100))).where(F.col("s") >= need(F.col("n"), F.col("least")))
        last = materialise(_beside(shared.select("node", "comp", "token"), materialise(alive, "alive")), "tokens")  # with s, n, most, least
        discard(left.sparkSession, shared)
        rows = last.select("node", "comp", "n", "token")
        tables.append(last)
    sizes = materialise(last.select("node", "comp").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("comp_n")), "sizes")
    weights = materialise(last.groupBy("comp").agg(F.count(F.lit(1)).alias("rows_n")).join(sizes, "comp").select("comp", "comp_n", "rows_n"), "weights")
    ranked = materialise(join_groups(last, weights, "comp", "rows_n", "inner").withColumn("rank", F.struct("comp_n", "comp")).drop("rows_n", "comp_n"), "ranked")
    of_token = ranked.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("rank").alias("top"))
    ordered = ranked.join(of_token, "token").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("df", "token")))
    probes = ordered.where((F.col("r") <= F.col("s") - need(F.col("n"), F.col("least")) + 1) & (F.col("rank") < F.col("top")))
    probes = materialise(probes.select("token", F.col("node").alias("x"), F.col("rank").alias("rank_x"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("most").alias("mx"), "r"), "probes")
    held = ranked.select("token", F.col("node").alias("y"), F.col("rank").alias("rank_y"), F.col("n").alias("ny"), F.col("s").alias("sy"), F.col("most").alias("my"))
    wanted = need(F.col("nx"), F.col("ny"))
    fits = (F.col("rank_x") < F.col("rank_y")) & (F.col("sy") >= wanted) & (F.col("r") <= F.col("sx") - wanted + 1)
    small = probes.join(held.where("my >= ny"), "token").where(fits)
    large = probes.where("mx >= nx").join(held.where("my < ny"), "token").where(fits)
    met = small.unionByName(large).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    met = materialise(met, "met")
    for used in (*tables, ranked, probes):
        discard(left.sparkSession, used)
    return met


def _beside(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows joined with nodes by their node: few rows of nodes, which are counted, are broadcast, so that rows stay where they are."""
    return rows.join(F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes, "node")


def _grouped(own: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """own(rid, doc_id, text), whose rids are the same in every scan, as (rid, doc_id, n_shingles, component_id)."""
    bound_batches(own.sparkSession)
    signed = materialise(own.mapInArrow(_sign(size, bands, rows), "rid long, doc_id long, n_shingles long, digest binary, keys array<long>"), "signatures")
    named = signed.where("doc_id is not null and digest is not null")
    firsts = materialise(named.groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "sets")
    lone = join_keys(signed.select(F.col("rid").alias("node"), F.col("n_shingles").alias("n"), "keys"), firsts, "node", "left_semi")
    buckets = lone.select("node", "n", F.explode("keys").alias("key"))
    counted = buckets.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key")))  # one shuffle of the buckets
    found = materialise(counted.where("members > 1"), "shared")  # node, n, key, members
    reach = found.groupBy("node").agg(F.sum("members").alias("reach"))
    members = materialise(found.drop("members").join(reach, "node"), "members")
    discard(own.sparkSession, found)
    # The sets of all nodes that share a bucket, made anew from their texts: those of all documents, 8 bytes a word, would be larger than the texts.
    texts = join_keys(own.select(F.col("rid").alias("node"), "text"), members.select("node").distinct(), "node", "left_semi")
    sets = materialise(texts.mapInArrow(_full_sets(size), "node long, hashes array<long>"), "members-sets")
    narrow = materialise(signed.select("rid", "doc_id", "n_shingles", "digest"), "rows")
    discard(own.sparkSession, signed)

    links = None
    tried = None
    roots = None
    grouped = members.withColumn("comp", F.col("node"))
    for turn in range(STAR_ROUNDS + 1):
        if turn == 0:
            left = grouped  # each member of a bucket is a component of its own
        else:
            open_keys = grouped.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            left = materialise(grouped.join(open_keys, "key", "left_semi"), "open")
        if turn < STAR_ROUNDS:
            # A later round takes the member with most reach outside the earlier centre's component.
            centre = left.groupBy("key").agg(F.max(F.struct("reach", "node", "comp", "n")).alias("c"))
            if turn:
                rest = left.join(centre.select("key", F.col("c.comp").alias("done")), "key").where("comp <> done")
                centre = rest.groupBy("key").agg(F.max(F.struct("reach", "node", "comp", "n")).alias("c"))
            # An intersection is no larger than the smaller set, a union no smaller than the larger one.
            near = F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent
            pairs = left.join(centre, "key").where(F.expr("comp <> c.comp") & near).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
        else:
            pairs = _cross_pairs(left, sets, percent)
        if tried is not None:
            # Held against both orders: an earlier centre may now be the member.
            pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            if turn < STAR_ROUNDS:
                continue
            break
        fresh = materialise(_confirmed(pairs, sets, percent), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = fresh if links is None else links.unionByName(fresh)
        roots = materialise(connected_components(links), "roots")
        if turn < STAR_ROUNDS:
            grouped = members.join(roots, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        if turn:
            discard(own.sparkSession, left)
    if links is None:
        found = firsts.select("digest", F.col("least").alias("component_id"), "copies")
    else:
        rooted = firsts.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
        found = rooted.join(least, "component").select("digest", "component_id", "copies")
    discard(own.sparkSession, sets)
    out = join_groups(narrow, materialise(found, "components"), "digest", "copies")
    own_id = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("rid", "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own_id).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 x intersection >= percent x union of their
    shingle sets; component_id is the smallest id reached over links. Equal sets
    are one node from the start, so copies never meet in a bucket. Nodes that
    share a band's bucket are candidates. A bucket is not paired out: first all
    its members are held against the one that meets most others, twice, and what
    that links is merged; between the components that are left, _cross_pairs()
    finds every pair that can be linked. There is no cap. Every link is confirmed
    on the full sets of the whole texts: these are read once for the signatures,
    and those of nodes that share a bucket once more for their sets. Texts are
    shuffled only where such nodes are more than a broadcast holds.

    Null and wordless texts have the empty set and are linked with nothing. A
    text of fewer words than a shingle is one shingle. Repeated rows are equal
    sets. A row with a null id takes no part: its component_id is null, and it is
    kept. Empty tables give no rows; other columns are ignored.
    """
    keyed, key = with_row_key(docs)
    own = keyed.select(F.col(key).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = _grouped(own, size, percent, bands, rows)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group only, that of the smallest id; all columns kept.

    Rows are told apart by a key of their own, not by their ids: a row that shares
    its id with a near copy stays. Of rows of one group that share its smallest id
    the first stays. Null ids, null and wordless texts stay.
    """
    keyed, key = with_row_key(docs)
    own = keyed.select(F.col(key).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = materialise(_grouped(own, SHINGLE_WORDS, SIMILARITY, BANDS, ROWS), "grouped")
    placed = out.where("doc_id is not null and n_shingles > 0")
    least = placed.where("doc_id = component_id").groupBy("component_id").agg(F.min("rid").alias("rid"))
    return without_rows(keyed, key, materialise(placed.select("rid").join(least.select("rid"), "rid", "left_anti"), "gone"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
"""
