"""Token ids in raw shards, found by a minimal perfect hash index."""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, materialise, scratch_path, table, width
from factloom.llm.tokens import encoder, with_end

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"IDS1"
HEAD = "<4sI"  # the mark, and the bytes of an id
#: Keys an index bucket is meant to hold; more keys give more buckets.
KEYS_PER_BUCKET = 1 << 16
#: Bytes of text that a shard is meant to hold, where that gives more shards than the session has shuffle partitions.
SHARD_BYTES = 256 << 20
#: Characters of the text by which the rows of one id are dealt over shards.
PREFIX_CHARS = 16
#: Bits of a level's table per key that is still without a place.
SPREAD = 2
_SEED = 0x9E3779B97F4A7C15


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(salt * _SEED % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each has a place of its own below their number.

    Level by level every key without a place is hashed into a bit table; keys
    alone in their bit take it, the others go on to the next level. A key's place
    is the number of bits set before its own, over all levels. Unknown keys get
    some place, or -1; a stored fingerprint tells them apart.

    A level is kept as blocks of BLOCK_BITS bits behind the number of bits set
    before them. One lookup reads one block a level, and half of the keys end in
    the first: the cost does not depend on the number of keys.
    """

    BLOCK_BITS = 256
    BLOCK = np.dtype([("before", "<u8"), ("bits", "u1", BLOCK_BITS // 8)])

    def __init__(self, sizes: list[int], blocks: list[np.ndarray]):
        self.sizes, self.blocks = sizes, blocks
        self.bits = [np.unpackbits(b["bits"].reshape(-1)) for b in blocks]
        self.ranks = []
        for bits, b in zip(self.bits, blocks, strict=True):
            inside = np.cumsum(bits.reshape(-1, self.BLOCK_BITS), axis=1, dtype=np.int64).ravel() - bits
            self.ranks.append(np.repeat(b["before"].astype(np.int64), self.BLOCK_BITS) + inside)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, blocks, left, before = [], [], keys.astype(np.uint64), 0
        while len(left):
            if len(sizes) > 200:
                raise ValueError("keys of a perfect hash must differ")
            size = max(8, SPREAD * len(left))
            at = (_mixed(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=-(-size // cls.BLOCK_BITS) * cls.BLOCK_BITS)
            alone = (hits == 1).astype(np.uint8).reshape(-1, cls.BLOCK_BITS)
            block = np.zeros(len(alone), cls.BLOCK)
            ones = alone.sum(axis=1, dtype=np.int64)
            block["before"] = before + np.cumsum(ones) - ones
            block["bits"] = np.packbits(alone, axis=1)
            before += int(ones.sum())
            sizes.append(size)
            blocks.append(block)
            left = left[hits[at] > 1]
        return cls(sizes, blocks)

    def place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            if not len(todo):
                break
            at = (_mixed(keys[todo], level + 1) % np.uint64(size)).astype(np.int64)
            hit = bits[at] == 1
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes)
        return head + b"".join(b.tobytes() for b in self.blocks)

    @classmethod
    def _head(cls, f) -> tuple[list[int], int]:
        (n,) = struct.unpack("<I", f.read(4))
        sizes = list(struct.unpack(f"<{n}Q", f.read(8 * n)))
        return sizes, sum(-(-s // cls.BLOCK_BITS) for s in sizes) * cls.BLOCK.itemsize

    @classmethod
    def read(cls, f) -> PerfectHash:
        sizes, _ = cls._head(f)
        return cls(sizes, [np.frombuffer(f.read(-(-s // cls.BLOCK_BITS) * cls.BLOCK.itemsize), cls.BLOCK) for s in sizes])

    @classmethod
    def seek(cls, f, key: np.ndarray) -> tuple[int, int]:
        """(place of one key, end of the hash in the file), from one block a level."""
        sizes, length = cls._head(f)
        begin = f.tell()
        end, place = begin + length, -1
        for level, size in enumerate(sizes):
            at = int(_mixed(key, level + 1)[0] % np.uint64(size))
            block, bit = divmod(at, cls.BLOCK_BITS)
            f.seek(begin + block * cls.BLOCK.itemsize)
            held = np.frombuffer(f.read(cls.BLOCK.itemsize), cls.BLOCK)[0]
            bits = np.unpackbits(held["bits"])
            if bits[bit]:
                place = int(held["before"]) + int(bits[:bit].sum())
                break
            begin += -(-size // cls.BLOCK_BITS) * cls.BLOCK.itemsize
        return place, end


def key_of(doc_id: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The index key of the nth row (from 0) with an id; ids of their first rows are their own keys."""
    return doc_id.astype(np.int64).view(np.uint64) ^ _mixed(nth.astype(np.uint64), 7) * (nth > 0).astype(np.uint64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 99) >> np.uint64(32)).astype(np.uint32)


class IndexBucket:
    """A perfect hash of one bucket's keys, then by place a record of fingerprint, shard, offset and length."""

    RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])

    def __init__(self, hashed: PerfectHash, records: np.ndarray):
        self.hashed, self.records = hashed, records

    @classmethod
    def build(cls, keys: np.ndarray, shards: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> IndexBucket:
        hashed = PerfectHash.build(keys)
        records = np.zeros(len(keys), cls.RECORD)
        at = hashed.place(keys)
        for field, values in zip(cls.RECORD.names, (fingerprint(keys), shards, offsets, lengths), strict=True):
            records[field][at] = values
        return cls(hashed, records)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(known, shard, offset, length) for each key."""
        at = self.hashed.place(keys)
        if not len(self.records):
            none = np.zeros(len(keys), np.int64)
            return none.astype(bool), none, none, none
        held = self.records[np.maximum(at, 0)]
        known = (at >= 0) & (held["print"] == fingerprint(keys))
        return known, held["shard"], held["at"], held["n"]

    def to_bytes(self) -> bytes:
        return self.hashed.to_bytes() + self.records.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> IndexBucket:
        f = io.BytesIO(raw)
        return cls(PerfectHash.read(f), np.frombuffer(f.read(), cls.RECORD))

    @classmethod
    def seek(cls, f, key: np.ndarray) -> tuple[int, int, int] | None:
        """(shard, offset, length) of one key: a block a level and one record are read, however many keys there are."""
        place, end = PerfectHash.seek(f, key)
        if place < 0:
            return None
        f.seek(end + place * cls.RECORD.itemsize)
        held = np.frombuffer(f.read(cls.RECORD.itemsize), cls.RECORD)
        if not len(held) or held["print"][0] != fingerprint(key)[0]:
            return None
        return int(held["shard"][0]), int(held["at"][0]), int(held["n"][0])


def _files(folder: str):
    """The file system of a folder, under the scheme names that Spark uses."""
    from pyarrow import fs

    scheme, mark, rest = folder.partition(":")
    if not mark or folder.startswith("/"):
        return fs.FileSystem.from_uri(folder)
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}.get(scheme, scheme) + ":" + ("//" + rest if not rest.startswith("//") else rest))


class _Out:
    """A new file whose name has the task's attempt in it: attempts never write over each other's.

    Which attempt counts is known from the rows that Spark commits; files of
    others are never read.
    """

    def __init__(self, folder: str, stem: str):
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        self.attempt = context.taskAttemptId() if context else 0
        self.file = files.open_output_stream(f"{root}/{stem}-{self.attempt}", compression=None)

    def __enter__(self) -> _Out:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _get(folder: str, name: str):
    files, root = _files(folder)
    return files.open_input_file(f"{root}/{name}")


def _ids_at(f, at: int, n: int) -> np.ndarray:
    """n ids of a shard from place at, with 32 bits each."""
    f.seek(0)
    mark, step = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
    if mark != MAGIC:
        raise ValueError("a shard is not in the format")
    f.seek(struct.calcsize(HEAD) + step * at)
    raw = f.read(step * n)
    if len(raw) != step * n:
        raise ValueError("a shard ends early")
    return np.frombuffer(raw, f"<u{step}").astype("<u4")


def _write_shard(folder: str, name: str, end_id: int):
    """Writes a partition's ids batch by batch, and gives a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder = TaskContext.get().partitionId(), encoder(name)
        kind = "<u2" if max(coder.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        with _Out(folder, f"shard-{shard:06d}") as out:
            out.file.write(struct.pack(HEAD, MAGIC, np.dtype(kind).itemsize))
            base, last, count = 0, None, 0
            for batch in batches:
                if not len(batch):
                    continue
                doc = batch.column(0).to_numpy()
                ids, ends = with_end(*coder.encode_batch(batch.column(1)), end_id)
                out.file.write(ids.astype(kind).tobytes())
                sizes = np.diff(ends, prepend=0)
                fresh = np.r_[last is None or doc[0] != last, doc[1:] != doc[:-1]]
                firsts = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), -1))
                nth = np.where(firsts >= 0, np.arange(len(doc)) - firsts, count + np.arange(len(doc)))
                last, count = doc[-1], int(nth[-1]) + 1
                columns = [doc, nth, np.full(len(doc), shard, np.int32), np.full(len(doc), out.attempt, np.int64), base + ends - sizes, sizes]
                base += int(ends[-1])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "nth", "shard", "attempt", "at", "n"])

    return run


def _write_index(folder: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        keys = key_of(frame["doc_id"].to_numpy(), frame["nth"].to_numpy())
        built = IndexBucket.build(keys, frame["shard"].to_numpy(), frame["at"].to_numpy(), frame["n"].to_numpy())
        with _Out(folder, f"index-{bucket:06d}") as out:
            out.file.write(built.to_bytes())
            return pd.DataFrame({"bucket": [bucket], "attempt": [out.attempt], "keys": [len(keys)]})

    return run


def _look_up(folder: str, names: dict[int, str]):
    """Rows of one bucket, with the places that the index gives."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        with _get(folder, names[int(frame["bucket"].iloc[0])]) as f:
            index = IndexBucket.from_bytes(f.read())
        known, shard, at, n = index.find(key_of(frame["doc_id"].to_numpy(), frame["nth"].to_numpy()))
        if not known.all():
            raise ValueError("a key of the corpus is not in its index")
        return pd.DataFrame({"doc_id": frame["doc_id"], "shard": shard.astype(np.int32), "at": at.astype(np.int64), "n": n.astype(np.int64)})

    return run


def _read_back(folder: str, names: dict[int, str], bases: dict[int, int], null_id: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, f = None, None
        for frame in frames:
            crcs = []
            for shard, at, n in zip(frame["shard"], frame["at"], frame["n"], strict=True):
                if shard != held:
                    if f:
                        f.close()
                    held, f = shard, _get(folder, names[shard])
                crcs.append(zlib.crc32(_ids_at(f, at, n).tobytes()))
            start = frame["shard"].map(bases).to_numpy(np.int64) + frame["at"].to_numpy()
            ids = frame["doc_id"].astype("Int64").mask(frame["doc_id"] == null_id)
            yield pd.DataFrame({"doc_id": ids, "start": start, "n_tokens": frame["n"], "ids_crc32": np.array(crcs, np.int64)})

    return run


class TokenStore:
    """Raw little-endian ids in shards of ascending doc_id, with an index by id.

    shard-*: four bytes "IDS1", the bytes of an id (2 where the vocabulary allows,
    else 4) as 32 bits, then the ids of its documents in a row. index-*: a bucket
    of keys: the perfect hash, then by place a record of fingerprint, shard, offset
    and length. bases[shard] has the ids before it. manifest.json holds the names
    of the files that count, so that a store is opened again by its folder.
    """

    #: Null ids come before all others and are held under this key.
    NULL_ID = -(2**63)

    def __init__(self, folder: str, shards: dict[int, str], bases: dict[int, int], index: dict[int, str], buckets: int):
        self.folder, self.shards, self.bases, self.index, self.buckets = folder, shards, bases, index, buckets

    def save(self) -> TokenStore:
        files, root = _files(self.folder)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/manifest.json", compression=None) as f:
            f.write(json.dumps({"shards": self.shards, "bases": self.bases, "index": self.index, "buckets": self.buckets}).encode())
        return self

    @classmethod
    def open(cls, folder: str) -> TokenStore:
        with _get(folder, "manifest.json") as f:
            held = json.loads(f.read())
        numbered = ({int(k): v for k, v in held[name].items()} for name in ("shards", "bases", "index"))
        return cls(folder, *numbered, held["buckets"])

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of one document by key, or None: a few blocks of the index and one range of a shard are read."""
        key = key_of(np.array([self.NULL_ID if doc_id is None else doc_id], np.int64), np.array([nth]))
        bucket = int(_bucket_of(key, self.buckets)[0])
        if bucket not in self.index:
            return None
        with _get(self.folder, self.index[bucket]) as f:
            found = IndexBucket.seek(f, key)
        if not found:
            return None
        shard, at, n = found
        with _get(self.folder, self.shards[shard]) as f:
            return _ids_at(f, at, n)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(keys, 5) % np.uint64(buckets)).astype(np.int64)


def _keyed(buckets: int, carry: dict[int, tuple[int, int]]):
    """Rows with the nth row of their id over all shards, and the bucket of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, nth, shard = (batch.column(k).to_numpy() for k in range(3))
            for s in np.unique(shard).tolist():
                if s in carry:
                    nth = nth + np.where((shard == s) & (doc == carry[s][0]), carry[s][1], 0)
            bucket = _bucket_of(key_of(doc, nth), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nth), *(batch.column(k) for k in (2, 4, 5)), pa.array(bucket)], ["doc_id", "nth", "shard", "at", "n", "bucket"])

    return run


def write_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, end_id: int = END_ID) -> tuple[TokenStore, DataFrame]:
    """Writes docs to folder and returns the store and its keys (doc_id, nth, bucket).

    The rows are dealt by ranges of id and of the first characters of the text, so
    that rows that share one id, such as null, are spread as well; each range is
    tokenised in order and written as one shard of about SHARD_BYTES of text.
    Files carry their task's attempt in the name, and only those whose rows Spark
    has committed are listed, so lost or repeated tasks do no harm. Rows that
    repeat an id are in the order of their texts, and the nth of them has a key of
    its own. The driver gets a row a shard and a row a bucket.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(TokenStore.NULL_ID))
    own = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    shards = max(width(spark), -(-size // SHARD_BYTES))
    dealt = own.repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, PREFIX_CHARS).asc_nulls_first()).sortWithinPartitions("doc_id", F.col("text").asc_nulls_first())
    rows = materialise(dealt.mapInArrow(_write_shard(folder, name, end_id), "doc_id long, nth long, shard int, attempt long, at long, n long"), "token-rows")
    ends = rows.groupBy("shard", "attempt").agg(
        F.sum("n").alias("ids"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max_by("nth", F.struct("doc_id", "nth")).alias("nth"),
    ).collect()  # a row a shard
    base, total, carry, before = {}, 0, {}, (None, 0)
    for r in sorted(ends, key=lambda r: r["shard"]):
        base[r["shard"]] = total
        total += r["ids"]
        if r["first"] == before[0]:
            carry[r["shard"]] = before
        before = (r["last"], r["nth"] + 1 + (before[1] if r["first"] == r["last"] == before[0] else 0))
    buckets = max(width(spark), -(-sum(r["docs"] for r in ends) // KEYS_PER_BUCKET))
    keyed = rows.mapInArrow(_keyed(buckets, carry), "doc_id long, nth long, shard int, at long, n long, bucket int")
    built = materialise(keyed.groupBy("bucket").applyInPandas(_write_index(folder), "bucket int, attempt long, keys long"), "token-index").collect()  # a row a bucket
    store = TokenStore(
        folder, {r["shard"]: f"shard-{r['shard']:06d}-{r['attempt']}" for r in ends}, base,
        {r["bucket"]: f"index-{r['bucket']:06d}-{r['attempt']}" for r in built}, buckets,
    )
    return store.save(), keyed.select("doc_id", "nth", "bucket")


def token_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """One row per row of docs, from the files written: doc_id, start, n_tokens, ids_crc32.

    Every key is looked up in the index; the ranges found are then read shard by
    shard. Null and empty texts are the end id alone. Null ids come first. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    store, keys = write_store(docs, folder, id_col, text_col, name, end_id)
    found = keys.groupBy("bucket").applyInPandas(_look_up(folder, store.index), "doc_id long, shard int, at long, n long")
    by_shard = found.repartition(width(spark), "shard").sortWithinPartitions("shard", "at")
    return by_shard.mapInPandas(_read_back(folder, store.shards, store.bases, TokenStore.NULL_ID), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans(table(spark, sf_dir, "documents"))
