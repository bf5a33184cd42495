import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm.token_store import IndexBucket, PerfectHash, TokenStore, op5_token_ids, token_spans, write_store


def expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def key(row):
    return (row[0] is not None, *row) if row[0] is not None else (False, 0, *row[1:])


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op5_token_ids(spark, sf).collect())) == sorted(expected(rows))


def test_nulls_repeats_and_no_rows(spark):
    rows = [(5, None, 1), (5, "b c", 1), (5, "b c", 1), (5, "a", 1), (None, "x y", 1), (-3, "", 1), (9, "word " * 30000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = [tuple(r) for r in token_spans(df).collect()]
    assert sorted(got, key=key) == sorted(expected([r[:2] for r in rows]), key=key)
    assert token_spans(df.limit(0)).count() == 0


def test_keyed_access(spark, tmp_path):
    rows = [(k * 7, f"text number {k}") for k in range(500)] + [(None, "null id"), (7, "zz again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store, _ = write_store(df, f"file://{tmp_path}")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc, nth, text in [(0, 0, "text number 0"), (7 * 499, 0, "text number 499"), (None, 0, "null id"), (7, 0, "text number 1"), (7, 1, "zz again")]:
        assert list(store.get(doc, nth)) == [*t.encode(text, add_special_tokens=False).ids, 1]
    assert store.get(3) is None and store.get(7, 2) is None


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    keys = np.unique(keys)
    built = PerfectHash.build(keys)
    assert sorted(built.place(keys)) == list(range(len(keys)))
    index = IndexBucket.build(keys, keys % 7, keys % 1000, keys % 50)
    again = IndexBucket.from_bytes(index.to_bytes())
    known, shard, at, n = again.find(keys)
    assert known.all() and (shard == keys % 7).all() and (at == keys % 1000).all() and (n == keys % 50).all()
    assert again.find(keys + np.uint64(1))[0].mean() < 0.001
    assert not IndexBucket.build(keys[:0], keys[:0], keys[:0], keys[:0]).find(keys)[0].any()


def test_one_id_over_many_shards(spark, tmp_path):
    rows = [(None, f"text {k % 50} of nobody") for k in range(400)] + [(4, f"{k} again") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in token_spans(df, folder=f"file://{tmp_path}").collect()), key=key) == sorted(expected(rows), key=key)
    store = TokenStore.open(f"file://{tmp_path}")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = sorted((x for d, x in rows if d is None), key=str.encode)
    for nth in (0, 137, 399):
        assert list(store.get(None, nth)) == [*t.encode(texts[nth], add_special_tokens=False).ids, 1]
    assert store.get(None, 400) is None
