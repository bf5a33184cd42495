import re
import zlib

import pandas as pd
import pytest

import corpus_pipeline
from factloom.llm.language_id import identify_languages

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def survivors(docs: dict, predicted: dict, items: list[str]) -> set:
    """The ids that brute force keeps after all filtering stages."""
    left = {k: t for k, t in docs.items() if predicted[k]}
    best = {}
    for k, t in left.items():
        best[t.translate(LOW)] = max(k, best.get(t.translate(LOW), k))
    left = {k: left[k] for k in best.values()}
    sets = {}
    for k, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in left}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(left)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {k: t for k, t in left.items() if find(k) == k}
    windows = set()
    for t in items:
        w = WORD.findall((t or "").translate(LOW))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    out = set()
    for k, t in left.items():
        w = WORD.findall(t.translate(LOW))
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            out.add(k)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_against_brute_force(spark, documents):
    docs = {r.doc_id: r.text for r in documents.collect()}
    known = {r.doc_id: r.lang_pred != "und" and r.score >= 1.1 / documents.select("lang").distinct().count() for r in identify_languages(documents).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = survivors(docs, known, items)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == want and 0 < len(want) < len(docs)
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()


def test_stages_keep_the_columns_of_documents(spark, documents):
    extra = documents.selectExpr("*", "text as key", "doc_id as node", "lang as sha")
    rows = [(None, None, None, None, None, None, None, None), (10**6, "", "en", "s", 0, "k", 1, "h"), (10**6 + 1, "Só uma frase " * 4000, None, None, None, None, None, None)]
    docs = extra.limit(30).union(spark.createDataFrame(rows, extra.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == extra.columns
        assert docs.dtypes == extra.dtypes
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 10**6 + 1 in left and 10**6 not in left
    assert isinstance(docs.toPandas(), pd.DataFrame) and zlib.crc32(b"") == 0


def test_no_documents(spark, documents, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
