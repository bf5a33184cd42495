import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from factloom.llm.resample import OP13_SQL, op13_importance_resample, resample, sql_crc32

SCHEMA = "doc_id long, text string, n_words string, buckets int, g1 string, rank int"
TARGET = ["the quick brown fox jumps over the lazy dog", "Pack my box with five dozen jugs", None, "", "été 1999 où the quick"]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent, least):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for doc_id, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in f)
        rows.append((doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    open_ = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = percent * len(open_) // 100
    out = [(r[0], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(open_)]
    return sorted(map(str, out + [(r[0], *r[2:], None) for r in rows if r[1] < least]))


def rows(df):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


DOCS = [(i, " ".join(f"w{(i * k) % 17} the quick" if k % 3 else "Fox, über-ÄSTHETIK" for k in range(i % 9))) for i in range(120)]
DOCS += [(None, "the quick brown fox " * 6), (None, None), (500, None), (501, ""), (502, "... ,, \n"), (503, "a"), (504, "a B"), (7, "the quick brown fox jumps over " * 4), (7, "the quick brown fox jumps over " * 4), (505, "längst " * 5000)]


@pytest.mark.parametrize("percent, least", [(5, 20), (50, 3), (100, 0), (0, 1)])
def test_brute_force(spark, percent, least):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in DOCS], SCHEMA).repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample(docs, target, percent=percent, least_words=least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(got) == brute(DOCS, TARGET, percent, least)


@pytest.mark.parametrize("docs, target", [([], TARGET), (DOCS[:30], []), ([], [])])
def test_empty_tables(spark, docs, target):
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, least_words=2)
    assert rows(got) == brute(docs, target, 30, 2)


def test_target_like_texts_are_drawn(spark):
    plain = [(i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(40))) for i in range(190)]
    wanted = [(1000 + i, " ".join(f"t{(i + k) % 11}" for k in range(40))) for i in range(10)]
    target = spark.createDataFrame([(" ".join(f"t{(i + k) % 11}" for k in range(60)),) for i in range(5)], "text string")
    got = resample(spark.createDataFrame(plain + wanted, "doc_id long, text string"), target).where("rank is not null").collect()
    assert {r.doc_id for r in got} == {i for i, _ in wanted} and sorted(r["rank"] for r in got) == list(range(1, 11))


def test_only_counts_are_shuffled(spark):
    docs = spark.createDataFrame(DOCS[:40], "doc_id long, text string")
    plan = resample(docs, docs)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = rows(op13_importance_resample(spark, sf))
    assert got == sorted(map(str, con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({OP13_SQL})").fetchall()))


def test_sql_checksum():
    texts = ["", "a", "abc def", "é\U0001f600 x"]
    head = OP13_SQL.split("\nd AS")[0].rstrip(",")
    got = duckdb.sql(f"{head} SELECT {sql_crc32('x')} FROM (SELECT unnest({texts!r}) AS x), crc_table").fetchall()
    assert [r[0] for r in got] == [zlib.crc32(t.encode()) for t in texts]
