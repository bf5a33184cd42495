import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from factloom.llm.period_runs import OP11_SQL, find_runs, op11_period_runs, period_runs, split_words

WORD = r"[^\x20\x09-\x0D]+"


def brute(w):
    """All runs by their definition: for each period the stretches that keep it, without those that have a smaller one."""
    runs = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                runs.setdefault((start, i - start + q), q)  # the smallest period comes first
            i += i == start
    return sorted(((s, n, q) for (s, n), q in runs.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted):
    w = re.findall(WORD, text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(text)), runs, text


def sequences():
    rng = random.Random(3)
    for _ in range(700):
        w = []
        while len(w) < rng.choice([10, 30, 60, 120, 250]):
            some = rng.choice([1, 2, 3, 5, 50])
            x = [rng.randrange(some) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 15, 16, 17, 31, 33]))] * rng.choice([1, 2, 3, 4, 7])
            w += x[: len(x) - rng.randrange(3)]
            w += [rng.randrange(100) for _ in range(rng.randrange(5) * (rng.random() < 0.3))]
        yield w[:300]


def test_runs_against_brute_force():
    found = 0
    for w in sequences():
        want = brute(w)
        found += len(want)
        assert find_runs(np.array(w, np.int32)) == want, w
    assert found > 300


@pytest.mark.parametrize("w, want", [
    ([], []),
    ([1] * 23, []),
    ([1] * 24, [(0, 24, 1)]),
    ([1, 2] * 11 + [1], []),
    ([0] + [1, 2, 3, 4, 5, 6, 7, 8, 9] * 3 + [1], [(1, 28, 9)]),
    ([1] * 30 + [2] * 30, [(0, 30, 1), (30, 30, 1)]),
])
def test_small(w, want):
    assert find_runs(np.array(w, np.int32)) == want


def test_long_texts_are_searched_in_about_linear_time():
    fib, last = [0, 1], [0]
    while len(fib) < 30_000:
        fib, last = fib + last, fib
    for w in ([1] * 100_000, [1, 2] * 50_000, list(np.random.default_rng(1).integers(0, 900, 30_000)) * 3, ([1] * 4999 + [2]) * 20, fib):
        began = time.time()
        runs = find_runs(np.array(w, np.int32))
        assert time.time() - began < 20 and runs
    assert find_runs(np.array(([1] * 4999 + [2]) * 20, np.int32))[-1] == (95_000, 4999, 1)
    assert (0, 100_000, 5000) in find_runs(np.array(([1] * 4999 + [2]) * 20, np.int32))


def test_words_are_cut_at_ascii_white_space_alone():
    texts = ["  a b\x0b\x0cc\x1d d e \x85\x1c x y", None, "", " \n", "é z\tq\r\nw"]
    words, bounds = split_words(pa.array(texts))
    assert [words.slice(a, b - a).to_pylist() for a, b in zip(bounds, bounds[1:], strict=False)] == [re.findall(WORD, t or "") for t in texts]


TEXTS = [None, "", "  \n", "a", "a " * 40, ("one two three " * 12 + "end ") * 3, " ".join(f"w{i}" for i in range(60)), "x y\x1cz " * 30, "p q " * 13 + " ".join(f"v{i}" for i in range(9)) + " p q" * 13]


@pytest.mark.parametrize("planted", [False, True])
def test_rows_against_brute_force(spark, planted):
    docs = [(i, t) for i in range(40) for t in TEXTS[i % 9 :][:1]] + [(i, " ".join(f"u{k % 71}" for k in range(i))) for i in range(60, 140)]
    docs += [(None, "a " * 30), (5, "a " * 40), (5, "a " * 40), (900, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, period int, collapsed string").repartition(3)
    got = period_runs(df, planted=planted).collect()
    want = [expected(i, t, planted) for i, t in docs]
    assert sorted(str(tuple(r)[:8]) for r in got) == sorted(str(w[0]) for w in want)
    assert sorted(str((r.doc_id, [tuple(x) for x in r.runs], r.collapsed)) for r in got) == sorted(str((w[0][0], w[1], w[2])) for w in want)
    if planted:
        assert any(w[1] for (i, _), w in zip(docs, want, strict=True) if i and 60 <= i < 140)


def test_empty_table(spark):
    assert period_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op11_period_runs(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP11_SQL})").fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 50
