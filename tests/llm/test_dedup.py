import hashlib

import numpy as np
import pytest

from factloom.llm.common import connected_components, number_rows
from factloom.llm.exact_dedup import CountingQuotientFilter, drop_exact_copies, exact_dedup, repeated_fingerprints
from factloom.llm.near_dedup import CirculantMinHash, drop_near_copies, near_duplicates, shingles

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(4)] + [np.full(7, 2**64 - 1, np.uint64), np.zeros(3, np.uint64), np.empty(0, np.uint64)]
    parts.append(np.concatenate([parts[0][:50], parts[1][:5]]))
    filters = [CountingQuotientFilter.build(p, np.ones(len(p), np.int64)) for p in parts]
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters])
    want, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.fingerprints() == want).all() and (merged.counts == counts).all()
    cut = list(merged.split(4))
    assert [k for k, _ in cut] == sorted({int(x >> np.uint64(60)) for x in want})
    assert (np.concatenate([f.fingerprints() for _, f in cut]) == want).all()
    assert CountingQuotientFilter.merge([]).counts.size == 0


def test_repeated_fingerprints(spark):
    df = spark.createDataFrame([(-5, 1), (-5, 1), (7, 1), (9, 3), (0, 1)], "fp long, copies long").repartition(3)
    assert {(r.fp, r.n) for r in repeated_fingerprints(df, 5).collect()} == {(-5, 2), (9, 3)}


ROWS = [(3, "A b", "en"), (1, "a B", "de"), (2, None, "x"), (4, "", None), (5, "É", "fr"), (6, "é", "fr"), (7, "a b", "en"), (7, "a b", "en"), (8, "x " * 40000, "en"), (9, "X " * 40000, "en"), (None, "q", "en"), (None, "z", "en"), (10, "Z", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id long, text string, sha string, fp string")


def test_exact_groups(spark, docs):
    groups = {}
    for k, t, _ in ROWS:
        groups.setdefault((t or "").translate(LOW), []).append(k)
    want = []
    for k, t, _ in ROWS:
        own = groups[(t or "").translate(LOW)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((k, keep, len(own), hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()))
    got = exact_dedup(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(str, want))
    assert sorted(str(r.doc_id) for r in got if r.kept) == sorted(map(str, [7, 4, 5, 6, 9, None, 10]))
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [7, 4, 5, 6, 9, None, 10]))
    assert exact_dedup(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    mh = CirculantMinHash(64, 4)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 600).astype(np.uint64)
    other = np.unique(np.r_[base[:480], rng.integers(0, 2**63, 120).astype(np.uint64)])
    agree = (mh.signature(np.unique(base)) == mh.signature(other)).mean()
    assert abs(agree - 480 / 720) < 0.1
    assert (mh.keys(other) == mh.keys(other)).all() and len(set(mh.keys(other).tolist())) == 64


def test_shingles_follow_the_definition():
    assert len(shingles(b"a b c d")) == 1 and len(shingles(b"")) == len(shingles(None)) == len(shingles(b" \t\x0b")) == 0
    assert len(shingles(b"a b c d e f")) == 2 and (shingles(b"A  B\nC d") == shingles(b"a b c D")).all()
    assert (shingles("a b c d e".encode()) != shingles(b"a b c d e")).any()


def brute(rows):
    sets = {}
    for k, t in rows:
        w = [x for x in (t or "").translate(LOW).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.setdefault(k, []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = sorted(sets)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if both and 100 * both >= 75 * (len(x) + len(y) - both):
                        p, q = sorted((find(a), find(b)))
                        root[q] = p
    return {k: find(k) for k in ids}


def test_near_groups_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "one two three")]
    for k in range(60):  # near copies at all distances, chains among them
        t = list(base)
        for _ in range(k % 9):
            t[rng.integers(120)] = f"x{rng.integers(10**6)}"
        rows.append((100 + k, " ".join(t)))
    for k in range(40):
        rows.append((300 + k, " ".join(base[:50] + list(rng.choice(words, 40)))))
    rows += [(500, " ".join(base) + " tail"), (500, " ".join(base) + " tail"), (501, " ".join(base * 60))]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, node long, digest string")
    got = near_duplicates(df).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert drop_near_copies(df).columns == df.columns
    null = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(null).collect()) == [("1", "1", True), ("None", "None", True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_and_numbering(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 160)} | {200: 200}
    df = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(None, 1)], "g int, v long")
    rows = number_rows(df, ["g"], ["v"], "n", ["v"]).collect()
    for g in (0, 1, 2, None):
        own = sorted(r.n for r in rows if r.g == g)
        assert own == list(range(len(own)))


def test_a_row_does_not_go_with_its_namesake(spark, tmp_path):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [(1, " ".join(base)), (5, near), (5, "a text of its own"), (None, " ".join(base)), (None, None), (7, "x y"), (7, "X  y"), (7, "x y")]
    written = f"{tmp_path}/docs"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(written)
    for d in (df, spark.read.parquet(written)):  # with and without files to know rows by
        assert {(r.doc_id, r.text) for r in drop_near_copies(d).collect()} >= {(1, rows[0][1]), (5, "a text of its own"), (None, rows[0][1]), (None, None)}
        assert (5, near) not in {(r.doc_id, r.text) for r in drop_near_copies(d).collect()}
        assert sorted(str(tuple(r)) for r in drop_exact_copies(d).collect()) == sorted(str(r) for r in [*rows[:3], rows[4], rows[5], rows[6]])


def test_templates_with_a_shorter_member(spark):
    """Documents that share a long passage and are not linked meet only the short one in their buckets."""
    rng = np.random.default_rng(3)
    shared = [f"s{k}" for k in range(104)]
    rows = [(k, " ".join(shared + [f"d{k}w{j}" for j in range(24 + k % 2)])) for k in range(120)]
    rows += [(500, " ".join(shared)), (501, " ".join([*shared[:100], "q", "r"]))] + [(600 + k, " ".join(rng.permutation(shared))) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == brute(rows)


def test_filters_merge_in_order_and_look_up():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    parts = [CountingQuotientFilter.build(x, np.ones(len(x), np.int64)) for x in np.split(np.r_[prints, prints[:1500]], 9)]
    whole = CountingQuotientFilter.merge(parts)
    held = whole.fingerprints()
    assert (np.diff(held.astype(object)) > 0).all() and len(held) == len(np.unique(prints))
    assert [whole.count(int(p)) for p in (*prints[:5], *prints[-5:], 12345)] == [2] * 5 + [1] * 5 + [0]


def test_near_duplicates_compare_only_sets_whose_sizes_allow_a_link(spark, monkeypatch):
    """Pairs of sizes that cannot be linked are not sent; here by the forms for more rows than are broadcast."""
    from factloom.llm import common, near_dedup

    words = [f"w{i}" for i in range(300)]
    rows = [(10 * k + j, " ".join(words[40 * k : 40 * k + int(40 * 1.6**j)])) for k in range(2) for j in range(4)]  # each begins as the longer ones do
    rows += [(100 + k, " ".join(words[40 * k : 40 * k + 40] + ["end"])) for k in range(2)]  # near copies of the shortest ones
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    size = [len(t.split()) - 4 for _, t in rows]
    sent, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, sets, percent: (sent.extend((r.a, r.b) for r in pairs.collect()), confirmed(pairs, sets, percent))[1])
    monkeypatch.setattr(near_dedup, "BROADCAST_NODES", 0)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    found = near_dedup.near_duplicates(docs, bands=64, rows=1).collect()
    assert sent and all(100 * min(size[a], size[b]) >= 75 * max(size[a], size[b]) for a, b in sent)
    assert {r.doc_id: r.component_id for r in found} == {i: i if i < 100 else 10 * (i - 100) for i, _ in rows}


def test_only_sets_of_texts_that_share_a_bucket_are_written(spark, monkeypatch, tmp_path):
    """Of all texts only signatures are kept, which are smaller than sets; a set goes to its pairs by one join."""
    from factloom.llm import near_dedup

    rng = np.random.default_rng(11)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 400))) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " end") for k in range(3)] + [(200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    kept, write = {}, near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, name: kept.setdefault(name, write(df, name)) if "hashes" in df.columns else write(df, name))
    found = near_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert list(kept) == ["members-sets"]
    assert {r.doc_id: r.component_id for r in found} == {i: i - 100 if 100 <= i < 103 else i for i, _ in rows}
