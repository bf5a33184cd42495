import zlib

from factloom.llm.sharding import kd_shards, op6_sharding


def hold(got, texts, shards, slack):
    """Every row once, sizes and checksums right, slots gapless, shards' bytes within slack of their mean."""
    want = sorted((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes = {}
    for s in {r.shard for r in got}:
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[s] = sum(r.size for r in own)
    assert set(sizes) <= set(range(shards)) and {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes.get(s, 0) - mean) <= slack for s in range(shards)), sizes


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op6_sharding(spark, sf).collect()
    hold(got, texts, 24, max(len((t or "").encode()) for _, t in texts))
    by_text = {}
    for r in got:
        by_text.setdefault(r.text_crc32, []).append(r)
    mean = sum(r.size for r in got) / 24
    for own in by_text.values():
        if sum(r.size for r in own) <= 0.02 * mean:
            assert len({r.shard for r in own}) == 1


def test_hot_group_nulls_ties_and_clashing_names(spark):
    rows = [(k, "the same text", "en", "s", 13, "x") for k in range(300)] + [(1000 + k, f"text {k}", None, f"s{k % 3}", None, None) for k in range(300)]
    rows += [(5000, None, "de", None, 0, "n"), (5001, "", None, None, None, None), (5001, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    hold(kd_shards(df, shards=7).collect(), [r[:2] for r in rows], 7, 60)
    hold(kd_shards(df.select("doc_id", "text"), shards=None, target_bytes=2000).collect(), [r[:2] for r in rows], 6, 60)


def test_no_rows_and_fewer_rows_than_shards(spark):
    df = spark.createDataFrame([(1, "a", "x", "y", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert kd_shards(df.limit(0)).count() == 0
    assert [r.slot for r in kd_shards(df, shards=3).collect()] == [0]


def test_placing_does_not_depend_on_files(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = df.union(df.limit(3)).withColumn("source", df.source.substr(1, 2))
    one, five = ({tuple(r) for r in kd_shards(df.repartition(n), shards=5).collect()} for n in (1, 5))
    assert one == five


def test_long_names_that_begin_alike_are_apart(spark):
    rows = [(k, f"text {k}", f"wikipedia_{'en' if k % 2 else 'de'}") for k in range(200)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=2).collect()
    assert len({(r.doc_id % 2, r.shard) for r in got}) <= 3 and sum(r.group_split for r in got) <= 1
