import zlib

import numpy as np
import pytest

from factloom.llm.language_id import ByteGRU, identify_languages, keep_identified, op1_language_id


def test_gradients_by_differences():
    net = ByteGRU(["a", "b", "c"], units=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    codes, labels = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = net.gradients(codes, labels)
    for k, v in net.p.items():
        flat = v.reshape(-1)
        for i in rng.integers(0, 15 if k == "x" else flat.size, 6):
            held, loss = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = held + step
                loss.append(net.gradients(codes, labels)[0])
            flat[i] = held
            assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(grads[k].reshape(-1)[i], abs=2e-4)


def test_pooling_reads_every_byte():
    net = ByteGRU(["a", "b"])
    texts = [bytes(np.random.default_rng(n).integers(0, 255, n).astype(np.uint8)) for n in (1, 5, 96, 97, 300, 1000)]
    got = net.pooled(texts, span=96)
    for text, row in zip(texts, got, strict=True):
        parts = [net._softmax(net._states(np.frombuffer(text[i : i + 96], np.uint8)[:, None], [])).sum(axis=(0, 1)) for i in range(0, len(text), 96)]
        assert np.allclose(sum(parts) / len(text), row, atol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)


def test_nulls_no_letters_no_labels_and_no_rows(spark):
    rows = [(k, "the and of with that " * 3 if k % 2 else "der die und das nicht " * 3, "en" if k % 2 else "de", 0.5) for k in range(80)]
    rows += [(100, None, "en", 0.1), (101, "12 - 34", None, 0.1), (102, "", "de", None), (None, "der die das", None, None), (103, "the and " * 20000, None, None), (103, "the and", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = identify_languages(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and by[None].held_out
    assert by[None].lang_pred == "de" and by[103].lang_pred == "en"
    kept = keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k in by if k not in (100, 101, 102)}
    bare = df.withColumn("lang", df.lang.substr(9, 9)).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in identify_languages(bare).collect()} == {"und"}
    assert keep_identified(bare).count() == len(rows) - 3
    assert identify_languages(df.limit(0)).count() == 0
