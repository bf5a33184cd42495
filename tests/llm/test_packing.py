import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm.packing import best_two_fit, op9_packing, pack
from factloom.llm.tokens import encoder

TEXTS = ["", " ", "a", "\fa", "a \fb", "\f", "a\n\nb c\n\n\nd e\n", "a\nb\n.c\n d", "1a 2 b3,4 c", "x\r\ny z", "a  b", " a b ", "a\n b", "a \nb", "don't 's x 's", "é é", "e ́x y", "<|endoftext|> a <|endoftext|>", "x　y z", "a <| endoftext |> b", "ab ŉn c", "a\x85 b", "İ a İ", "ß À\n\n b  c d", "猫 が 好き a b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_give_the_library_s_ids(name):
    e = encoder(name)
    for text in TEXTS:
        assert e.encode(text) == e.whole(text), text
    assert e.encode(None) == b""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "B's", "é", "́", "1", "<|endoftext|>", "猫", "\xa0", "-"]), max_size=12).map("".join))
def test_any_spacing(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(name)
        assert e.encode(text) == e.whole(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30))
def test_plan_uses_every_piece_once(counts):
    used, bins = Counter(), 0
    for times, lengths in best_two_fit(counts, 60):
        assert sum(lengths) <= 60 and times > 0
        bins += times
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 60) <= bins <= 2 * total / 60 + 1


def test_two_pieces_replace_the_smallest_one():
    # Greedy: 6 + 3 leaves 1; 3 gives way to 2 + 2, which fill the sequence.
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def check_sequences(got, texts, most=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {k: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in texts.items()}
    for doc, ids in whole.items():
        own = got[got.doc_id == doc].sort_values("piece")
        assert list(own.piece) == list(range(len(own))) and own.length.sum() == len(ids)
        assert list(own.length[1:]) == [most] * (len(own) - 1)
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= most
    total = sum(map(len, whole.values()))
    assert got.sequence_id.nunique() <= -(-total // most) * 1.02 + 1


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_sequences(op9_packing(spark, sf).toPandas(), texts)


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "word " * 5000, "z"), (4, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    check_sequences(pack(df).toPandas(), {r[0]: r[1] for r in rows})
    twice = pack(df.union(df).union(spark.createDataFrame([(None, "q", "q")], df.schema))).toPandas()
    assert twice.length.sum() == 2 * pack(df).toPandas().length.sum() + 2
    assert pack(df.limit(0)).count() == 0


def test_texts_are_cut_a_few_at_a_time(monkeypatch):
    """A batch's masks and places are those of a few texts, whatever its size; ids and ends are the same."""
    texts = TEXTS * 3 + [None, "a long text " * 50, ""]
    e = encoder("byte_bpe_50k.json")
    want = [e.whole(t or "") for t in texts]
    cut, sizes = e._cut, []
    monkeypatch.setattr(e, "_cut", lambda raw, bounds: (sizes.append((len(raw), len(bounds) - 1)), cut(raw, bounds))[1])
    monkeypatch.setattr("factloom.llm.tokens.BYTES_AT_ONCE", 100)
    for some in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1)):
        sizes.clear()
        ids, ends = e.encode_batch(some)
        assert np.concatenate([[0], ends]).tolist() == np.cumsum([0, *(len(w) // 4 for w in want)]).tolist()
        assert ids.astype("<u4").tobytes() == b"".join(want)
        assert len(sizes) > 5 and all(size <= 100 or rows == 1 for size, rows in sizes)
