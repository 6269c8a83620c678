import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuesift.llm import packing
from issuesift.llm.queries import tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    packing.encoder(tokenizer_path())  # loads the vocabulary
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(deadline=None)
@given(st.integers(1, 10_000), st.sampled_from([1, 2, 64, 1024]))
def test_cut_lengths(n, longest):
    lengths = packing.cut(n, longest)
    assert sum(lengths) == n
    assert all(k <= longest and k & (k - 1) == 0 for k in lengths)
    assert lengths == sorted(lengths, reverse=True)
    assert len(set(lengths)) == len(lengths) - max(0, lengths.count(longest) - 1)


@settings(deadline=None)
@given(st.text())
def test_both_encoders_agree(reference, text):
    assert packing.encoder(tokenizer_path())(text) == reference(text)


def check(pieces, docs, reference):
    want = sorted((d, np.array([*reference(t or ""), 0], "<u4").tobytes()) for d, t in docs)
    by = {}
    for r in pieces:
        by.setdefault((r.doc_id, r.start), []).append(r)
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    assert all(r.offset == 0 and r.length <= 1024 and r.length & (r.length - 1) == 0 for r in pieces)
    for d in {d for d, _ in want}:
        raw, copies = [w for x, w in want if x == d][0], sum(x == d for x, _ in want)
        at = 0
        while at < len(raw) // 4:
            same = by.pop((d, at))
            assert len(same) == copies
            for r in same:
                assert bytes(r.ids) == raw[4 * at:4 * (at + r.length)] and r.doc_tokens == len(raw) // 4
                assert zlib.crc32(bytes(r.ids)) == r.crc
            at += same[0].length
    assert not by


def test_pieces_rebuild_every_document(spark, reference):
    rows = [(1, None, None, None, 0), (2, "", None, None, 0), (3, "<|endoftext|> don't  stop\n\n", None, None, 0), (4, "word " * 30_000, None, None, 0),
            (5, "same", None, None, 0), (5, "same", None, None, 0)]
    docs = documents(spark, rows).withColumn("length", F.lit(1)).withColumn("ids", F.lit("x"))
    got = packing.pack(docs, tokenizer_path()).withColumn("crc", F.crc32("ids")).collect()
    check(got, [(r[0], r[1]) for r in rows], reference)


def test_whole_table(spark, reference):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = packing.pack(docs, tokenizer_path()).withColumn("crc", F.crc32("ids")).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], reference)


def test_empty_table_and_bad_length(spark):
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(documents(spark, []), tokenizer_path(), max_len=1000)


def test_queries_give_the_ids_of_tokenizers(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from issuesift.llm.queries import op8_pack

    asked = Tokenizer.from_file(tokenizer_path())
    rows = [(1, "a <|endoftext|> b", None, None, 0), (2, "<|endoftext|>" * 3, None, None, 0), (3, " " * 1_500_000 + "a", None, None, 0),
            (4, "b" + "\n\u3000" * 120_000 + "c  d", None, None, 0), (5, "plain  text", None, None, 0)]
    folder = tempfile.mkdtemp(prefix="issuesift-test-")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    for got in (op8_pack(spark, folder), corpus_pipeline.pack(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)):
        pieces = {(r.doc_id, r.start): r for r in got.collect()}
        for i, text, *_ in rows:
            ids, at = [*asked.encode(text, add_special_tokens=False).ids, 0], 0
            while at < len(ids):
                r = pieces.pop((i, at))
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
                at += r.length
        assert not pieces
