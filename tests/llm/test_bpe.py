import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from obligor.llm import bpe
from obligor.llm.pretokens import newer_characters
from obligor.llm.queries import RANKS, op1_byte_bpe

RANK_TABLE = bpe.read_ranks(P.path(RANKS))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANK_TABLE, special_tokens={})
CODEC = bpe.BytePairCodec(RANK_TABLE, P.PATTERN, newer_characters(), remembered=500)


def expected(text):
    return np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_encoded_as_the_library_does_and_decoded_back(text):
    ids = CODEC.encode([text])[0]
    assert ids == expected(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_runs_and_group_sizes():
    rng = random.Random(1)
    texts = ["a" * 30_000, " " * 5_000, "ab" * 2_000, "\n\n \t x", "don't we'll I'm"]
    texts += ["".join(rng.choices("abcdeé漢", k=n)) for n in (1, 2, 63, 64, 65, 66, 500)]
    assert CODEC.encode(texts) == [expected(text) for text in texts]


def test_characters_of_newer_unicode_are_no_letters():
    newer = newer_characters()
    text = f"a{newer[0]}b {newer[-1]}1 {newer[5]}{newer[6]}!"
    assert CODEC.encode([text, "plain", text])[0] == expected(text)


def test_merging_alone_and_in_groups_agree():
    rng = random.Random(2)
    pieces = ["".join(rng.choices("etaoin shr", k=rng.randint(2, 60))).encode() for _ in range(300)]
    alone = [np.array(bpe.merge_long(piece, RANK_TABLE), "<u4").tobytes() for piece in pieces]
    grouped = []
    for piece in pieces:
        grouped += CODEC._merge_group([piece], 64)
    assert alone == grouped


def test_decode_rejects_unknown_ids():
    with pytest.raises(ValueError, match="outside the vocabulary"):
        CODEC.decode(np.array([CODEC.size], "<u4").tobytes())


def test_encode_and_decode_as_table_operators(odd, odd_rows):
    path = P.path(RANKS)
    rows = bpe.decode(bpe.encode(odd, path, P.PATTERN, out_col="coded"), path, P.PATTERN, "coded", "back")
    assert rows.columns == [*odd.columns, "coded", "back"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.coded, r.back) for r in rows.collect())
    want = sorted((i is None, i or 0, expected(t or ""), (t or "").encode()) for i, t in odd_rows)
    assert [(a, b, bytes(c), bytes(d)) for a, b, c, d in got] == want
    unpacked = rows.where("doc_id = 0").select(bpe.unpacked(rows["coded"]).alias("x")).first().x
    assert unpacked == LIBRARY.encode_ordinary(dict(odd_rows)[0])


def test_query_digests(spark, sf_dir):
    got = op1_byte_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        row = got.loc[doc_id]
        assert row.n_tokens == len(LIBRARY.encode_ordinary(text))
        assert row.ids_sha256 == hashlib.sha256(expected(text)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
