import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from obligor.llm import blocks, token_counts
from obligor.llm.pretokens import newer_characters
from obligor.llm.queries import COUNTED, op6_token_counts

LIBRARY = Tokenizer.from_file(P.path(COUNTED))


def n_tokens(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def check(got, rows, limit=512):
    want = sorted(((i is None, i or 0, len((t or "").encode()), n_tokens(t)) for i, t in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > limit) for r in got)


def test_odd_rows(odd, odd_rows):
    check(token_counts.token_counts(odd, P.path(COUNTED), P.PATTERN).collect(), odd_rows)


def test_special_strings_and_newer_characters(spark):
    newer = newer_characters()
    texts = ["<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endof", f"x{newer[0]} 1{newer[-1]}", "'s 't \n\n  z"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(token_counts.token_counts(df, P.path(COUNTED), P.PATTERN).collect(), rows)


@pytest.mark.parametrize("terms", [1, 50])
def test_many_small_blocks(spark, odd, odd_rows, terms, monkeypatch):
    monkeypatch.setattr(blocks.pack, "__defaults__", (terms,))
    check(token_counts.token_counts(odd.repartition(3), P.path(COUNTED), P.PATTERN).collect(), odd_rows)


def test_empty_table(empty):
    assert token_counts.token_counts(empty, P.path(COUNTED), P.PATTERN).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(op6_token_counts(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs])
