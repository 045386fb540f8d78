import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from obligor.llm import bpe, decontamination, quality, simhash, toxicity
from obligor.llm.queries import RANKS, labels_of



@pytest.fixture(scope="module")
def folder(spark, odd, labels, tmp_path_factory):
    """A table folder whose documents hold every odd row, and extra columns."""
    top = tmp_path_factory.mktemp("tables")
    odd.write.parquet(f"{top}/documents.parquet")
    labels.write.parquet(f"{top}/labels.parquet")
    text = odd.where("doc_id = 5").first().text + " " + odd.where("doc_id = 7").first().text
    spark.createDataFrame([(1, text), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_on_odd_rows_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pin(stage(spark, docs, folder), name)
        assert docs.columns == columns
        assert docs.count() <= rows
        rows = docs.count()
    assert corpus_pipeline.run(spark, folder).count() == rows


def test_stages_on_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_run_is_the_operators_one_after_another(spark, sf_dir):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe",
    ]
    labels = labels_of(spark, sf_dir)
    drawn = {r.doc_id for r in quality.sample(docs, quality.target_labels(labels)).collect()}
    left = docs.where(docs["doc_id"].isin(list(drawn)))
    model = toxicity.fit(left, toxicity.training_labels(labels))
    calm = {r.doc_id for r in toxicity.scored(left, model).where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text) for r in left.collect() if r.doc_id in calm]
    first = {}
    prints = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    first = {i for i in ids if find(i) == i}
    items = [decontamination.plain_words(r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(RANKS)), special_tokens={})
    want = {}
    for i, text in rows:
        whole = b" %s " % b" ".join(decontamination.plain_words(text.encode()))
        if i in first and not any(b" %s " % b" ".join(item) in whole for item in items):
            want[i] = np.array(library.encode_ordinary(text), "<u4").tobytes()
    assert set(got) == set(want)
    for i, ids_of in want.items():
        assert bytes(got[i].ids) == ids_of and got[i].n_tokens == len(ids_of) // 4
        assert got[i].ids_sha256 == hashlib.sha256(ids_of).hexdigest()


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)
