"""Each stage of the pipeline on its own input, against brute-force versions."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import toxicity
from tests.llm.test_line_runs import brute as brute_lines
from tests.llm.test_packing import check as check_packed
from tests.llm.test_simhash import wide_reach

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 4000).cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "packing"]


def test_rejected_documents_are_those_above_the_threshold(spark, stages):
    docs, kept = stages[:2]
    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if chain.predict(r.text)[-1] < chain.threshold}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_later_copies_of_lines_go(stages):
    before, after = (s.collect() for s in stages[1:3])
    docs, gone = brute_lines(before, 1, 3)
    want = {r.doc_id: "\n".join(x for i, x in enumerate(docs[False, r.doc_id, r.text]) if i not in gone[False, r.doc_id, r.text]) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_one_of_each_group_stays(stages):
    before, after = (s.collect() for s in stages[2:4])
    least = defaultdict(list)
    for r, k in zip(before, wide_reach(before)):
        least[k].append(r.doc_id)
    assert {r.doc_id for r in after} == {min(v) for v in least.values()}


def test_what_is_left_is_packed_whole(stages):
    check_packed(stages[3])


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and out.count() > 0


def test_stages_on_nothing_and_on_clashing_names(spark, odd, none):
    for docs in (none, odd):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            before, out = out, stage(spark, out, SF)
            assert name == "packing" or out.columns == docs.columns
            out = out.cache()
            assert name == "packing" or out.count() <= before.count()
        assert out.columns[:2] == ["doc_id", "start"] and (out.count() > 0) == (docs is odd)
