"""The pipeline on the small tables, stage by stage, against brute force and the operators' own results."""

import hashlib
import re

import numpy as np
import pytest
from brute import similar_groups
from tokenizers import Tokenizer

import corpus_pipeline
from clausegrid.llm import mixing, quality
from clausegrid.llm.queries import VOCABULARY


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        result = stage(spark, docs, FOLDER)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert result.columns == docs.columns
        result.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((before, docs))
    return out


def test_quality_keeps_what_the_operator_keeps(stages):
    before, after = stages[0]
    kept = {r.doc_id for r in quality.assess_quality(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    assert kept


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in similar_groups(rows)})


def test_secrets_are_masked_and_nothing_else_changes(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[2])
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i]]
    for i in before:
        planted = re.findall('token = "([0-9a-f]{40})"', before[i].text)
        assert all(p not in after[i].text for p in planted)
        if planted:
            assert i in changed
    for i in changed:
        pattern = ".+".join(map(re.escape, after[i].text.split("[SECRET]")))
        assert re.fullmatch(pattern, before[i].text, re.S) and after[i].n_chars == len(after[i].text)


def test_mix_repeats_what_the_operator_takes(stages):
    before, after = stages[3]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want


def test_encoding_of_the_mix(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(VOCABULARY)
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert after.count() == before.count()
