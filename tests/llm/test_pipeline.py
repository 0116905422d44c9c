"""The pipeline against its stages' operators, which have brute-force tests of their own, and against what must hold of its result."""

from __future__ import annotations

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import exact_dedup, quality_rules, simhash
from tessera.llm.common import documents, written
from tests.llm.test_operators import brute_substrings


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = documents(spark, small), [documents(spark, small)]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small))
        out.append(docs)
    return out


def ids(df, condition="true"):
    return sorted(r.doc_id for r in df.where(condition).select("doc_id").collect())


def test_stages(stages):
    docs, good, unlike, apart, cut, packed = stages
    assert len(corpus_pipeline.STAGES) == 5 and all(d.columns == docs.columns for d in (good, unlike, apart, cut))
    assert ids(good) == ids(quality_rules.judged(docs), "kept")
    assert ids(unlike) == ids(exact_dedup.exact_dedup(good), "kept")
    assert ids(apart) == ids(simhash.near_duplicates(unlike), "doc_id = component_id")
    before, after = {r.doc_id: r for r in apart.collect()}, {r.doc_id: r for r in cut.collect()}
    expected = brute_substrings([(i, r.text) for i, r in before.items()])
    assert after.keys() == before.keys()
    for i, (n_words, n_gone, _) in expected.items():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", after[i].text)) == n_words - n_gone
        assert (after[i].text == before[i].text) == (n_gone == 0) and after[i].lang == before[i].lang
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in packed.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in after.items()}


def test_run(spark, small, stages):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == stages[-1].columns and out.count() == stages[-1].count()


def test_stages_on_odd_rows(spark, small):
    """Nulls in any column, empty texts, rows that repeat, clashing names, and no rows at all."""
    prose = [" ".join(f"w{(k * 7919 + i * i * 31) % 4001}" for i in range(80)) for k in range(6)]
    rows = [(k, t, "en", None, "m") for k, t in enumerate(prose)] + [(k, t, "en", None, "m") for k, t in enumerate(prose[:2])]
    rows += [(20, None, None, None, None), (21, "", "en", "s", "m"), (None, prose[5], "en", "s", None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __row string").repartition(2)
    for table, stay in ((docs, [0, 1, 2, 3, 4, 5]), (docs.limit(0), [])):
        for _, stage in corpus_pipeline.STAGES[:4]:
            table = written(stage(spark, table, small))
            assert table.columns == docs.columns
        assert ids(table) == stay
        packed = corpus_pipeline.STAGES[4][1](spark, table, small).collect()
        assert sorted({r.doc_id for r in packed}) == stay
