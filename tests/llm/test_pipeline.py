import collections
import re

import corpus_pipeline
from shroud.llm import queries
from shroud.session import cut_lineage
from shroud.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.llm.test_exact_and_near import brute_classes
from tests.llm.test_text_operators import brute_spans
from tests.llm.test_token_operators import check_packing


def test_stages_one_by_one(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "personal data", "packing"]
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = cut_lineage(stage(spark, inputs[-1], SF_SMALL))
        assert out.schema.names == docs.schema.names
        inputs.append(out)
    rows = [{r.doc_id: r for r in d.collect()} for d in inputs]
    toxic = {r.doc_id for r in read_table(spark, SF_SMALL, "labels").where("toxic = 1").collect()}
    assert set(rows[1]) < set(rows[0]) and len(toxic - set(rows[1])) >= 0.7 * len(toxic)
    first = {}
    for i in sorted(rows[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[1][i].text or ""), i)
    assert set(rows[2]) == set(first.values())
    ids = sorted(rows[2])
    assert set(rows[3]) == {ids[k] for k in brute_classes([rows[2][i].text for i in ids])}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not brute_spans(r.text)
        if not brute_spans(rows[3][i].text):
            assert r == rows[3][i]
    packed = corpus_pipeline.pack_sequences(spark, inputs[-1], SF_SMALL).collect()
    waste, _ = check_packing(packed, [(i, r.text) for i, r in rows[4].items()])
    assert waste < 0.02


def test_run_and_registration(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {"pipeline", *queries.QUERIES} <= set(names)
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))
    rows = names["pipeline"](spark, SF_SMALL).collect()
    assert collections.Counter(r.doc_id for r in rows) and all(r.length > 0 for r in rows)


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0
