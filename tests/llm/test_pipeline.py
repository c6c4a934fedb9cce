from collections import Counter

import pytest
from test_jaccard import brute_kept

import corpus_pipeline
from kinthread.llm import bpe, mixing, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs.collect())
    return out


def test_each_stage_does_its_work(spark, stages):
    before, harmless, single, masked, mixed, encoded = stages
    columns = list(before[0].asDict())
    assert all(list(s[0].asDict()) == columns for s in (harmless, single, masked, mixed))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in before if model.scores([r.text])[0] >= 0.5}
    assert {r.doc_id for r in before} - {r.doc_id for r in harmless} == bad
    # one document of each group of five-word Jaccard similarity 0.8 or more, by brute force
    assert sorted(r.doc_id for r in single) == brute_kept([(r.doc_id, r.text) for r in harmless])
    assert [r.doc_id for r in sorted(masked)] == [r.doc_id for r in sorted(single)]
    found = secrets.scan(spark.createDataFrame(single)).where("is_secret").collect()
    text = {r.doc_id: r.text for r in masked}
    assert all(r.value not in text[r.doc_id] and secrets.MASK in text[r.doc_id] for r in found)
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= mixing.MOST_REPEATS and set(copies) <= {r.doc_id for r in masked}
    encoding = bpe.load_encoding(bpe.RANKS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded) == Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text))) for r in mixed)


def test_run_gives_the_stages_result(spark, stages):
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r.doc_id, tuple(r.ids)) for r in stages[-1])


def test_stages_take_odd_rows_and_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, m_row string, findings string, row string"
    text = "some words of a text that is long enough to stand " * 3
    rows = [(1, None), (2, ""), (2, ""), (None, text), (4, text), (4, text), (5, "x " * 30_000), (6, " \n\t"), (7, "ein anderer text")]
    docs = spark.createDataFrame([(i, t, None, None if i == 5 else "s", len(t or ""), "a", "b", "c") for i, t in rows], schema)
    for given in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            assert name == "byte_bpe" or out.columns == docs.columns
            got = out.collect()
            if given is not docs:
                assert got == []
            elif name == "near_duplicates":
                assert sorted(str(r.doc_id) for r in got) == ["1", "4", "5", "7"]
            elif name in ("toxicity", "secrets"):
                assert Counter(map(str, got)) == Counter(map(str, docs.collect()))
            elif name == "mixing":
                assert {r.doc_id for r in got} <= {None, 4, 5, 7} and max(Counter(r.doc_id for r in got if r.doc_id != 4).values()) <= 3
            else:
                assert len(got) == len(rows) and all(r.n_tokens == len(r.ids) for r in got)
