import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm.common import stored, table
from tests.llm.cases import FOLDER, ODD, documents, empty
from tests.llm.test_near import plain_groups
from tests.llm.test_pack import check
from tests.llm.test_scans import SECRETS, plain_spans

SECRET = 'x password = "hunter2222" y'


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output over a small table with odd rows."""
    given = table(spark, FOLDER, "documents")
    extra = documents(spark, [*ODD, SECRET], 10_000).select(*given.columns)
    docs, out = stored(given.unionByName(extra), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, FOLDER), name)
        out[name] = (docs, result)
        docs = result
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_filtering_stages_keep_clean_documents(spark, stages):
    labels = table(spark, FOLDER, "labels")
    for name, label, wanted in (("quality", "quality", 1), ("toxicity", "toxic", 0)):
        before, after = stages[name]
        assert after.columns == before.columns and set(texts(after).items()) <= set(texts(before).items())
        marked = before.join(labels, "doc_id").where(F.col(label) == wanted)
        kept = marked.join(after.select("doc_id"), "doc_id", "left_semi").count()
        assert kept >= 0.97 * marked.count()
        assert before.count() > after.count()


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    rows = sorted(texts(before).items())
    groups, _ = plain_groups([t for _, t in rows], 5)
    assert texts(after) == {rows[i][0]: rows[i][1] for i in range(len(rows)) if groups[i] == i}
    assert after.columns == before.columns


def test_no_fixed_secret_is_left(spark, stages):
    before, after = stages["secrets"]
    assert after.columns == before.columns and before.count() == after.count()
    old, new = texts(before), texts(after)
    given = documents(spark, [*SECRETS, SECRET, *ODD])
    alone = texts(corpus_pipeline.secrets(spark, given, FOLDER))
    assert alone[len(SECRETS)] == 'x [secret]" y'  # the pattern ends before a closing quote
    for earlier, later in ((old, new), (texts(given), alone)):
        for doc_id, text in earlier.items():
            assert not plain_spans(later[doc_id])
            assert later[doc_id] == text or "[secret]" in later[doc_id]


def test_packing_and_run(spark, stages):
    before, after = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts(before).items()}
    assert check(after.collect(), ids) < 0.01


def test_stages_bear_an_empty_table(spark):
    docs = empty(spark).select(*table(spark, FOLDER, "documents").columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
