"""Statistics against plain code, the rule list on held-out documents."""

import numpy as np
import pytest

from folio.llm import examples
from folio.llm import quality as Q


@pytest.fixture(scope="module")
def common(spark, data):
    return spark.read.parquet(f"{data}/common_words.parquet")


def test_statistics(spark, common):
    rows = [(1, "The cat sat on the mat. It was happy!\n- one\n- two"), (2, None), (3, ""), (4, " ​\n"), (5, "a|b"), (6, "word " * 50_000)]
    got = {r.doc_id: r for r in Q.statistics(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_words int"), common).collect()}
    assert got[1].n_words == 13 and got[1].entry_share > 0.1 and got[1].end_punct_share == pytest.approx(1 / 3)
    assert got[1].common_word_share == pytest.approx(6 / 13, abs=0.09) and got[1].mean_word_length == pytest.approx(sum(map(len, rows[0][1].split())) / 13)
    for k in (2, 3, 4):
        assert got[k].blank and got[k].n_words in (0, 1)
    assert got[6].n_words == 50_000
    assert Q.statistics(spark.createDataFrame([], "doc_id bigint, text string"), common).count() == 0


def test_induction():
    generator = np.random.default_rng(1)
    x = generator.random((900, len(Q.NAMES)))
    k = Q.NAMES.index("cell_share")
    labels = np.where(x[:, k] > 0.6, "table", "prose")
    rules = Q.induce(x, labels)
    said = np.full(len(x), "prose", dtype=object)
    for r in reversed(rules):
        said[Q.covers(r.tests, x)] = r.kind
    assert (said == labels).mean() > 0.97 and "cell_share" in Q.case_sql(rules)
    assert Q.case_sql([]) == "'prose'" and Q.induce(x[:0], labels[:0]) == []


def test_held_out(spark, common, data):
    documents = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rules = Q.fit(documents.where("doc_id % 2 = 0"), common)
    texts = {r.doc_id: r.text for r in documents.where("doc_id % 2 = 1 and text is not null").collect()}
    said = {r.doc_id: r.kind for r in Q.kinds(documents.where("doc_id % 2 = 1"), common, rules).collect()}
    labelled = {k: label for k, t in texts.items() if (label := examples.unanimous(t)) is not None and said[k] is not None}
    right = sum(said[k] == label for k, label in labelled.items())
    assert len(labelled) > 300 and right / len(labelled) > 0.95


def test_tables_without_rows_or_languages(spark):
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert Q.not_prose(empty, common).count() == 0 and Q.statistics(empty, common).count() == 0
    rows = [(1, None), (2, ""), (3, " \u00a0\n"), (4, "a" + " " * 200_000 + "b"), (5, "\n" * 100_000 + "One line. " + "\t" * 9)]
    found = {r.doc_id: r for r in Q.kinds(spark.createDataFrame(rows, "doc_id bigint, text string"), common, []).collect()}
    assert [found[k].kind for k in range(1, 6)] == [None, None, None, "prose", "prose"] and found[4].n_words == found[5].n_words == 2
    assert Q.not_prose(spark.createDataFrame(rows, "doc_id bigint, text string"), common).count() == 0
