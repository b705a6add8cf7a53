"""Every operator over rows whose columns are all null: no row is lost and nothing fails."""

import pytest

from strandloom.llm import bpe, chat_format, decontaminate, language_id, near_dedup, pii, quality_rules, token_store, url_filters, warc
from tests.llm.helpers import documents


@pytest.fixture(scope="module")
def nulls(spark):
    rows = [(None, None, None, None, None), (None, "some text", None, None, None), (7, None, "en", None, None), (7, "some text", None, "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_documents(spark, sf, nulls):
    learnt = language_id.fit(nulls.unionByName(documents(spark, sf)).where(language_id.learnable()))
    labels = spark.createDataFrame([(None, None), (None, 1), (7, None), (7, 1), (7, 0), (7, 5)], "doc_id long, quality int")
    assert language_id.predict(nulls, learnt).where("lang_pred is null").count() == 0
    model = quality_rules.fit(nulls, labels)
    empty = spark.createDataFrame([(None, "some text"), (1, None)], "item_id long, text string")
    results = [
        language_id.predict(nulls, learnt),
        quality_rules.judge(nulls, model),
        pii.digest(pii.find(nulls)),
        pii.redacted(nulls),
        decontaminate.search(nulls, empty),
        bpe.encode(nulls),
        near_dedup.near_classes(nulls),
        token_store.read_checksums(token_store.write_sequences(nulls)),
    ]
    assert [r.count() for r in results] == [4] * len(results)


def test_pages_and_chats(spark):
    pages = spark.createDataFrame([(None, None, None), (None, "http://a.com/x", "p"), (3, None, "p"), (4, "x", None)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    assert url_filters.judge(pages, labels).count() == 4
    assert warc.pages_of(warc.read_archives(warc.write_archives(pages))).count() == 4
    chats = spark.createDataFrame([(None, None, None, None), (1, None, None, "x"), (0, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert chat_format.preferences(chat_format.paired(chats)).count() == 3


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(None, "some text"), (None, None), (None, "a text of its own"), (7, "some text"), (8, "some text")], "doc_id long, text string")
    left = near_dedup.kept(docs, near_dedup.near_classes(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, ""), (0, "a text of its own"), (0, "some text"), (7, "some text")]
