"""The registered queries on awkward tables: nulls, empty and long texts, repeats, columns with clashing names; and on empty ones."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_quality import brute as brute_counts
from tracelake.llm.queries import QUERIES

CONTRACT = {
    "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_decontamination": ["doc_id", "item_id"], "op3_language_id": ["doc_id", "language", "kept"], "op4_token_counts": ["doc_id", "n_tokens"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op6_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op8_token_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op13_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "pages_language_id": ["page_id", "language", "kept"],
}
#: Rows of queries that do not give one for each document.
ROWS = {"op5_warc": 4, "pages_language_id": 4, "op13_filter_audit": 3 * 120 * 5}


def tables(spark, docs, place):
    """Documents as given, labels with nulls and odd values, pages with nulls, a benchmark of awkward items."""
    docs.write.parquet(f"{place}/documents.parquet")
    labels = [(i, i % 2, 0, "t") for i in range(20)] + [(None, 1, 0, "t"), (3, None, None, None), (3, 7, 0, "t")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{place}/labels.parquet")
    pages = [(1, "http://a.example/", "<html lang=en>x"), (2, None, None), (None, "u", ""), (2, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{place}/pages.parquet")
    items = [(1, prose(0, 120), 5), (2, None, 5), (3, "", 5), (4, "one", 5), (None, "two words", 5)]
    spark.createDataFrame(items, "item_id long, text string, doc_id long").write.parquet(f"{place}/benchmark.parquet")


@pytest.fixture(scope="module")
def place(spark, docs, tmp_path_factory):
    found = str(tmp_path_factory.mktemp("sf"))
    tables(spark, docs, found)
    return found


@pytest.mark.parametrize("name", QUERIES)
def test_columns_and_rows(spark, docs, place, name):
    found = QUERIES[name](spark, place)
    assert set(CONTRACT[name]) <= set(found.columns)
    if name not in ("op2_decontamination", "op11_spelling_variants"):
        assert found.count() == ROWS.get(name, docs.count())


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, no_docs, tmp_path, name):
    tables(spark, no_docs, tmp_path)
    for table in ("labels", "pages", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/none/{table}.parquet")
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def test_results(spark, docs, place):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = lambda name, *columns: Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, place).collect())
    assert run("op1_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == Counter((doc, *brute_counts(text)) for doc, text in rows)
    assert run("op6_ngram_jaccard", "doc_id", "n_shingles", "component_id") == brute_classes(rows, 4, 85)
    ids = [(doc, library.encode(text or "", add_special_tokens=False).ids) for doc, text in rows]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert run("op7_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter((doc, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for doc, x in ids)
    assert run("op8_token_records", "doc_id", "n_tokens", "ids_crc32") == Counter((doc, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for doc, x in ids)
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"] is not None, r["doc_id"] or 0) for r in QUERIES["op8_token_records"](spark, place).collect())
    assert [s[0] for s in starts] == [sum(s[1] for s in starts[:i]) for i in range(len(starts))] and [s[2:] for s in starts] == sorted(s[2:] for s in starts)
    assert run("op9_sharding", "doc_id", "size", "text_crc32", "law") == Counter((doc, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key") for doc, t in rows)
    leaks = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontamination"](spark, place).collect()}
    copies = {(doc, 1) for doc, t in rows if t and t.split()[:60] == prose(0, 120).split()[:60]}
    assert leaks == copies | {(3, 4), (4, None)}


def test_a_kept_table_is_followed_by_a_collection_if_the_heap_has_grown(spark, monkeypatch):
    from tracelake.llm import common

    workspace, calls = common.Workspace(spark, "heap"), []
    monkeypatch.setattr(common, "let_go", calls.append)
    for share, name in ((0.0, "grown"), (1.1, "small")):
        monkeypatch.setattr(common, "GROWN", share)
        assert workspace.keep(name, spark.range(10)).count() == 10
    assert len(calls) == 1


def test_a_collection_leaves_little_of_the_drivers_heap_free(spark):
    from tracelake.llm import common

    common.Workspace(spark, "heap")
    heap = spark._jvm.Runtime.getRuntime()
    common.let_go(spark)
    assert heap.freeMemory() < 0.55 * heap.totalMemory()
