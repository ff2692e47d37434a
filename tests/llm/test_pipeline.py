"""Each stage against a brute-force version on one small table, and the whole run."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_language import speech


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("sf")
    bench = [(0, prose(700, 30)), (1, prose(701, 40))]
    rows, r = [], random.Random(2)
    for i in range(60):
        lang = ["en", "fr", "de"][i % 3]
        text = speech(lang, i, 120)
        if i % 10 == 4:
            text = rows[i - 3][1]  # an exact copy
        elif i % 10 == 7:
            words = rows[i - 3][1].split(" ")
            words[r.randrange(len(words))] = "new"
            text = " ".join(words)
        elif i % 10 == 8:
            words = text.split(" ")
            words[50:50] = bench[i % 2][1].split(" ")
            text = " ".join(words)
        elif i % 10 == 9:
            text += " mail me@site.example from 10.0.0.1"
        rows.append((i, text, lang, "h.example.org", len(text)))
    rows += [(100, None, "en", None, None), (101, "", None, None, 0), (None, speech("en", 999, 90), None, None, None), (0, rows[0][1], "en", "h.example.org", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), rows


def test_stages_one_by_one(spark, tables):
    place, rows = tables
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{place}/documents.parquet")
    told = stages["language_id"](spark, docs, place)
    assert Counter(r["doc_id"] for r in told.collect()) == Counter(r[0] for r in rows if r[1])
    kept = stages["near_duplicates"](spark, told, place)
    ids = Counter(r["doc_id"] for r in kept.collect())
    alike = brute_classes([(r["doc_id"], r["text"]) for r in told.collect()], 5, 80)
    assert ids == Counter({doc: 1 for doc, _, least in alike if doc == least})
    clean = stages["decontamination"](spark, kept, place)
    assert {r["doc_id"] for r in clean.collect()} == {d for d in ids if d is None or d % 10 != 8}
    hidden = stages["personal_data"](spark, clean, place)
    assert hidden.columns == list(corpus_pipeline.COLUMNS)
    for r in hidden.collect():
        assert r["n_chars"] == len(r["text"])
        assert ("[EMAIL] from [IP]" in r["text"]) == (r["doc_id"] is not None and r["doc_id"] % 10 == 9) and "@" not in r["text"]
    assert stages["bpe"](spark, hidden, place).count() == hidden.count()


def test_whole_run(spark, tables):
    """All rows of the last stage, against plain versions of all stages one after another."""
    place, rows = tables
    told = [(doc, text) for doc, text, *_ in rows if text]
    leads = [doc for doc, _, least in brute_classes(told, 5, 80) if doc == least]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc in leads:
        text = next(t for d, t in told if d == doc)
        if doc is None or doc % 10 != 8:  # the others hold an item
            text = re.sub(r"\b(\d+\.){3}\d+\b", "[IP]", re.sub(r"\S+@\S+", "[EMAIL]", text))
            ids = library.encode(text, add_special_tokens=False).ids
            want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = [tuple(r) for r in corpus_pipeline.run(spark, place).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert Counter(found) == Counter(want) and len(found) > 40


def test_empty_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id(spark, tables):
    """Different texts of one id, as the stages state it."""
    stages, place = dict(corpus_pipeline.STAGES), tables[0]
    clean, leak = speech("en", 5000, 120), speech("en", 5001, 60) + " " + prose(700, 30) + " " + speech("en", 5002, 60)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, clean, "en", "h", 1), (1, leak, "en", "h", 1), (2, speech("en", 5003, 120), "en", "h", 1), (2, clean, "en", "h", 1), (3, clean, "en", "h", 1), (4, "12", "en", "h", 1), (4, speech("en", 5004, 120), "en", "h", 1)]
    docs = spark.createDataFrame(rows, kind)
    clean_ids = Counter(r["doc_id"] for r in stages["decontamination"](spark, docs, place).collect())
    assert clean_ids == Counter({2: 2, 3: 1, 4: 2})
    led = Counter((r["doc_id"], r["text"]) for r in stages["near_duplicates"](spark, docs, place).collect())
    assert led == Counter((r[0], r[1]) for r in rows if r[0] != 3)  # 3 copies a text of 1; 2 leads a class of its own and keeps its copy
    assert Counter(r["doc_id"] for r in stages["language_id"](spark, spark.read.parquet(f"{place}/documents.parquet").select(*corpus_pipeline.COLUMNS).unionByName(docs.where("doc_id = 4").withColumn("doc_id", docs["doc_id"] + 900)), place).collect())[904] == 2
