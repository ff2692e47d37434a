import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracelake.llm import byte_bpe, records, textvec, token_count
from tracelake.llm.common import Workspace

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def odd_texts(n):
    r = random.Random(5)
    alphabet = [*"ab '\n\t 12.,é　\x1f\x85字​'s", "<|endoftext|>", " the", "  ", "ll"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_bpe_equals_the_library(library):
    bpe = byte_bpe.load(BPE)
    for text in odd_texts(2000):
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == want, text
        assert bpe.decode(want).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_bpe_skips_stale_entries(library):
    bpe = byte_bpe.load(BPE)
    for text in ("aaaaaaaaaaaaaaa", "abababababab", "thethethethe", "ééééééé", "a" * 3000):
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_round_trip_digests(docs, no_docs, library):
    rows = byte_bpe.round_trip(docs, BPE).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert byte_bpe.round_trip(no_docs, BPE).count() == 0


def test_encode_then_decode_gives_the_texts(docs):
    back = byte_bpe.decode(byte_bpe.encode(docs, BPE), BPE).collect()
    assert Counter(tuple(r) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())


def brute_pieces(word, initial, inner):
    n = i = 0
    for e in range(len(word), 0, -1):
        if word[:e] in initial:
            n, i = 1, e
            break
    else:
        n = 1
    while i < len(word):
        for e in range(len(word), i, -1):
            if word[i:e] in inner:
                n, i = n + 1, e
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_token_counts_equal_greedy_matching(docs, no_docs):
    initial, inner, mark = token_count.sentencepiece_vocabulary(PIECES)
    assert mark
    initial, inner = set(initial), set(inner)
    automaton = token_count.Automaton(initial, inner)
    words = {w for t in odd_texts(500) for w in re.findall("[^\x20\x09-\x0d]+", t)} | {"internationalisation", "zzzqqq\U0001f600x"}
    for word in words:
        assert automaton.count(word) == brute_pieces(word, initial, inner), word
    rows = {(r["doc_id"], r["n_chars"]): r for r in token_count.count_tokens(docs, PIECES).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        found = rows[r["doc_id"], len(text)]
        ws = re.findall("[^\x20\x09-\x0d]+", text)
        assert found["n_words"] == len(ws)
        if len(text) < 5000:
            assert found["n_tokens"] == sum(brute_pieces(w, initial, inner) for w in ws)
    assert token_count.count_tokens(docs, PIECES).count() == docs.count()
    assert token_count.count_tokens(no_docs, PIECES).count() == 0


def test_tiny_automaton_follows_links():
    automaton = token_count.Automaton({"abcd", "a"}, {"a", "b", "c", "d", "bc", "cde", "e"})
    assert automaton.count("abcd") == 1
    assert automaton.count("abce") == 3  # a, bc, e
    assert automaton.count("abx") == 3  # a, b, one unknown byte
    assert automaton.count("b") == 2  # the mark alone, then b


def test_pieces_with_characters_that_are_no_pieces():
    initial, inner = {"aé", "ab", "字b"}, {"a", "b", "ab", "aéb", "é字"}
    automaton = token_count.Automaton(initial, inner)
    r = random.Random(2)
    for _ in range(3000):
        word = "".join(r.choice("abé字x") for _ in range(r.randint(1, 9)))
        assert automaton.count(word) == brute_pieces(word, initial, inner), word
    assert token_count.Automaton(initial, inner, mark_is_piece=False).count("x") == 4  # the mark's three bytes, then x


def test_records_round_trip(spark, docs, no_docs, library):
    folder = Workspace(spark, "records").path("files")
    manifest = records.write(docs, folder, BPE)
    rows = sorted(records.read_digests(spark, manifest).collect(), key=lambda r: r["start"])
    source = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    start = 0
    for r, d in zip(rows, source, strict=True):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(len(r["ids"]) for r in records.read(spark, manifest).collect()) == sorted(r["n_tokens"] for r in rows)
    entry = next(e for e in manifest if e["docs"] > 1)
    before = sum(e["docs"] for e in manifest if e["part"] < entry["part"])
    assert len(records.lookup(entry, 1)) == rows[before + 1]["n_tokens"]
    straight = Counter((r["doc_id"], tuple(r["ids"])) for r in records.read(spark, manifest).collect())
    orders = []
    for seed in (1, 2):
        shuffled = records.read_shuffled(spark, manifest, seed, 3).collect()
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in shuffled) == straight
        orders.append([r["doc_id"] for r in sorted(shuffled, key=lambda r: r["place"])])
    assert orders[0] != orders[1]
    assert sum(r["n_tokens"] for r in records.index(spark, manifest).collect()) == start
    empty = records.write(no_docs, Workspace(spark, "records").path("files"), BPE)
    assert records.read_digests(spark, empty).count() == 0


def test_damage_is_found(tmp_path):
    framed = records.frame(b"some payload")
    assert struct.unpack("<Q", framed[:8])[0] == 12
    place = tmp_path / "x"
    for at in (3, 14, len(framed) - 1):
        place.write_bytes(framed[:at] + bytes([framed[at] ^ 1]) + framed[at + 1 :])
        with pytest.raises(ValueError), place.open("rb") as f:
            list(records.frames(f))


def alike(n=10):
    """Two unequal texts of 2 ** n letters that any polynomial hash modulo 2 ** 64 takes for one."""
    text = "a"
    for _ in range(n):
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_bulk_encoding_equals_the_library_on_random_texts(library):
    from tracelake.llm.library_bpe import LibraryEncoder

    r = random.Random(11)
    words = ["the", "Thé", "a1.", "(x)", "don't", "'ll", "字", "…", "!!", "\U0001f600", "<|", "x\ny", "\n", "9.5,", "naïve?"]
    texts = [*odd_texts(1500), *alike(), "", None, *(" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(1500))]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(byte_bpe.encoded(pa.array(texts), BPE)) == want
    encoder, found = LibraryEncoder(BPE), []
    encoder.max_pieces = 300  # so that the table is emptied again and again
    for chunk in textvec.chunks(pa.array(texts), 2000):
        ids, counts = encoder.encode(chunk)
        found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == want


def test_colliding_pieces_keep_their_own_ids(spark, library):
    one, other = alike()
    wrap = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    want = [library.encode(t, add_special_tokens=False).ids for t in (one, other)]
    assert want[0] != want[1]
    assert list(byte_bpe.encoded(pa.array([one, other]), BPE)) == want
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string").coalesce(1)
    manifest = records.write(docs, Workspace(spark, "records").path("files"), BPE)
    rows = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in records.read_digests(spark, manifest).collect()}
    assert rows == {1: wrap([*want[0], 0]), 2: wrap([*want[1], 0])}
