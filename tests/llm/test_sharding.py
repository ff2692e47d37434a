import zlib
from collections import Counter

from pyspark.sql import functions as F

from tracelake.llm.sharding import assign_shards, next_key


def jump(key, n):
    """The published loop."""
    key = (42 if key is None else key) & (1 << 64) - 1
    at, ahead = -1, 0
    while ahead < n:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_generator_wraps(spark):
    keys = [0, 1, -1, 42, 2**63 - 1, -(2**63), 123456789012345678]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", next_key(F.col("k")).alias("n")).collect()
    assert all(r["n"] % (1 << 64) == (r["k"] * 2862933555777941757 + 1) % (1 << 64) for r in rows)


def test_matches_the_loop_and_numbers_every_row(docs):
    rows = assign_shards(docs, 7).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["shard"] == jump(r["doc_id"], 7) and r["grown_shard"] == jump(r["doc_id"], 8)
        assert r["grown_shard"] in (r["shard"], 7)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)


def test_spread_and_moves(spark):
    rows = assign_shards(spark.range(20_000).selectExpr("id as doc_id", "cast(null as string) as text"), 40).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 40 and max(counts.values()) < 1.25 * 500
    moved = sum(r["shard"] != r["grown_shard"] for r in rows)
    assert 0.7 * 20_000 / 41 < moved < 1.3 * 20_000 / 41


def test_one_shard_and_no_rows(docs, no_docs):
    assert {r["shard"] for r in assign_shards(docs, 1).collect()} == {0}
    assert assign_shards(no_docs, 40).count() == 0


def test_other_ids_are_hashed(spark):
    rows = assign_shards(spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "doc_id string, text string"), 5).collect()
    assert {r["doc_id"] for r in rows} == {"a", "b", None} and all(0 <= r["shard"] < 5 for r in rows)
