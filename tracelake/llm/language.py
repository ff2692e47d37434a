"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Text likelihoods are hashed byte-trigram models counted over every document with a
declared language.  Host priors come from grouped sums of text posteriors: a host is
smoothed towards its address suffix, the suffix towards the whole corpus, and a row's
own share is left out.  ``und`` is a class of its own with a uniform text model; rows
that it wins, and rows without letters, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import textvec
from tracelake.llm.common import Workspace, broadcast_if_small, small_batches

BUCKETS = 1 << 15
POOLED = 2000.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 1e-4
SMOOTHING = 20.0
DECLARED_SMOOTHING = 5.0
HOT_ROWS = 1_000_000
#: Classes of a row's evidence: the best by its text, and all others that its text puts less than MARGIN nats below the best.
#: Declaration and priors move two classes by 95 nats at most in a table of 10^11 rows, so what lies further back cannot win,
#: and 676 such classes together weigh less than a double resolves.
TOP = 16
MARGIN = 144.0

#: Letters keep their (lower-cased) byte, all other ASCII becomes a space.
LETTER = np.full(256, 32, np.uint32)
LETTER[128:] = np.arange(128, 256)
LETTER[65:91] = LETTER[97:123] = np.arange(97, 123)


def trigrams(chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each byte trigram with two letters in a row."""
    b = LETTER[chunk.data]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(chunk.n_docs), np.diff(chunk.offsets))
    letter = b != 32
    use = letter[1:-1] & (letter[:-2] | letter[2:]) & (owner[:-2] == owner[2:])
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(17)).astype(np.int64)[use], owner[:-2][use]


def declared_code(column: Column) -> Column:
    """The two-letter primary tag of a declared language, else null (so 676 values at most, which bounds the model; three-letter tags are no evidence)."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2})(?:[-_].*)?$", 1), F.lit(""))


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, bucket), counted over all rows.

    Every declared language is a class.  Its counts are smoothed by POOLED trigrams of all
    languages together, so one of little text differs from them by what it has.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            declared = np.array(batch.column(1).to_pylist(), object)
            for chunk in textvec.chunks(batch.column(0)):
                buckets, docs = trigrams(chunk)
                own = declared[chunk.first_row : chunk.first_row + chunk.n_docs]
                for lang in {x for x in own if x}:
                    mine = buckets[(own == lang)[docs]]
                    total[lang] = total.get(lang, 0) + np.bincount(mine, minlength=BUCKETS)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["lang", "bucket", "n"]
            )

    def packed(part: pa.Table) -> pa.Table:
        counts = np.zeros(BUCKETS)
        counts[part["bucket"].to_numpy()] = part["n"].to_numpy()
        return pa.table({"lang": part["lang"].slice(0, 1), "counts": pa.array([counts.tobytes()], pa.binary())})

    known = rows.select("text", "declared").where(F.col("declared").isNotNull())
    sums = known.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    with small_batches(rows.sparkSession):  # a row of BUCKETS counts for each two-letter tag
        found = sorted((r["lang"], np.frombuffer(r["counts"])) for r in sums.groupBy("lang").applyInArrow(packed, "lang string, counts binary").collect())
    if not found:
        return [], np.zeros((0, BUCKETS), np.float32)
    counts = np.stack([c for _, c in found])
    pooled = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    return [x for x, _ in found], np.log((counts + POOLED * pooled) / (counts.sum(axis=1, keepdims=True) + POOLED)).astype(np.float32)


def softmax(logs: np.ndarray) -> np.ndarray:
    parts = np.exp(logs - logs.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), kind), values.shape[1]).cast(pa.list_(kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _spread(classes: np.ndarray, values: np.ndarray, width: int, rest: float, more: tuple[np.ndarray, np.ndarray], more_values: pa.Array) -> np.ndarray:
    """Values by class, also those of the (row, class) pairs ``more``; ``rest`` for the classes that a row does not name."""
    found = np.full((len(classes), width), rest)
    np.put_along_axis(found, classes.astype(np.int64), values.astype(float), axis=1)
    found[more] = more_values.flatten().to_numpy(zero_copy_only=False)
    return found


def text_evidence(rows: DataFrame, langs: list[str], logs: np.ndarray, id_col: str) -> DataFrame:
    """The TOP best ``classes`` of each whole text, und being the last one, with their log likelihoods ``ll`` and posteriors ``p`` of the text alone; n_trigrams.

    ``more``, ``more_ll`` and ``more_p`` are the other classes that can still win: those
    within MARGIN of the best.  They are many only for a text that hardly tells many
    declared languages apart.

    Overlapping trigrams are far from independent, so the mean log likelihood of n counts
    as n of them, but as 4 * sqrt(n) at most.  Likelihoods are relative to the best.  A row
    takes ten bytes a class.
    """
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    names = [id_col, "declared", "host", "suffix", "n_trigrams", "classes", "ll", "p", "more", "more_ll", "more_p"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ns, lls = [], []
            for chunk in textvec.chunks(batch.column(4)):
                buckets, docs = trigrams(chunk)
                n = np.bincount(docs, minlength=chunk.n_docs)
                sums = [np.bincount(docs, weights=row[buckets], minlength=chunk.n_docs) for row in table]
                sums.append(n * -np.log(BUCKETS))
                ll = np.stack(sums, axis=1) * np.minimum(1, 4 / np.sqrt(np.maximum(n, 1)))[:, None]
                ll[:, -1] += np.log(UNKNOWN_PRIOR)
                ns.append(n)
                lls.append(ll)
            if ns:
                ll = np.concatenate(lls)
                ll -= ll.max(axis=1, keepdims=True)
                best = np.sort(np.argpartition(-ll, TOP - 1, axis=1)[:, :TOP], axis=1) if ll.shape[1] > TOP else np.tile(np.arange(ll.shape[1]), (len(ll), 1))
                p = softmax(ll)
                kept = [_lists(np.take_along_axis(x, best, axis=1), pa.float32()) for x in (ll, p)]
                near = ll > -MARGIN
                np.put_along_axis(near, best, False, axis=1)
                ends = pa.array(np.concatenate([[0], near.sum(axis=1).cumsum()]), pa.int32())
                more = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((near.nonzero()[1], pa.int16()), (ll[near], pa.float32()), (p[near], pa.float32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.concatenate(ns), pa.int64()), _lists(best, pa.int16()), *kept, *more], names=names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "declared", "host", "suffix", "text").mapInArrow(
        scored, f"`{id_col}` {kind}, declared string, host string, suffix string, n_trigrams long, classes array<short>, ll array<float>, p array<float>, more array<short>, more_ll array<float>, more_p array<float>"
    )


def fuse(joined: DataFrame, classes: list[str], said: dict[str, np.ndarray], id_col: str) -> DataFrame:
    """Final classes of evidence rows joined with the sums ``s`` of their host and the prior ``by_suffix`` of its suffix."""
    total = sum(said.values(), np.zeros(len(classes))) + DECLARED_SMOOTHING * max(len(said), 1)
    told = {tag: np.log((v + DECLARED_SMOOTHING) / total) for tag, v in said.items()}  # log P(declared | class)
    shared = joined.sparkSession.sparkContext.broadcast(told)

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, names = len(classes), np.array(classes, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, (own, ll, p) = batch.column(2).to_numpy(), (_matrix(batch.column(i), min(k, TOP)) for i in range(3, 6))
            s, by_suffix = (_matrix(batch.column(i), k) for i in (6, 7))
            more = np.repeat(np.arange(len(n)), pc.list_value_length(batch.column(8))), batch.column(8).flatten().to_numpy(zero_copy_only=False)
            ll, p = _spread(own, ll, k, -1e30, more, batch.column(9)), _spread(own, p, k, 0.0, more, batch.column(10))
            heard, tags, table = n > 0, batch.column(1).to_pylist(), shared.value
            others = np.maximum(s - np.where(heard[:, None], p, 0.0), 0.0)  # a row's own share is left out
            prior = np.log((others + SMOOTHING * by_suffix) / (others.sum(axis=1, keepdims=True) + SMOOTHING))
            none = np.zeros(k)
            final = softmax(ll + np.stack([table.get(t, none) for t in tags]) + prior)
            best = np.where(heard, names[final.argmax(axis=1)], UNKNOWN)
            text = np.where(heard, names[p.argmax(axis=1)], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(text, pa.string()), pa.array(best, pa.string()), pa.array(final.max(axis=1)), pa.array(best != UNKNOWN, pa.bool_())],
                names=[id_col, "declared", "text_language", "language", "probability", "kept"],
            )

    kind = joined.schema[id_col].dataType.simpleString()
    return joined.select(id_col, "declared", "n_trigrams", "classes", "ll", "p", "s", "by_suffix", "more", "more_ll", "more_p").mapInArrow(
        fused, f"`{id_col}` {kind}, declared string, text_language string, language string, probability double, kept boolean"
    )


def identify(rows: DataFrame, workspace: Workspace, id_col: str = "doc_id") -> DataFrame:
    """Fuse the evidence of rows (id, text, declared, host, suffix; any may be null).

    Returns id, declared, text_language, language, probability, kept.  A null or empty
    text, or one without two letters in a row, is ``und`` and not kept.  A null or
    malformed declaration is no evidence.  A null host or suffix counts as the empty
    one.  Repeated rows each give a row.  Texts of any length are worked on whole, and
    every declared language can win.  If no row declares a language (as in an empty
    table), all rows are ``und``.

    Host priors are broadcast while they are small.  Beyond that the hosts of over
    HOT_ROWS rows, few at any size, are broadcast and the others joined by a shuffle in
    which no key has more rows than that.
    """
    rows = rows.select(
        id_col, F.coalesce(F.col("text"), F.lit("")).alias("text"), declared_code(F.col("declared")).alias("declared"),
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"),
    )
    langs, logs = train(rows)
    classes = [*langs, UNKNOWN]
    k = range(len(classes))
    evidence = workspace.keep("evidence", text_evidence(rows, langs, logs, id_col))

    hosts = workspace.keep("hosts", evidence.groupBy("suffix", "host").agg(F.count("*").alias("rows")))
    heard = evidence.where("n_trigrams > 0").select("suffix", "host", "declared", F.explode(F.arrays_zip(F.concat("classes", "more").alias("class"), F.concat("p", "more_p").alias("p"))).alias("x")).select("suffix", "host", "declared", "x.class", "x.p")
    sums = workspace.keep("sums", heard.groupBy("suffix", "host", "class").agg(F.sum("p").alias("s")))
    corpus = {r["class"]: r["s"] for r in sums.groupBy("class").agg(F.sum("s").alias("s")).collect()}  # a row a class
    everything = sum(corpus.values())
    world = [(corpus.get(i, 0.0) + 1) / (everything + len(classes)) for i in k]
    said: dict[str, np.ndarray] = {r[0]: np.zeros(len(classes)) for r in evidence.where("declared is not null").select("declared").distinct().collect()}  # at most 676 tags
    for r in heard.where("declared is not null").groupBy("declared", "class").agg(F.sum("p").alias("s")).collect():
        said[r["declared"]][r["class"]] = r["s"]

    def dense(of: DataFrame, *by: str) -> DataFrame:
        """Sums of all classes in one array for each key; a key has a row a class."""
        told = of.groupBy(*by, "class").agg(F.sum("s").alias("s")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("class", "s"))).alias("m"))
        return told.select(*by, F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("short")), F.lit(0.0))).alias("s"))

    smooth = lambda u: F.zip_with(u, F.array(*map(F.lit, world)), lambda x, w: (x + SMOOTHING * w) / (F.aggregate(u, F.lit(0.0), lambda a, b: a + b) + SMOOTHING))
    width = 64 + 16 * len(classes)
    none = F.array_repeat(F.lit(0.0), len(classes))
    of_suffix = hosts.select("suffix").distinct().join(dense(sums, "suffix"), "suffix", "left")
    smoothed = workspace.keep("suffixes", of_suffix.select("suffix", smooth(F.coalesce("s", none)).alias("by_suffix")))
    of_host = hosts.join(dense(sums, "suffix", "host"), ["suffix", "host"], "left").join(broadcast_if_small(smoothed, width), "suffix")
    priors = workspace.keep("priors", of_host.select("suffix", "host", "rows", F.coalesce("s", none).alias("s"), "by_suffix"))
    key, few = ["suffix", "host"], broadcast_if_small(priors, width)
    if few is not priors:
        joined = evidence.join(few, key)
    else:
        hot = broadcast_if_small(priors.where(F.col("rows") > HOT_ROWS), width)
        rest = evidence.join(hot.select(*key), key, "left_anti").join(priors.where(F.col("rows") <= HOT_ROWS), key)
        joined = evidence.join(hot, key).unionByName(rest.select(*evidence.join(hot, key).columns))
    return fuse(joined, classes, said, id_col)


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents: the declared language is ``lang``, the host is ``source``."""
    source = F.lower("source")
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), source.alias("host"), F.regexp_extract(source, r"\.([a-z]+)$", 1).alias("suffix"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Web pages: declared in the html tag, host and suffix of the address, text without markup."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    text = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*+>|&[#a-z0-9]{1,10};", " ")
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z_-]+)", 1)
    return pages.select("page_id", text.alias("text"), declared.alias("declared"), host.alias("host"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"))
