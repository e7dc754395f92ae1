"""Substring dedup.

Method: fixed-block anchors.  Each document's non-overlapping 7-word blocks are
indexed; every rolling 7-word window probes the index.  Any 13 repeated words
hold an aligned block of their first document, so no repeat is missed.  Windows
of 13 words around anchors that meet in two documents are then compared by
128-bit hashes over two independent hashes of each word, and neighbouring
repeated windows grow into maximal repeated spans.  Anchors travel as 39 bits of
their hash: a false meeting there only adds windows to compare.  Texts are read
anew where they are needed; of a step's files only its answers stay.

A word is removed if a window of `window` words that covers it also starts in a
document with a smaller doc_id; windows are judged on the input.

Shape of the work: hashes travel packed, a row for each block of documents and
hash partition, not a row for each window; a partition answers with ordinals of
the windows that met.  Within a partition equal hashes are reduced to the
smallest document (and largest prober), so frequent passages cost no pairs.

Defined cases: a null, empty or short text has no windows and loses nothing; a
null doc_id is neither earlier nor later than any other; rows that share a
doc_id are judged each by its own text and never against each other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, ascii_words, blocks, hash_words, mix, partitions, plain, shuffles_freed, stored, trimmed, windows

WINDOW = 13
#: Bytes of a packed anchor hash; its lowest bit says that the window is an indexed one.
PACKED = 5
#: Bytes of a packed window hash, by which repeats are decided; all of these are indexed.
WHOLE = 16
#: Seed of the multipliers of a window's second 64 bits.
SECOND = 1007
_PACKED_SCHEMA = "part int, docs binary, texts binary, counts binary, hashes binary"
_MET = "bucket int, part int, docs binary, texts binary, counts binary, ordinals binary"
_ANSWER = "doc_id bigint, text_hash int, met struct<parts: binary, counts: binary, ordinals: binary>"


def block_words(window: int) -> int:
    """Longest block of which any `window` words hold an aligned one."""
    return (window + 1) // 2


def text_key(text) -> Column:
    """A 32-bit key of a text, to tell rows that share a doc_id apart."""
    return F.xxhash64(text).cast("string").substr(-9, 9).cast("int")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: the hash tells rows that share a doc_id apart."""
    rows = plain(documents, doc_id="doc_id", text="text")
    return rows.select("doc_id", text_key("text").alias("text_hash"), "text")


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _pack(docs, texts, rows, h, parts, indexed=None, more=None):
    """Rows of `_PACKED_SCHEMA` from windows in (document, position) order; `rows` says whose window each is.

    Either anchors (`indexed` says which are blocks), or whole windows with `more`, their second 64 bits."""
    import pyarrow as pa

    part = _parts(h, parts)
    order = np.argsort(part, kind="stable")
    if more is None:
        value = (h[order] << np.uint64(1) | indexed[order].astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :PACKED]
    else:
        value = np.stack([h[order], more[order]], axis=1).view(np.uint8)
    part, rows = part[order], rows[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
    out = {k: [] for k in ("part", "docs", "texts", "counts", "hashes")}
    for a, b in itertools.pairwise(edges.tolist()):
        own = rows[a:b]
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        out["part"].append(int(part[a]))
        out["docs"].append(docs[own[first]].tobytes())
        out["texts"].append(texts[own[first]].tobytes())
        out["counts"].append(np.diff(np.append(first, b - a)).astype(np.int32).tobytes())
        out["hashes"].append(value[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("docs", "texts", "counts", "hashes"))], list(out))


def _unpack(pdf, whole: bool):
    """(docs, text hashes, windows of each, hash, indexed) of all packed windows of a partition; for whole ones the rank of the 128-bit hash."""
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in pdf.docs])
    texts = np.concatenate([np.frombuffer(x, np.int32) for x in pdf.texts])
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in pdf.counts])
    if whole:
        raw = np.frombuffer(b"".join(pdf.hashes), np.uint64).reshape(-1, WHOLE // 8)
        order = np.lexsort((raw[:, 1], raw[:, 0]))
        rank = np.zeros(len(raw), np.uint64)
        rank[order[1:]] = np.cumsum((raw[order[1:]] != raw[order[:-1]]).any(axis=1))
        return docs, texts, counts, rank, np.ones(len(raw), bool)
    raw = np.frombuffer(b"".join(pdf.hashes), np.uint8).reshape(-1, PACKED)
    value = np.zeros((len(raw), 8), np.uint8)
    value[:, :PACKED] = raw
    value = value.view(np.uint64).ravel()
    return docs, texts, counts, value >> np.uint64(1), (value & np.uint64(1)).astype(bool)


def _meet(both: bool, buckets: int):
    """A function for a hash partition: which windows lie in an indexed block of a smaller document
    (and, for anchors (`both`), which blocks are probed by a larger one), packed by buckets of documents."""

    def run(key, pdf):
        import pandas as pd

        docs, texts, counts, h, indexed = _unpack(pdf, not both)
        run_of = np.repeat(np.arange(len(docs), dtype=np.int32), counts)
        doc = docs[run_of]
        order = np.lexsort((doc[indexed], h[indexed]))
        keys, least = h[indexed][order], doc[indexed][order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        keys, least = keys[first], least[first]
        if not len(keys):
            return pd.DataFrame(columns=["bucket", "part", "docs", "texts", "counts", "ordinals"])
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        met = known & (least[at] < doc)
        if both:
            greatest = np.full(len(keys), np.iinfo(np.int64).min)
            k, d = at[known], doc[known]
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            last = np.append(k[1:] != k[:-1], True)
            greatest[k[last]] = d[last]
            met |= indexed & known & (greatest[at] > doc)
        where = np.flatnonzero(met)
        ordinals = (where - np.repeat(np.cumsum(counts) - counts, counts)[where]).astype(np.int32)
        runs, n = np.unique(run_of[where], return_counts=True)
        bucket = (mix(docs[runs].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.cumsum(n) - n
        out = {k: [] for k in ("bucket", "docs", "texts", "counts", "ordinals")}
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            out["bucket"].append(int(bucket[own[0]]))
            out["docs"].append(docs[runs[own]].tobytes())
            out["texts"].append(texts[runs[own]].tobytes())
            out["counts"].append(n[own].astype(np.int32).tobytes())
            out["ordinals"].append(ordinals[np.repeat(cut[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())].tobytes())
        return pd.DataFrame({"bucket": np.array(out["bucket"], np.int32), "part": np.full(len(out["bucket"]), key[0], np.int32)} | {k: out[k] for k in ("docs", "texts", "counts", "ordinals")})

    return run


def _by_document(_, pdf):
    """The answers of all partitions for a bucket of documents: a row per document."""
    import pandas as pd

    docs, texts, counts = (np.concatenate([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("docs", np.int64), ("texts", np.int32), ("counts", np.int32)))
    ordinals = np.frombuffer(b"".join(pdf.ordinals), np.int32)
    parts = np.repeat(pdf.part.to_numpy(np.int32), [len(x) // 4 for x in pdf.texts])
    start = np.cumsum(counts) - counts
    order = np.lexsort((texts, docs))
    first = np.flatnonzero(np.concatenate([[True], (docs[order][1:] != docs[order][:-1]) | (texts[order][1:] != texts[order][:-1])]))
    rows = []
    for own in np.split(order, first[1:]):
        n = counts[own]
        where = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows.append((docs[own[0]], texts[own[0]], {"parts": parts[own].tobytes(), "counts": n.tobytes(), "ordinals": ordinals[where].tobytes()}))
    return pd.DataFrame(rows, columns=["doc_id", "text_hash", "met"])


def _answers(packed: DataFrame, both: bool, buckets: int) -> DataFrame:
    """doc_id, text_hash and `met`: the ordinals that met, by partition."""
    return packed.groupBy("part").applyInPandas(_meet(both, buckets), _MET).groupBy("bucket").applyInPandas(_by_document, _ANSWER)


def _positions(h: np.ndarray, parts: int, met) -> np.ndarray:
    """Positions (in h) of the windows that `met` names by partition and ordinal."""
    part = _parts(h, parts)
    order = np.argsort(part, kind="stable")
    start = np.searchsorted(part[order], np.arange(parts + 1))
    own, n, ordinals = (np.frombuffer(met[k], np.int32) for k in ("parts", "counts", "ordinals"))
    return order[np.repeat(start[own], n) + ordinals]


def _hashes(words, cache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def anchors(documents: DataFrame, window: int, parts: int) -> DataFrame:
    """Every rolling block-sized window of the documents that hold a window, packed by hash partition."""
    k = block_words(window)

    def run(batches):
        cache = hash_words()
        for part in blocks(batches):
            ids, texts = part.column("doc_id").to_numpy(), part.column("text_hash").to_numpy()
            words = [ascii_words(t, False) for t in part.column("text").to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            h = np.fromiter(map(cache.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(n.sum()))
            rows = np.repeat(np.arange(len(n), dtype=np.int32), n)
            at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            w = windows(h, k)
            good = ((at <= n[rows] - k) & (n[rows] >= window))[: len(w)]
            yield _pack(ids, texts, rows[: len(w)][good], w[good], parts, indexed=at[: len(w)][good] % k == 0)
            cache.trim()

    return documents.mapInArrow(trimmed(run), _PACKED_SCHEMA)


def _starts(h: np.ndarray, window: int, parts: int, met) -> np.ndarray:
    """Where windows begin that hold an anchor that met, in a text of these word hashes."""
    k = block_words(window)
    mark = np.zeros(len(h) + 1, np.int64)
    p = _positions(windows(h, k), parts, met)
    np.add.at(mark, np.maximum(p - (window - k), 0), 1)
    np.add.at(mark, p + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: len(h) - window + 1])


def _exact(rows: DataFrame, window: int, parts: int) -> DataFrame:
    """The windows around anchors that met, all of them indexed, packed whole by hash partition."""

    def run(batches):
        cache, second = hash_words(), Cache(xxhash.xxh3_64_intdigest)
        for part in blocks(batches):
            own, more = [], []
            for text, met in zip(part.column("text").to_pylist(), part.column("met").to_pylist()):
                words = ascii_words(text, False)
                h = _hashes(words, cache)
                starts = _starts(h, window, parts, met)
                own.append(windows(h, window)[starts])
                more.append(windows(_hashes(words, second), window, SECOND)[starts])
            n = np.fromiter(map(len, own), np.int64, len(own))
            rows = np.repeat(np.arange(len(n), dtype=np.int32), n)
            yield _pack(part.column("doc_id").to_numpy(), part.column("text_hash").to_numpy(), rows, np.concatenate(own), parts, more=np.concatenate(more))
            cache.trim(), second.trim()

    return rows.mapInArrow(trimmed(run), _PACKED_SCHEMA)


def repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, met, again: of documents with repeated windows, which anchors met and which of the windows around them repeat.

    Texts move once for this, and once more where the answers are applied; they are not stored."""
    spark = documents.sparkSession
    parts, buckets = partitions(spark), max(8, partitions(spark) // 4)
    rows = keyed(documents).where("doc_id is not null and text is not null")
    with shuffles_freed(spark):  # each step's files make room for the next one's
        met = stored(_answers(anchors(rows, window, parts), True, buckets), "anchors-met")
        again = stored(_answers(_exact(rows.join(met, ["doc_id", "text_hash"]), window, parts), False, buckets), "windows-met")
    return met.join(again.withColumnRenamed("met", "again"), ["doc_id", "text_hash"])


def _removed(words: list, met, again, window: int, parts: int, cache) -> np.ndarray:
    """Which words of a text are covered by repeated windows."""
    mark = np.zeros(len(words) + 1, np.int64)
    if met is not None:
        h = _hashes(words, cache)
        starts = _starts(h, window, parts, met)
        p = starts[_positions(windows(h, window)[starts], parts, again)]
        np.add.at(mark, p, 1)
        np.add.at(mark, p + window, -1)
    return np.cumsum(mark)[:-1] > 0


def _kept(words: list, gone: np.ndarray) -> bytes:
    return b" ".join(itertools.compress(words, (~gone).tolist()))


def removals(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, spans (maximal repeated word ranges), kept_text of the documents that lose words."""
    parts = partitions(documents.sparkSession)

    def run(batches):
        import pyarrow as pa

        cache = hash_words()
        for part in blocks(batches):
            out = []
            for doc, text_hash, text, met, again in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "met", "again"))):
                words = ascii_words(text, False)
                gone = _removed(words, met, again, window, parts, cache)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                spans = [{"start": int(a), "end": int(b)} for a, b in edge]
                out.append({"doc_id": doc, "text_hash": text_hash, "n_words": len(words), "n_removed": int(gone.sum()), "spans": spans, "kept_text": _kept(words, gone).decode("utf-8", "surrogatepass")})
            cache.trim()
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept_text", pa.string())]))

    schema = "doc_id bigint, text_hash int, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept_text string"
    return keyed(documents).join(repeats(documents, window), ["doc_id", "text_hash"]).mapInArrow(trimmed(run), schema).dropDuplicates(["doc_id", "text_hash"])


def digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    parts = partitions(documents.sparkSession)

    def run(batches):
        import hashlib

        import pyarrow as pa

        cache = hash_words()
        for part in blocks(batches):
            n, removed, digest = [], [], []
            for text, met, again in zip(*(part.column(c).to_pylist() for c in ("text", "met", "again"))):
                words = ascii_words(text, False)
                gone = _removed(words, met, again, window, parts, cache) if met is not None else None
                n.append(len(words)), removed.append(0 if gone is None else int(gone.sum()))
                digest.append(hashlib.sha256(b" ".join(words) if gone is None else _kept(words, gone)).hexdigest())
            cache.trim()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    every = keyed(documents).join(repeats(documents, window), ["doc_id", "text_hash"], "left")
    return every.select("doc_id", "text", "met", "again").mapInArrow(trimmed(run), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns; the text of a document that loses words is its kept words joined by one space."""
    tag = f"_{uuid.uuid4().hex}"  # no column of the documents has such a name
    doc, own, met, again = f"{tag}_doc", f"{tag}_own", f"{tag}_met", f"{tag}_again"
    parts, at = partitions(documents.sparkSession), documents.columns.index("text")
    found = repeats(documents, window).toDF(doc, own, met, again)
    joined = documents.join(found, (documents["doc_id"] == F.col(doc)) & (text_key(documents["text"]) == F.col(own)), "left").drop(doc, own)

    def run(batches):
        import pyarrow as pa

        cache = hash_words()
        for part in blocks(batches):
            texts = part.column(at).to_pylist()
            for k, (x, y) in enumerate(zip(part.column(met).to_pylist(), part.column(again).to_pylist())):
                if x is not None:
                    words = ascii_words(texts[k], False)
                    texts[k] = _kept(words, _removed(words, x, y, window, parts, cache)).decode("utf-8", "surrogatepass")
            cache.trim()
            columns = part.columns[: len(part.columns) - 2]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-2])

    return joined.mapInArrow(trimmed(run), documents.schema)
