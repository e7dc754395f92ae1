"""Token ids in bit-packed blocks.

Method: fixed-width bit packing.  Each id takes the fewest bits that hold the
vocabulary; documents lie one after another in ascending doc_id order, several
to a block, and each block row carries the offsets of its documents, so a block
is unpacked with numpy at once and any document or id is reached directly.

Format of a written folder (`FORMAT`): Parquet files, shard by shard in order;
one row per block: `shard` and `block` order the blocks, `first` is the number
of ids before the block in its shard, `doc_ids` and `lengths`
are those of the block's documents (a document is never split), `bits` is the
width, `payload` is the ids, most significant bit first, padded to a byte.

Defined cases: added tokens of the tokenizer's file are recognised in texts, as
the library does by default; a null or empty text has the end id alone; a null doc_id sorts
first; rows with the same doc_id are each stored, in order of their length; an
empty table gives an empty folder and no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, new_table, partitions, plain, trimmed
from .pretokens import Indexer, Splitter

FORMAT = "shard int, block bigint, first bigint, doc_ids array<bigint>, lengths array<bigint>, bits int, payload binary"
#: Ids in a block, apart from a last long document.
BLOCK_IDS = 1 << 16


def width(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()


def unpack(payload: bytes, bits: int, count: int, start: int = 0) -> np.ndarray:
    """`count` ids from the `start`-th on, without touching the bytes before."""
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    raw = np.frombuffer(payload, np.uint8)[first:last]
    if bits == 16:
        return raw.view(">u2").astype(np.uint32)
    ones = np.unpackbits(raw)[start * bits - first * 8 :][: count * bits].reshape(count, bits)
    return ones.astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Pre-tokens and their ids, kept by a Python worker from task to task; emptied when it holds too many."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.index = tokenizer(path), Indexer(Splitter(pattern), 800_000)
        self.at, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None

    def block(self, texts) -> list[np.ndarray]:
        """The ids of each text; one that holds an added token of the file is encoded whole, as the pattern would split that."""
        whole = [k for k, t in enumerate(texts) if t and self.added and self.added.search(t)]
        if not whole:
            return self.split(texts)
        got = self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)
        own = dict(zip(whole, (np.array(e.ids, np.uint32) for e in got)))
        return [own.get(k, x) for k, x in enumerate(self.split([None if k in own else t for k, t in enumerate(texts)]))]

    def split(self, texts) -> list[np.ndarray]:
        """The ids of texts without added tokens, pre-token by pre-token."""
        reset, new, flat, lengths = self.index.block(texts)
        if reset:
            self.at, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)
        if new:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(n.sum()))])
        count = np.diff(self.at)[flat]
        ends = np.cumsum(count)
        # the ids of all pre-tokens, gathered at once
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[:-1][flat] - (ends - count), count)
        every = self.ids[where]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [every[a:b] for a, b in itertools.pairwise(cuts)]


@lru_cache(maxsize=1)
def worker_encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def packed_documents(documents: DataFrame, path: str, pattern: str, end_id: int | None, borders=()) -> DataFrame:
    """doc_id, n_tokens, payload, shard (by `borders` of doc_id) and bits of each document (the end id included).

    Distinct pre-tokens are encoded by the tokenizers library and gathered."""

    def run(batches):
        import pyarrow as pa

        encoder = worker_encoder(path, pattern)
        bits = width(encoder.tokenizer.get_vocab_size())
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for part in blocks(batches):
            own = [np.concatenate([x, tail]) for x in encoder.block(part.column("text").to_pylist())]
            docs = part.column("doc_id").to_pylist()
            shard = [0 if d is None else bisect.bisect_left(borders, d) for d in docs]
            columns = [part.column("doc_id"), pa.array([len(x) for x in own], pa.int64()), pa.array([pack(x, bits) for x in own], pa.binary()), pa.array(shard, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "payload", "shard"])

    rows = plain(documents, doc_id="doc_id", text="text")
    return rows.mapInArrow(trimmed(run), "doc_id bigint, n_tokens bigint, payload binary, shard int").withColumn("bits", F.lit(width(tokenizer(path).get_vocab_size())))


def write(documents: DataFrame, folder: str, path: str, pattern: str, end_id: int | None = 0) -> None:
    """Writes the token ids of all documents to `folder`, in ascending doc_id order."""
    spark = documents.sparkSession
    # shard borders from the id column alone, so that the texts are encoded once and moved once
    shards = partitions(spark)
    steps = [k / shards for k in range(1, shards)]
    borders = documents.agg(F.percentile_approx("doc_id", steps, 100_000)).first()[0] if steps else None
    packed = packed_documents(documents, path, pattern, end_id, sorted(set(borders or ())))
    ordered = packed.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens")

    def run(batches):
        import pyarrow as pa

        shard, block, first = None, 0, 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.int32()), ("payload", pa.binary())])
        docs, counts, held, total, bits = [], [], [], 0, 0

        def row():
            raw = held[0] if len(held) == 1 else pack(np.concatenate([unpack(p, bits, n) for p, n in zip(held, counts)]), bits)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "first": first, "doc_ids": docs, "lengths": counts, "bits": bits, "payload": raw}], schema)

        for batch in batches:
            for of, doc, n, payload, bits in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "payload", "bits"))):
                if docs and (of != shard or total + n > BLOCK_IDS):
                    yield row()
                    docs, counts, held, total, block, first = [], [], [], 0, block + 1, first + total
                if of != shard:
                    shard, block, first = of, 0, 0
                docs.append(doc)
                counts.append(n)
                held.append(payload)
                total += n
        if docs:
            yield row()

    ordered.mapInArrow(trimmed(run), FORMAT).write.parquet(folder)


def read(spark, folder: str, each, schema: str) -> DataFrame:
    """One row per stored document: start (ids before it), then what `each(doc_id, ids)` gives.

    Starts are a prefix sum over the shards' totals (a row per shard) plus what
    the block row says."""
    table = spark.read.schema(FORMAT).parquet(folder)
    size = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)
    totals = table.groupBy("shard").agg(F.max(F.col("first") + size).alias("n")).collect()
    before, base = 0, {}
    for shard, n in sorted(map(tuple, totals)):
        base[shard] = before
        before += n

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ids, at, out = unpack(r["payload"], r["bits"], sum(r["lengths"])), 0, []
                for doc, n in zip(r["doc_ids"], r["lengths"]):
                    out.append({"doc_id": doc, "start": base[r["shard"]] + r["first"] + at} | each(doc, ids[at : at + n]))
                    at += n
                yield pa.RecordBatch.from_pylist(out)

    return table.mapInArrow(trimmed(run), f"doc_id bigint, start bigint, {schema}")


def digests(documents: DataFrame, path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Writes the ids, reads the files back: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    spark = documents.sparkSession
    folder = new_table(spark, "token-ids")
    write(documents, folder, path, pattern, end_id)

    def each(_, ids):
        return {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}

    return read(spark, folder, each, "n_tokens bigint, ids_crc32 bigint")
