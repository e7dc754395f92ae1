"""Byte-level BPE encoding and decoding.

Method: a block's distinct pre-tokens travel to the JVM as byte arrays; there a
higher-order `aggregate` folds the ranked merges, looking pairs up in a literal
rank map (literal arrays: the rows of a sparse table of pairs, laid over each
other).  The ids
of each distinct pre-token are then gathered for every document of the block.
Decoding concatenates the binary pieces of the ids.  No shuffle takes place:
merges run once per distinct pre-token of a task, whatever its document counts.
Pre-tokens of over `LONG` bytes are merged in passes, one for each merge that
they use, so that time doesn't grow with the square of their length.

Defined cases: a null or empty text has no ids (n_tokens 0, hashes of the empty
string); every input row gives one output row, repeated rows included; a null
doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, plain, trimmed
from .pretokens import Indexer, Splitter

#: Bits of a token id in the packed entries of the rank map.
ID_BITS = 16
_BLOCK_SCHEMA = "reset boolean, doc_id array<bigint>, length array<bigint>, flat binary, words array<array<smallint>>"
#: The rank of pieces that don't merge.
NONE = 1 << ID_BITS
PLAN_STRING = "spark.sql.maxPlanStringLength"
#: Bytes above which a pre-token is merged pass by pass.
LONG = 256


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(id, id) -> the id of their bytes, for all pairs that can meet.

    When a merge of some rank is due, all of lower rank are done, and none has crossed the ends of its two pieces; so these
    are what the bytes alone are merged to by lower ranks.  Where that is two pieces, no other pair of them ever meets."""
    pairs = {}
    for piece, merged in ranks.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, k = min((ranks.get(a + b, merged), k) for k, (a, b) in enumerate(itertools.pairwise(parts)))
            if rank >= merged:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        cuts = [len(parts[0])] if len(parts) == 2 else range(1, len(piece))
        for cut in cuts:
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pairs[a, b] = merged
    return pairs


def _free_place(full: np.ndarray, row: np.ndarray, step: int = 4096) -> int:
    """The first slot from `SPARE` on at which a row of offsets (0 among them) meets no full slot."""
    start = 0
    while start + step + int(row.max()) < len(full):
        at = start + np.flatnonzero(~full[start : start + step])
        for x in row:
            at = at[~full[at + x]]
        if len(at):
            return int(at[0])
        start += step
    raise ValueError("too many merges for the rank map")


@lru_cache(maxsize=4)
def rank_map(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, slots, places): the ids of the 256 bytes, and the pairs that merge; ids are counted from 1 here, 0 is an empty slot.

    A pair of ids (a, b) merges to the id whose bytes are those of a and b.  It sits in slot places[a] + b, as
    a * 2^16 + merged id: rows of a sparse table, laid over each other so that no two pairs meet."""
    ranks = {piece: rank + 1 for piece, rank in load_ranks(path).items()}
    if max(ranks.values()) >= 0xD800:
        raise ValueError("the rank map holds ids below the code points of surrogates")
    rows: dict[int, list] = {}
    for (a, b), merged in merge_pairs(ranks).items():
        rows.setdefault(a, []).append((b, merged))
    width = max(ranks.values()) + 1
    slots, places = np.zeros(1 << 21, np.int64), np.zeros(width, np.int64)
    full = np.zeros(len(slots), bool)
    for a, own in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        b, merged = np.array(own, np.int64).T
        places[a] = at = _free_place(full, b - b.min()) - b.min()
        full[at + b] = True
        slots[at + b] = a << ID_BITS | merged
    last = int(np.flatnonzero(full).max()) + 1 if full.any() else 1
    return np.array([ranks[bytes([x])] for x in range(256)]), slots[:last], places


def literal_array(values) -> Column:
    """An array literal of any length (folded once by the optimizer)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def rank_tables(path: str) -> Column:
    """The rank map as one struct literal (folded by the optimizer)."""
    first, slots, places = rank_map(path)
    return F.struct(literal_array(first).alias("first"), literal_array(slots).alias("slots"), literal_array(places).alias("places"))


def glyph(i: Column) -> Column:
    """The character whose code point is an id counted from 1."""
    return F.decode(F.unhex(F.lpad(F.hex(i), 4, "0")), "UTF-16BE")


def merge_words(words: Column, path: str) -> Column:
    """Token ids of each pre-token of an array, given as arrays of unsigned bytes; the rank map is bound once."""
    return F.get(F.transform(F.array(rank_tables(path)), lambda t: F.transform(words, lambda w: merge_column(w, t))), F.lit(0))


def merge_column(word: Column, tables: Column) -> Column:
    """Token ids of one pre-token given as an array of its unsigned bytes."""

    def rank(a, b):
        """The id that two ids merge to; NONE if they don't, or if there is no second one (null)."""
        entry = F.get(tables["slots"], (F.get(tables["places"], a.cast("int")) + b).cast("int"))
        return F.least(entry.bitwiseXOR(F.shiftleft(a, ID_BITS)), F.lit(NONE))

    # A piece is packed as rank << 40 | start << 16 | id: the rank of merging it with the next piece (NONE if they
    # don't merge), its first byte and its id; the least value is the leftmost pair of lowest rank, and no two are equal.
    ids = F.transform(word, lambda x: F.get(tables["first"], x.cast("int")))
    packed = lambda p: F.transform(p, lambda x, k: F.shiftleft(rank(x, F.get(p, k + 1)), 40).bitwiseOR(F.shiftleft(k.cast("bigint"), ID_BITS)).bitwiseOR(x))
    pieces = F.get(F.transform(F.array(ids), packed), F.lit(0))
    return F.when(F.size(word) <= LONG, _one_by_one(pieces, rank)).otherwise(_pass_by_pass(pieces, rank))


def _one_by_one(pieces: Column, rank) -> Column:
    """Merges the leftmost pair of lowest rank, one in a step; a step without one leaves at once."""

    def id_of(x):
        return x.bitwiseAND((1 << ID_BITS) - 1)

    def ranked(x, a, after):
        """The packed piece of id `a` at the place of x, before the packed piece `after` (null at the end)."""
        place = x.bitwiseAND(((1 << 24) - 1) << ID_BITS).bitwiseOR(a)
        return F.shiftleft(rank(a, id_of(after)), 40).bitwiseOR(place)

    def step(s, _):
        # positions are compared, not looked up: array_position leaves its loop by an exception, which costs more than all else
        def merged(low):
            def new(x, k):
                joined = F.shiftright(low, 40)
                here, before, gone = x == low, F.get(s, k + 1) == low, F.get(s, k - 1) == low
                return F.when(here, ranked(x, joined, F.get(s, k + 2))).when(gone, F.lit(-1).cast("bigint")).when(before, ranked(x, id_of(x), joined)).otherwise(x)

            return F.when(low >= NONE << 40, s).otherwise(F.array_remove(F.transform(s, new), F.lit(-1).cast("bigint")))

        return F.get(F.transform(F.array(F.array_min(s)), merged), F.lit(0))

    steps = lambda p: F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    return F.get(F.transform(F.array(pieces), lambda p: F.aggregate(steps(p), p, step, lambda s: F.transform(s, lambda x: id_of(x) - 1))), F.lit(0))


def _pass_by_pass(pieces: Column, rank) -> Column:
    """Merges all pairs of the lowest rank in one pass, leftmost first; ends when no pair is left.

    A pass takes time in proportion to the pre-token, and there is one for each merge of the vocabulary that it uses, so
    long pre-tokens don't take the square of their length.  (A merge makes pairs of higher rank only, so this is the same order.)"""

    def ids_of(s):
        return F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("bigint"))

    def step(state, _):
        def lowest(p):
            """rank << 32 | id << 16 | id of the pair of lowest rank."""
            return F.array_min(F.transform(p, lambda x, k: F.coalesce(F.shiftleft(rank(x, F.get(p, k + 1)), 32).bitwiseOR(F.shiftleft(x, 16)).bitwiseOR(F.get(p, k + 1)), F.lit(NONE << 32))))

        def merged(low):
            at = lambda bits: glyph(F.shiftright(low, bits).bitwiseAND((1 << ID_BITS) - 1))
            text = F.replace(state["text"], F.concat(at(16), at(0)), at(32))
            return F.struct((low < NONE << 32).alias("more"), F.when(low < NONE << 32, text).otherwise(state["text"]).alias("text"))

        found = F.transform(F.array(ids_of(state["text"])), lowest)
        return F.when(state["more"], F.get(F.transform(found, merged), F.lit(0))).otherwise(state)

    start = F.struct(F.lit(True).alias("more"), F.array_join(F.transform(pieces, lambda x: glyph(x.bitwiseAND((1 << ID_BITS) - 1))), "").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.size(pieces)), start, step, lambda s: F.transform(ids_of(s["text"]), lambda i: i - 1))


def _to_blocks(pattern: str):
    def run(batches):
        import pyarrow as pa

        index = Indexer(Splitter(pattern))
        for part in blocks(batches):
            reset, new, flat, lengths = index.block(part.column("text").to_pylist())
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            at = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(np.fromiter(map(len, raw), np.int32, len(raw)), out=at[1:])
            data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int16)
            words = pa.ListArray.from_arrays(pa.array(at), pa.array(data))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([reset]),
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([flat.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), words),
                ],
                ["reset", "doc_id", "length", "flat", "words"],
            )

    return run


def encoded_blocks(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Blocks of documents with the ids of their new distinct pre-tokens (column `ids`), in task order."""
    conf = documents.sparkSession.conf
    if conf.get(PLAN_STRING, None) in (None, str((1 << 31) - 16)):  # else each plan in a log holds the rank map several times
        conf.set(PLAN_STRING, "1m")
    out = plain(documents, doc_id="doc_id", text="text").mapInArrow(trimmed(_to_blocks(pattern)), _BLOCK_SCHEMA)
    return out.select("reset", "doc_id", "length", "flat", merge_words(F.col("words"), path).alias("ids"))


def decoded_blocks(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The same, and the bytes that the ids of each pre-token decode to (column `decoded`)."""
    pieces = F.array(piece_table(path))
    return encoded_blocks(documents, path, pattern).withColumn("decoded", F.get(F.transform(pieces, lambda t: F.transform("ids", lambda x: decode_by(x, t))), F.lit(0)))


def _gathered(make):
    """A mapInArrow function: make() gives (kept, row, schema).

    `kept` are functions of (a block's ids, where each pre-token's start, their decoded bytes) to lists by pre-token;
    row(doc_id, number of ids, the document's entries of each list) makes a row."""

    def run(batches):
        import pyarrow as pa

        kept, row, schema = make()
        tables, counts = [[] for _ in kept], np.empty(0, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("reset")[k].as_py():
                    tables, counts = [[] for _ in kept], np.empty(0, np.int64)
                lists = batch.column("ids")[k].values
                at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                ids, decoded = lists.flatten().to_numpy(zero_copy_only=False).tolist(), []
                if "decoded" in batch.schema.names:
                    own = batch.column("decoded")[k].values
                    ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].tolist() if len(own) else [0]
                    raw = own.buffers()[2].to_pybytes() if len(own) and own.buffers()[2] else b""
                    decoded = [raw[x:y] for x, y in itertools.pairwise(ends)]
                counts = np.concatenate([counts, np.diff(at)])
                for table, f in zip(tables, kept):
                    table += f(ids, at.tolist(), decoded)
                lengths = batch.column("length")[k].values.to_numpy()
                flat = np.frombuffer(batch.column("flat")[k].as_py(), np.int32)
                sums = np.concatenate([[0], np.cumsum(counts[flat])])
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                totals, cuts, flat = (sums[cuts[1:]] - sums[cuts[:-1]]).tolist(), cuts.tolist(), flat.tolist()
                rows = []
                for doc, n, a, b in zip(batch.column("doc_id")[k].as_py(), totals, cuts, cuts[1:]):
                    own = flat[a:b]
                    rows.append(row(doc, n, *(map(t.__getitem__, own) for t in tables)))
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


@lru_cache(maxsize=1)
def _numbers() -> list[int]:
    """One object for each id, however many pre-tokens have it."""
    return list(range(1 << ID_BITS))


def _ids(ids, at, _):
    own = list(map(_numbers().__getitem__, ids))
    return [tuple(own[a:b]) for a, b in itertools.pairwise(at)]


def _decoded(ids, at, decoded):
    return decoded


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def make():
        import pyarrow as pa

        def row(doc, n, ids):
            return {"doc_id": doc, "ids": list(itertools.chain.from_iterable(ids))}

        return [_ids], row, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    return encoded_blocks(documents, path, pattern).mapInArrow(trimmed(_gathered(make)), "doc_id bigint, ids array<int>")


def encode_checked(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 (of the bytes that the ids decode to) of every whole text."""

    def make():
        import pyarrow as pa

        def row(doc, n, ids, decoded):
            return {"doc_id": doc, "n_tokens": n, "ids": list(itertools.chain.from_iterable(ids)), "decoded_sha256": hashlib.sha256(b"".join(decoded)).hexdigest()}

        return [_ids, _decoded], row, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    return decoded_blocks(documents, path, pattern).mapInArrow(trimmed(_gathered(make)), "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (bytes of the decoded ids)."""

    def make():
        import pyarrow as pa

        decimal = list(map(str, range(1 << ID_BITS)))

        def written(ids, at, _):
            own = [decimal[i] for i in ids]
            return [" ".join(own[a:b]) for a, b in itertools.pairwise(at)]

        def row(doc, n, ids, decoded):
            return {"doc_id": doc, "n_tokens": n, "ids_sha256": hashlib.sha256(" ".join(ids).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(b"".join(decoded)).hexdigest()}

        return [written, _decoded], row, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    return decoded_blocks(documents, path, pattern).mapInArrow(trimmed(_gathered(make)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def piece_table(path: str) -> Column:
    """A literal array of the bytes of each id, in hexadecimal."""
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return F.split(F.lit(",".join(pieces)), ",")


def decode_by(ids: Column, pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i.cast("int"))), ""))


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: its pieces, concatenated (null stays null)."""
    return decode_by(ids, piece_table(path))
