"""Language identification.

Method: an interpolated Kneser-Ney character language model per language, kept
as sorted arrays of packed n-grams; a text goes to the language with the lowest
cross-entropy per character, and is marked as rejected where even that lies
above the language's calibrated limit.

Texts are lower-cased; letters keep their code (those above 2^16 share 4096
codes), any run of other characters is one space.  4-grams of all training
texts are counted, whole texts, over the whole table, and all of them are kept;
the lower orders use continuation counts.

A language's limit is 1.1 times a quantile of the cross-entropies of its training texts under
its own model: of every one with `SURE_CHARS` letters and spaces or more, whole (copies count as
often as they occur, as in the counts).  The quantile is exact: its two order statistics are
found by counting the values' bits from the highest on, so only counts reach the driver.

A worker holds `BYTES` of tables at once, by an estimate from counted entries.
Where all models together take more, texts are scored in several passes, each
with the tables of some languages; a language that takes more by itself is cut
by the histories of its 4-grams, and its passes' sums are added.

Defined cases: a null text or one without letters is `und`, score 0; ties go to
the language that sorts first; null langs teach nothing; with no training rows
all texts are `und`; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, stored, trimmed

ORDER = 4
DISCOUNT = 0.75
#: Bytes of tables that a worker holds at once, and what an entry takes (keys, shares, histories, all orders).
BYTES, ENTRY = 256 << 20, 48
#: Chars that count at most towards how sure a score is.
SURE_CHARS = 40


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code of each code point: 0 for all but letters."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low if low < 0xF000 else 0xF000 + (low & 0xFFF)
    return out


def grams(text: str | None) -> np.ndarray:
    """Packed 4-grams that end at each character of a text (three spaces come before it)."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letter_codes()[raw]
    c = c[(c > 0) | (np.concatenate([np.zeros(1, np.uint16), c[:-1]]) > 0)]
    if not c.any():
        return np.empty(0, np.uint64)
    c = np.concatenate([np.zeros(ORDER - 1, np.uint64), c.astype(np.uint64)])
    out = np.zeros(len(c) - ORDER + 1, np.uint64)
    for j in range(ORDER):
        out = out << np.uint64(16) | c[j : j + len(out)]
    return out


class Model:
    """Kneser-Ney tables of one language: by order, sorted n-grams with their discounted shares and sorted histories with what they leave.

    Of a language cut in `of` shards it has the 4-grams whose history modulo `of` is `shard`; `lower` are its
    3-grams with their continuation counts then."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shard: int = 0, of: int = 1, lower=None):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        self.shard, self.of = shard, of
        self.levels = []
        for n in range(ORDER, 0, -1):
            history = keys >> np.uint64(16)
            h, at, kinds = np.unique(history, return_inverse=True, return_counts=True)
            total = np.bincount(at, counts)
            share = np.maximum(counts - DISCOUNT, 0) / total[at]
            self.levels.append((keys, share, h, DISCOUNT * kinds / total))
            if n == ORDER and lower is not None:
                keys, counts = lower
            elif n > 1:  # how many letters come before each shorter n-gram
                keys, counts = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
                counts = counts.astype(np.float64)
        self.uniform = 1.0 / (len(self.levels[-1][0]) + 1)

    def log_probability(self, wanted: np.ndarray) -> np.ndarray:
        """Natural log of P(last char | the three before) for packed 4-grams; 0 for those of other shards."""
        if self.of > 1:
            out, own = np.zeros(len(wanted)), (wanted >> np.uint64(16)) % np.uint64(self.of) == self.shard
            out[own] = self._log(wanted[own])
            return out
        return self._log(wanted)

    def _log(self, wanted: np.ndarray) -> np.ndarray:
        p = np.full(len(wanted), self.uniform)
        for n, (keys, share, histories, left) in enumerate(reversed(self.levels), 1):
            w = wanted & np.uint64((1 << 16 * n) - 1) if n < ORDER else wanted
            p = _look_up(keys, share, w, 0.0) + _look_up(histories, left, w >> np.uint64(16), 1.0) * p
        return np.log(p)


def _look_up(keys, values, wanted, missing):
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class Models:
    """The languages, their rejection limits, and what each pass over the texts holds: (lang, shard, of).  `load` gets a pass's models."""

    def __init__(self, sizes: dict[str, int], load=None, held: int | None = None):
        held = held or BYTES
        self.langs, self.limits, self.load, self.passes = sorted(sizes), {}, load, []
        room = 0
        for lang in self.langs:
            of = max(1, -(-sizes[lang] * ENTRY // held))
            for shard in range(of):
                need = sizes[lang] * ENTRY // of
                if not self.passes or need > room:
                    self.passes.append([])
                    room = held
                self.passes[-1].append((lang, shard, of))
                room -= need


def negative_logs(langs: list[str], models: list[tuple[str, Model]], texts) -> tuple[np.ndarray, np.ndarray]:
    """(chars of each text, its -log probability under each language, as far as these models have it)"""
    own = [grams(t) for t in texts]
    n = np.fromiter(map(len, own), np.int64, len(own))
    out = np.zeros((len(own), len(langs)))
    full = np.flatnonzero(n)
    if len(full) and models:
        kinds, at = np.unique(np.concatenate(own), return_inverse=True)
        starts = (np.cumsum(n) - n)[full]
        for lang, m in models:
            out[full, langs.index(lang)] -= np.add.reduceat(m.log_probability(kinds)[at], starts)
    return n, out


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text): counted by block, then summed."""

    def run(batches):
        import pyarrow as pa

        for part in blocks(batches):
            by: dict = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, own in by.items():
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return rows.mapInArrow(trimmed(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tables(counts: DataFrame, own: list[tuple]) -> list[tuple[str, Model]]:
    """The models of one pass, from the table of counts."""
    whole = [lang for lang, _, of in own if of == 1]
    out = []
    if whole:
        table = counts.where(F.col("lang").isin(whole)).select("lang", "gram", "n").toArrow()
        lang, gram, n = table.column("lang").combine_chunks().dictionary_encode(), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        codes = lang.indices.to_numpy(zero_copy_only=False)
        out = [(x, Model(gram[codes == k], n[codes == k])) for k, x in enumerate(lang.dictionary.to_pylist())]
    for name, shard, of in own:
        if of > 1:
            rows = counts.where(F.col("lang") == name)
            part = rows.where(F.pmod(F.shiftrightunsigned("gram", 16), F.lit(of)) == shard).select("gram", "n").toArrow()
            low = rows.groupBy(F.col("gram").bitwiseAND((1 << 16 * (ORDER - 1)) - 1).alias("gram")).agg(F.count("*").alias("n")).toArrow()
            keys, n = low.column("gram").to_numpy().view(np.uint64), low.column("n").to_numpy().astype(np.float64)
            order = np.argsort(keys)
            out.append((name, Model(part.column("gram").to_numpy().view(np.uint64), part.column("n").to_numpy(), shard, of, (keys[order], n[order]))))
    return sorted(out, key=lambda x: x[0])


def own_entropies(rows: DataFrame, models: Models) -> DataFrame:
    """lang, bits: of each (lang, text) row of `SURE_CHARS` or more, the bits of its -log probability per character under its own language's model."""
    rows = rows.select("lang", "text", F.lit(0.0).alias("logs"))
    for k, own in enumerate(models.passes):
        last = k == len(models.passes) - 1
        rows = rows.mapInArrow(trimmed(_own_logs(models.load(own), last)), "lang string, bits bigint" if last else rows.schema)
        if not last:
            rows = stored(rows, "own-logs")
    return rows


def _own_logs(tables, last: bool):
    def run(batches):
        import pyarrow as pa

        for part in blocks(batches):
            langs, texts = np.array(part.column("lang").to_pylist(), object), part.column("text").to_pylist()
            logs, n = part.column("logs").to_numpy().copy(), np.zeros(len(texts), np.int64)
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                n[at], more = negative_logs([lang], [x for x in tables if x[0] == lang], [texts[i] for i in at])
                logs[at] += more[:, 0]
            if not last:
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(logs)], part.schema.names)
                continue
            good = n >= SURE_CHARS
            h = np.maximum(logs[good] / n[good], 0.0) + 0.0  # no sign, not of a zero either
            yield pa.RecordBatch.from_arrays([part.column("lang").filter(pa.array(good)), pa.array(h.view(np.int64))], ["lang", "bits"])

    return run


def quantiles(values: DataFrame, q: float, width: int = 12) -> dict[str, float]:
    """The exact quantile (linear between order statistics) by lang, over all rows of (lang, bits): the bits of doubles from 0 on.

    These sort as the doubles do; each round counts the next few bits of the
    values that agree with what is known of a wanted one, by language."""
    counts = {r["lang"]: r["count"] for r in values.groupBy("lang").count().collect()}
    wanted = {}  # (lang, which of the two): (bits known so far, rank among the values that have them)
    for lang, n in counts.items():
        low = int(q * (n - 1))
        wanted |= {(lang, 0): (0, low), (lang, 1): (0, min(low + 1, n - 1))}
    spark, left = values.sparkSession, 64
    while left and wanted:
        step = min(width, left)
        known = spark.createDataFrame(sorted({(lang, head) for (lang, _), (head, _) in wanted.items()}), "lang string, head long")
        left -= step
        head = F.shiftrightunsigned("bits", left + step) if left + step < 64 else F.lit(0).cast("long")  # a shift by 64 is none
        heads = values.select("lang", F.shiftrightunsigned("bits", left).alias("b"), head.alias("head"))
        found: dict = {}
        for r in heads.join(F.broadcast(known), ["lang", "head"]).groupBy("lang", "head", "b").count().orderBy("lang", "head", "b").collect():
            found.setdefault((r["lang"], r["head"]), []).append((r["b"], r["count"]))
        for key, (prefix, rank) in wanted.items():
            for b, n in found[key[0], prefix]:
                if rank < n:
                    wanted[key] = b, rank
                    break
                rank -= n
    value = {key: float(np.array([known], np.int64).view(np.float64)[0]) for key, (known, _) in wanted.items()}
    return {lang: value[lang, 0] + (value[lang, 1] - value[lang, 0]) * (q * (n - 1) - int(q * (n - 1))) for lang, n in counts.items()}


def train(documents: DataFrame, where: Column | str, quantile: float = 0.999, held: int | None = None) -> Models:
    """Models and limits of all languages, from every row of `documents` that meets `where`."""
    rows = documents.where(where).select("lang", "text").where("lang is not null and text is not null")
    counts = stored(count_grams(rows), "grams")
    models = Models({r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}, held=held)
    if len(models.passes) == 1:
        only = _tables(counts, models.passes[0])
        models.load = lambda _: only
    else:
        models.load = lambda own: _tables(counts, own)
    if models.langs:
        own = stored(own_entropies(rows, models), "entropies")
        models.limits = {lang: x * 1.1 for lang, x in quantiles(own, quantile).items()}
    return models


def predict(documents: DataFrame, models: Models) -> DataFrame:
    """All columns of `documents`, lang_pred, score (0 to 1), cross_entropy and rejected."""
    added = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType()))
    documents = documents.drop(*(name for name, _ in added))
    sums = f"_{uuid.uuid4().hex}"  # no column of the documents has this name
    text = documents.columns.index("text")
    rows = documents.withColumn(sums, F.lit(None).cast("binary"))
    for own in models.passes[:-1]:
        rows = stored(_summed(rows, text, models.langs, models.load(own)), "language-sums")
    tables = models.load(models.passes[-1]) if models.passes else []
    langs, limits = models.langs, models.limits

    def run(batches):
        import pyarrow as pa

        for part in blocks(batches):
            n, logs = _with_sums(part, text, langs, tables)
            lang, score, best, rejected = [], [], [], []
            for chars, row in zip(n.tolist(), logs / np.maximum(n, 1)[:, None]):
                if not chars or not langs:
                    lang.append("und"), score.append(0.0), best.append(None), rejected.append(True)
                    continue
                k = int(row.argmin())
                odds = np.exp((row[k] - row) * min(chars, SURE_CHARS))
                lang.append(langs[k]), score.append(float(1 / odds.sum())), best.append(float(row[k]))
                rejected.append(bool(row[k] > limits.get(langs[k], np.inf)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64()), pa.array(rejected, pa.bool_())],
                [*part.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return rows.mapInArrow(trimmed(run), T.StructType([*documents.schema.fields, *(T.StructField(*x) for x in added)]))


def _with_sums(part, text: int, langs: list[str], tables) -> tuple[np.ndarray, np.ndarray]:
    """(chars, -log probabilities) of a block, the sums of earlier passes (its last column) added."""
    n, logs = negative_logs(langs, tables, part.column(text).to_pylist())
    for k, before in enumerate(part.columns[-1].to_pylist()):
        if before is not None:
            logs[k] += np.frombuffer(before, np.float64)
    return n, logs


def _summed(rows: DataFrame, text: int, langs: list[str], tables) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for part in blocks(batches):
            _, logs = _with_sums(part, text, langs, tables)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x.tobytes() for x in logs], pa.binary())], part.schema.names)

    return rows.mapInArrow(trimmed(run), rows.schema)
