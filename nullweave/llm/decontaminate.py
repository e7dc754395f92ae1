"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

Method: the postings (term, document, position) of all benchmark terms in the
training documents are stored.  Each distinct test window is searched from its
rarest term (by postings counted over all documents): the offset-adjusted list
of that term gives candidate starts, which are intersected with the list of the
second rarest term; what is left is joined with the lists of all other terms
and must meet every one of them.  `proximity` intersects the same lists within
a distance instead of at fixed offsets.

Terms and windows travel as numbers, and a step's shuffle files go when it ends.
The test side is broadcast only while it is small (`SMALL_ROWS` counted rows
and `SMALL_BYTES` counted bytes of text); beyond that the joins shuffle.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A
window is `n` consecutive words of an item; a shorter item is one window.

Defined cases: null or wordless texts have no words, windows or hits; repeated
or shared windows count for each of their items; rows that share a doc_id are
searched each by itself; rows with null ids keep their null; an empty benchmark
hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, settled, shuffles_freed, stored

WINDOW = 8
#: Rows (of numbers, and one text at most) and bytes of text up to which a test table is broadcast.
SMALL_ROWS, SMALL_BYTES = 500_000, 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a text column, in order (an empty array for null)."""
    trimmed = F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), f"^{_GAPS}|{_GAPS}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAPS))


def test_windows(benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(w, words) of the distinct windows, w a number, and (w, item) of who has them."""
    items = plain(benchmark, item_id="item_id", text="text").select(F.col("item_id").cast("string").alias("item"), words("text").alias("own")).where("size(own) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("own") - n + 1, F.lit(1)))
    every = stored(items.select("item", F.explode(F.transform(starts, lambda i: F.slice("own", i, n))).alias("words")).distinct(), "windows")
    numbered = stored(every.select("words").distinct().withColumn("w", F.monotonically_increasing_id()), "numbered")
    return numbered, stored(every.join(numbered, "words").select("w", "item"), "owners")


def small(df: DataFrame) -> DataFrame:
    """A test table, marked for broadcast if a count of its rows and of its bytes of text says that it is small."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    size = F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(0)).cast("bigint")), F.lit(0))
    rows, text = df.agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and text <= SMALL_BYTES else df


def index_terms(windows: DataFrame) -> DataFrame:
    """word, term (a number) of all words of the windows, with the end mark as -1."""
    found = windows.select(F.explode("words").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term"))
    mark = windows.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("bigint").alias("term"))
    return stored(found.union(mark), "terms")


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """uid, doc_id, pos, term of every occurrence of a term; each document ends with a row of term -1 whose pos is its number of words."""
    rows = plain(documents, doc_id="doc_id", text="text").withColumn("uid", F.monotonically_increasing_id())
    listed = rows.select("uid", "doc_id", F.posexplode(F.concat(words("text"), F.array(F.lit("")))).alias("pos", "word"))
    return stored(listed.join(small(terms), "word").select("uid", "doc_id", "pos", "term"), "postings")


def phrase_hits(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """uid, start, w, len of every exact occurrence of a window, by intersecting postings from the rarest term on."""
    index = index.where("term >= 0").select("uid", "pos", "term")
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    counted = stored(terms.join(frequency, "term"), "frequencies")  # one row a term; a window with a term that no document has can't occur
    spread = windows.select("w", F.size("words").alias("len"), F.posexplode("words").alias("offset", "word")).join(small(counted), "word")
    lists = spread.groupBy("w", "len").agg(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("t")).where("size(t) = len")
    lists = stored(lists.select("w", "len", F.transform("t", lambda x: F.struct(x["offset"].alias("offset"), x["term"].alias("term"))).alias("t")), "test-lists")

    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    rarest = lists.select(first["term"].alias("term"), first["offset"].alias("offset"), "w", "len", second["term"].alias("next_term"), (second["offset"] - first["offset"]).alias("step"))
    found = index.join(small(rarest), "term").where(F.col("pos") >= F.col("offset"))
    start = (F.col("pos") - F.col("offset")).alias("start")
    alone = found.where("len = 1").select("uid", start, "w", "len")
    wanted = found.where("len > 1").select("uid", (F.col("pos") + F.col("step")).alias("pos"), F.col("next_term").alias("term"), start, "w", "len")
    second_lists = index.join(small(rarest.select(F.col("next_term").alias("term")).where("term is not null").distinct()), "term", "left_semi")
    columns = ("uid", "start", "w", "len")
    found = stored(wanted.join(second_lists, ["uid", "pos", "term"]).select(*columns).union(alone), "candidates")

    others = lists.where("len > 2").select("w", F.explode(F.slice("t", 3, 1 << 20)).alias("x")).select("w", "x.offset", "x.term")
    rest = found.where("len > 2").join(small(others), "w").select("uid", (F.col("start") + F.col("offset")).alias("pos"), "term", "start", "w", "len")
    met = rest.join(index, ["uid", "pos", "term"]).groupBy(*columns).agg(F.count("*").alias("met")).where("met = len - 2")
    return stored(met.select(*columns).union(found.where("len <= 2")), "hits")


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated of every document."""
    with shuffles_freed(documents.sparkSession):
        return settled(documents.sparkSession, "decontamination", lambda: _decontaminate(documents, benchmark, n, least_items))


def _decontaminate(documents: DataFrame, benchmark: DataFrame, n: int, least_items: int) -> DataFrame:
    windows, owners = test_windows(benchmark, n)
    terms = index_terms(windows)
    index = postings(documents, terms)
    hits = phrase_hits(index, windows, terms)
    covered = hits.select("uid", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    n_hit = covered.groupBy("uid").agg(F.count("*").alias("n_hit"))
    items = hits.select("uid", "w").distinct().join(small(owners), "w").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    every = index.where("term = -1").select("uid", "doc_id", F.col("pos").cast("bigint").alias("n_words"))
    found = every.join(n_hit, "uid", "left").join(items, "uid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), (F.size(items) >= least_items).alias("contaminated")
    )


def proximity(documents: DataFrame, phrases: DataFrame, distance: int) -> DataFrame:
    """doc_id, item_id, start: where two words that follow each other in an item stand within `distance` words, in order."""
    items = plain(phrases, item_id="item_id", text="text").select("item_id", words("text").alias("words"))
    terms = index_terms(items.select("words"))
    index = postings(documents, terms).where("term >= 0")
    pairs = items.select("item_id", F.explode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, 1 << 20).alias("b"))).alias("p")).where("p.b is not null")
    pairs = pairs.select("item_id", F.col("p.a").alias("word"), F.col("p.b").alias("other")).join(terms, "word")
    pairs = pairs.join(terms.toDF("other", "other_term"), "other").select("item_id", "term", "other_term").distinct()
    first = index.join(pairs, "term").select("uid", "doc_id", "item_id", F.col("pos").alias("start"), F.col("other_term").alias("term"))
    reach = first.withColumn("pos", F.explode(F.sequence(F.col("start") + 1, F.col("start") + distance)))
    return reach.join(index.select("uid", "pos", "term"), ["uid", "pos", "term"]).select("doc_id", "item_id", "start").distinct()


def clean(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, least_items: int = 2) -> DataFrame:
    """All columns of the documents that aren't contaminated; rows without a doc_id can't be named and stay."""
    bad = decontaminate(documents, benchmark, n, least_items).where("contaminated").select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti").select(*documents.columns)
