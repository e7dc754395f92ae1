import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from nullweave.llm import bpe, covertree, decontaminate, html, langid, minhash, pretokens, quality, substring, token_counts, token_ids
from nullweave.llm import queries as Q

RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def prose(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta".split()) + str(r.randrange(vocabulary)) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [
    BASE,
    BASE,
    BASE.replace("alpha", "omega", 1),
    prose(2, 40) + " " + " ".join(BASE.split()[20:60]),
    None,
    "",
    "   \n\t ",
    "one two three",
    "One  two\tthree",
    "Ünïcödé ²³ ½ ٣ 漢字かな 🙂 don't won't I'LL it's x y\x1cz\x85",
    "= " * 50 + "=" * 700 + " " * 30 + "a" * 400,
    prose(3, 9000, 5000),
    " ".join(BASE.split()[:70]) + " " + prose(4, 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with extra columns whose names the operators use inside, repeated rows and null ids."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "a text without id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = "sig n keys score lang_pred uid pos term met part id component weight y ids length rank".split()
    return df.withColumns({c: F.lit("clash") for c in clash}).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def everyone(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_splitter_is_the_pattern():
    import regex

    slow, fast = regex.compile(P.PATTERN), pretokens.Splitter(P.PATTERN)
    r = random.Random(5)
    letters = [chr(c) for c in range(256)] + list("'stmdrevl  \n\t") * 6 + ["é", "漢", "½", " "]
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(25)))
        assert fast(t) == slow.findall(t)


def test_bpe_round_trip(docs, nothing):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = everyone(bpe.round_trip(docs, RANKS, P.PATTERN))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0
    back = bpe.encode(docs.where("doc_id = 9"), RANKS, P.PATTERN).select(bpe.decode(F.col("ids"), RANKS).alias("t")).first()
    assert bytes(back.t).decode() == TEXTS[9]


def test_token_ids(docs, nothing, spark, tmp_path):
    t = token_ids.tokenizer(TOKENIZER)
    got = token_ids.digests(docs, TOKENIZER, P.PATTERN).collect()
    assert len(got) == len(TEXTS) + 2
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, want = 0, []
    for r in rows:
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_ids.digests(nothing, TOKENIZER, P.PATTERN).count() == 0


def test_token_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "no such token <|endoftex|>", "<|endoftext|><|endoftext|>", None, "x<|endoftext|>  y's"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = token_ids.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER, P.PATTERN).collect()
    start, want = 0, []
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 20])
def test_packing(bits):
    ids = np.random.default_rng(0).integers(0, 1 << bits, 1001).astype(np.uint32)
    raw = token_ids.pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    assert (token_ids.unpack(raw, bits, len(ids)) == ids).all()
    assert (token_ids.unpack(raw, bits, 7, 500) == ids[500:507]).all()
    assert token_ids.width(50257) == 16 and token_ids.width(1) == 1 and token_ids.width(65537) == 17


def best(word, scores):
    top = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            p = scores.get(word[s:e])
            if p is not None:
                c = (top[s][0] + p, top[s][1] + 1)
                if c[0] > top[e][0] or c[0] == top[e][0] and c[1] < top[e][1]:
                    top[e] = c
    return top[-1]


def test_token_counts(docs, nothing):
    scores, split = token_counts.piece_scores(RANKS), pretokens.Splitter(P.PATTERN)
    words = sorted({w.encode() for t in TEXTS for w in split(t)}, key=len)[:400]
    got = token_counts.trie_counts(words, scores)
    for w in words:
        assert got[w][1] == best(w, scores)[1] and got[w][0] == pytest.approx(best(w, scores)[0])
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, RANKS, P.PATTERN).collect()}
    for i in (0, 4, 7, 9):
        assert rows[i].n_tokens == sum(best(w.encode(), scores)[1] for w in split(TEXTS[i]))
    assert token_counts.token_counts(nothing, RANKS, P.PATTERN).count() == 0


def near(texts):
    sets = {}
    for i, t in texts:
        w = SPACED.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(docs, nothing):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    for i, (n, component) in near(list(enumerate(TEXTS))).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, component == i)
    assert got[None].component_id is None
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 0 and kept.where("doc_id = 3").count() == 1


def test_near_duplicates_of_many(spark):
    """Families of edited copies, and many documents that share one passage."""
    r, rows, passage = random.Random(9), [], prose(77, 40).split()
    for f in range(25):
        base = prose(100 + f, r.choice([8, 25, 60, 300]), 10_000).split()
        for _ in range(r.choice([1, 2, 6, 14])):
            w = [x if r.random() > r.choice([0, 0.005, 0.02, 0.04, 0.1]) else f"w{r.randrange(10**6)}" for x in base]
            rows.append((len(rows), " ".join(w)))
    for k in range(150):
        rows.append((len(rows), " ".join(passage) + " " + prose(10_000 + k, r.randrange(20, 90), 10_000)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df).collect()} == want


def test_near_duplicates_in_a_large_open_bucket(spark):
    """3 against 4 shingles (0.75), all 3 of them in 70 other texts: the pair's only common bucket is large and open."""
    pair, common = [f"q81x{k}" for k in range(8)], [f"c{k}" for k in range(24)]
    rows = [" ".join(pair[:7]), " ".join(pair)]
    rows += [" ".join([*pair[:7], *common, f"end{k}"]) for k in range(70)] + [" ".join([*common, f"tail{k}"]) for k in range(10)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = near(list(enumerate(rows)))
    assert want[1] == (4, 0)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df).collect()} == want


def test_near_duplicates_of_a_group_below_the_threshold(spark, monkeypatch):
    """300 texts at 0.70 from each other, some of them with a twin: pairs that aren't linked don't leave the tasks that compare them."""
    base, rows = prose(5, 104, 10_000).split(), []
    for k in range(300):
        rows.append(" ".join([*base, *(f"own{k}x{j}" for j in range(21))]))
        if k % 30 == 0:
            rows.append(rows[-1] + f" twin{k}")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    met, confirmed = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: met.append(pairs.count()) or confirmed(pairs, *rest))
    want = near(list(enumerate(rows)))
    assert len({c for _, c in want.values()}) == 300
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df).collect()} == want
    assert sum(met) < 16 * len(rows) < 300 * 299 / 4


def test_one_of_each_of_short_texts_below_the_threshold(spark, monkeypatch):
    """300 texts of 21 shingles, 17 of them in all (0.68), some with a twin: of small sets, too, only links leave the tasks."""
    base, rows = prose(6, 21, 10_000).split(), []
    for k in range(300):
        rows.append(" ".join([*base, *(f"own{k}x{j}" for j in range(4))]))
        if k % 30 == 0:
            rows.append(rows[-1] + f" twin{k}")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    met, confirmed = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: met.append(pairs.count()) or confirmed(pairs, *rest))
    want = near(list(enumerate(rows)))
    assert {x.doc_id for x in minhash.one_of_each(df).collect()} == {i for i, (_, c) in want.items() if i == c}
    assert sum(met) < 16 * len(rows) < 300 * 299 / 4


def test_rare_keys_lose_no_pair(spark):
    """Sets at 0.75 share a rare key, however common the rest of them is."""
    passage = prose(77, 40).split()
    rows = [(2 * k + e, " ".join([*passage, *prose(k, 60, 10_000).split(), *[f"z{k}y{j}" for j in range(20 * e)]])) for k in range(40) for e in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rare = {r.id: set(np.frombuffer(r.rare, np.int64)) for r in minhash._rare(df.selectExpr("doc_id as id"), df, (75, 100)).collect()}
    assert len(rare) == 80 and all(rare[2 * k] & rare[2 * k + 1] for k in range(40))
    assert sum(bool(rare[i] & rare[j]) for i in rare for j in rare if i // 2 < j // 2) == 0


def cut(texts):
    first, words = {}, {i: SPACED.findall(t or "") for i, t in texts}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(docs, nothing):
    got = {}
    for r in substring.digests(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed, r.kept_sha256))
    want = cut(list(enumerate(TEXTS)))
    assert all(got[i] == {v} for i, v in want.items())
    assert got[None] == {(4, 0, hashlib.sha256(b"a text without id").hexdigest())}
    assert substring.digests(nothing).count() == 0
    out = substring.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 0").first().text == TEXTS[0] and out.where("doc_id = 1").first().text == ""
    spans = substring.removals(docs).where("doc_id = 3").first().spans
    assert [(s.start, s.end) for s in spans] == [(40, 80)]


def test_substrings_of_colliding_windows(spark):
    """Windows of the same first 7 words whose hashes agree in the low 39 bits and in the partition (of 4)."""
    ends = [([807, 758, 337, 101, 309, 130], [902, 929, 748, 261, 322, 252]), ([49, 525, 609, 167, 996, 480], [917, 50, 535, 610, 348, 896])]
    rows = [" ".join(f"w{k}" for k in [*range(7), *end]) for pair in ends for end in pair]
    df = spark.createDataFrame([*enumerate(rows), (9, rows[3])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.digests(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 13}


def test_decontamination(docs, nothing, spark):
    items = [(1, " ".join(BASE.split()[30:45])), (2, "ONE, two; three!"), (3, None), (4, ""), (5, " ".join(BASE.split()[33:43])), (5, " ".join(BASE.split()[33:43])), (6, "never seen words here at all in any text")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash"))
    got = {}
    for r in decontaminate.decontaminate(docs, bench).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_hit, tuple(r["items"]), r.contaminated))
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    for i, t in enumerate(TEXTS):
        w, hit, own = WORD.findall(low(t)), set(), set()
        for g, who in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    own |= who
        assert got[i] == {(len(w), len(hit), tuple(sorted(own)), len(own) >= 2)}
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert not any(r.n_items for r in decontaminate.decontaminate(docs, bench.where("false")).collect())
    left = decontaminate.clean(docs, bench, least_items=1)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()}.isdisjoint({0, 1, 2, 7, 8})
    pairs = spark.createDataFrame([(1, "one three")], "item_id long, text string")
    assert {(r.doc_id, r.start) for r in decontaminate.proximity(docs, pairs, 2).collect()} == {(7, 0), (8, 0)}


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (r.normal(size=8) + 3 * (i % 4))]) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (920, [1.0, 2.0]), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("clash")).withColumn("score", F.lit(1))
    got = {}
    for x in covertree.top_k(df, "vec_id % 20 = 0", 20).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    good = {i: np.floor(64 * np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 20 == 0]:
        s = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        assert sorted(got.get(q, [])) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert covertree.top_k(df.where("false"), "vec_id % 20 = 0", 20).count() == 0


def test_cover_tree_covers():
    p = np.random.default_rng(1).normal(size=(500, 3)) * np.array([10, 1, 1])
    todo, leaves = [covertree.cover_tree(p)], []
    while todo:
        n = todo.pop()
        assert (np.sqrt(((p[n.rows] - n.center) ** 2).sum(axis=1)) <= n.radius + 1e-9).all()
        assert all(c.radius <= n.radius / 2 + 1e-9 for c in n.children)
        todo += n.children
        leaves += [] if n.children else n.rows.tolist()
    assert sorted(leaves) == list(range(500))


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="page"><header>Site name</header>
<nav><a href=a>Home</a> <a href=b>News</a></nav><div class="cookie-notice">We use cookies a lot here.</div>
<div id=main><h1>A title &amp; more</h1><p>First   paragraph with <b>bold</b> text, long enough to count as content.<p>Second one &eacute;&#233;; still open
<ul><li>item one of the list<li>item two</ul><script>var x = "</p>";</script><form><input><label>Your mail</label></form>
<aside>Related things</aside></div><div class="comments"><p>Reader: nice article, thanks a lot for it!</p></div><footer>(c) 2024</footer></body></html>"""


def test_html(spark):
    want = "A title & more First paragraph with bold text, long enough to count as content. Second one éé; still open item one of the list item two"
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "just text"), (5, "u", "<p>a<!-- <p>b"), (6, "u", "<div><div><p>x</b></div>"), (7, "u", "<" * 200), (8, "u", "<p>" * 5000 + "deep"), (None, "u", "<p>no id</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == "" and got[4].text == "just text" and got[5].text == "a" and got[6].text == "x" and got[8].text == "deep" and got[None].text == "no id"
    assert html.extract(df.where("false")).count() == 0


def test_html_of_layout_names():
    """A noise word in the name of what holds the article doesn't take the article away."""
    story = "<p>" + "The council met on Monday and talked at length about the new bridge. " * 4 + "</p>"
    want = " ".join(story[3:-4].split())
    for name in ("content has-sidebar", "no-sidebar", "page with-nav", "post related-posts-on", "search-results", "modal-open"):
        assert html.main_text(f'<body><div class="{name}"><article>{story}</article></div><div class="ad">Buy now</div></body>') == want
        assert html.main_text(f'<body><div class="{name}"><div>{story}<div class="comments"><p>Nice.</p></div></div></div></body>') == want
    assert html.main_text(f"<body><form action=x><main>{story}</main><input></form></body>") == want
    comments = '<div class="comments">' + "<article><p>I have a long opinion on all of this, as ever.</p></article>" * 20 + "</div>"
    assert html.main_text(f"<body><article>{story}</article>{comments}</body>") == want
    assert html.main_text(f'<body><div class="no-sidebar"><article>{story}</article>{comments}</div></body>') == want


def test_html_by_density():
    """The article is found without being named, whole, with short blocks and inline markup; a page's header goes, an article's stays."""
    story = "<h1>Bridge news</h1><p><b>The council met on Monday</b> and talked at length<br>about the <a href=x>new bridge</a> over the river. " + "It was a long talk, as ever. " * 9 + "</p><p>So be it.</p>"
    want = "Bridge news The council met on Monday and talked at length about the new bridge over the river. " + "It was a long talk, as ever. " * 9 + "So be it."
    menu = "<ul>" + "".join(f"<li><a href={k}>Entry {k}</a></li>" for k in range(12)) + "</ul>"
    for tag in ("div", "article", "main", "section"):
        assert html.main_text(f"<body><header>Site Name Daily, news and a long tagline</header>{menu}<{tag}>{story}</{tag}></body>") == want
    assert html.main_text(f"<body><article><header>{story[:20]}</header>{story[20:]}</article></body>") == want


@pytest.mark.parametrize("page", ["<a " * 20_000, '<a "' * 20_000, "<!" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<div><p>" * 10_000, "<a '" * 9_999 + ">", "<" * 100_000])
def test_html_takes_linear_time(page):
    import time

    start = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - start < 2


def test_quality(spark, docs, nothing):
    good = [(i, prose(i, 80), 1) for i in range(60)]
    bad = [(100 + i, " | ".join(prose(i, 60).split()), 0) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(999, 1), (3, None)], "doc_id long, quality int")
    w = quality.train(df.where("doc_id % 2 = 0"), labels)
    scored = quality.score(df, w).join(labels, "doc_id").where("doc_id % 2 = 1 and quality is not null").collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in scored)
    rows = quality.score(docs, w)
    assert rows.count() == docs.count() and rows.where("score between 0 and 1").count() == rows.count()
    assert quality.score(nothing, w).count() == 0
    none = quality.train(df, labels.where("false"))
    assert quality.score(df, none).first().score == 0.5
    ones = quality.train(df, labels.where("quality = 1"))
    assert quality.score(docs, ones).where("score > 0.5").count() == docs.count()


def test_language(spark, docs, nothing):
    a = [(i, "the cat and the dog are in the house with us " * 3, "en") for i in range(10)]
    b = [(20 + i, "die katze und der hund sind bei uns im haus " * 3, "de") for i in range(10)]
    df = spark.createDataFrame([*a, *b, (50, "x", None), (51, None, "fr")], "doc_id long, text string, lang string")
    models = langid.train(df, "true")
    new = spark.createDataFrame([(1, "und die katze"), (2, "and the cat"), (3, None), (4, "123 !?"), (5, "漢字漢字漢字漢字漢字" * 9)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(new, models).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred, got[4].lang_pred) == ("de", "en", "und", "und")
    assert got[5].rejected and got[5].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, models).count() == docs.count() and langid.predict(nothing, models).count() == 0
    assert langid.predict(new, langid.train(df.where("false"), "true")).where("lang_pred = 'und'").count() == 5
    # the same in several passes, languages cut by the histories of their 4-grams
    cut = langid.train(df, "true", held=1500)
    assert len(cut.passes) > 3 and max(of for own in cut.passes for _, _, of in own) > 1
    for r in langid.predict(new, cut).collect():
        x = got[r.doc_id]
        assert (r.lang_pred, r.rejected) == (x.lang_pred, x.rejected) and r.score == pytest.approx(x.score) and r.cross_entropy == (x.cross_entropy and pytest.approx(x.cross_entropy))


def test_language_limits_are_of_all_training_texts(spark):
    """Limits follow every training text, whatever their number, order of values and copies, and are the same in several passes."""
    r, letters = random.Random(3), "abcdefghijkl"
    rows = [(lang, " ".join("".join(r.choice(letters[: 2 + k % 11]) for _ in range(5)) for _ in range(9))) for lang, m in (("x", 2600), ("y", 50), ("z", 1)) for k in range(m)]
    rows += rows[:40] + [("x", "short"), ("w", "tiny")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    models = langid.train(df, "true")
    tables = models.load(models.passes[0])
    want = {}
    for lang in "xyz":
        chars, logs = langid.negative_logs([lang], [m for m in tables if m[0] == lang], [t for x, t in rows if x == lang])
        want[lang] = pytest.approx(1.1 * np.quantile((logs[:, 0] / chars)[chars >= langid.SURE_CHARS], 0.999), rel=1e-12)
    assert models.limits == want
    cut = langid.train(df, "true", held=100_000)
    assert len(cut.passes) > 2 and max(of for own in cut.passes for _, _, of in own) > 1 and cut.limits == want


@pytest.mark.parametrize("q", [0.0, 0.3, 0.999, 1.0])
def test_quantiles_are_exact(spark, q):
    h = {"a": np.random.default_rng(1).gamma(2.0, size=5000), "b": np.array([0.0, 0.0, 1e-300, 2.5]), "c": np.array([1.5]), "d": np.full(300, 0.7)}
    rows = [(lang, int(b)) for lang, x in h.items() for b in x.view(np.int64)]
    got = langid.quantiles(spark.createDataFrame(rows, "lang string, bits long"), q)
    assert got == {lang: pytest.approx(np.quantile(x, q), rel=1e-12) for lang, x in h.items()}


def test_kneser_ney_sums_to_one():
    g, n = np.unique(np.concatenate([langid.grams("abracadabra is a word " * 3), langid.grams("banana bandana")]), return_counts=True)
    m = langid.Model(g, n)
    letters = np.unique(g & np.uint64(0xFFFF))
    for history in (g >> np.uint64(16))[:20]:
        p = np.exp(m.log_probability(history << np.uint64(16) | letters)).sum()
        assert p == pytest.approx(1 - m.levels[-1][3][0] * m.uniform, abs=0.05) and p <= 1 + 1e-9


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_queries_against_sql(spark, name):
    from nullweave.plans import compare

    small = f"{DATA}/sf0.001"
    assert compare.differences(Q.QUERIES[name](spark, small), compare.duck(small), Q.ORACLE[name]) == []


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = Q.op3_quality(spark, sf).where("held_out").join(labels, "doc_id").where("quality is not null").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    lang = Q.op5_language(spark, sf).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert q > 0.97 and lang > 0.98


def test_pipeline(spark):
    import corpus_pipeline as C

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = C.keep_quality(spark, docs, sf).persist()
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups = near(rows)
    one = C.drop_near_duplicates(spark, kept, sf).persist()
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if c == i}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = cut(rows)
    parts = C.cut_repeats(spark, one, sf).persist()
    for r in parts.collect():
        assert hashlib.sha256(" ".join(SPACED.findall(r.text)).encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)
    grams = {tuple(w[k : k + 8]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [WORD.findall(low(r.text))] for k in range(max(1, len(w) - 7))}
    clean = C.drop_contaminated(spark, parts, sf).persist()
    dirty = {r.doc_id for r in parts.collect() for w in [WORD.findall(low(r.text))] if any(tuple(w[k : k + 8]) in grams for k in range(len(w)))}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in parts.collect()} - dirty
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    out = {r.doc_id: list(r.ids) for r in C.encode(spark, clean, sf).collect()}
    assert out == {i: enc.encode_ordinary(t) for i, t in texts.items()}
    assert C.run(spark, sf).count() == len(out)
