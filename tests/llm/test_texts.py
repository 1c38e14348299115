"""Toxicity, language model, page text, leaks, licences and the pipeline."""

import collections
import html
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrahaz.llm import decontamination, language_model, licenses, page_text, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(1)
    bad, good = ["foulword", "rotten", "vermin"], ["word%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = [rng.choice(good) for _ in range(60)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, marked):
    return spark.createDataFrame(marked[0], "doc_id long, text string"), spark.createDataFrame(marked[1], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, marked):
    docs, labels = frames(spark, marked)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = dict(marked[1])
    wrong = [i for i in truth if i % 3 == 0 and found[i]["predicted"] != truth[i]]
    assert len(wrong) <= 2 and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(r["evidence"][0]["toxic"] == 1 for i, r in found.items() if truth[i] and r["predicted"])


def test_neighbours_are_the_nearest(spark, marked, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "MIN_GAIN", 1.0)
    monkeypatch.setattr(toxicity, "MIN_ODDS", 1.0)
    docs, labels = frames(spark, marked)
    model = toxicity.fit(docs, labels)
    dense = np.zeros((len(model.ids), len(model.terms)))
    for t, (*_, example, own) in enumerate(model.posting):
        dense[example, t] = own
    row, term, own = model.vectors(pa.array([x for _, x in marked[0][:40]], pa.large_string()))
    for i in range(40):
        here = row == i
        best, who = model.nearest(term[here], own[here])
        cosine = dense[:, term[here]] @ own[here]
        assert np.allclose(best, np.sort(cosine[cosine > 0])[::-1][:toxicity.NEIGHBOURS])
        assert np.allclose(cosine[who], best)


def test_toxicity_of_odd_rows(spark, marked):
    docs, labels = frames(spark, marked)
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "", "y")], "doc_id long, text string, score string")
    rows = toxicity.score(odd, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 3 and all(r["predicted"] == 0 and r["evidence"] == [] for r in rows)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert [r["score"] for r in toxicity.score(odd, None).collect()] == [0.0] * 3
    assert toxicity.score(docs.limit(0), None).collect() == []
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, one).collect())


def test_op2_rows(spark, small, documents):
    rows = queries.QUERIES["op2_toxicity"](spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in documents)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_op3_counts_base_and_gain(spark, small, documents):
    tokens = {d: WORD.findall((x or "").translate(LOWER)) + [""] for d, x in documents}
    count = collections.Counter(w for d, t in tokens.items() if crc(d, 7) != 2 for w in t)
    total, kinds = sum(count.values()), len(count)
    rows = queries.QUERIES["op3_pitman_yor"](spark, small).collect()
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"], 7) == 2, len(t), sum(count[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in t), rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_predictive_probabilities_sum_to_one(spark, monkeypatch):
    # every word that the texts know follows "ab" once, and one unknown word stands for the rest
    train = [(1, "ab cd ab ef gh ab cd"), (2, "ef ab gh gh cd")]
    known = ["ab", "cd", "ef", "gh"]
    docs = train + [(10 + i, f"ab {w}") for i, w in enumerate([*known, "zz"])] + [(20, "ab")]
    rows = {r["doc_id"]: r["score"] for r in language_model.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 10).collect()}
    beyond = {w: rows[10 + i] for i, w in enumerate([*known, "zz"])}
    # score("ab w") = P(ab) P(w | ab) P(end | w) and score("ab") = P(ab) P(end | ab): compare two chunkings for equality
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 16)
    again = {r["doc_id"]: r["score"] for r in language_model.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 10).collect()}
    assert all(again[d] == pytest.approx(rows[d], rel=1e-6) for d in rows)
    assert all(v < 0 for v in beyond.values()) and beyond["zz"] < beyond["cd"]


def test_restaurants_are_proper():
    rng = np.random.default_rng(3)
    word, context, counts = np.repeat(np.arange(6), 4), np.tile([0x6162, 0x6362, 0x6163, 0x2020], 6), rng.integers(0, 90, 24)
    bucket = language_model.Bucket(word, context, counts)
    discounts, uniform = (0.6, 0.5, 0.4), 1 / 7
    totals, seats = np.zeros(language_model._SIZE), None
    for k in range(3):
        seats = bucket.sweep(seats, totals, discounts, uniform, np.random.default_rng(k))
        totals = bucket.totals(seats)
        assert (seats[0] <= counts).all() and ((seats[0] > 0) == (counts > 0)).all()
    p0, _, p2 = bucket.predict(seats, totals, discounts, uniform)
    unseen = (language_model.STRENGTH + discounts[2] * totals[-2]) * uniform / (language_model.STRENGTH + totals[-1])
    assert p0.sum() + unseen == pytest.approx(1)
    for c in np.unique(context):
        narrow = c & 0xFF
        t1, c1 = totals[2 * 65536 + narrow], totals[2 * 65536 + 256 + narrow]
        p1 = (language_model.STRENGTH + discounts[1] * t1) * unseen / (language_model.STRENGTH + c1)
        rest = (language_model.STRENGTH + discounts[0] * totals[c]) * p1 / (language_model.STRENGTH + totals[65536 + c])
        assert p2[context == c].sum() + rest == pytest.approx(1)


def _one_by_one(customers, weight, discount, rng):
    """Tables of one dish by the definition, with the draws of ``_seat``."""
    tables, seated = 1, 1
    while seated < customers:
        drawn = rng.random(max(1, min(seated, language_model.LOT)))
        for k, u in enumerate(drawn[:customers - seated], seated):
            free = weight(tables)
            tables += u * (free + k - discount * tables) < free
        seated += len(drawn)
    return tables


@pytest.mark.parametrize("lot", [1 << 18, 37])
def test_every_customer_meets_the_tables_of_those_before(monkeypatch, lot):
    monkeypatch.setattr(language_model, "LOT", lot)
    for seed, (customers, a, b, discount) in enumerate([(5000, 40.0, 0.3, 0.7), (3000, 1e9, 0, 0.5), (2000, 0.02, 0.9, 0.9), (65, 5.0, 2.0, 0.1), (1, 1.0, 0, 0.5)]):
        found = language_model._seat(np.array([customers]), lambda dishes, now: a + b * now, discount, np.random.default_rng(seed))
        assert found.tolist() == [_one_by_one(customers, lambda t: a + b * t, discount, np.random.default_rng(seed))]
    many = language_model._seat(np.array([900, 0, 3, 1, 70]), lambda dishes, now: np.full(now.shape, 1e12), 0.5, np.random.default_rng(1))
    assert many.tolist() == [900, 0, 3, 1, 70]  # nobody shares a table that is so unlikely to be chosen


def test_customers_leave_before_they_are_seated():
    # one word in one context: nothing but its own customers is in the three restaurants
    bucket, discounts, uniform, s = language_model.Bucket(np.array([0]), np.array([0x6162]), np.array([400])), (0.6, 0.5, 0.4), 1 / 3, language_model.STRENGTH
    totals, seats = np.zeros(language_model._SIZE), None
    for seed in range(4):
        t2, _, t1, _, t0 = (0, 0, 0, 0, 0) if seats is None else (int(x[0]) for x in seats)
        p0 = uniform if seats is None else (t1 - 0.4 * t0 + (s + 0.4 * t0) * uniform) / (s + t1)

        def parent(now, tables, discount, beyond):
            tables = min(max(tables, 1), now)
            return (now - discount * tables + (s + discount * tables) * beyond) / (s + now)

        rng = np.random.default_rng(seed)
        n2 = _one_by_one(400, lambda t: (s + 0.6 * t) * parent(t, t1, 0.5, p0), 0.6, rng)
        n1 = _one_by_one(n2, lambda t: (s + 0.5 * t) * parent(t, t0, 0.4, uniform), 0.5, rng)
        n0 = _one_by_one(n1, lambda t: (s + 0.4 * t) * uniform, 0.4, rng)
        seats = bucket.sweep(seats, totals, discounts, uniform, np.random.default_rng(seed))
        totals = bucket.totals(seats)
        assert [int(x[0]) for x in seats] == [n2, n2, n1, n1, n0]


def test_language_model_without_training_or_rows(spark):
    df = spark.createDataFrame([(4, "b c"), (None, None), (4, "b c")], "doc_id long, text string")
    assert sorted(r["score"] for r in language_model.score(df, F.lit(False)).collect()) == [0.0] * 3
    assert language_model.score(df.limit(0), F.lit(True)).collect() == []
    assert len(language_model.score(df, F.lit(True)).collect()) == 3


def test_words_before_that_end_alike_are_told_apart(spark):
    docs = [(i, "walked home") for i in range(20)] + [(20 + i, "talked loud") for i in range(20)]
    docs += [(100, "walked home"), (101, "walked loud"), (102, "talked loud"), (103, "talked home")]
    rows = {r["doc_id"]: r["score"] for r in language_model.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    assert rows[100] > rows[101] + 0.5 and rows[102] > rows[103] + 0.5


def _words(rng):
    # contexts 0, 1 end in the same two bytes, 2 in the same last byte, 3 in others
    before = np.array([0x6162 << 48 | 5, 0x6162 << 48 | 9, 0x6362 << 48 | 7, 0x6163 << 48 | 1], np.uint64)
    counts = rng.integers(0, 30, 24)
    return language_model.Words(np.full(6, 4, np.uint32), np.sort(before), np.tile(np.arange(4), 6), counts), counts


def test_restaurants_of_words_before_are_proper():
    rng = np.random.default_rng(5)
    own, counts = _words(rng)
    discounts, uniform, s = (0.7, 0.6, 0.5, 0.4), 1 / 7, language_model.STRENGTH
    totals, opened, seats = np.zeros(language_model._SIZE), np.zeros(4), None
    for k in range(3):
        seats = own.sweep(seats, totals, opened, discounts, uniform, np.random.default_rng(k))
        totals, opened, customers = own.totals(seats)
        tables = own.tables(seats)
        assert (tables <= counts).all() and ((tables > 0) == (counts > 0)).all()
        assert totals[:65536].sum() <= totals[65536:131072].sum() == opened.sum() == tables.sum() and customers.sum() == counts.sum()
    p = own.predict(seats, totals, opened, customers, discounts, uniform)
    beyond = (s + discounts[3] * totals[-2]) * uniform / (s + totals[-1])  # of the word that stands for all others
    for c in range(4):
        two = int(own.bytes.context[own.up[c]])
        p1 = (s + discounts[2] * totals[131072 + (two & 0xFF)]) * beyond / (s + totals[131072 + 256 + (two & 0xFF)])
        p2 = (s + discounts[1] * totals[two]) * p1 / (s + totals[65536 + two])
        rest = (s + discounts[0] * opened[c]) * p2 / (s + customers[c])
        assert p[own.where == c].sum() + rest == pytest.approx(1)


def test_customers_of_a_word_before_are_seated_one_by_one():
    # one word after one other: nothing but its own customers is in the four restaurants
    own = language_model.Words(np.array([1]), np.array([0x6162 << 48 | 5], np.uint64), np.array([0]), np.array([300]))
    discounts, uniform, s = (0.7, 0.6, 0.5, 0.4), 1 / 3, language_model.STRENGTH
    totals, opened, seats = np.zeros(language_model._SIZE), np.zeros(1), None
    for seed in range(4):
        t3, t2, _, t1, _, t0 = (0,) * 6 if seats is None else (int(x[0]) for x in seats)
        p0 = uniform if seats is None else (t1 - 0.4 * t0 + (s + 0.4 * t0) * uniform) / (s + t1)
        p1 = uniform if seats is None else (t2 - 0.5 * t1 + (s + 0.5 * t1) * p0) / (s + t2)

        def parent(now, tables, discount, beyond):
            tables = min(max(tables, 1), now)
            return (now - discount * tables + (s + discount * tables) * beyond) / (s + now)

        rng = np.random.default_rng(seed)
        n3 = _one_by_one(300, lambda t: (s + 0.7 * t) * parent(t, t2, 0.6, p1), 0.7, rng)
        n2 = _one_by_one(n3, lambda t: (s + 0.6 * t) * parent(t, t1, 0.5, p0), 0.6, rng)
        n1 = _one_by_one(n2, lambda t: (s + 0.5 * t) * parent(t, t0, 0.4, uniform), 0.5, rng)
        n0 = _one_by_one(n1, lambda t: (s + 0.4 * t) * uniform, 0.4, rng)
        seats = own.sweep(seats, totals, opened, discounts, uniform, np.random.default_rng(seed))
        totals, opened, _ = own.totals(seats)
        assert [int(x[0]) for x in seats] == [n3, n2, n2, n1, n1, n0]


def test_buckets_and_shards_exchange_the_words_before(spark, monkeypatch):
    # what a word before has served is spread over many buckets; the scores of one bucket differ by draws only
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["ab", "cb", "de", "f", "gh", "ib"]) for _ in range(30))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {r["doc_id"]: r for r in language_model.score(frame, F.col("doc_id") < 30).collect()}
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 200)
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 500)
    for r in language_model.score(frame, F.col("doc_id") < 30).collect():
        one = whole[r["doc_id"]]
        assert r[:4] == one[:4] and r["base_score"] == pytest.approx(one["base_score"], rel=1e-9)
        assert r["score"] == pytest.approx(one["score"], rel=0.02)


def test_op7_on_all_pages(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.QUERIES["op7_page_text"](spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b<script>x</script>", "a\nb"), ("<!-- only -->", ""), ("<" * 50, "<" * 50),
    ("<body><header><h1>Site</h1></header><div><h1>T</h1><p>One &amp; two<!-- x --> three<br>four<p>Second <a href=x>link</a> text</div>"
     "<div class='comments'><p>first reader says much</p></div><ul class=menu><li>a<li>b</ul></body>", "T\nOne & two three four\nSecond link text"),
    ("<main><p>kept words here</p><aside>related</aside><form>mail <input></form></main><footer>end</footer>", "kept words here"),
    ("<article><p>it&#39;s &lt;b&gt; &nbsp; x</p><table><tr><td>1<td>2</table></article>", "it's <b> x\n1\n2"),
])
def test_page_shapes(page, text):
    assert page_text.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<article><p>first words</p><section id='related-work'><h2 id='navigation-systems'>Navigation</h2><p class='share-price'>second words</p></section>"
     "<div id='social-impact'>third</div><section id='share-of-market'>fourth</section><div class='comment'>fifth <a href=x>l</a> words</div></article>",
     "first words\nNavigation\nsecond words\nthird\nfourth\nfifth l words"),
    ("<body><div><h1>T</h1><section id='notice'><p>one long part of the text</p></section><div id='share-price'><p>another part of the text</p></div></div></body>",
     "T\none long part of the text\nanother part of the text"),
    ("<body><div class='widget'><h1>T</h1><p>all of the text is in here</p></div></body>", "T\nall of the text is in here"),
    ("<article><p>kept words here</p><ul class='share-buttons'><li><a href=x>one site</a><li><a href=y>other</a></ul></article>", "kept words here"),
    ("<body><div><p>kept words in a long line</p></div><div class='site-footer'><p>all about us</p></div><div id=comments2>x y</div></body>",
     "kept words in a long line"),
    # lower case of some letters is longer
    ("<article>" + "\u0130" * 30 + "<SCRIPT>x = 1</Script><p>after it</p><style>y</STYLE ><p>end</p></article>", "\u0130" * 30 + "\nafter it\nend"),
    ("<article><script>a = '</scripts>' + b</script><p>after it</p></article>", "after it"),
])
def test_names_alone_do_not_drop_text(page, text):
    assert page_text.main_text(page) == text


POST = "<p>the first part of the post is here</p><p>the second part of the post follows it</p>"
TEXT = "the first part of the post is here\nthe second part of the post follows it"
REMARKS = "".join(f"<p>reader {i} writes a remark of some length about the post, quite a long one</p>" for i in range(4))


@pytest.mark.parametrize("page, text", [
    (f"<article>{POST}<div class='comments'><p>one remark here</p><p>two</p></div></article>", TEXT),
    (f"<article>{POST}<section id=comments><p>one remark here</p></section><div class='comment-list'><p>other</p></div></article>", TEXT),
    (f"<body><article>{POST}<div class='comments'>{REMARKS}</div></article></body>", TEXT),
    (f"<article>{POST}<div class='advert'><p>buy this now</p></div><div class=ad>and this</div></article>", TEXT),
    (f"<main>{POST}<div class='newsletter'><p>get our news</p></div><div id='cookie-notice'>we use cookies</div></main>", TEXT),
    (f"<body><div class='post'>{POST}</div><div class='comments'>{REMARKS}</div></body>", TEXT),
    (f"<body><div class='post'>{POST}</div><section id='comments'>{REMARKS}</section></body>", TEXT),
    (f"<body><form action='x'><div class='page'>{POST}</div><input name=a></form></body>", TEXT),
    (f"<body><div>{POST}</div><form><p>your name</p><input></form></body>", TEXT),
    (f"<body><main><article>{POST}</article><article><p>another article stands beside it in full</p></article></main></body>",
     TEXT + "\nanother article stands beside it in full"),
    (f"<body><main><h1>Title</h1><article>{POST}</article><ul><li><a href=x>more of this</a></ul></main></body>", "Title\n" + TEXT),
    ("<article><p>with <math><mi>x</mi><mo>+</mo><mn>1</mn></math> inside the line of text</p></article>", "with x+1 inside the line of text"),
    (f"<body><div class='comments'>{POST}</div></body>", TEXT),
])
def test_pages_without_comments_adverts_notices_and_forms(page, text):
    assert page_text.main_text(page) == text


def test_pages_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (None, "<p>x</p>", None)], "page_id long, html string, text string")
    assert sorted(r["text"] for r in page_text.extract(df).collect()) == ["", "", "x"]
    assert page_text.extract(df.limit(0)).collect() == []


def test_op6_finds_the_planted_items(spark, small, documents):
    def plain(x):
        return f" {' '.join(re.findall(r'[^\W_]+', (x or '').lower()))} "

    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    expected = {(d, i) for d, x in documents for i, b in items if b in plain(x)}
    found = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op6_template_leaks"](spark, small).collect()}
    assert expected and found == expected


def leak_frames(spark):
    item = "A train leaves Boston at 9 with 40 passengers and arrives after 3 hours, how far did Alice travel from Boston to Paris?"
    benchmark = spark.createDataFrame([(1, item), (2, "short item here"), (3, None), (4, "")], "item_id long, text string")
    changed = "Noise. A train leaves Chicago at 7 with 55 passengers and arrives after 8 minutes, how far did Carol travel from {} to Rome? more"
    docs = spark.createDataFrame([
        (1, changed.format("Chicago")), (2, changed.format("Denver")), (3, "this is a SHORT item here ok"), (4, None), (None, "short item here"),
        (6, "a train leaves town"), (6, "a train leaves town")], "doc_id long, text string")
    return docs, benchmark


def test_changed_numbers_and_names_are_caught_when_consistent(spark):
    docs, benchmark = leak_frames(spark)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()} == {(1, 1), (3, 2), (None, 2)}
    kept = decontamination.decontaminate(docs, benchmark).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 4, 6, 6]


def test_leaks_with_names_that_open_sentences_and_dense_slots(spark):
    items = [
        "Tom has 5 apples. Sara buys 3 more apples. How many apples does Tom have now?",
        "What is 12 plus 30 plus 41?",
        "Scores of 3 4 5 6 7 went to Anna Berg on May 2 1999 and 8 9 10 11 to nobody",
        "The river that Alice Brown crossed near Paris was wide and cold at night",
    ]
    cases = [
        ("Ben has 7 apples. Lily buys 4 more apples. How many apples does Ben have now?", {0}),
        ("x y. \"Ben has 7 apples.\nLily buys 4 more apples. How many apples does\nBen have now?\"", {0}),
        ("Ben has 7 apples. Lily buys 4 more apples. How many apples does Lily have now?", set()),
        ("well, what is 7 plus 44 plus 6 then", {1}), ("what is 7 plus 44 minus 6 then", set()), ("what is 7 plus 7 plus 6", set()),
        ("scores of 13 14 15 16 17 went to Carl Dorn on June 22 2001 and 18 19 20 21 to nobody", {2}),
        ("the river that\nCarol\nGreen crossed near\nRome was wide and cold at night", {3}),
        # a part with other names does not undo equal words
        ("The river that Alice Brown crossed near Paris was wide and cold at day", {3}),
        ("the river that alice brown crossed near paris was wide and cold at night", {3}),
        ("1 2 3 4 5 6 7 8 9 10 11 12", set()), ("Who has the river? Where is it?", set()),
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()}
    assert found == {(i, item) for i, (_, held) in enumerate(cases) for item in held}


def test_leaks_of_empty_tables(spark):
    docs, benchmark = leak_frames(spark)
    assert decontamination.leaks(docs.limit(0), benchmark).collect() == []
    assert decontamination.leaks(docs, benchmark.limit(0)).collect() == []


def test_canonical_words_without_a_number_per_byte():
    """Words lose the signs around them as by a regular expression, and a slice is worked on in few bytes per byte of text."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZ9 .,\n-é(\"") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "...", ".. a", "a"]
    first, value, _ = decontamination.canonical(pa.array(texts, pa.large_string()))
    cores = [[m for w in WORD.findall(t) for m in re.findall(r"[a-zA-Z0-9é](?:.*[a-zA-Z0-9é])?", w)] for t in texts]
    assert np.diff(first).tolist() == [len(c) for c in cores]
    plain = decontamination.canonical(pa.array([" ".join(c) for c in cores], pa.large_string()))[1]
    assert value.tolist() == plain.tolist()

    text = pa.array([("Some words of seven 7 letters, and a Name. " * 12_000)], pa.large_string())
    tracemalloc.start()
    decontamination.canonical(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * len(text[0].as_py())


def test_op9_equals_its_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    rows = queries.QUERIES["op9_license_rules"](spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(db.execute(queries.ORACLES["op9_license_rules"]).fetchall())


def test_licence_rules_need_their_order(spark):
    grant, notice, as_is = (licenses.SENTENCES[k].capitalize() + "." for k in ("mit_grant", "mit_notice", "mit_as_is"))
    texts = [f"Intro.\n{grant} {notice}\n\nUnknown words. {as_is}", f"{as_is} {grant} {notice}", "SPDX-License-Identifier: Apache-2.0", None, "",
             "Licensed under the Apache License, Version 2.0. All rights reserved!", f"Intro. {grant} {notice} {as_is}".replace(" to ", "\n  to ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert found == {0: ["MIT"], 1: [], 2: ["Apache-2.0"], 3: [], 4: [], 5: ["Apache-2.0", "Proprietary"], 6: ["MIT"]}
    assert licenses.scan(df.limit(0)).collect() == []


MIT_TEXT = """MIT License
{}
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

APACHE_TEXT = """Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

BSD_TEXT = """Copyright (c) 2020, X

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2{0} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3{0} Neither the name of {1} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""

ISC_TEXT = """ISC License

Copyright (c) 2020 X

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""


def test_wrapped_licence_texts(spark):
    def comment(text, mark):
        return "\n".join((mark + line).rstrip() for line in text.split("\n"))

    mit, bsd = MIT_TEXT.format("\nCopyright (c) 2020 X\n"), BSD_TEXT.format(".", "the copyright holder")
    cases = [
        (mit, ["MIT"]), (MIT_TEXT.format("Copyright (c) 2020 X").replace("\n\n", "\n"), ["MIT"]), (MIT_TEXT.format(""), ["MIT"]),
        (mit.replace("\n", "\r\n"), ["MIT"]), (comment(mit, " * "), ["MIT"]), (comment(mit, "# "), ["MIT"]),
        (APACHE_TEXT, ["Apache-2.0"]), (APACHE_TEXT.replace("\n\n", "\n"), ["Apache-2.0"]), (comment(APACHE_TEXT, "// "), ["Apache-2.0"]),
        (bsd, ["BSD-3-Clause"]), (BSD_TEXT.format(")", "the University of X").replace("\n\n", "\n"), ["BSD-3-Clause"]),
        (comment(bsd, " * "), ["BSD-3-Clause"]), (bsd[:bsd.index("3.")] + bsd[bsd.index("THIS"):], ["BSD-2-Clause"]), (ISC_TEXT, ["ISC"]),
        ("- licensed under the\n  MIT license\n- written in haste", ["MIT"]),
        # each part of a text by itself: a notice on its line does not decide how the rest is read
        (f"All rights reserved\nReleased under the MIT license\nLicensed under CC BY 4.0\n\nno end\n\n{bsd}", ["BSD-3-Clause", "CC-BY-4.0", "MIT", "Proprietary"]),
        ("This work is licensed under" + " " * 5000 + "the GNU General Public License version 3", ["GPL-3.0"]),
        ("Redistribution and use of these texts are permitted:\n1. never\n2. at night", []),
    ]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert found == {i: names for i, (_, names) in enumerate(cases)}
    for sentence in licenses._KNOWN:
        assert re.search(licenses._SIGNS, sentence) and len(sentence) >= licenses._LEAST


def test_pipeline_stage_by_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, small)
    rows = out.collect()
    assert out.columns[:5] == docs.columns and all(r["round_trip"] for r in rows)
    assert 0 < len(rows) < len(before) and {r["doc_id"] for r in rows} <= set(before)
    leaks = {r["doc_id"] for r in queries.QUERIES["op6_template_leaks"](spark, small).collect()}
    assert not leaks & {r["doc_id"] for r in rows}
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "byte-level BPE"


def test_pipeline_keeps_clean_rows(spark, small):
    rng = random.Random(9)
    rows = [(i, " ".join("w%d" % rng.randint(0, 10**6) for _ in range(40)), "en", "s", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(30))


def test_every_stage_against_brute_force(spark, small):
    """Each stage on what the one before kept, beside a plain version of its rule."""
    import tiktoken
    import public_tokenizers

    from tests.llm.test_duplicates import linked_texts, without_repeats
    from terrahaz.llm import byte_bpe
    from terrahaz.llm.frames import new_folder

    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = new_folder(spark, "stage")
        stage(spark, docs, small).write.parquet(folder)
        after = spark.read.parquet(folder)
        seen.append((name, {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}))
        docs = after
    (_, before, kept), (_, _, single), (_, _, cut), (_, _, clean), (_, _, coded) = seen
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    gone = set(before) - set(kept)
    assert all(truth.get(d, 1) == 1 for d in gone)  # few labels here: what toxicity finds is tested above
    rows = [(d, r["text"]) for d, r in kept.items()]
    assert set(single) == {d for d, _, least in linked_texts(rows, 5, 80) if d == least}
    expected = {d: (n, removed, digest) for d, n, removed, digest in without_repeats([(d, r["text"]) for d, r in single.items()])}
    assert set(cut) == set(single)
    for d, r in cut.items():
        n, removed, digest = expected[d]
        words = WORD.findall(r["text"] or "")
        assert len(words) == n - removed and r["n_chars"] == len(r["text"] or "")
        if not removed:
            assert r == single[d]

    def plain(x):
        return f" {' '.join(re.findall(r'[^\W_]+', (x or '').lower()))} "

    items = [plain(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(i in plain(r["text"]) for r in clean.values() for i in items)
    assert set(cut) - set(clean) <= {d for d, r in cut.items() if any(plain(i)[:60].strip() in plain(r["text"]) or i[-60:].strip() in plain(r["text"]) for i in items)}
    ranks = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(coded) == set(clean)
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in coded.values())
