"""The training-data operators against brute force, SQL, the tokenizer's library and held-out labels, and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from jobscope.llm import bpe, decontaminate, exact_dedup, html_text, near_dedup, quality, sharding, substring_dedup, toxicity, url_filter
from jobscope.llm import words as W
from jobscope.llm.queries import QUERIES, SQL

DOCS = "doc_id bigint, text string, lang string, node string, score double"
SENTENCE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, None, None, None, None), (2, "", "en", "x", 1.0), (3, "   \n\t", "en", None, None), (4, SENTENCE, "en", "y", None),
    (5, SENTENCE, None, None, 2.0), (5, SENTENCE, None, None, 2.0), (None, SENTENCE, "en", None, None), (None, None, None, None, None),
    (6, "a " * 30000, "en", None, None), (7, "short text", "en", None, None), (8, "é漢😀<|endoftext|> x", "fr", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("name", list(SQL))
def test_queries_match_sql(spark, duck, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


# --- encoding ---------------------------------------------------------------------------------


def test_bpe_equals_the_library(documents):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.load(bpe.vocabulary_path())
    random.seed(3)
    letters = " \n\t  abETHthe'sll0123½²é漢字 \u0085\x1c 　😀́-_.,!<|endoftext|>#"
    texts = [r["text"] for r in documents.collect()]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(2000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_streamed_tokens_do_not_depend_on_the_buffer(monkeypatch):
    own = bpe.load(bpe.vocabulary_path())
    assert 20 < own.lookahead < 1000
    random.seed(4)
    for piece in ("ab", "ation", "0", "=-", "éèa", "abcdefghijklmnop"):
        data = "".join(random.choice(piece) for _ in range(900)).encode()
        monkeypatch.setattr(bpe, "BUFFER", random.choice([1, 7, 50]))
        assert list(own.stream(data[i : i + 5] for i in range(0, len(data), 5))) == own.merge_all(data) == own.forward(data)


def test_bpe_odd_rows(odd, nothing):
    rows = bpe.encode_table(odd, round_trip=True).collect()
    assert len(rows) == len(ODD)
    assert sorted((r["text"] or "") for r in rows) == sorted((t[1] or "") for t in ODD)
    empty = next(r for r in rows if r["doc_id"] == 2)
    assert (empty["n_tokens"], empty["token_ids"], empty["ids_sha256"]) == (0, [], hashlib.sha256(b"").hexdigest())
    assert bpe.encode_table(nothing).count() == 0


# --- dedup ------------------------------------------------------------------------------------


def test_exact_odd_rows(odd, nothing):
    found = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(odd).collect()}
    text = hashlib.sha256(SENTENCE.encode()).hexdigest()
    assert (found[4, text]["keep_id"], found[4, text]["group_size"], found[4, text]["kept"]) == (5, 4, False)
    assert found[2, hashlib.sha256(b"").hexdigest()]["keep_id"] == 2 and found[1, hashlib.sha256(b"").hexdigest()]["keep_id"] == 2
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7, 8] and kept.columns == odd.columns


def brute_repeats(texts):
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        yield len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


@pytest.mark.parametrize("hot", [2, 400])
def test_substrings_by_brute_force(documents, odd, nothing, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    for df in (documents, odd.withColumn("doc_id", F.col("doc_id"))):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        expected = collections.Counter((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows])))
        found = substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert collections.Counter(map(tuple, found)) == expected
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_automaton_counts_windows():
    random.seed(5)
    texts = [[random.choice("abc") for _ in range(random.randint(3, 30))] for _ in range(20)]
    weights = [random.randint(1, 2) for _ in texts]
    automaton = substring_dedup.Automaton()
    for text, weight in zip(texts, weights):
        automaton.add(text, weight)
    automaton.close()
    seen = collections.Counter()
    for text, weight in zip(texts, weights):
        for i in range(len(text) - 3):
            seen[tuple(text[i : i + 4])] += weight
    for text in texts:
        assert automaton.repeated(text, 4) == [i for i in range(len(text) - 3) if seen[tuple(text[i : i + 4])] > 1]


def test_near_classes(spark, odd, nothing):
    random.seed(6)
    base = [f"w{random.randint(0, 9999)}" for _ in range(300)]
    rows, hub = [], " ".join(base)
    for i in range(40):
        copy = list(base)
        for _ in range(2):
            copy[random.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(f"w{random.randint(0, 9999)}" for _ in range(200))) for i in range(20)] + [(200, hub), (201, hub)]
    found = {r["doc_id"]: r for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {found[i]["class_id"] for i in [*range(40), 200, 201]} == {0} and found[0]["class_size"] == 42
    assert all(found[100 + i]["class_id"] == 100 + i and found[100 + i]["kept"] for i in range(20))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(odd).collect() if r["doc_id"]}
    assert (got[1], got[2], got[4], got[5], got[3], got[7]) == (1, 1, 4, 4, 3, 7)
    assert near_dedup.near_classes(nothing).count() == 0


def test_one_of_each_class(spark):
    words = lambda k, n=100: [f"{k}{j}" for j in range(n)]
    near = lambda k, tail: " ".join(words(k) + [tail])
    rows = [
        (1, near("a", "x")), (None, near("a", "y")), (None, near("b", "x")),  # a null-id copy beside a null-id row of its own
        (2, near("c", "x")), (3, near("c", "y")), (3, near("d", "x")),  # one id with two texts, one of them a copy
        (None, near("e", "x")), (None, near("e", "y")), (None, near("e", "y")),  # a class without ids
        (4, near("f", "x")), (4, near("f", "x")), (4, near("f", "y")),  # a class that repeats its id
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = [(r["doc_id"], r["text"]) for r in near_dedup.one_of_each(docs).collect()]
    assert collections.Counter((i, t.split()[0]) for i, t in left) == collections.Counter(
        [(1, "a0"), (None, "b0"), (2, "c0"), (3, "d0"), (None, "e0"), (4, "f0")]
    )
    assert set(left) <= set(rows)


def near_links(spark, texts):
    """Class of each text, and the linked pairs by brute force."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(rows).collect()}
    idf = near_dedup.inverse_frequencies(rows.select("text"))
    sides = [(i, j) for i in range(len(texts)) for j in range(i)]
    near = near_dedup.weighted_jaccard(pa.array([texts[i] for i, _ in sides]), pa.array([texts[j] for _, j in sides]), idf) >= near_dedup.SIMILARITY
    return found, [pair for pair, hit in zip(sides, near) if hit]


def test_near_classes_in_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 100, raising=False)
    common = [f"c{i}" for i in range(250)]
    texts = [" ".join(common + [f"o{i}x{j}" for j in range(34)]) for i in range(400)]
    # Three texts are near one other each, a little more than all others, which share 0.77; they meet in hot buckets only.
    texts += [" ".join(common + [f"o{i}x{j}" for j in range(8)] + [f"p{i}x{j}" for j in range(26)]) for i in (0, 39, 43)]
    random.Random(12).shuffle(texts)
    found, links = near_links(spark, texts)
    missed = sum(found[i] != found[j] for i, j in links)
    assert (len(links), missed, len(set(found.values()))) == (3, 0, 400)


def test_sampling_estimates_weighted_jaccard():
    idf = np.linspace(1, 5, near_dedup.CELLS).astype(np.float32)
    random.seed(7)
    shared, one, two = ([f"{k}{random.randint(0, 10**6)}" for _ in range(400)] for k in "sab")
    left, right = " ".join(shared + one[:100]), " ".join(shared + two[:100])
    exact = near_dedup.weighted_jaccard(pa.array([left]), pa.array([right]), idf)[0]
    hits = []
    for seed in range(30):
        marks = [f" m{seed} m{seed} m{seed} m{seed} m{seed}"] * 2
        keys = [near_dedup.band_keys(next(iter(W.pieces(pa.array([t + m])))), idf)[0] for t, m in zip((left, right), marks)]
        hits.append((keys[0] == keys[1]).mean())
    assert 0.6 < exact < 0.72 and abs(np.mean(hits) - exact**near_dedup.ROWS) < 0.12


# --- benchmark --------------------------------------------------------------------------------


def test_decontamination(spark, odd, nothing):
    random.seed(8)
    items = [" ".join(f"w{random.randint(0, 5000)}" for _ in range(n)) for n in (5, 12, 30, 60)]
    noise = lambda n: " ".join(f"w{random.randint(0, 5000)}" for _ in range(n))
    edited = items[2].split()
    edited[7], edited[20] = "changed", "other"
    del edited[12]
    far = items[3].split()
    far[::3] = ["q"] * len(far[::3])
    rows = [(i, f"{noise(50)} {x.upper().replace(' ', ',  ')} {noise(30)}") for i, x in enumerate(items)]
    rows += [(10, noise(40) + "\n" + " ".join(edited) + " " + noise(9)), (11, " ".join(far)), (12, noise(500)), (13, None), (14, "")]
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(items)] + [(9, None), (8, "")], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (3, 3), (10, 2)}
    assert (found[10, 2]["edits"], found[10, 2]["start_word"], found[2, 2]["edits"], found[2, 2]["n_words"]) == (3, 40, 0, 30)
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [11, 12, 13, 14]
    assert decontaminate.drop_contaminated(odd, bench).count() == len(ODD) and decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("n", [5, 8, 12, 15, 20, 30])
def test_edited_items_are_found(n):
    rng = random.Random(n)
    noise = lambda k: [f"w{rng.randint(0, 5000)}" for _ in range(k)]
    items = [noise(n) for _ in range(200)]
    index = decontaminate.Index(list(range(200)), [" ".join(x) for x in items])
    hits = 0
    for i, item in enumerate(items):
        edited = list(item)
        for _ in range(int(decontaminate.MAX_EDIT_SHARE * n)):
            at, kind = rng.randrange(len(edited)), rng.randrange(3)
            edited[at : at + (kind < 2)] = noise(kind > 0)
        text = " ".join(noise(rng.choice([0, 20])) + edited + noise(rng.choice([0, 20])))
        hits += any(found == i for piece in W.pieces(pa.array([text])) for _, found, *_ in index.matches(piece))
    assert hits >= 198


def test_edit_distance_and_recall():
    random.seed(9)
    for _ in range(60):
        item, text = ([random.randint(1, 4) for _ in range(random.randint(1, n))] for n in (8, 12))
        best = min(
            _distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1)
        )
        cost, a, b = decontaminate.closest(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64))
        assert cost == best == _distance(item, text[a:b])
    assert decontaminate.recall(0.0, 30, 50) == 1 and decontaminate.recall(0.1, 30, 200) > 0.95


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


# --- pages ------------------------------------------------------------------------------------


def test_main_text():
    page = (
        "<html><head><title>T</title><script>if (a < b) x('</p>')</script></head><body><header><h1>Site</h1></header>"
        "<ul class='menu'><li>Home<li>About</ul><div class=\"cookie-notice\">We use <p>cookies</div>"
        "<article><header><h1>Title &amp; more</h1></header><p>First <b>long</b>\n paragraph&nbsp;here<p>second<br>line"
        "<aside>related</aside><div class='ad'>buy <p>now</div><p>third</article>"
        "<section id='comments'><p>a comment that is far longer than the article, much longer than all of its text together</section>"
        "<footer>&copy; x</footer></body></html>"
    )
    assert html_text.main_text(page) == "Title & more\nFirst long paragraph here\nsecond line\nthird"
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "just &lt;text&gt;")] == ["", "", "", "just <text>"]


def prose(name, sentences=8):
    return " ".join(f"{name} sentence number {i} of the long body text, with words." for i in range(sentences))


@pytest.mark.parametrize("page, lines", [
    # Without an article: what lies around an advert stays, short or not; menus without a class go.
    (f"<body><p>An intro.</p><div class='ad'>Buy now</div><p>{prose('a')}</p><p>{prose('b')}</p><div class='ad'>x</div><p>Closing line.</p></body>",
     ["An intro.", prose("a"), prose("b"), "Closing line."]),
    (f"<div><a href=x>Home</a> <a href=x>About us</a></div><div>Start</div><div>Shop</div><div><h1>Title</h1><p>{prose('a')}<p>{prose('b')}</div><div>(c) me</div>",
     ["Title", prose("a"), prose("b")]),
    (f"<div><a>Start</a></div><p>{prose('a')}</p><ul><li>one</li><li>two</li></ul><p>{prose('b')}</p><div><a href=x>a link that is about as long as a sentence is.</a></div>",
     [prose("a"), "one", "two", prose("b")]),
    # Articles in articles, and side by side.
    (f"<article><p>Outer start.</p><article><p>{prose('a')}</p></article><p>Outer end.</p></article>", ["Outer start.", prose("a"), "Outer end."]),
    (f"<div class='main-content'><p>{prose('a')}</p></div><p>between</p><div class='main-content'><p>short one</p></div>", [prose("a"), "short one"]),
    (f"<main><p>{prose('a')}</p></main><article class='teaser'><p>other</p></article>", [prose("a")]),
    # Classes that name something else, or hold the text.
    (f"<div class='search results-page'><p>{prose('a')}</p><p>{prose('b')}</p></div>", [prose("a"), prose("b")]),
    (f"<div class='search'>find it here</div><p>{prose('a')}</p><div class='site-footer'>{prose('f', 3)}</div>", [prose("a")]),
    (f"<article><div class='header'><h1>Title</h1></div><section class='notice-of-death'><p>{prose('a')}</p></section><div class='cookie-notice'>c</div></article>",
     ["Title", prose("a")]),
    (f"<div id='comments'><p>{prose('c', 30)}</p></div><div><p>{prose('a')}</p></div>", [prose("a")]),
])
def test_text_of_pages_of_many_shapes(page, lines):
    assert html_text.main_text(page).split("\n") == lines


def test_pages_query(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op8_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["n_chars"] == len(r["text"]) and r["text"].split("\n")[0][:20] in html_text.html.unescape(body)
        assert "©" not in r["text"] and "track(" not in r["text"]


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "http://example.net/fr/", "https://example.com/de/", "http://b.org/fr/a#b", "http://x.net", "no url", None, "http://notexample.com/de/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rule_table(spark)).collect()}
    assert found == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/fr/", "net/", "block"),
        2: ("example.com", "/de/", "example.com/de/", "block"), 3: ("b.org", "/fr/a", "org/fr/", "allow"),
        4: ("x.net", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("notexample.com", "/de/", None, "allow"),
    }


# --- sharding ---------------------------------------------------------------------------------


def test_shards(spark, sf_dir, odd, nothing):
    rows = QUERIES["op10_sharding"](spark, sf_dir).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert len(sharding.assign_shards(odd, 3, ["doc_id", "text"]).collect()) == len(ODD)
    assert sharding.assign_shards(nothing, 3, ["doc_id"]).count() == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(drawn.mean() - 6) < 0.15 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    big = [sharding.hypergeometric(rng, 10**10, 10**10, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 5e5) < 500
    matrix = sharding.communication_matrix([5, 0, 17], [8, 7, 7], 3)
    assert matrix.sum(axis=1).tolist() == [5, 0, 17] and matrix.sum(axis=0).tolist() == [8, 7, 7]


# --- classifiers ------------------------------------------------------------------------------


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def labels():
    import duckdb

    return {r[0]: r[1:] for r in duckdb.sql("SELECT doc_id, quality, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()}


def test_quality_on_held_out_rows(spark, labels):
    rows = QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"]) for r in rows)
    judged = [(r["score"], r["predicted"], labels[r["doc_id"]][0]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == q for _, p, q in judged]) > 0.9
    good, bad = [s for s, _, q in judged if q], [s for s, _, q in judged if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_prior_from_histograms():
    positive, everything = np.zeros(10), np.zeros(10)
    positive[5:] = 200
    everything[5:], everything[:3] = 140, 100
    assert abs(quality.estimate_prior(positive, everything) - 0.7) < 0.03


def test_toxicity_on_held_out_rows(spark, labels):
    rows = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").collect()
    import duckdb

    truth = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    judged = [(r["is_toxic"], truth[r["doc_id"]]) for r in rows if held_out(r["doc_id"]) and r["doc_id"] in truth]
    found, missed = sum(p and t for p, t in judged), sum(not p and t for p, t in judged)
    assert found / (found + missed) > 0.85 and sum(p and not t for p, t in judged) <= 0.01 * len(judged)


def test_terms_are_counted_in_every_partition(spark):
    rows = [(f"rare common{i}", 0) for i in range(6)] + [("rare bad", 1), ("bad", 1)]
    for parts in (1, 8):
        labelled = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "text string, label int")
        counts = {r["cell"]: (r["toxic"], r["other"]) for r in toxicity.term_table(labelled, "text", "label").collect()}
        cell = {w: int(toxicity._cells(next(iter(W.pieces(pa.array([w])))))[1][0]) for w in ("rare", "bad", "common")}
        assert counts == {cell["rare"]: (1, 6), cell["bad"]: (2, 0), cell["common"]: (0, 6)}


def test_classifiers_odd_rows(spark, odd, nothing):
    scores = quality.score(odd, None, 0.4)
    assert scores.count() == len(ODD) and quality.score(nothing, None, 0.4).count() == 0
    assert quality.features(pa.array([None, "", "a\nb", "x" * 200000])).shape == (4, quality.WIDTH)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(odd, none) is None
    found = toxicity.classify(odd, None)
    assert found.count() == len(ODD) and not found.where("is_toxic").count() and found.columns[: len(odd.columns)] == odd.columns


CLASHING = ["row_", "gone_", "path_", "host_", "url_", "rank_", "block_", "shard_", "is_toxic", "p_toxic", "node", "text_sha256", "row", "key", "id", "place", "digest", "kept", "class_id"]


def test_no_column_is_lost(spark, sf_dir):
    """Columns named as the operators name theirs keep names, values and count."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    more = {name: F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")) for name in CLASHING}
    more |= {"is_toxic": F.col("doc_id") % 2 == 0, "p_toxic": F.col("doc_id") / 3}
    wide = docs.withColumns(more)
    expected = {r["doc_id"]: r for r in wide.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, wide, sf_dir)
        assert found.columns == wide.columns, name
        rows = found.collect()
        assert rows and all(r == expected[r["doc_id"]] for r in rows), name
    for found in (
        sharding.assign_shards(wide, 3, ["doc_id"]),
        url_filter.judge(wide.withColumn("url", F.lit("http://a.net/x")), url_filter.rule_table(spark)),
    ):
        rows = found.collect()
        assert len(rows) == 60 and all(r[c] == expected[r["doc_id"]][c] for r in rows for c in wide.columns)
    for found in (exact_dedup.exact_groups(wide), near_dedup.near_classes(wide)):
        assert found.count() == 60


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        before = after
    tokens = corpus_pipeline.run(spark, sf_dir).collect()
    texts = [r["text"] for r in tokens]
    assert len(set(texts)) == len(texts) and 0 < len(tokens) < docs.count()
    assert {r["doc_id"] for r in tokens} == {r["doc_id"] for r in before.select("doc_id").collect()}
