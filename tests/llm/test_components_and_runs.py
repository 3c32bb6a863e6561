"""Components against union-find, and sorted digest runs against grouping in Python."""

import collections
import random

import pytest

from jobscope.llm import components, decontaminate, exact_dedup


def brute_roots(links):
    parent = {n: n for pair in links for n in pair}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        one, two = sorted((top(a), top(b)))
        parent[two] = one
    return {n: top(n) for n in parent}


def rooted(df):
    return {r["node"]: r["root"] for r in df.collect()}


@pytest.fixture
def tables_written(monkeypatch):
    names = collections.Counter()
    plain = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: names.update([name]) or plain(df, name))
    return names


@pytest.mark.parametrize("shape", ["shuffled", "ordered"])
def test_a_chain_takes_few_rounds(spark, tables_written, shape):
    labels = list(range(1000))
    if shape == "shuffled":
        random.Random(5).shuffle(labels)
    links = list(zip(labels, labels[1:]))
    found = rooted(components.components(spark.createDataFrame(links, "a bigint, b bigint")))
    assert found == brute_roots(links)
    # A round is one table of roots; each halving of paths is one more table of hooks.
    assert tables_written["roots"] <= (8 if shape == "shuffled" else 1) and tables_written["hooks"] <= 40


def test_components_of_random_links(spark):
    draw = random.Random(6)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(7, 7), (400, 400), (1, 2), (2, 1)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    assert rooted(components.components(frame)) == brute_roots(links)
    assert rooted(components.components(frame.limit(0))) == {}


def test_further_links_join_classes(spark):
    draw = random.Random(7)
    links = [(draw.randint(0, 200), draw.randint(0, 200)) for _ in range(80)]
    later = [(draw.randint(0, 250), draw.randint(0, 250)) for _ in range(60)] + [(900, 900), (901, 0)]
    first, second = (spark.createDataFrame(x, "a bigint, b bigint") for x in (links, later))
    assert rooted(components.joined_components(components.components(first), second)) == brute_roots(links + later)


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_runs_merge_like_groups(spark, keep, kind):
    draw = random.Random(8)
    rows = [(f"{draw.randint(0, 40):064x}" if i % 3 else "ff" * 32, draw.choice([None, draw.randint(0, 10**6)])) for i in range(4000)]
    rows = [(d, None if n is None else n if kind == "bigint" else str(n)) for d, n in rows] + [("00" * 32, None)]
    frame = spark.createDataFrame([(d, 1, 2, n) for d, n in rows], f"digest string, n_bytes bigint, check_hash bigint, id {kind}").repartition(7)
    expected = collections.defaultdict(list)
    for d, n in rows:
        expected[d].append(n)
    pick = max if keep == "max" else min
    for rounds in (1, 2):
        got = {r["digest"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.tree_merge(frame, rounds, keep).collect()}
        assert got == {d: (pick((n for n in ids if n is not None), default=None), len(ids)) for d, ids in expected.items()}


def test_a_common_digest_is_one_entry_before_any_exchange(spark):
    frame = spark.range(0, 20000, 1, 5).selectExpr(
        "if(id % 3 = 0, repeat('ab', 32), sha2(string(id), 256)) AS digest", "1L AS n_bytes", "2L AS check_hash", "IF(id % 2 = 0, NULL, id) AS id"
    )
    runs = exact_dedup._run(frame.selectExpr("digest", "n_bytes", "check_hash", "id AS keep_id", "1L AS group_size"), "max")
    assert runs.where("digest = repeat('ab', 32)").count() == 5


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,2)", "string", "bigint", "int", "date", "boolean", "double", "binary"])
def test_items_of_every_type_of_id(spark, kind):
    words = " ".join(f"w{i}" for i in range(12))
    value = {"date": "DATE'2020-01-02'", "boolean": "true", "binary": "X'FF00'"}.get(kind, f"CAST('7' AS {kind})")
    items = spark.sql(f"SELECT {value} AS item_id, '{words}' AS text UNION ALL SELECT CAST(NULL AS {kind}), NULL")
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "other words"), (3, None)], "doc_id bigint, text string")
    found = decontaminate.contaminated(docs, items)
    assert dict(found.dtypes)["item_id"] == kind
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, items.where("text IS NOT NULL").first()["item_id"])]
