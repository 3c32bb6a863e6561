"""Manifest, personal data and whitening against plain Python over the same rows, and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.llm import merkle, pii, whitening
from jobscope.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest ---------------------------------------------------------------------------------

MANIFEST_DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, `rank` int, digest string"


def digest_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(digests, at):
    """Root of a run of digests, and the siblings of the one at a place, level by level."""
    sides = []
    while len(digests) > 1:
        low = at // 16 * 16
        run = digests[low : low + 16]
        sides.append(("".join(run[: at - low]), "".join(run[at - low + 1 :])))
        digests, at = [sha("".join(digests[i : i + 16])) for i in range(0, len(digests), 16)], at // 16
    return digests[0], sides


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rows in groups.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest_of(r)))
    leaves = {s: [digest_of(r) for r in rows] for s, rows in groups.items()}
    subroots = [climb(leaves[s], 0)[0] for s in order]
    for s in order:
        for i, row in enumerate(groups[s]):
            subroot, sides = climb(leaves[s], i)
            root, above = climb(subroots, order.index(s))
            sides += above
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                changed = (*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4]))
            folded = digest_of(changed)
            for before, after in sides:
                folded = sha(before + folded + after)
            yield row[0], leaves[s][i], subroot, root, sha("".join(a + b for a, b in sides)), folded, folded == root


@pytest.mark.parametrize("shape", ["many", "one source", "odd"])
def test_manifest_by_brute_force(spark, shape):
    rng = random.Random(shape)
    rows = [(i, rng.choice(["a", "b", "é", "Z", None, ""]), rng.choice(["en", None]), i % 7, f"Text {i} ÄB") for i in range(500)]
    if shape == "one source":
        rows = [(*r[:1], "s", *r[2:]) for r in rows[:300]]
    elif shape == "odd":
        same = [(5, "a", "en", 1, "Same")] * 300
        rows = same + [(None, "a", None, None, None), (None, None, None, None, ""), (1, "a", "en", 2, None), (1, "a", "en", 2, "X" * 50000)]
        rows += [(i, f"s{i}", None, None, "T") for i in range(40)]
    df = spark.createDataFrame([(*r, "t", 1, "d") for r in rows], MANIFEST_DOCS)
    lowered = F.translate("row.text", merkle.UPPER, merkle.UPPER.lower())
    chosen = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(df, tampered={"text": lowered}, where=chosen).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(brute_manifest(rows))


def test_manifest_of_nothing_and_of_a_few_leaves(spark):
    assert merkle.manifest(spark.createDataFrame([], MANIFEST_DOCS)).count() == 0
    leaves = spark.range(500).select(
        F.lit("t").alias("tree"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(0).alias("tie"),
        F.struct(F.col("id")).alias("ask"),
    )
    trees = merkle.grow(leaves)
    asked = trees.leaves.where("rank IN (0, 17, 499)").select("tree", "rank", "ask")
    root = trees.roots.first()
    assert (root["height"], len(trees.records)) == (3, 4)
    for row in merkle.descend(trees.records, trees.roots.withColumn("path", F.expr(merkle.NO_PATH)), asked).collect():
        digests = [sha(str(i)) for i in range(500)]
        assert row["digest"] == digests[row["ask"]["id"]] and row["home"] == climb(digests, 0)[0] == root["digest"]
        assert [tuple(s) for s in reversed(row["path"])] == climb(digests, row["rank"])[1]


# --- personal data ----------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def proven(text):
    out = []
    for place, (kind, form) in enumerate(PLAIN.items()):
        for found in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", found[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in found[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((found.start(), place, found.end()))
    return sorted(out)


def spans_of(df, learned):
    rows = df.collect()
    return collections.Counter((r["doc_id"], *[(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["learned"] == learned]) for r in rows)


def test_seed_forms_by_plain_patterns(spark):
    rng = random.Random(11)
    letters = " .@+-()0159ab%é😀\n1+@."
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(3000)]
    rows += [(None, "x@y.zz 1.2.3.4"), (None, None), (1, None), (2, ""), (3, "a" * 3000 + "@"), (4, "1" * 3000), (5, "a.b@c.d-" * 3000)]
    rows += [(6, "4111 1111 1111 1111, 4111-1111-1111-1112, 256.1.1.1 001.2.3.255")] * 2
    df = spark.createDataFrame([(*r, "rid", "items") for r in rows], "doc_id bigint, text string, rid string, items string")
    assert spans_of(pii.personal_data(df), False) == collections.Counter((i, *proven(t or "")) for i, t in rows)
    assert pii.personal_data(df.limit(0)).count() == 0


def test_patterns_find_what_no_form_proves(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "and"]) for _ in range(n))
    rows = []
    for i in range(12):
        rows.append((i, f"{words(5)} call me at +1 (555) 555-01{i:02d} {words(9)}"))
        rows.append((100 + i, f"{words(5)} write to me{i}@x{i}.org for help {words(9)}"))
        rows.append((200 + i, f"{words(5)} order number 77755501{i:02d} shipped {words(9)}"))
        rows.append((250 + i, f"{words(5)} licence 12.{i} {words(3)} +1 (555) 777-01{i:02d} {words(5)}"))
    rows += [(300, f"{words(5)} call me at 555-0199 {words(3)}"), (301, f"{words(5)} write to jane@intranet for help"), (302, f"{words(4)} of 555-0777 {words(5)}")]
    # A pattern that only found strings share is trusted in the second turn.
    for k in range(6):
        rows += [(310 + k, f"{words(3)} call me at 555-020{k} {words(3)}"), (320 + k, f"dial desk 555-020{k} now {words(3)}")]
    rows.append((330, "please dial desk 555-0999 now ok"))
    df, texts = spark.createDataFrame(rows, "doc_id bigint, text string"), dict(rows)
    found = {}
    for r in pii.personal_data(df).collect():
        for s in r["spans"]:
            if s["learned"]:
                found[r["doc_id"]] = (pii.KINDS[s["kind"]], texts[r["doc_id"]][s["start"] : s["end"]])
    expected = {300: ("phone", "555-0199"), 301: ("email", "jane@intranet"), 330: ("phone", "555-0999")}
    expected |= {at + k: ("phone", f"555-020{k}") for at in (310, 320) for k in range(6)}
    assert found == expected
    first = {r["doc_id"] for r in pii.personal_data(df, rounds=1).collect() if any(s["learned"] for s in r["spans"])}
    assert 300 in first and 330 not in first


def test_pii_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    df = QUERIES["op13_pii"](spark, sf_dir)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    rows = df.collect()
    assert len(rows) == len(texts) and sum(r["n_email"] for r in rows) > 0
    for r in rows:
        spans = proven(texts[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == sha(text) and set(filter(None, text.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]


# --- whitening --------------------------------------------------------------------------------


def matrices():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    yield "random", rng.standard_normal((500, 64))
    yield "graded", rng.standard_normal((500, 40)) * 10.0 ** np.linspace(0, -10, 40)
    yield "identity", np.eye(30)
    yield "repeated columns", np.hstack([rng.standard_normal((200, 10))] * 3)
    yield "few rows", rng.standard_normal((5, 20))
    yield "one column", rng.standard_normal((50, 1))
    yield "constant columns", np.hstack([rng.standard_normal((50, 5)), np.zeros((50, 5))])
    yield "equal values", (turn * np.repeat([5, 4, 3, 2, 1, 0.5], 10)) @ turn.T
    yield "pairs", np.linalg.cholesky(np.diag(np.abs(np.arange(21) - 10.0) + 1) + np.diag(np.full(20, 0.5), 1) + np.diag(np.full(20, 0.5), -1)).T


@pytest.mark.parametrize("name, rows", list(matrices()), ids=[n for n, _ in matrices()])
def test_principal_against_lapack(name, rows):
    width = rows.shape[1]
    r = whitening._triangle(rows, width)
    values, vectors = whitening.principal(r)
    exact = np.linalg.svd(r, compute_uv=False) ** 2
    k = len(values)
    assert k == (exact > (width * whitening.EPS) ** 2 * exact[0]).sum()
    assert np.abs(values - exact[:k]).max() <= 1e-13 * exact[0] and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-14
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() < 1e-14 * exact[0]


def test_dqds_keeps_small_values():
    """Each value of a graded matrix is right in its own digits, and steps with shifts lose none."""
    rng = np.random.default_rng(4)
    d, e = 10.0 ** -np.arange(12.0), 10.0 ** -np.arange(11.0) * rng.random(11) * 1e-3
    exact = np.linalg.svd(np.diag(d) + np.diag(e, 1), compute_uv=False) ** 2
    assert np.abs(whitening.dqds(d, e) / exact - 1)[:6].max() < 1e-12
    assert abs(np.prod(whitening.dqds(d, e) / d**2) - 1) < 1e-12  # the determinant


def test_whitening_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op12_embedding_whitening"](spark, sf_dir).toPandas()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(vectors["embedding"].to_numpy()).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, directions = (a[..., ::-1] for a in np.linalg.eigh(centred.T @ centred / n))
    expected = centred @ directions[:, :32] / np.sqrt(values[:32])
    found = rows.pivot(index="vec_id", columns="component", values="whitened").loc[vectors["vec_id"]].to_numpy()
    assert np.abs(found * np.sign((found * expected).sum(axis=0)) - expected).max() < 1e-9
    assert (rows.groupby("vec_id")["deviation"].first().loc[vectors["vec_id"]].to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()
    assert np.abs(rows.groupby("component")["explained"].first().to_numpy() / (values[:32] / values.sum()) - 1).max() < 1e-12
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"].max() < 1e-10 and set(rows["n"]) == {n}


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.standard_normal(3)], "x") for i in range(40)]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [nan, 1.0, 2.0], None), (103, [1.0, inf, 0.0], "x"), (104, [], "x"), (105, [1.0], "x"), (106, [1e300, 0.0, 0.0], "x")]
    twice = [(7, good[7][1], "x"), (None, [0.5, 0.25, 0.125], "x")]
    schema = "vec_id int, embedding array<double>, component string"
    df = spark.createDataFrame(good + odd + twice, schema).repartition(11)
    rows = whitening.whiten(df).collect()
    assert collections.Counter(r["vec_id"] for r in rows) == collections.Counter({i: 3 for i in range(40) if i != 7} | {7: 6, None: 3})
    assert {r["n"] for r in rows} == {42} and max(r["identity_error"] for r in rows) < 1e-12
    for some in (odd, odd + good[:1], [], good[:1] * 5):
        assert whitening.whiten(spark.createDataFrame(some, schema)).count() == 0
    big = np.array([[2**39, 5], [0, 1]])
    assert whitening._deviations(big, 3, np.array([7, 7])).to_pylist() == [None, 49 + 16]
