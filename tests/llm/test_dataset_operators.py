"""Merkle manifest, hard negatives and source mixing against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import WORD
from pyspark.sql import functions as F

from linksift.llm import hard_negatives, manifest, mixing
from linksift.llm.oracles import ORACLES
from linksift.llm.queries import QUERIES
from linksift.llm.ranks import place_of, running_within
from linksift.llm.tables import settle

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, tables):
    got = QUERIES[name](spark, SF).toPandas()
    with duckdb.connect() as db:
        for table in tables:
            db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
        want = db.sql(ORACLES[name]).df()
    columns = list(want.columns)
    key = lambda df: sorted(map(str, df[columns].astype(object).values.tolist()))
    assert len(want) and key(got) == key(want)


# ---- running totals


def test_running_totals_in_slices(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(60), rng.randrange(9)) for _ in range(900)] + [(0, 5, 1)] * 300
    df = settle(spark.createDataFrame(rows, "k long, x long, w long").withColumn("no", F.monotonically_increasing_id()), "t")
    got = running_within(df, ["k"], place_of("x"), ["x", "no"], "before", F.col("w"), slice_rows=20).withColumn("p", place_of("x")).collect()
    assert len(got) == len(rows)
    total = Counter()
    for r in sorted(got, key=lambda r: (r["k"], r["p"], r["x"], r["no"])):
        assert r["before"] == total[r["k"]]
        total[r["k"]] += r["w"]


# ---- Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    texts = [None if v is None else str(v) for v in row]
    return digest("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def plain_manifest(rows):
    """Sorted (leaf, subroot, root, siblings joined) of (group, id, leaf)."""

    def climb(hashes):
        """The root and the siblings above every leaf."""
        proofs, spans = [""] * len(hashes), [[i] for i in range(len(hashes))]
        while len(hashes) > 1:
            upper, wider = [], []
            for a in range(0, len(hashes), 8):
                run = hashes[a : a + 8]
                for i, span in enumerate(spans[a : a + 8]):
                    for leaf in span:
                        proofs[leaf] += "".join(run[:i] + run[i + 1 :])
                upper.append(digest("".join(run)))
                wider.append([leaf for span in spans[a : a + 8] for leaf in span])
            hashes, spans = upper, wider
        return hashes[0], proofs

    groups = defaultdict(list)
    for group, key, leaf in rows:
        groups[group].append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lower = {g: climb([leaf for *_, leaf in sorted(groups[g])]) for g in order}
    root, above = climb([lower[g][0] for g in order])
    return sorted(
        (leaf, lower[g][0], root, digest(proof + above[i]))
        for i, g in enumerate(order)
        for (*_, leaf), proof in zip(sorted(groups[g]), lower[g][1])
    )


def proven(spark, rows):
    docs = spark.createDataFrame(rows, "grp string, id long, leaf string, row string, path int").repartition(3)
    got = manifest.manifest(docs, F.col("leaf"), "grp", "id", [F.col("row"), F.col("path")])
    return got.withColumn("proof", manifest.proof_digest(F.col("path"))).withColumn("folded", manifest.fold(F.col("leaf"), F.col("path"))).collect()


IDS = {
    "dense": list(range(700)),
    "sparse": [i * 7_919_777_777 - 10**12 for i in range(300)],
    "extremes": [-(1 << 63), (1 << 63) - 1, -1, 0, 1, 63, 64, 65, None],
    "repeated": [5] * 40 + [6, 7, 6, 100, None, None, 5],
}


@pytest.mark.parametrize("kind", IDS)
def test_manifest(spark, kind):
    ids = IDS[kind]
    rows = [(["a", "b", "a", None, "é", "zz"][n % 6], key, digest(str(n)), f"row {n}", n) for n, key in enumerate(ids)]
    rows.append(("alone", 9, digest("alone"), None, None))
    got = proven(spark, rows)
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == plain_manifest([r[:3] for r in rows])
    assert all(r["folded"] == r["root"] for r in got)
    assert sorted(str(r["row"]["row"]) for r in got) == sorted(str(r[3]) for r in rows)


def test_manifest_where_a_third_of_the_rows_are_equal(spark, monkeypatch):
    monkeypatch.setattr("linksift.llm.ranks.SLICE_ROWS", 10)
    rows = [("a", n, digest(str(n)), "", 0) for n in range(300)] + [("a", 70, digest("same"), "", 0)] * 150
    rows += [("a", 71, digest(f"x{n}"), "", 0) for n in range(50)]
    got = proven(spark, rows)
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == plain_manifest([r[:3] for r in rows])
    assert all(r["folded"] == r["root"] for r in got)


def test_manifest_of_one_group_and_of_none(spark):
    one = proven(spark, [(None, None, digest("x"), "", 0)])
    assert [(r["subroot"], r["root"], r["folded"], r["proof"], r["place"]) for r in one] == [(digest("x"),) * 3 + (digest(""), 0)]
    assert proven(spark, []) == []


def test_leaves_of_odd_documents(spark, odd_docs, odd_rows):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    got = odd_docs.select(manifest.leaf_of(*map(F.col, fields)).alias("leaf")).collect()
    assert sorted(r["leaf"] for r in got) == sorted(plain_leaf((r[0], r[3], r[2], r[4], r[1])) for r in odd_rows)


def test_manifest_query_against_sql(spark):
    against_sql(spark, "op11_merkle_manifest", ["documents"])


def test_tampering_is_seen(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(QUERIES["op11_merkle_manifest"](spark, SF), "doc_id").collect()
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in r["text"] or "")
        assert r["verified"] == (not changed)


# ---- hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=10):
    """rows: (id, label, vector) of whole numbers, ids unique."""
    out = []
    for key, label, vector in rows:
        if key not in anchors:
            continue
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i, other) for i, other, v in rows if i != key)
        for ps, p, _ in [s for s in scores if s[2] == label][:positives]:
            fit = [(n, -ns) for ns, n, other in scores if other != label and 30 * -ps <= 100 * -ns <= 90 * -ps]
            out += [(key, p, rank + 1, n, -ps, ns) for rank, (n, ns) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, anchors):
    vectors = spark.createDataFrame(rows, "id long, label long, vector array<long>").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(vectors, F.col("id").isin(list(anchors))).collect())


@pytest.mark.parametrize("scale", [3, 200, 10**6, 10**8])
def test_hard_negatives(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 150)
    monkeypatch.setattr(hard_negatives, "LEAF_SAMPLE", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK", 10)
    rng = random.Random(scale)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(3), [int(scale * (c + rng.gauss(0, 0.3))) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(600 + i, i % 2, rows[0][2]) for i in range(250)] + [(900, 1, [0] * 6), (901, 77, rows[5][2])]
    anchors = {r[0] for r in rows if r[0] % 20 == 0} | {901}
    assert mined(spark, rows, anchors) == plain_negatives(rows, anchors)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [3.0, 1.0]), (2, 0, [1.5, 0.5]), (3, 0, [2.0]), (4, 0, []), (5, None, [1.0, 1.0]), (6, 1, None), (7, 1, [nan, 1.0]),
            (8, 0, [inf, 1.0]), (9, 0, [None, 1.0]), (None, 0, [1.0, 1.0]), (10, 0, [1.5, 0.5]), (10, 0, [1.5, 0.5])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, vector string")
    vectors = hard_negatives.usable(table, "vec_id", "label", "embedding")
    assert sorted(r["id"] for r in vectors.collect()) == [0, 1, 2, 3, 4, 10, 10]
    whole = vectors.select("id", "label", F.transform("vector", lambda x: F.floor(4 * x)).alias("vector"))
    got = sorted(tuple(r) for r in hard_negatives.mine(whole, F.col("id") == 0).collect())
    # The positive scores 80; rows 2 and 10 score 40, row 3 32 (filled up with zeros), row 4 nothing.
    assert got == [(0, 1, 1, 2, 80, 40), (0, 1, 2, 10, 80, 40), (0, 1, 3, 3, 80, 32)]
    assert hard_negatives.mine(whole.where("id < 0"), F.col("id") == 0).collect() == []
    assert hard_negatives.mine(whole, F.col("id") == 77).collect() == []
    assert hard_negatives.mine(whole.where("label = 0"), F.col("id") == 4).collect() == []


def test_subtrees_are_left_out_and_nothing_is_missed():
    rng = np.random.default_rng(4)
    rows = (rng.normal(0, 1, (40, 8))[rng.integers(0, 40, 4000)] * 100 + rng.normal(0, 5, (4000, 8))).astype(np.int64)
    tree = hard_negatives.grown(rows[:1000], float(np.sqrt((rows**2).sum(1).max())) + 1)
    raised = tree.raised(rows)
    leaf = hard_negatives.leaves_of(tree, raised)
    ranges = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)], 2) for p in tree.points]
    for x, number in zip(raised, leaf):
        for node, j in tree.paths[number]:
            far = hard_negatives.distances(x[None], tree.points[node])[0]
            ranges[node][:, j, 0] = np.minimum(ranges[node][:, j, 0], far)
            ranges[node][:, j, 1] = np.maximum(ranges[node][:, j, 1], far)
    queries = rows[:20]
    scores = queries @ rows.T
    low, high = np.sort(scores, 1)[:, -30], scores.max(1)
    far = [hard_negatives.distances(np.hstack([queries, np.zeros((20, 1))]), p) for p in tree.points]
    reach = lambda s: np.sqrt(np.maximum((queries**2).sum(1) + tree.length**2 - 2.0 * s, 0))
    left = 0
    for number in range(len(tree.paths)):
        good = hard_negatives.alive(tree, ranges, far, number, reach(high), reach(low))
        left += int((~good).sum())
        inside = (scores[:, leaf == number] >= low[:, None]).any(1)
        assert good[inside].all()
    assert left > 0.3 * 20 * len(tree.paths)


def test_hard_negatives_query_against_sql(spark):
    against_sql(spark, "op12_hard_negatives", ["embeddings"])


# ---- mixing


def plain_targets(words, weights=(5, 2, 1)):
    """source -> target, sharing the excess again and again."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(words, 0.0), set(), 1.5 * sum(words.values())
    while left > 1e-9 and len(full) < len(words):
        free = sum(weight[s] for s in words if s not in full)
        for s in words:
            if s not in full:
                target[s] += left * weight[s] / free
        left = 0.0
        for s in words:
            if s not in full and target[s] >= 2 * words[s]:
                left += target[s] - 2 * words[s]
                target[s] = 2.0 * words[s]
                full.add(s)
    return target


def check_mix(rows, got):
    """rows: (doc_id, source, text); got: rows of ``mix``."""
    words = Counter()
    for _, source, text in rows:
        words[source] += len(WORD.findall(text or ""))
    want, taken, longest = plain_targets(words), Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        source = r["row"]["source"]
        assert r["size"] == len(WORD.findall(r["row"]["text"] or "")) and r["source_size"] == words[source]
        assert math.isclose(r["target"], want[source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["copies"] <= 2
        taken[source] += r["taken"]
        longest[source] = max(longest[source], r["size"])
    return {s: (taken[s] - want[s], longest[s]) for s in words}


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("row", F.lit(1)).repartition(3)
    return mixing.mix(docs, [F.col(c) for c in ("doc_id", "source", "text", "size", "row")]).collect()


def odd_mix():
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choice(["a"] * 6 + ["b", "c", "d", None, "é", "\U0001f600", "￮"])
        rows.append((i, source, " ".join(["w"] * rng.choice([0, 1, 3, 7, 20, 40, rng.randrange(300)]))))
    return rows + [(5, "a", "x y\tz q\nr")] * 300 + [(901, "long", "w " * 50_000), (None, "a", None), (902, "empty", ""), (903, "null", None)]


def test_mix_meets_the_targets(spark):
    rows = odd_mix()
    for source, (error, _) in check_mix(rows, mixed(spark, rows)).items():
        assert abs(error) <= 1, source


def test_mix_agrees_with_another_run_and_layout(spark, monkeypatch):
    rows = odd_mix()
    told = lambda got: Counter((r["row"]["doc_id"], r["row"]["source"], r["size"], r["taken"]) for r in got)
    first = told(mixed(spark, rows))
    monkeypatch.setattr("linksift.llm.ranks.SLICE_ROWS", 25)
    random.Random(1).shuffle(rows)
    assert told(mixed(spark, rows)) == first


def test_rates_are_tilted_exponentially(spark):
    """log rate / size is one number for all documents of a source that are not at their limit."""
    rng = random.Random(2)
    classes = [(s, size, rng.randrange(1, 60)) for s in range(3) for size in rng.sample(range(1, 400), 30)]
    words = Counter()
    for s, size, docs in classes:
        words[s] += size * docs
    goal = {0: 0.3, 1: 1.0, 2: 1.9}
    sources = spark.createDataFrame([(s, words[s], goal[s] * words[s]) for s in goal], "s long, words long, target double")
    table = spark.createDataFrame(classes, "s long, size long, docs long")
    for r in mixing.tilts(settle(table, "c"), settle(sources, "s")).collect():
        got = sum(docs * size * min(2.0, math.exp(r["lam"] * size / r["mean"])) for s, size, docs in classes if s == r["s"])
        assert abs(got - r["target"]) <= 0.51


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [(r["size"], r["target"], r["taken"]) for r in mixed(spark, [(1, None, None)])] == [(0, 0.0, 0)]


def test_mix_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words, taken = Counter(), defaultdict(int)
    got = QUERIES["op13_source_mix"](spark, SF).collect()
    for r in got:
        doc = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(doc["text"] or ""))
        words[doc["source"]] += r["size"]
        taken[doc["source"]] += r["taken"]
    want = plain_targets(words)
    assert len(got) == len(docs)
    assert all(abs(taken[s] - want[s]) <= 1 for s in words)
    assert all(math.isclose(r["target"], want[docs[r["doc_id"]]["source"]]) for r in got)
