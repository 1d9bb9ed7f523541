"""The vector operators against brute force on small tables with nulls, ties, repeated rows and odd vectors."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import centroids, hard_negatives, neighbours, queries
from palimpsest.llm.vectors import HIGHEST, in_blocks, sound_rows, whole_products
from tests.oracle import differences

VECTORS = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def made(n: int, width: int = 64, seed: int = 1, same: float = 0.3) -> list[tuple]:
    """Rows of which a share has one vector and one label."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, width)) / width**0.5
    v[r.random(n) < same] = v[0]
    return [(i, [float(np.float32(x)) for x in v[i]], int(r.integers(0, 10)) if r.random() > same else 3) for i in range(n)]


def odd_rows(width: int = 64) -> list[tuple]:
    return [
        (None, [0.5] * width, 1), (9000, None, 1), (9050, [0.1] * (width - 1) + [None], 2), (9100, [0.1] * (width - 1) + [NAN], 2), (9150, [INF] + [0.1] * (width - 1), 3),
        (9200, [0.25] * width, None), (9250, [], 4), (9300, [0.0] * width, 4), (9350, [0.3] * (width // 2), 5), (9400, [0.2] * width, 5), (9400, [0.2] * width, 5), (9450, [0.2] * width, 6),
    ]


def usable(rows: list[tuple]) -> dict[int, tuple]:
    """By id, the smallest of the rows that count."""
    out: dict[int, tuple] = {}
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            if i not in out or (label or 0, v) < (out[i][1] or 0, out[i][0]):
                out[i] = (v, label)
    return out


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("vec", "key", "score", "anchor_id", "id", "leaf", "part", "rank", "cluster", "distance", "n", "place")})


# 11


def mined_plainly(rows: list[tuple]) -> Counter:
    kept = {i: ([math.floor(256 * x) for x in v], label) for i, (v, label) in usable(rows).items() if label is not None}
    dot = lambda a, b: min(HIGHEST, max(-HIGHEST - 1, sum(x * y for x, y in zip(a, b))))
    out = Counter()
    for a, (va, la) in kept.items():
        if a % 50:
            continue
        ranked = sorted((-dot(va, v), i, label == la) for i, (v, label) in kept.items() if i != a)
        for ps, p in [(-s, i) for s, i, same in ranked if same][:5]:
            found = [(-s, i) for s, i, same in ranked if not same and 50 * ps <= -100 * s <= 95 * ps][:3]
            out.update((a, p, k, i, ps, s) for k, (s, i) in enumerate(found, 1))
    return out


NAMES = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


@pytest.mark.parametrize("rows", [made(600), made(300, 5, 2, 0.6) + odd_rows(5), [(i, [float(i % 3), -1.0], i % 2) for i in range(0, 400, 25)]], ids=["hot", "odd", "zero scores"])
def test_hard_negatives_equal_brute_force(spark, rows):
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(5)
    got = Counter(tuple(r[c] for c in NAMES) for r in hard_negatives.mined(df, F.col("vec_id") % 50 == 0).collect())
    want = mined_plainly(rows)
    assert want and got == want


def test_hard_negatives_in_several_blocks(spark, monkeypatch):
    rows = made(600)
    queries_ = sound_rows(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding").where("vec_id % 50 = 0")
    blocks = in_blocks(queries_, 2000)
    assert len(blocks) > 1 and sorted(r["vec_id"] for b in blocks for r in b.collect()) == list(range(0, 600, 50))
    monkeypatch.setattr(hard_negatives, "in_blocks", lambda q: in_blocks(q, 2000))
    got = hard_negatives.mined(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0)
    assert Counter(tuple(r[c] for c in NAMES) for r in got.collect()) == mined_plainly(rows)


def test_products_are_exact_whatever_their_size():
    a, b = np.array([[2.0**40, 3.0], [1.0, -2.0]]), np.array([[2.0**20 + 1, 1.0], [2.0**50, 0.0], [1.0, 7.0]])
    assert whole_products(a, b).tolist() == [[2**60 + 2**40 + 3, HIGHEST, 2**40 + 21], [2**20 - 1, 2**50, -13]]


def test_keys_sort_as_pairs_do(spark):
    pairs = [(a, s, k, i) for a in (-5, 0, 7) for s in (-(1 << 62), -1, 0, 9) for k in (0, 1) for i in (-2, 3)]
    keys = spark.createDataFrame(pairs, "a long, s long, k int, i long")
    first, second = (hard_negatives.packed(F.col("a"), F.col("s"), k, F.col("i")) for k in (0, 1))
    told = keys.withColumn("key", F.when(F.col("k") == 0, first).otherwise(second)).collect()
    assert [tuple(r)[:4] for r in sorted(told, key=lambda r: bytes(r["key"]))] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


# 12


def nearest_plainly(rows: list[tuple], k: int, every: int) -> dict[int, list]:
    kept = {i: np.array(v) for i, (v, _) in usable(rows).items() if any(v)}
    dot = lambda a, b: float((a[: len(b)] * b[: len(a)]).sum())
    return {q: sorted((-dot(v, w), i) for i, w in kept.items() if i != q)[:k] for q, v in kept.items() if q % every == 0}


def found_by_query(df) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    return out


def test_neighbours_reach_their_recall(spark):
    rows = made(4000, 24, 3, 0.0)
    got = found_by_query(neighbours.neighbours(clashing(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 20 == 0, leaves=60))
    want = nearest_plainly(rows, 20, 20)
    assert got.keys() == want.keys() and all([r for _, _, r in g] == list(range(1, 21)) for g in got.values())
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vectors = {i: np.array(v) for i, v, _ in rows}
    assert all(abs(-s - float((vectors[q] * vectors[i]).sum())) < 1e-12 for q, g in got.items() for s, i, _ in g)


def test_visits_are_fewer_than_leaves_where_vectors_have_groups(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centres[i % 40] + r.normal(size=24) * 0.2], 0) for i in range(4000)]
    df = neighbours.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, leaves=60)
    got, want = found_by_query(df), nearest_plainly(rows, 20, 20)
    assert df.first()["leaves_visited"] <= 15
    assert sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("rows", [made(700, 8, 4, 0.4) + odd_rows(8), made(7, 8, 4, 0.0), [(i, [1.0, 2.0], 0) for i in range(90)]], ids=["odd", "few", "equal"])
def test_neighbours_of_all_leaves_equal_brute_force(spark, rows):
    """A hot vector's copies tie: the smaller ids come first. All cells are cut small."""
    df = spark.createDataFrame(rows, VECTORS)
    got = found_by_query(neighbours.neighbours(df, F.col("vec_id") % 20 == 0, leaves=9, visits=9))
    want = nearest_plainly(rows, 20, 20)
    assert got.keys() == {q for q, w in want.items() if w}
    for q, g in got.items():
        assert [i for _, i, _ in g] == [i for _, i in want[q]] and np.allclose([s for s, _, _ in g], [s for s, _ in want[q]], atol=1e-12)


def test_cells_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 40)
    monkeypatch.setattr(neighbours, "PART_VISITS", 3)
    rows = made(500, 8, 6, 0.5)
    got, want = found_by_query(neighbours.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, leaves=6, visits=6)), nearest_plainly(rows, 20, 20)
    assert {q: [i for _, i, _ in g] for q, g in got.items()} == {q: [i for _, i in w] for q, w in want.items()}


def test_one_visit_still_finds_as_many_as_asked(spark):
    rows = made(300, 8, 7, 0.0)
    got = found_by_query(neighbours.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, leaves=50, visits=1))
    assert all(len(g) == 20 for g in got.values())


# 13


def clustered_plainly(rows: list[tuple], k: int = 8, rounds: int = 10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cs = [v for _, v in start]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((d(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cs)]
    placed = [(i, *reversed(near(v))) for i, v in kept]
    inertia = Counter()
    for _, j, dist in placed:
        inertia[j] += dist
    cap = lambda x: min(x, HIGHEST)
    return Counter((i, j, cap(dist), cap(inertia[j]), cap(sum(inertia.values())), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, dist in placed)


@pytest.mark.parametrize(
    "rows",
    [made(150) + odd_rows(), made(5), [(i, [float(i % 2)] * 64, 0) for i in range(60)], [*made(40), (77, [3e30] + [0.0] * 63, 0), (78, [-5e6] + [0.0] * 63, 0)]],
    ids=["odd", "few", "ties", "large"],
)
def test_centroids_equal_brute_force(spark, rows):
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(5)
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = Counter(tuple(r) for r in centroids.clustered(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == clustered_plainly(rows)


def test_transform_keeps_distances():
    w = centroids.WALSH
    assert (w @ w.T == 64 * np.eye(64)).all() and [(np.diff(r) != 0).sum() for r in w] == list(range(64))


# all


def test_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mined(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.neighbours(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert centroids.clustered(empty).count() == 0


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_centroids"])
def test_queries_equal_their_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_op12_on_its_table(spark):
    df = queries.op12_neighbours(spark, "/root/testdata/sf0.1")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got, want = found_by_query(df), nearest_plainly(rows, 20, 20)
    assert got.keys() == want.keys() and sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want) >= 0.9 * 20 * len(want)
