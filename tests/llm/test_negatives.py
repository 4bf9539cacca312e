"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest

from gleaner.llm import hard_negatives as hard

SHAPE = "vec_id BIGINT, label INT, embedding ARRAY<DOUBLE>, id STRING, row STRING, tile INT, v STRING, w STRING, score STRING"


def brute(rows, every=50, positives=5, negatives=3):
    kept = []
    dim = max((len(v) for *_, v in rows if v), default=0)
    for key, label, vector in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        kept.append((key, label, whole + [0] * (dim - len(whole))))
    out = []
    for key, label, vector in kept:
        if key % every:
            continue
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(vector, v, strict=True)))), k, g) for k, g, v in kept]
        same = sorted((-s, k) for s, k, g in scored if g == label and k != key)[:positives]
        for place, (minus, positive) in enumerate(same):
            high = -minus
            found = sorted((-s, k) for s, k, g in scored if g != label and 50 * high <= 100 * s <= 95 * high)[:negatives]
            out += [(key, positive, rank, k, high, -s, place) for rank, (s, k) in enumerate(found, 1)]
    return sorted(out, key=lambda r: (r[0], r[6], r[2]))


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "a", "b", 1, "c", "d", "e") for r in rows], SHAPE).repartition(4)
    return sorted(tuple(r) for r in hard.hard_negatives(frame, **options).collect())


def same(spark, rows, **options):
    tile = options.pop("tile", None)
    got = found(spark, rows, tile=tile, **options)
    assert got == sorted(r[:6] for r in brute(rows, **options))
    return got


def cloud(draw, n, dim=6, labels=4, clusters=5, width=0.2):
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, draw.randrange(labels), [c + draw.gauss(0, width) for c in draw.choice(centres)]) for i in range(n)]


@pytest.fixture
def small_nodes(monkeypatch):
    monkeypatch.setattr(hard, "LEAF", 4)
    monkeypatch.setattr(hard, "FANOUT", 3)
    monkeypatch.setattr(hard, "CHUNK", 5)


def test_clusters_ties_and_tiles(spark):
    rows = cloud(random.Random(1), 700)
    rows += [(1000 + i, i % 3, [0.5] * 6) for i in range(90)]  # equal vectors
    rows += [(2000 + i, i % 2, [round(random.Random(i).uniform(-1, 1), 1)] * 6) for i in range(100)]
    assert same(spark, rows, tile=64)
    assert same(spark, rows)


def test_odd_rows(spark):
    rows = cloud(random.Random(2), 160, dim=3)
    rows += [(50, None, [1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (3, 1, None), (4, 1, [1.0, None, 2.0])]
    rows += [(5, 1, [float("nan"), 0.0, 0.0]), (6, 2, [float("inf"), 0.0, 0.0]), (7, 2, [1e307, 0.0, 0.0])]
    rows += [(300, 1, []), (301, 1, [0.5]), (350, 2, [0.0, 0.0, 0.0]), (-50, 3, [0.2, -0.7, 0.1]), (-49, 3, [0.2, -0.7, 0.1])]
    rows += [(400, 9, [3.0, 3.0, 3.0])]  # no other row of its label
    rows += [(101, 1, [0.4, 0.4, 0.4])] * 3 + [(450, 1, [0.4, 0.4, 0.4])] * 2  # repeated rows
    rows += [(500, 2, [0.4, 0.4, 0.1]), (500, 3, [0.4, 0.4, 0.2])]  # one key, two rows
    # rows that share a key and are no anchor come in any order only if equal
    assert same(spark, rows, tile=20)


@pytest.mark.parametrize("factor", [1e3, 1e6, 1e13])
def test_large_numbers_are_exact(spark, factor):
    rows = [(i, g, [x * factor for x in v]) for i, g, v in cloud(random.Random(3), 120, dim=4)]
    assert same(spark, rows, tile=30, every=20) or factor == 1e13  # beyond a long all are equal


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [0.5])]) == []
    assert found(spark, [(50, 1, [0.5]), (51, 1, [0.5])]) == []


def test_search_prunes(small_nodes):
    draw = np.random.default_rng(4)
    values = (draw.normal(0, 40, (40, 8))[draw.integers(0, 40, 2000)] + draw.normal(0, 2, (2000, 8))).round().astype(np.float32)
    ids, labels = draw.permutation(2000), draw.integers(0, 3, 2000)
    tree = hard.Tree(values, ids, labels)
    at = np.flatnonzero(tree.ids % 50 == 0)
    q, own, mine = tree.values[at], tree.ids[at], tree.labels[at]
    low, high = np.full((len(at), 1), hard._LEAST + 1), np.full((len(at), 1), hard._MOST)
    best = np.zeros((len(at), 1, 5, 2), np.int64)
    best[..., 0] = hard._NONE
    tree.search(q, own, mine, low, high, best, True)
    score = (q @ tree.values.T).astype(np.int64)
    for i in range(len(at)):
        fits = (tree.labels == mine[i]) & (tree.ids != own[i])
        order = np.lexsort((tree.ids[fits], -score[i, fits]))[:5]
        assert best[i, 0, :, 1].tolist() == tree.ids[fits][order].tolist()
    leaves = len(tree.begin) - 1
    assert tree.visited < 0.5 * leaves * len(at)


def test_boxes_hold_their_rows(small_nodes):
    draw = np.random.default_rng(5)
    values = draw.integers(-50, 50, (300, 4)).astype(np.float32)
    tree = hard.Tree(values, np.arange(300), draw.integers(0, 5, 300))
    assert sorted(tree.ids) == list(range(300))
    q = draw.integers(-50, 50, (20, 4)).astype(np.float32)
    least, most = tree.boxes.bounds(q)
    for leaf in range(len(tree.begin) - 1):
        score = q @ tree.values[tree.begin[leaf] : tree.begin[leaf + 1]].T
        assert (score.min(1) >= least[:, leaf]).all() and (score.max(1) <= most[:, leaf]).all()
    root_least, root_most = least[:, -1], most[:, -1]
    assert (root_least <= least.min(1)).all() and (root_most >= most.max(1)).all()


def test_recall_is_whole_on_the_table(spark):
    from gleaner.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in REGISTRY["op11_box_negatives"](spark, folder).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(k, (g + 1) % 10 if k % 7 == 0 else g, v) for k, g, v in rows]
    assert got == sorted(r[:6] for r in brute(moved))
