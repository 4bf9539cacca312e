"""Substring dedup, fingerprints and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from gleaner.llm import components, fingerprints, hot, jaccard_join, substring_dedup, words

WORD = re.compile(r"[^\x20\t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def removed(rows, order):
    """Kept words by row, rows equal in key and text being one."""
    seen, out = set(), {}
    for k, t in sorted(set(rows), key=order):
        own = WORD.findall(t or "")
        covered = [False] * len(own)
        for i in range(len(own) - 19):
            window = tuple(own[i : i + 20])
            if window in seen:
                covered[i : i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, c in zip(own, covered, strict=True) if not c)
        out[k, t] = (len(own), sum(covered), kept)
    return out


def hashed_order(spark, pairs):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(t or "",) for _, t in pairs], "t STRING").distinct()
    codes = {r["t"]: r["h"] for r in table.select("t", F.xxhash64("t").alias("h")).collect()}
    return lambda p: (LAST if p[0] is None else p[0], codes[p[1] or ""])


def test_substring_dedup(spark, docs, rows, no_docs):
    pairs = [(i, t) for i, t, *_ in rows]
    want = removed(pairs, hashed_order(spark, pairs))
    got = substring_dedup.deduplicated(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=key) == sorted(
        ((p[0], *want[p]) for p in pairs), key=key
    )
    digests = substring_dedup.digests(docs).collect()
    assert sorted(r["kept_sha256"] for r in digests) == sorted(hashlib.sha256(want[p][2].encode()).hexdigest() for p in pairs)
    assert substring_dedup.digests(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_of_repetitive_text(spark, seed):
    """Few different words, so windows repeat within and between texts; few buckets."""
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(15, 60))) for _ in range(6)]
    pairs = [(i, rnd.choice(["\n", " ", "\t \n"]).join(rnd.choice(passages) if rnd.random() < 0.6 else str(i) for _ in range(6))) for i in range(60)]
    docs = spark.createDataFrame(pairs, "doc_id BIGINT, text STRING").repartition(7)
    want = removed(pairs, lambda p: p[0])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.deduplicated(docs).collect()}
    assert got == {k: v for (k, _), v in want.items()}


def test_frequent_grams(spark):
    docs = spark.createDataFrame([(f"a b c d {i} {i} {i} {i + 1}",) for i in range(200)], "text STRING").repartition(6)

    def grams(column):
        cut = words.cut(column)
        found, inside = cut.grams(4)
        return found[inside]

    common = hot.frequent(docs, "text", grams, 0.1)
    one = words.cut(docs.limit(1).toArrow().column(0)).grams(4)[0]
    assert one[0] in common and len(common) <= 20
    wide = hot.widespread(docs, "text", grams, 150, 8, 3)
    assert wide.has(one).tolist()[0] and len(wide.codes) == 1


def scalar_chunks(data):
    """The chunks of one text, byte by byte."""
    h, hashes = 0, []
    for b in data:
        h = (2 * h + int(fingerprints._GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    out, start = {}, 0
    while start < len(data):
        end = min(start + fingerprints.MOST, len(data))
        for e in range(start + fingerprints.LEAST, end + 1):
            size, value = e - start, hashes[e - 1]
            if (size <= fingerprints.NORMAL and not value & int(fingerprints.STRICT)) or (size >= fingerprints.NORMAL and not value & int(fingerprints.LOOSE)):
                end = e
                break
        out[data[start:end]] = out.get(data[start:end], 0) + end - start
        start = end
    return out


def test_chunks_are_those_of_the_scalar_hash():
    rnd = random.Random(3)
    texts = [bytes(rnd.randrange(97, 103) for _ in range(rnd.choice([0, 1, 15, 16, 17, 200, 1000]))) for _ in range(40)]
    prints = fingerprints.Prints(texts)
    for i, t in enumerate(texts):
        want = scalar_chunks(t)
        assert prints.size[prints.first[i] : prints.first[i + 1]].sum() == sum(want.values()) == len(t)
        assert prints.first[i + 1] - prints.first[i] == len(want)


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprints(spark, docs, rows, no_docs, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.compared(docs).collect()
        empty = fingerprints.compared(no_docs).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert empty == 0 and len(got) == len(rows)
    pairs = [(i, t or "") for i, t, *_ in rows]
    order = hashed_order(spark, pairs)
    places = sorted(set(pairs), key=lambda p: (p[0] is None, -(p[0] or 0), order(p)[1]))
    want = []
    for p in pairs:
        following = places[(places.index(p) + 1) % len(places)][1]
        n = len(p[1]) // 3
        changed = p[1][: len(p[1]) - n] + following[:n]
        own, theirs, other = (scalar_chunks(x.encode()) for x in (p[1], changed, following))
        weight = sum(own.values())

        def near(b, own=own, weight=weight):
            return sum(v for k, v in own.items() if k in b) / weight if own and b else float(not own and not b)

        want.append((str(p[0]), len(p[1]), hashlib.sha256(changed.encode()).hexdigest(), round(near(theirs), 9), round(near(other), 9)))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == sorted(want)
    assert len({r["fingerprint"] for r in got}) == len({t for _, t in pairs})


def test_likeness_survives_a_shift():
    rnd = random.Random(5)
    text = " ".join(f"word{rnd.randrange(900)}" for _ in range(600)).encode()
    a, b = fingerprints.Prints([text]), fingerprints.Prints([b"inserted " + text[:900] + b" more " + text[900:]])
    zero = np.zeros(1, np.int64)
    assert a.within(b, zero, zero)[0] > 0.93


def jaccard_groups(rows):
    sets = []
    for _, t in rows:
        own = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(own[i : i + 4]) for i in range(max(1, len(own) - 3))} if own else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(str(k), len(sets[i]), str(least.get(root(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows)], [root(i) for i in range(len(rows))]


def test_jaccard_components(docs, rows, no_docs):
    want, _ = jaccard_groups([(i, t) for i, t, *_ in rows])
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(want)
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_jaccard_join_of_many_near_copies(spark, monkeypatch):
    """A block of several chunks, around the threshold; every link between
    different texts counts."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randrange(0, 7)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(40)}"
        if rnd.random() < 0.3:
            own = own[: rnd.randrange(60, 90)]
        rows.append((1000 - i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(6)
    want, _ = jaccard_groups(rows)
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(want)
    assert len({r["component_id"] for r in got}) > 1


def alike_groups(rows, n, percent):
    """Ids of the components of texts whose ``n``-word sets are alike enough."""
    cut = {k: WORD.findall(t.translate(LOWER)) for k, t in rows}
    sets = {k: {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} for k, own in cut.items()}
    least = {k: k for k in sets}
    for _ in sets:  # at most as many rounds as there are texts
        links = [(a, b) for a in sets for b in sets if least[a] < least[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        if not links:
            break
        for a, b in links:
            least[b] = min(least[a], least[b])
    return least


def test_histograms_let_all_links_pass():
    rnd = random.Random(3)
    passed = 0
    for _ in range(400):
        size = rnd.randrange(1, 900)
        base = [rnd.getrandbits(63) for _ in range(size + 200)]
        one, other = set(base[:size]), set(base[rnd.randrange(0, max(1, size // 5)) : size + rnd.randrange(0, 60)])
        if not other:
            continue
        flat = [np.sort(np.array(list(s), np.uint64)) for s in (one, other)]
        sketches = jaccard_join.histograms(np.concatenate(flat), np.array([0, len(one), len(one) + len(other)]))
        for percent in (80, 85):
            if 100 * len(one & other) >= percent * len(one | other):
                assert jaccard_join.may_link(*sketches, (len(one), len(other)), percent)
                passed += 1
    assert passed > 50
    # a class of 255 or more tells nothing
    assert jaccard_join.may_link(bytes([255] * 16), bytes([0] * 16), (9000, 9000), 85)


@pytest.mark.parametrize("limit", [2, 64])
def test_chance_ties_make_no_blocks(spark, monkeypatch, limit):
    """Texts of common words share n-grams with many others; pairs of them are
    candidates and go, while the near copies among them link."""
    monkeypatch.setattr(jaccard_join, "LIST", limit)
    rnd = random.Random(21)
    stock = [" ".join(f"s{rnd.randrange(30)}" for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(stock) for _ in range(25))) for i in range(200)]
    for i in range(0, 200, 10):
        own = rows[i][1].split(" ")
        own[50] = "changed"
        rows.append((1000 + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(6)
    want, _ = jaccard_groups(rows)
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(want)
    hot = jaccard_join.NOWHERE
    passed = jaccard_join._candidates(jaccard_join._keyed(docs, "doc_id", "text"), hot, 4, 85, 16).cache()
    if limit == 64:
        assert passed.where("root IS NOT NULL").select("node", "root").distinct().count() > 40
        assert jaccard_join._ties(passed, 85).distinct().count() <= 25
    passed.unpersist()


def near_copies(rnd, base, number, changed, cut=0):
    """Texts with about ``changed`` of the words of ``base`` changed, some without an end."""
    rows = []
    for _ in range(number):
        own = [f"x{rnd.getrandbits(30)}" if rnd.random() < changed / len(base) else w for w in base]
        rows.append(" ".join(own[: len(own) - rnd.randrange(cut)] if cut and rnd.random() < 0.5 else own))
    return rows


def test_large_groups_cost_no_squares(spark, monkeypatch):
    """Near copies of one text by far more than a chunk: few are compared more than once."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    dealt, links = [], jaccard_join._links

    def counted(known, *rest):
        dealt.append(known.selectExpr("coalesce(sum(size(gs)), 0)").first()[0])
        return links(known, *rest)

    monkeypatch.setattr(jaccard_join, "_links", counted)
    rnd = random.Random(31)
    texts = near_copies(rnd, [f"b{i}" for i in range(300)], 240, 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING").repartition(4)
    want = alike_groups(list(enumerate(texts)), 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, n=5, percent=80).collect()}
    assert got == want and list(want.values()).count(0) > 200
    assert sum(dealt) < 6 * 240  # every chunk with every other is over 20 times each


@pytest.mark.parametrize(("hubs", "limit"), [(0, 64), (1, 1), (8, 1)])
def test_sets_apart_in_large_blocks_are_compared(spark, monkeypatch, hubs, limit):
    """Chunks of different sizes, with no hubs or few, and lists that are all long."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 6)
    monkeypatch.setattr(jaccard_join, "HUBS", hubs)
    monkeypatch.setattr(jaccard_join, "LIST", limit)
    rnd = random.Random(32)
    texts = [t for b in range(3) for t in near_copies(rnd, [f"b{b % 2}_{i}" for i in range(150 - 30 * b)], 40, 4, 45)]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING").repartition(4)
    want = alike_groups(list(enumerate(texts)), 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, n=5, percent=80).collect()}
    assert got == want and len(set(want.values())) > 5


def stars(rows):
    """The ``_tied`` stars of sets (size, place of their common n-gram), each given twice."""
    size, step = (np.array(c) for c in zip(*rows, strict=True))
    node, m = np.arange(len(rows)).astype(np.uint64), len(rows)
    raw = np.int64(m).tobytes() + np.full(m, 7, np.uint64).tobytes() + node.tobytes() + size.astype(np.int32).tobytes() + step.astype(np.int32).tobytes()
    block, place = zstandard.ZstdCompressor().compress(raw), {x: i for i, x in enumerate(jaccard_join._named(node, size))}
    root = list(range(m))
    for batch in jaccard_join._tied([block, block], 80):
        for u, v in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), strict=True):
            root[place[u]] = place[v]
    return root


def test_long_lists_tie_what_can_link(monkeypatch):
    """All pairs that place and size allow end in one star, and sets without a partner in none."""
    monkeypatch.setattr(jaccard_join, "LIST", 1)
    rnd = random.Random(33)
    for _ in range(300):
        rows = [(rnd.randrange(60, 140), rnd.randrange(12)) for _ in range(rnd.randrange(2, 12))]
        root = stars(rows)
        for i, (a, p) in enumerate(rows):
            for j, (b, q) in enumerate(rows[:i]):
                if 100 * min(a, b) >= 80 * max(a, b) and 180 * min(a - p, b - q) >= 80 * (a + b):
                    assert root[i] == root[j]
    assert stars([(100, 0), (100, 15), (101, 1)]) == [0, 1, 0]  # what follows place 15 is too little
    assert stars([(100, 0), (100, 15), (90, 1)]) == [0, 0, 0]  # but for the smaller


def test_widespread_grams_are_bounded(spark):
    rows = [(" ".join(f"w{w}" for w in range(i, 40)),) for i in range(40)]  # word w is in w + 1 texts
    docs = spark.createDataFrame(rows, "text STRING").repartition(3)

    def grams(column):
        return words.cut(column).hashes()

    assert len(hot.widespread(docs, "text", grams, 11, 4, 2).codes) == 30
    wide = hot.widespread(docs, "text", grams, 11, 4, 2, 12)
    kept = wide.has(words.cut(pa.array([rows[0][0]])).hashes())
    assert kept.tolist() == [False] * 28 + [True] * 12


def test_one_of_each_takes_any_names(spark):
    rows = [(1, "a b c d e f", 5, "x", "p", 7), (2, "a b c d e f", 6, "y", "q", 8), (3, "other words", 7, "z", "r", 9)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, __place INT, __hash STRING, c0 STRING, _hash INT")
    assert sorted(tuple(r) for r in jaccard_join.one_of_each(docs).collect()) == [rows[0], rows[2]]


def test_sizes_far_apart_in_a_large_block(spark, monkeypatch):
    """80 and 95 n-grams link at 80 percent; under classes for 85 they would be two apart."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 1)
    rnd = random.Random(12)
    rows = []
    for i in range(8):
        base = [f"b{i}w{rnd.randrange(10**6)}" for _ in range(99)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base[:84])), (10 * i + 2, " ".join(base[:66]))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    want = alike_groups(rows, 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, n=5, percent=80).collect()}
    assert got == want and want[1] == 0 and want[2] == 2


def test_one_of_each(docs, rows, no_docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    _, groups = jaccard_groups([(i, t) for i, t, *_ in rows])
    with_words = {g for g, (_, t, *_) in zip(groups, rows, strict=True) if WORD.search(t or "")}
    without = sum(1 for _, t, *_ in rows if not WORD.search(t or ""))
    assert kept.count() == len(with_words) + without
    assert {1, 10, 12}.isdisjoint({r["doc_id"] for r in kept.collect()}) is False
    assert not {2, 3, 11} & {r["doc_id"] for r in kept.collect()}
    assert jaccard_join.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("limit", [300_000, 20, 3])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "EDGES", limit)
    edges = [(str(i), str(i + 1)) for i in range(100, 140)] + [("900", "901"), ("905", "901"), ("7", "7")]
    found = components.components(spark.createDataFrame(edges, "u STRING, v STRING")).collect()
    labels = {r["node"]: r["label"] for r in found}
    assert {labels[str(i)] for i in range(100, 141)} == {"100"} and {labels[x] for x in ("900", "901", "905")} == {"900"}
    assert len(found) == len(labels) == 44
    assert components.components(spark.createDataFrame([], "u STRING, v STRING")).count() == 0


def test_overlaps():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3, 4], [9], [])]
    assert jaccard_join.overlaps(sets).tolist() == [[3, 2, 0, 0], [2, 3, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]


def test_possible_pairs_stay():
    partial = np.array([[10, 9, 1], [9, 10, 0], [1, 0, 10]])
    kept = jaccard_join.possible(partial, np.array([40, 40, 40]), 85)
    assert kept.tolist() == [[10, 9, 0], [0, 10, 0], [0, 0, 10]]
    assert jaccard_join.possible(partial, np.array([40, 20, 40]), 85)[0, 1] == 0


def test_narrow_keys():
    keys = words.mixed(np.arange(100, dtype=np.uint64))
    assert len(jaccard_join._narrow(keys)) == 600
    back = jaccard_join._widened(jaccard_join._narrow(keys))
    assert back.tolist() == [((int(k) << 3) & (2**64 - 1)) >> 16 for k in keys]
