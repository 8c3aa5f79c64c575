import collections
import random

import numpy as np
from cnvspark.llm.near_dedup import Sketcher, components, drop_near_duplicates, near_duplicates, ordered_similarity, shingles
from cnvspark.llm.words import word_hashes


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            t = d[j + 1]
            d[j + 1] = before + 1 if x == y else max(d[j + 1], d[j])
            before = t
    return d[-1]


def test_alignment_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(5, 50)
        a = [rng.randint(0, 30) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.randint(0, 30)] * rng.randint(0, 1)
        want = (s := lcs(a, b)) / (len(a) + len(b) - s)
        got = ordered_similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert (want >= 0.8 - 1e-9) == (got > 0) and (not got or abs(got - want) < 1e-9)


def docs_with_copies(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(30):
        texts.append([word() for _ in range(rng.randint(1, 150))])
    for _ in range(60):  # a long passage that unlike documents share
        texts.append([word() for _ in range(rng.randint(40, 90))] + passage)
    base = [word() for _ in range(200)]
    for _ in range(80):  # a large group of near-copies about the threshold
        x = list(base)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = word()
        texts.append(x)
    return [" ".join(t) for t in texts]


def classes_by_brute_force(rows):
    shs = [shingles(w, 5) for w in word_hashes([t or "" for _, t in rows])]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (len(shs[i]) and len(shs[j]) and ordered_similarity(shs[i], shs[j], 0.8) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_classes_against_brute_force(spark):
    texts = docs_with_copies(random.Random(3))
    rows = [(i, t) for i, t in enumerate(texts + texts[:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    assert same_partition([got[i]["class_id"] for i, _ in rows], classes_by_brute_force(rows))
    kept = [r["doc_id"] for r in got.values() if r["kept"]]
    assert sorted(kept) == sorted({r["class_id"] for r in got.values()})


def test_no_link_is_lost_in_a_large_group_about_the_threshold(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(400):  # the base itself is no text, and most pairs are just below the threshold
        x = list(base)
        for _ in range(3):
            x[rng.randrange(len(x))] = word()
        rows.append((i, " ".join(x)))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert same_partition([got[i] for i, _ in rows], classes_by_brute_force(rows))


def test_texts_without_words_are_alike_only_if_equal(spark):
    rows = [(1, "!!!"), (2, "???"), (3, "!!!"), (4, ""), (5, None), (6, "One two three four five six!"), (7, "one two, three four five SIX")]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6}


def test_pairs_that_share_only_a_large_band(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    passage = [word() for _ in range(100)]
    texts = []
    for _ in range(60):  # pairs alike, unlike all others, in bands of the passage that all of them share
        x = passage + [word() for _ in range(60)]
        texts += [x, [*x[:-1], word()]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sketcher = Sketcher(5, 1, 1, 2)
    bands = [set(sketcher.bands_of(w).tolist()) for w in word_hashes([t for _, t in rows])]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least=1, rows=1, bands=2).collect()}
    pairs = [i for i in range(0, len(rows), 2) if bands[i] & bands[i + 1]]
    assert len(pairs) > 50 and max(collections.Counter(b for x in bands for b in x).values()) > 40
    assert all(got[i] == got[i + 1] == i for i in pairs) and len(set(got.values())) >= 60


def test_odd_rows(spark, odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert by_id[43][0]["class_id"] == by_id[44][0]["class_id"] == 0 and by_id[0][0]["copies"] == 3
    assert by_id[40][0]["class_id"] == by_id[41][0]["class_id"] == 40
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns
    texts = [r["text"] for r in left.collect()]
    assert len({t or "" for t in texts}) == len(texts) and None in [r["doc_id"] for r in left.collect()]


def test_empty_table(none):
    assert near_duplicates(none).collect() == [] and drop_near_duplicates(none).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (4, 5), (11, 12), (5, 6), (6, 7), (20, 20)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 11: 10, 12: 10}


def test_sketch_sees_order():
    words = [f"w{i}" for i in range(100)]
    moved = words[50:] + words[:50]
    a, same, b = word_hashes([" ".join(words), " ".join(words).upper(), " ".join(moved)])
    s = Sketcher()
    assert (s.bands_of(a) == s.bands_of(same)).all()
    # 92 of 96 runs are in both texts, so sketches that ignored their order would mostly be equal; a quarter keeps its order.
    assert (s.bands_of(a) == s.bands_of(b)).mean() < 0.3
