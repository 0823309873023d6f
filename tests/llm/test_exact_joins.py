"""Spelling variants, bit-plane clusters and the Jaccard join against plain Python, and on odd rows."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import plain
from logweave.llm import bit_planes, jaccard_join, linking, spelling
from logweave.llm.jaccard_join import Join, joined_classes

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000))


def words_of(rng, n, letters="abcdé"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 8))) for _ in range(n)]


# ---- spelling variants ----------------------------------------------------------------------


def test_edit_hashes_are_those_of_the_edited_words():
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint64)
    words = ["abcab", "caéca"]
    made = {}
    for length, keys, row, place, letter in spelling.edits(words, 5, alphabet):
        for key, r, p, c in zip(keys, row, place, letter):
            text = words[r][:p] + (chr(int(c)) if c else "") + words[r][p + 1:]
            assert len(text) == length
            made[text] = int(key)
    texts = list(made)
    assert [made[t] for t in texts] == [int(k) for k in spelling.word_keys(texts)]
    # Every deletion, and every replacement by a later letter.
    for w in words:
        assert {w[:k] + w[k + 1:] for k in range(5)} <= set(made)
        assert {w[:k] + c + w[k + 1:] for k in range(5) for c in "abcé" if c > w[k]} <= set(made)


def test_filters_find_every_member():
    keys = spelling.word_keys([f"word{i}" for i in range(20_000)])
    others = spelling.word_keys([f"other{i}" for i in range(20_000)])
    made = spelling.Filter.of(keys)
    assert len(made.find(keys)) == len(keys) and len(made.find(others)) < 200
    assert made.words.nbytes * 8 <= spelling.BITS * len(keys) + 512


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(documents, monkeypatch, small):
    if small:
        # Filters cut by hash, and broadcast in several groups.
        monkeypatch.setattr(spelling, "SHARD_WORDS", 20)
        monkeypatch.setattr(spelling, "GROUP_BYTES", 200)
        monkeypatch.setattr(spelling, "EDITS", 64)
    rng = random.Random(5)
    vocabulary = words_of(rng, 250)
    # Uneven counts, so that words have more frequent neighbours and chains of them.
    pool = [w for w in vocabulary for _ in range(1 + int(rng.paretovariate(0.7)) % 60)]
    rows = [(d, " ".join(rng.choice(pool).capitalize() if rng.random() < 0.2 else rng.choice(pool) for _ in range(120)) + "; x1y-Ü") for d in range(60)]
    made = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(documents(rows)).collect()}
    expected = plain.spelling_variants(rows)
    assert made == expected
    assert any(root != form for form, root, *_ in made.values() if form)


def test_variants_of_odd_rows(documents):
    long = "a" * 30_000
    rows = [
        (1, None), (2, ""), (3, "  \t\n"), (4, "1234 __ 56"), (5, f"{long}b {long}c {long}"), (5, f"{long}b {long}c {long}"),
        (6, f"{long}b {long}c {long}b {long}c {long}b {long} {long}"), (None, "gruesse Gruesse gruesse GRUESSE grueße Grueße grueße"), (7, "×÷×÷× ×÷×÷× ×÷×÷×"),
    ]
    plainly = spelling.Spelling(misspelt=0)
    made = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(documents(rows), plainly).collect()}
    assert made == {
        long: (None, long, 4, 2, None), f"{long}b": (None, f"{long}b", 5, 2, None), f"{long}c": (None, f"{long}c", 4, 2, None),
        "gruesse": (None, "gruesse", 4, 0, None), "grueße": (None, "grueße", 3, 0, None), "×÷×÷×": (None, "×÷×÷×", 3, 0, None),
    }
    assert spelling.variants(documents([])).collect() == []
    assert spelling.variants(documents([(1, "rare words only once")])).collect() == []


def test_chains_of_forms(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(21)] + [(f"x{k}", "w3") for k in range(5)]
    made = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert made == {w: "w21" for w, _ in chain}


# ---- bit planes -----------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 2, 700, 2**27 - 1])
def test_products_are_exact(most):
    rng = np.random.RandomState(3)
    a, b = (rng.randint(-most - 1, most, (20, 64)).astype(np.int64) for _ in range(2))
    planes, others = bit_planes.pack(a), bit_planes.pack(b)
    assert (bit_planes.products(planes, others) == a @ b.T).all()
    assert (bit_planes.squares(planes) == (a * a).sum(axis=1)).all()
    weights = bit_planes.plane_weights(planes.shape[1])
    assert (np.einsum("p,npd->nd", weights, bit_planes.unpack_bits(planes).astype(np.int64)) == a).all()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "taken") for i, v in rows], "vec_id long, embedding array<double>, cluster string")


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bit_planes, "ROWS", 50)
    rng = np.random.RandomState(8)
    centres = rng.normal(size=(5, 64))
    rows = [(k, (centres[k % 5] + rng.normal(scale=0.7, size=64) * (1 + 30 * (k == 17))).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(120)] + [(3, rows[3][1])]
    made = bit_planes.cluster_vectors(vectors(spark, rows).repartition(7))
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in made.collect()) == Counter(plain.clusters(rows))


def test_clusters_of_odd_rows(spark):
    good = [[k / 7 - j / 64 for j in range(64)] for k in range(3)]
    rows = [
        (1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [None] + [0.5] * 63), (6, [float("nan")] * 64), (7, [float("inf")] + [0.0] * 63),
        (8, good[0]), (9, good[1]), (9, good[1]), (None, good[2]), (10, [0.0] * 64), (11, [-0.0] * 64),
    ]
    assert Counter(tuple(r) for r in bit_planes.cluster_vectors(vectors(spark, rows)).collect()) == Counter(plain.clusters(rows))
    assert bit_planes.cluster_vectors(vectors(spark, rows[:7])).collect() == []
    assert bit_planes.cluster_vectors(vectors(spark, [])).collect() == []
    with pytest.raises(Exception, match="overflow"):
        bit_planes.cluster_vectors(vectors(spark, [(1, [1e30] * 64)]))


# ---- Jaccard join ---------------------------------------------------------------------------


def test_keys_of_linked_sets_meet(spark):
    """Whatever the boundary: two linked sets share a subset or a list."""
    rng = random.Random(2)
    join = Join(percent=80)
    sets = []
    for size in [*range(1, 14), 25, 40]:
        for _ in range(4):
            base = rng.sample(range(400), size)
            sets.append(base)
            for change in range(1, 4):
                sets.append([*base[change // 2:], *rng.sample(range(400, 450), change % 2)])
    sets = [sorted(set(s)) for s in sets if s]
    table = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "id long, shingles array<bigint>").cache()
    linked = [(a, b) for a, b in combinations(range(len(sets)), 2) if plain.similar(set(sets[a]), set(sets[b]), 80)]
    assert len(linked) > 50
    for light in (0, 3, 8, 13):
        keys = {k: set() for k in range(len(sets))}
        for part in (join.subset_keys(table, light), join.list_keys(table, light)):
            for r in part.collect():
                keys[r["id"]] |= set(r["keys"])
        assert all(keys[a] & keys[b] for a, b in linked)


def test_boundary_follows_the_cost():
    join = Join()
    assert join.light_up_to({4: 100, 5: 100}, 10**6) >= 5
    # Sets of 40 have thousands of subsets each, and stay in the lists.
    assert join.light_up_to({5: 10, 40: 10_000}, 0) < 40


@pytest.mark.parametrize("percent,width", [(90, 3), (80, 5)])
def test_join_equals_brute_force(documents, monkeypatch, percent, width):
    monkeypatch.setattr(linking, "BLOCK_NODES", 7)
    rng = random.Random(percent)
    texts = []
    for n in [1, 2, 3, 4, 6, 9, 12, 15, 20, 26, 33, 45, 80, 300]:
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        for k in range(7):
            other = list(base)
            for _ in range(k):
                if rng.random() < 0.5 and len(other) > 1:
                    del other[-1 if rng.random() < 0.7 else rng.randrange(len(other))]
                else:
                    other.append(f"v{rng.randrange(50)}")
            texts.append(" ".join(other).upper() if k % 3 == 2 else "  ".join(other))
    shared = " ".join(f"s{k}" for k in range(60))
    texts += [f"{shared} {' '.join(f'u{d}x{k}' for k in range(d % 9))}" for d in range(60)]
    rows = dict(enumerate(texts, 1))
    made = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(documents(list(rows.items())), width, percent).collect()}
    sets = {d: plain.shingles(t, width) for d, t in rows.items()}
    classes = plain.classes(rows, [(a, b) for a, b in combinations(rows, 2) if plain.similar(sets[a], sets[b], percent)])
    assert made == {d: (len(sets[d]), classes[d]) for d in rows}
    assert len(set(classes.values())) < len(rows) - 40


def test_star_in_one_list(spark):
    """A hub with 600 variants, most of which are linked with nothing but the hub."""
    rng = random.Random(4)
    hub = list(range(100))
    sets = [hub] + [sorted([*rng.sample(hub, 95), *(1000 * k + j for j in range(5))]) for k in range(1, 601)]
    table = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "id long, shingles array<bigint>")
    assert {r["component"] for r in joined_classes(table, Join()).collect()} == {0}


def test_join_of_odd_rows(documents):
    base = " ".join(f"b{k}" for k in range(100))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (14, "ONE"), (5, LONG), (6, LONG + " end"), (None, LONG), (None, None),
        # One document with two texts, each with a near copy of its own.
        (7, base), (7, "two words"), (8, base + " tail"), (9, "TWO words"), (7, base),
    ]
    made = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(documents(rows)).collect()), key=str)
    n = len(plain.shingles(LONG, 3))
    assert made == sorted([
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (14, 1, 4), (5, n, 5), (6, n + 1, 5), (None, n, None), (None, 0, None),
        (7, 98, 7), (7, 1, 7), (8, 99, 7), (9, 1, 7), (7, 98, 7),
    ], key=str)
    assert jaccard_join.jaccard_join(documents([])).collect() == []


def test_smaller_partner_with_a_sample_of_one(spark):
    # Ten and nine three-word shingles, nine of them shared: exactly 90 %, and of the smaller set's sample one is left.
    rows = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(12)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:11]))]
    made = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made} == {d: (10 - d % 2, d - d % 2) for d, _ in rows}
