"""Main directions, suffix tree, telling patterns and the tree classifier against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import contexts, cooccurrence, detect, directions, evaluate, patterns, suffix_tree


def windows_of(spark, rows):
    """Windows from ``(ids, length, next_id, anomaly)``."""
    made = [(f"s{k % 7}", k, list(ids), length, nxt, bad) for k, (ids, length, nxt, bad) in enumerate(rows)]
    return spark.createDataFrame(made, "session_id string, window_idx long, ids array<int>, length int, next_id int, anomaly int")


# ---- main directions ------------------------------------------------------------------------


def dense(rows, size):
    x = np.zeros((len(rows), size))
    for k, ids in enumerate(rows):
        for i in ids:
            if i > 0:
                x[k, i - 1] += 1
    return x


@pytest.mark.parametrize("components", [1, 3])
def test_scores_equal_a_plain_decomposition(spark, components):
    rng = np.random.RandomState(components)
    size = 40
    rows = [rng.choice(size, 8, p=rng.dirichlet(np.ones(size) * 0.2)).tolist() for _ in range(300)]
    rows += rows[:50] + [[0, 0, 0], [1] * 8]
    train = windows_of(spark, [(r, len(r), 1, 0) for r in rows])
    test = windows_of(spark, [(r, len(r), 1, 0) for r in [*rows[:20], [2, 3, 90], [0]]])
    x = dense(rows, size)
    mean = x.mean(axis=0)
    _, _, v = np.linalg.svd(x - mean, full_matrices=False)
    y = dense([[i for i in r if i <= size] for r in [*rows[:20], [2, 3, 90], [0]]], size) - mean
    rest = (y * y).sum(axis=1) - ((y @ v[:components].T) ** 2).sum(axis=1)
    rest[20] += 1  # the id that the training windows do not have
    model = detect.fit_sparse_reconstruction(train, components)
    made = {r.window_idx: r for r in detect.score_sparse_reconstruction(model, test, size + 1).collect()}
    assert len(made) == 22
    assert np.allclose([made[k].score * size for k in range(22)], rest, atol=1e-8)
    assert math.isclose(made[21].total * size, (mean * mean).sum(), abs_tol=1e-9)
    loadings = np.array([r.loadings for r in model.orderBy("id").collect()])
    assert np.allclose(loadings.T @ loadings, np.eye(components), atol=1e-9)
    # Directions are the same up to the sign, which makes the largest part positive.
    ids = [r.id - 1 for r in model.orderBy("id").collect()]
    assert np.allclose(np.abs((loadings.T * v[:components, ids]).sum(axis=1)), 1, atol=1e-7)
    assert all(column[np.abs(column).argmax()] > 0 for column in loadings.T)


def test_same_scores_as_the_dense_fit(spark):
    rng = np.random.RandomState(0)
    train = windows_of(spark, [(rng.randint(1, 12, 6).tolist(), 6, 1, 0) for _ in range(200)])
    key = ["session_id", "window_idx"]
    old = detect.score_reconstruction(detect.fit_reconstruction(train, 12, 3), train, 12)
    new = detect.score_sparse_reconstruction(detect.fit_sparse_reconstruction(train, 3), train, 12)
    both = old.select(*key, "score", "total").join(new.select(*key, F.col("score").alias("s"), F.col("total").alias("t")), key).collect()
    assert len(both) == 200
    assert all(abs(r.score - r.s) < 1e-6 and abs(r.total - r.t) < 1e-9 for r in both)


def test_a_hundred_thousand_templates(spark):
    rng = np.random.RandomState(5)
    topics = [rng.randint(1, 100_000, 400) for _ in range(3)]
    rows = [np.concatenate((rng.choice(topics[k % 3], 200 + 60 * (k % 3)), rng.randint(1, 100_001, 40))).tolist() for k in range(240)]
    rows.append([100_000])
    train = windows_of(spark, [(r, len(r), 1, 0) for r in rows])
    model = detect.fit_sparse_reconstruction(train, 3)
    made = {r.window_idx: r.score for r in detect.score_sparse_reconstruction(model, train, 100_001).collect()}
    x = dense(rows, 100_000)
    x -= x.mean(axis=0)
    # The same by the products of the windows, of which there are few here.
    values, vectors = np.linalg.eigh(x @ x.T)
    rest = (x * x).sum(axis=1) - (vectors[:, -3:] ** 2) @ values[-3:]
    assert np.allclose([made[k] * 100_000 for k in range(len(rows))], rest, rtol=1e-8, atol=1e-6)


def test_few_directions_and_no_rows(spark):
    # Equal windows have no direction at all; two kinds of windows have one.
    same = windows_of(spark, [([1, 2], 2, 1, 0)] * 5)
    assert [r.score for r in detect.score_sparse_reconstruction(detect.fit_sparse_reconstruction(same, 3), same, 3).collect()] == [0.0] * 5
    two = windows_of(spark, [([1, 2], 2, 1, 0)] * 5 + [([1, 1], 2, 1, 0)])
    model = detect.fit_sparse_reconstruction(two, 3)
    assert {len(r.loadings) for r in model.collect()} == {1}
    assert all(abs(r.score) < 1e-12 for r in detect.score_sparse_reconstruction(model, two, 3).collect())
    none = windows_of(spark, [])
    model = detect.fit_sparse_reconstruction(none, 3)
    assert model.count() == 0 and detect.score_sparse_reconstruction(model, none, 3).count() == 0
    assert [r.score for r in detect.score_sparse_reconstruction(model, two.limit(1), 3).collect()] == [1.0]


# ---- suffix tree ----------------------------------------------------------------------------


def plain_tree(rows, size, k, share):
    counts = defaultdict(Counter)
    for ids, length, nxt, _ in rows:
        own = tuple(ids[:length])
        for m in range(min(length, size) + 1):
            counts[own[len(own) - m:]][nxt] += 1
    total = {c: sum(n.values()) for c, n in counts.items()}
    whole = sum(n * math.log(total[()] / n) for n in counts[()].values())
    kept = {()}
    for c in counts:
        if c:
            p = c[1:]
            gain = sum(n * math.log((n / total[c]) / (counts[p][x] / total[p])) for x, n in counts[c].items())
            if gain >= share * whole and gain > 0:
                kept |= {c[i:] for i in range(len(c))}
    spread = {}
    for c in sorted(kept, key=len):
        if not c:
            spread[c] = {x: n / total[c] for x, n in counts[c].items()}
        else:
            kinds = len(counts[c])
            spread[c] = {x: (counts[c][x] + kinds * p) / (total[c] + kinds) for x, p in spread[c[1:]].items()}
    return {" ".join(map(str, c)): sorted(p, key=lambda x: (-p[x], x))[:k] for c, p in spread.items()}


@pytest.mark.parametrize("share,k", [(0.001, 3), (0.01, 5), (0.0, 2), (1.0, 4)])
def test_suffix_tree_equals_brute_force(spark, share, k):
    rng = random.Random(int(1000 * share))
    rows = []
    for _ in range(150):
        ids = [rng.randrange(1, 7) for _ in range(5)]
        length = rng.choice([5, 5, 5, 3, 1, 0])
        nxt = (ids[0] + ids[1]) % 6 + 1 if rng.random() < 0.6 else rng.randrange(1, 9)
        rows.append((ids, length, nxt, 0))
    made = suffix_tree.fit_suffix_tree(windows_of(spark, rows), 4, k, share)
    assert {r.context: list(r.topk) for r in made.collect()} == plain_tree(rows, 4, k, share)


def test_tree_is_no_worse_than_a_fixed_order_and_bounded(spark):
    """An event that follows from the one five steps before: a fixed order of three cannot see it."""
    rng = random.Random(3)
    log = [rng.randrange(1, 3) for _ in range(5)]
    while len(log) < 3000:
        log.append(log[-5] if rng.random() < 0.8 else rng.randrange(1, 3))
    rows = [(log[i:i + 8], 8, log[i + 8], 0) for i in range(len(log) - 8)]
    train, test = windows_of(spark, rows[:2000]), windows_of(spark, rows[2000:])
    share = 0.002
    tree, fixed = suffix_tree.fit_suffix_tree(train, 8, 1, share), detect.fit_next_event(train, 3, 1)
    hits = lambda model, order: detect.score_next_event(test, model, order).where(evaluate.hit_rank() == 1).count()
    assert hits(tree, 8) > 1.2 * hits(fixed, 3)
    counts = contexts.next_event_counts(train, 8)
    nodes = suffix_tree.tree_nodes(counts, share)
    telling = nodes.where("gain is not null").orderBy(F.desc("gain")).collect()
    whole = counts.where("context = ''").agg(F.sum("n")).first()[0] * math.log(2)
    assert sum(r.gain >= share * whole for r in telling) <= 1 / share
    assert len(telling) <= 8 / share
    # Every node's parent is a node.
    names = {r.context for r in nodes.collect()}
    assert all(r.parent in names for r in telling)


def test_suffix_tree_of_nothing(spark):
    assert suffix_tree.fit_suffix_tree(windows_of(spark, []), 4, 3).count() == 0


# ---- telling patterns -----------------------------------------------------------------------


def plain_patterns(rows, share, widths=(2, 3, 4)):
    support, bad = Counter(), Counter()
    for ids, length, _, anomaly in rows:
        own = ids[:length]
        for p in {tuple(own[i:i + w]) for w in widths for i in range(len(own) - w + 1)}:
            support[p] += 1
            bad[p] += anomaly
    return {p: (n, bad[p]) for p, n in support.items() if n >= share * len(rows)}


def test_frequent_patterns_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        anomaly = int(rng.random() < 0.3)
        ids = [rng.randrange(1, 6) for _ in range(7)]
        if anomaly and rng.random() < 0.7:
            ids[2:5] = [4, 4, 2]
        rows.append((ids, rng.choice([7, 7, 4, 2, 1]), 1, anomaly))
    made = windows_of(spark, rows)
    for share in (0.02, 0.1):
        expected = plain_patterns(rows, share)
        found = {tuple(map(int, r.pattern.split())): (r.support, r.anomalous) for r in patterns.frequent_patterns(made, share).collect()}
        assert found == expected
    n, bad = len(rows), sum(r[3] for r in rows)

    def chi2(p):
        s, a = expected[p]
        b, c, d = s - a, bad - a, n - bad - (s - a)
        return n * (a * d - b * c) ** 2 / (s * (n - s) * bad * (n - bad))

    order = sorted(expected, key=lambda p: (-chi2(p), -expected[p][0], " ".join(map(str, p))))
    best = patterns.telling_patterns(made, 5, 0.1).orderBy("pattern_id").collect()
    assert [tuple(map(int, r.pattern.split())) for r in best] == order[:5]
    assert np.allclose([r.chi2 for r in best], [chi2(p) for p in order[:5]])
    # The vector has a place for each pattern and no more.
    featured = patterns.telling_features(made, patterns.telling_patterns(made, 5, 0.1), 5).collect()
    assert len(featured) == len(rows)
    for r in featured:
        ids, length, _, _ = rows[r.window_idx]
        own = ids[:length]
        expected_row = [float(any(tuple(own[i:i + len(p)]) == p for i in range(len(own)))) for p in order[:5]]
        assert r.features.toArray().tolist() == expected_row


def test_patterns_of_one_label_and_of_nothing(spark):
    rows = [([1, 2, 3], 3, 1, 0)] * 4
    best = patterns.telling_patterns(windows_of(spark, rows), 10, 0.5).collect()
    assert [(r.pattern, r.chi2) for r in sorted(best)] == [("1 2", 0.0), ("1 2 3", 0.0), ("2 3", 0.0)]
    assert patterns.telling_patterns(windows_of(spark, []), 10).count() == 0


# ---- boosted trees and their threshold ------------------------------------------------------


def plain_threshold(pairs):
    best = None
    for cut in sorted({s for s, _ in pairs}):
        tp = sum(b for s, b in pairs if s >= cut)
        flagged = sum(s >= cut for s, _ in pairs)
        f1 = 2 * tp / (flagged + sum(b for _, b in pairs)) if tp else 0.0
        best = max(best or (f1, cut), (f1, cut))
    return best[1], best[0]


@pytest.mark.parametrize("seed", range(4))
def test_threshold_equals_a_recount(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(12) / 10 + 0.3 * (b := int(rng.random() < 0.4)), b) for _ in range(rng.choice([1, 40]))]
    made = detect.best_threshold(spark.createDataFrame(pairs, "score double, anomaly int")).collect()
    assert [tuple(r) for r in made] == [plain_threshold(pairs)]


def test_threshold_without_anomalies_or_windows(spark):
    schema = "score double, anomaly int"
    assert tuple(detect.best_threshold(spark.createDataFrame([(0.2, 0), (0.5, 0)], schema)).first()) == (0.5, 0.0)
    assert tuple(detect.best_threshold(spark.createDataFrame([], schema)).first()) == (None, None)


def test_trees_see_pairs_of_events(spark):
    """Windows are anomalous when just one of two events stands in them, which no weights of single events can tell."""
    rng = random.Random(12)
    lines = []
    for s in range(60):
        for pos in range(24):
            lines.append([f"s{s}", 100 * s + pos, rng.choice("aaabbbcd") if pos % 4 else rng.choice("xyzz"), 0])
    for line in lines:
        line[3] = 0
    by_session = defaultdict(list)
    for line in lines:
        by_session[line[0]].append(line)
    for own in by_session.values():
        for k in range(0, 24, 4):
            group = own[k:k + 4]
            kinds = {x[2] for x in group}
            group[-1][3] = int(("c" in kinds) != ("x" in kinds))
    from logweave.plans import flows

    log = spark.createDataFrame([tuple(x) for x in lines], "session_id string, line_id long, template string, label int")
    data = flows.prepare(log, test_ratio=0.3)
    flagged, threshold = flows.tree_classification(data, 3, 4)
    from logweave.operators.windows import sliding_windows
    from logweave.operators.features import count_features

    size = data.vocab_size()
    plain = detect.score_classifier(
        detect.fit_classifier(count_features(sliding_windows(data.train, 3, 4), size)), count_features(sliding_windows(data.test, 3, 4), size))
    f1 = lambda made: evaluate.binary_metrics(made.select(F.col("flag").alias("pred"), F.col("anomaly").alias("truth"))).first()["f1"]
    assert f1(flagged) >= f1(plain)
    cut = threshold.first()["threshold"]
    assert all(r.flag == int(r.score >= cut) for r in flagged.select("flag", "score").collect())


def test_tree_query_is_not_below_the_logistic_fit(spark):
    from compare import DATA
    from logweave.plans import catalog

    if not (DATA / "sf0.001").exists():
        pytest.skip("test tables are not here")
    made = {r.model: r for r in catalog.QUERIES["d2_tree_classifier"](spark, str(DATA / "sf0.001")).collect()}
    assert set(made) == {"trees", "logistic"} and made["trees"].f1 >= made["logistic"].f1


# ---- learned token vectors ------------------------------------------------------------------


def test_learned_vectors_equal_a_plain_decomposition(spark):
    rng = random.Random(6)
    templates = [" ".join(rng.choice(["open", "read", "close", "file", "block", "node", "sent", "ok"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    lines = spark.createDataFrame([(t,) for t in templates for _ in range(rng.randrange(1, 4))], "template string")
    counts = Counter()
    for (t,) in lines.collect():
        w = t.split()
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    counts[w[i], w[j]] += 1
    pairs = cooccurrence.token_pairs(lines).cache()
    assert {(r.token, r.near): r.n for r in pairs.collect()} == counts
    own, total = Counter(), sum(counts.values())
    for (a, _), n in counts.items():
        own[a] += n
    expected = {(a, b): v for (a, b), n in counts.items() if (v := math.log(n * total / (own[a] * own[b]))) > 0}
    information = cooccurrence.mutual_information(pairs).cache()
    made = {(r.token, r.near): r.ppmi for r in information.collect()}
    assert made.keys() == expected.keys() and all(abs(made[k] - expected[k]) < 1e-12 for k in made)
    names = sorted({a for a, _ in expected})
    table = np.array([[expected.get((a, b), 0.0) for b in names] for a in names])
    vocabulary = spark.createDataFrame([(w, k + 2) for k, w in enumerate(names)], "token string, token_id int")
    _, _, v = np.linalg.svd(table)
    for dim in (3, len(names) + 2):
        vectors = {r.token: r.vec for r in cooccurrence.learned_vectors(information, vocabulary, dim).collect()}
        got = np.array([vectors[w] for w in names])
        assert got.shape == (len(names), dim)
        # The same up to the sign of each direction: equal inner products.
        y = table @ v[:dim].T
        assert np.allclose(got @ got.T, y @ y.T, atol=1e-7)
        again = {r.token: r.vec for r in cooccurrence.learned_vectors(information, vocabulary, dim).collect()}
        assert all(np.allclose(vectors[w], again[w], atol=1e-9) for w in names)


# ---- search over orders ---------------------------------------------------------------------


@pytest.mark.parametrize("rows", [10**6, 0])
def test_shared_search_chooses_like_the_sequential_one(spark, rows):
    rng = random.Random(8)
    log = [1, 2]
    while len(log) < 900:
        log.append((log[-1] + log[-2]) % 4 + 1 if rng.random() < 0.85 else rng.randrange(1, 6))
    made = [(log[i:i + 6], 6, log[i + 6], int(rng.random() < 0.1)) for i in range(len(log) - 6)]
    train, test = windows_of(spark, made[:600]), windows_of(spark, made[600:])

    def metrics(order):
        return evaluate.topk_metrics(detect.score_next_event(test, detect.fit_next_event(train, order, 1), order), 1)

    for patience in (1, 2):
        expected = detect.search(range(1, 5), metrics, patience, spark).collect()
        assert detect.search_orders(train, test, range(1, 5), 1, patience).collect() == expected
    model = detect.fit_next_event(train, 4, 1)
    each = detect.score_orders(test, model, [1, 3, 4], rows)
    for order in (1, 3, 4):
        own = detect.score_next_event(test, detect.fit_next_event(train, order, 1), order).select("session_id", "window_idx", "topk")
        assert sorted(each.where(F.col("order") == order).select("session_id", "window_idx", "topk").collect()) == sorted(own.collect())


def test_shared_search_reads_the_windows_once(spark, tmp_path):
    rows = [([1, 2, 3], 3, 1 + k % 3, 0) for k in range(20)]
    windows_of(spark, rows).write.parquet(str(tmp_path / "windows"))
    stored = spark.read.parquet(str(tmp_path / "windows"))
    model = detect.fit_next_event(windows_of(spark, rows), 4, 1).cache()
    plan = detect.score_orders(stored, model, range(1, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ids#") > 0 and plan.count("Relation [session_id") == 1
