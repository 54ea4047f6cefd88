import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from benchloom.functions import digests, errors
from benchloom.operators import mixtures, models, prep, ranks, trees
from benchloom.operators import neighbours
from benchloom.operators.neighbours import knn_regress, knn_regress_vectors, nearest, nearest_vectors, outermost
from benchloom.plans import learning
from benchloom.session import materialize

rng = random.Random(11)


# ---- preparation ----------------------------------------------------------------------


def test_split_per_value(spark, limit):
    rows = [(i, "solo" if i == 0 else ("hot" if i < 40 else f"v{i % 3}")) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, v string")
    parts = {"train": {}, "test": {}}
    for r in prep.per_feature_split(df, lambda cols: ["v"], ["id"], 0.5).collect():
        parts[r.part].setdefault(r.v, set()).add(r.id)
    assert parts["train"]["solo"] == parts["test"]["solo"] == {0}
    for v in ("hot", "v0", "v1", "v2"):
        train, test = parts["train"][v], parts["test"][v]
        assert not train & test
        assert train | test == {i for i, w in rows if w == v}
        assert len(test) == math.ceil(len(train | test) / 2)


def test_outliers(spark, limit):
    df = spark.createDataFrame([(str(float(i)),) for i in range(101)], "jct string")
    kept = sorted(r.jct for r in prep.outlier_filter(df, "jct").collect())
    assert kept == [float(i) for i in range(99)]


def test_encoders(spark, limit):
    df = spark.createDataFrame([(i, f"k{i % 12:02d}", "Z" if i % 2 else "a") for i in range(40)], "i int, s string, t string")
    encoded, used = prep.label_encode(df)
    got = {r.i: (r.s, r.t) for r in encoded.collect()}
    assert got == {i: (i % 12, 0 if i % 2 else 1) for i in range(40)}  # "Z" sorts before "a"
    again, _ = prep.label_encode(df.limit(1), ["s"], {"s": used["s"]})
    assert again.first().s == 0


def test_scaler_and_dataset(spark):
    df = spark.createDataFrame([(i, float(i), 4.0, 10.0 * i + 1) for i in range(5)], "id int, a double, c double, jct double")
    data, names, scaler = prep.dataset_xy(df, "jct", None, ["id"], scaler=prep.StandardScaler, feature_select=True)
    assert names == ["a"]
    x = np.array([r.features[0] for r in data.orderBy("id").collect()])
    assert x == pytest.approx((np.arange(5) - 2) / np.std(np.arange(5)))
    back = data.select(scaler.backward(F.col("label"), "label").alias("y"))
    assert sorted(r.y for r in back.collect()) == pytest.approx([1, 11, 21, 31, 41])
    some, names, _ = prep.dataset_xy(df, "jct", None, ["id"], num_rows=3)
    assert some.count() == 3 and names == ["a", "c"]
    _, mapped, _ = prep.dataset_xy(df, "jct", None, ["id"], feature_select=True, feature_map=[False, True])
    assert mapped == ["c"]
    assert prep.IdentityScaler().transform(df) is df


# ---- errors ---------------------------------------------------------------------------


def test_error_measures(spark):
    def measure(rows, fn):
        df = spark.createDataFrame(rows, "y double, p double")
        return df.agg(fn(F.col("y"), F.col("p"))).first()[0]

    rows = [(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)]
    y, p = np.array(rows).T
    assert measure(rows, errors.rmsre) == pytest.approx(np.sqrt(np.mean(((y - p) / y) ** 2)))
    assert measure(rows, errors.rrmse) == pytest.approx(np.sqrt(np.mean((y - p) ** 2)) / y.mean())
    assert measure(rows, errors.rrse) == pytest.approx(np.sqrt(((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()))
    assert measure([(3.0, 3.0)] * 2, errors.rrse) == 0.0
    assert measure([(3.0, 4.0)] * 2, errors.rrse) == 1.0
    assert measure([(1e-6, 1.0)], errors.rmsre_capped) == math.inf
    assert measure([(0.0, 1.0), (1.0, 1.0)], errors.rmsre) == math.inf
    df = spark.createDataFrame([(1.0, 200002.0), (2.0, 1.0)], "y double, p double")
    assert [r[0] for r in df.select(errors.relative_error(F.col("y"), F.col("p"))).collect()] == [math.inf, 0.5]


# ---- neighbours -----------------------------------------------------------------------

TRAIN = [("ab"[i % 4 == 0], i, float(rng.randrange(12)), float(rng.randrange(50)) + 1) for i in range(80)]
ASKED = [("ab"[i % 2], float(rng.randrange(-4, 28)) / 2) for i in range(60)] + [("c", 1.0)]


def brute_neighbours(group, q, k):
    train = sorted((x, i, y) for g, i, x, y in TRAIN if g == group)
    order = sorted(range(len(train)), key=lambda p: (
        abs(train[p][0] - q), train[p][0] >= q, p if train[p][0] >= q else -p))
    return [train[p] for p in order[:k]]


@pytest.mark.parametrize("k", [1, 3, 200])
def test_nearest_equals_brute_force(spark, limit, k):
    train = spark.createDataFrame(TRAIN, "g string, id int, x double, y double")
    asked = spark.createDataFrame(ASKED, "g string, x double")
    got = {}
    for r in nearest(train, asked, ["g"], "x", ["id"], k).collect():
        got.setdefault((r.g, r.query), []).append((r.place, r.id))
    for g, q in set(ASKED):
        expected = [(n + 1, i) for n, (_x, i, _y) in enumerate(brute_neighbours(g, q, k))]
        assert sorted(got.get((g, q), [])) == expected


def vector_rows():
    """Crowds: a third of group a in one vector, another third close together."""
    rows = [("ab"[i % 5 == 0], i, float(rng.randrange(9)), rng.random() * 4, float(i % 7)) for i in range(90)]
    rows += [("a", 100 + i, 2.0, 2.0, float(i)) for i in range(60)]
    rows += [("a", 200 + i, 3 + i * 1e-4, 1 + (i % 9) * 1e-4, float(i)) for i in range(60)]
    rows += [(None, 300, 1.0, 1.0, 5.0), (None, 301, -0.0, 1.0, 6.0), ("b", 302, 1e3, 0.0, 1.0),
             ("a", 303, None, 1.0, 9.0), ("a", 304, math.nan, 1.0, 9.0), ("a", 305, math.inf, 1.0, 9.0)]
    asked = [("ab"[i % 2], float(rng.randrange(-4, 20)) / 2, rng.random() * 5) for i in range(30)]
    asked += [("a", 2.0, 2.0), ("a", 3.0, 1.0), ("a", 1e6, -1e6), (None, 0.0, 1.0), ("c", 1.0, 1.0),
              ("a", None, 1.0), ("b", math.nan, 1.0)]
    return rows, asked


def brute_vectors(rows, g, q, k):
    if None in q or not all(map(math.isfinite, q)):
        return []
    own = [(r[2] + 0.0, r[3] + 0.0, r[1], r[4]) for r in rows if r[0] == g and r[2] is not None and math.isfinite(r[2])]
    return sorted(((x - q[0]) ** 2 + (z - q[1]) ** 2, x, z, i, y) for x, z, i, y in own)[:k]


@pytest.mark.parametrize("k, leaf", [(1, 2), (5, 4), (500, 32)])
def test_nearest_vectors_equals_brute_force(spark, monkeypatch, k, leaf):
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    rows, asked = vector_rows()
    train = spark.createDataFrame(rows, "g string, id int, x double, z double, y double")
    queries = spark.createDataFrame(asked, "g string, x double, z double")
    got = {}
    for r in nearest_vectors(train, queries, ["g"], ["x", "z"], ["id"], k).collect():
        got.setdefault((r.g, r._q_x, r._q_z), {})[r.place] = (r.id, r.distance)
    expected = {(g, x, z): {n + 1: (row[3], math.sqrt(row[0])) for n, row in enumerate(near)}
                for g, x, z in asked if (near := brute_vectors(rows, g, (x, z), k))}
    assert got == expected


def test_knn_on_vectors(spark):
    rows, asked = vector_rows()
    train = spark.createDataFrame(rows, "g string, id int, x double, z double, y double")
    test = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "row int, g string, x double, z double")
    both = {"u": "uniform", "d": "distance"}
    got = {r.row: r for r in knn_regress_vectors(train, test, ["x", "z"], "y", ["id"], 4, both, ["g"]).collect()}
    assert len(got) == len(asked)
    for i, (g, *q) in enumerate(asked):
        near = brute_vectors(rows, g, q, 4)
        if not near:
            assert got[i].u is None and got[i].d is None
            continue
        exact = [n[4] for n in near if n[0] == 0]
        far = [(n[4], 1 / math.sqrt(n[0])) for n in near if n[0]]
        by_distance = sum(exact) / len(exact) if exact else sum(y * w for y, w in far) / sum(w for _, w in far)
        assert (got[i].u, got[i].d) == (pytest.approx(sum(n[4] for n in near) / len(near)), pytest.approx(by_distance))
    assert knn_regress_vectors(train.limit(0), test, ["x", "z"], "y", ["id"]).filter("prediction IS NOT NULL").count() == 0
    assert knn_regress_vectors(train, test.limit(0), ["x", "z"], "y", ["id"]).count() == 0


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_equals_brute_force(spark, weights):
    train = spark.createDataFrame(TRAIN, "g string, id int, x double, y double")
    asked = spark.createDataFrame([(i, g, q) for i, (g, q) in enumerate(ASKED)], "row int, g string, x double")
    out = knn_regress(train, asked, "x", "y", ["id"], 4, weights, ["g"])
    got = {r.row: r.prediction for r in out.collect()}
    assert len(got) == len(ASKED)
    for i, (g, q) in enumerate(ASKED):
        near = brute_neighbours(g, q, 4)
        if not near:
            assert got[i] is None
            continue
        gaps = [abs(x - q) for x, _i, _y in near]
        if weights == "uniform":
            w = [1.0] * len(near)
        elif 0 in gaps:
            w = [float(d == 0) for d in gaps]
        else:
            w = [1 / d for d in gaps]
        assert got[i] == pytest.approx(sum(a * y for a, (_x, _i, y) in zip(w, near)) / sum(w))


# ---- models ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def line(spark):
    rows = [(i, float(i % 10), 5.0 + 3.0 * (i % 10) + rng.random()) for i in range(120)]
    return spark.createDataFrame(rows, "id int, x double, y double").persist()


def test_best_possible_beats_the_mean(line):
    best = models.predict_best_possible(line, ["x"], "y")
    naive = models.predict_naive(line, "y")
    score = lambda df: df.agg(errors.rmsre(F.col("y"), F.col("prediction"))).first()[0]
    assert score(best) < score(naive)
    assert best.count() == naive.count() == 120


def test_linear_and_svr_recover_the_line(line):
    model = models.linear().fit(models.assemble(line, ["x"], "y"))
    assert model.coefficients[0] == pytest.approx(3.0, abs=0.1)
    scaler = prep.StandardScaler.fit(line, ["x", "y"])
    weights = models.fit_svr_linear(scaler.transform(line), ["x"], "y")
    slope = weights["x"] * scaler.stats["y"][1] / scaler.stats["x"][1]
    assert slope == pytest.approx(3.0, abs=0.3)


def test_grid_equals_brute_force(line):
    folded = models.with_folds(line, ["id"])
    rows = [(r.fold, r.id, r.x, r.y) for r in folded.collect()]
    assert {f for f, *_ in rows} == {0, 1, 2}

    def score(predict):
        found = []
        for f in range(3):
            train, test = [r for r in rows if r[0] != f], [r for r in rows if r[0] == f]
            found.append(np.sqrt(np.mean([((y - predict(train, x)) / y) ** 2 for _f, _i, x, y in test])))
        return -np.mean(found), np.std(found)

    def knn(k):
        def predict(train, q):
            order = sorted(((x, i, y) for _f, i, x, y in train))
            place = sorted(range(len(order)), key=lambda p: (
                abs(order[p][0] - q), order[p][0] >= q, p if order[p][0] >= q else -p))[:k]
            return np.mean([order[p][2] for p in place])
        return predict

    def origin(train, q):
        x, y = np.array([r[2] for r in train]), np.array([r[3] for r in train])
        return q * (x * y).sum() / (x * x).sum()

    def through(train, q):
        x, y = np.array([r[2] for r in train]), np.array([r[3] for r in train])
        return np.polyval(np.polyfit(x, y, 1), q)

    got = {(r.n_neighbors, r.weights): r for r in models.grid_knn(folded, "x", "y", ["id"], sizes=[1, 4]).collect()}
    for k in (1, 4):
        assert (got[(k, "uniform")].mean_test_score, got[(k, "uniform")].std_test_score) == pytest.approx(score(knn(k)))
    lines = {r.fit_intercept: r for r in models.grid_linear(folded, "x", "y").collect()}
    assert lines[True].mean_test_score == pytest.approx(score(through)[0])
    assert lines[False].mean_test_score == pytest.approx(score(origin)[0])
    assert models.knn_sizes(120) == [1, 2, 4, 8, 16, 32] and models.knn_sizes(9) == [1, 2, 4]


def test_grid_search_and_feature_ranking(line):
    best = models.grid_search(line, "x", "y", ["id"], forest_grid=[{"numTrees": 2, "maxDepth": 2}])
    assert {r.family for r in best.collect()} == {"linear_regression", "nearest_neighbors", "random_forest"}
    noisy = line.withColumn("noise", F.pmod(F.hash("id"), F.lit(7)).cast("double"))
    ranked = [r.feature for r in models.rank_features_by_forest(noisy, ["noise", "x"], "y", ["id"], splits=1).collect()]
    assert ranked == ["x", "noise"]


def test_grid_search_over_whole_grids(line, monkeypatch):
    folded = models.with_folds(line, ["id"])
    one = models.grid_svr(folded, "x", "y", [{"C": 1.0, "epsilon": 0.1}, {"C": 0.05, "epsilon": 2.0}])
    got = {(r.C, r.epsilon): r.mean_test_score for r in one.collect()}
    for c, epsilon in got:
        errs = []
        for fold in range(3):
            scaler = prep.StandardScaler.fit(folded.where(f"fold <> {fold}"), ["x", "y"])
            fitted = models.fit_svr_linear(
                scaler.transform(folded.where(f"fold <> {fold}")), ["x"], "y", c, epsilon)
            out = models.apply_linear(scaler.transform(folded.where(f"fold = {fold}")), fitted)
            back = [scaler.backward(F.col(k), "y") for k in ("y", "prediction")]
            errs.append(out.agg(errors.rmsre(*back)).first()[0])
        assert got[c, epsilon] == pytest.approx(-np.mean(errs))
    assert len(models.settings(models.FOREST_GRID)) == 192
    assert len(models.settings(models.SVR_GRID)) == 36

    def broken(*a):
        raise ValueError("no neighbours")

    monkeypatch.setattr(models, "grid_knn", broken)
    best = models.grid_search(line, "x", "y", ["id"], [{"numTrees": 1, "maxDepth": 1}],
                              svr_grid=models.settings(models.SVR_GRID))
    best = {r.family: r for r in best.collect()}
    assert best.keys() == {"linear_regression", "nearest_neighbors", "random_forest", "svm"}
    assert (best["nearest_neighbors"].params, best["nearest_neighbors"].mean_test_score) == ("default", None)
    assert best["svm"].mean_test_score < 0


def test_registered_grid_search_tries_every_setting(spark, monkeypatch):
    asked = {}
    scores = "mean_test_score double, std_test_score double"
    monkeypatch.setattr(models, "grid_search", lambda *a, **k: asked.update(k) or spark.createDataFrame([], scores))
    monkeypatch.setattr(learning, "_cents", lambda t: None)
    learning.grid_search(None)
    assert len(asked["forest_grid"]) == 192 and len(asked["svr_grid"]) == 36


def _digest(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


def _draw(seed, tree, unique):
    """A Poisson draw of mean 1 from 16 bits of a digest."""
    shown = int(_digest(f"{seed}.{tree // 8}", *unique)[4 * (tree % 8):][:4], 16)
    total, k = 0.0, 0
    while k < 8:
        total += math.exp(-1) / math.factorial(k)
        if shown < int(total * 65536):
            break
        k += 1
    return k


def _one_tree(rows, depth, min_leaf, min_split, chosen, node=1):
    """A separate fit by recursion; rows are (w, features, y)."""
    w, s = sum(r[0] for r in rows), sum(r[0] * r[2] for r in rows)
    best = None
    if depth and w >= min_split:
        for f in chosen(node):
            values = sorted({r[1][f] for r in rows})
            for a, b in zip(values, values[1:]):
                left = [r for r in rows if r[1][f] <= a]
                wl, sl = sum(r[0] for r in left), sum(r[0] * r[2] for r in left)
                if min(wl, w - wl) >= min_leaf:
                    score = sl * sl / wl + (s - sl) ** 2 / (w - wl)
                    if score - s * s / w > 1e-12 * s * s / w and (best is None or score > best[0]):
                        best = score, f, (a + b) / 2
    if best is None:
        return lambda x: s / w
    _, f, at = best
    sides = [_one_tree([r for r in rows if (r[1][f] > at) == up], depth - 1, min_leaf, min_split, chosen,
                       2 * node + up) for up in (False, True)]
    return lambda x: sides[x[f] > at](x)


@pytest.mark.parametrize("features", [["x"], ["x", "z"]])
def test_shared_fits_score_like_separate_fits(spark, features):
    random.seed(7)
    data = [(i, float(random.randint(0, 9)), float(random.randint(0, 4))) for i in range(90)]
    data = [(i, x, z, float(round(100 + 40 * math.sin(x) + 10 * z + random.gauss(0, 5)))) for i, x, z in data]
    rows = spark.createDataFrame(data, "id bigint, x double, z double, y double")
    folded = models.with_folds(rows, ["id"])
    grid = models.settings({**models.FOREST_GRID, "maxDepth": (1, 3, None), "numTrees": (1, 3, 9)})
    got = {r.params: r for r in models.grid_forest(folded, features, "y", ["id"], grid).collect()}
    assert len(got) == len(grid) == 144
    held = [(r.fold, r.id, tuple(r[f] for f in features), r.y) for r in folded.collect()]
    for p in grid:
        tried = len(features) if p["featureSubsetStrategy"] == "all" else 1
        depth = p["maxDepth"] or 62
        errs = []
        for fold in range(3):
            fits = []
            for tree in range(p["numTrees"]):
                weigh = lambda id: _draw("0", tree, [id]) if p["bootstrap"] else 1  # noqa: E731, B023
                train = [(weigh(id), x, y) for f, id, x, y in held if f != fold and weigh(id)]
                keys = (fold, str(p["bootstrap"]).lower(), tried, p["minInstancesPerNode"], p["minInstancesToSplit"], tree)
                chosen = lambda node: sorted(sorted(
                    range(len(features)), key=lambda f: _digest("0", *keys, node, f))[:tried])  # noqa: B023
                fits.append(_one_tree(train, depth, p["minInstancesPerNode"], p["minInstancesToSplit"],
                                      chosen if tried < len(features) else lambda node: range(len(features))))
            test = [(x, y) for f, _, x, y in held if f == fold]
            errs.append(np.sqrt(np.mean([((y - np.mean([t(x) for t in fits])) / y) ** 2 for x, y in test])))
        r = got[models._text(p)]
        assert (r.mean_test_score, r.std_test_score) == pytest.approx((-np.mean(errs), np.std(errs))), p


def test_crowded_features_are_binned(spark):
    rows = spark.createDataFrame([("few", float(i % 5)) for i in range(40)] + [("many", float(i)) for i in range(1000)]
                                 + [("many", None), (None, 2.0)], "k string, x double")
    got = trees.binned(rows, ["k"], "x", 8).groupBy("k").agg(F.count_distinct("x"), F.count("*"), F.max("x")).collect()
    assert {tuple(r) for r in got} == {("few", 5, 40, 4.0), ("many", 8, 1001, 999.0), (None, 1, 1, 2.0)}


def written_rows(monkeypatch):
    """Names and row counts of what operators write from here on."""
    written = []

    def spy(df, name="stage", *rest):
        out = materialize(df, name, *rest)
        written.append((name, out.count()))
        return out

    for module in (models, trees, ranks):
        monkeypatch.setattr(module, "materialize", spy)
    return written


def test_feature_ranking_repeats_no_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 5), float(i % 3), float(i % 7)) for i in range(3000)],
                                 "id int, x double, z double, y double")
    written = written_rows(monkeypatch)
    models.rank_features_by_forest(rows, ["x", "z"], "y", ["id"], splits=2, n_trees=4).collect()
    assert max(n for _, n in written) < 3000


def test_feature_ranking_scores_like_separate_rows(spark):
    data = [(i, None if i % 11 == 0 else float(i % 6), float("nan") if i % 13 == 0 else float(i * i % 400),
             None if i % 17 == 0 else float(10 * (i % 6) + i % 4)) for i in range(900)]
    rows = spark.createDataFrame(data, "id int, x double, z double, y double")
    got = {r.feature: r.r2 for r in models.rank_features_by_forest(
        rows, ["x", "z"], "y", ["id"], splits=2, n_trees=3, depth=2, max_bins=1000).collect()}
    for at, feature in ((1, "x"), (2, "z")):
        scores = []
        for split in range(2):
            held = [(r[0], (r[at],), r[3]) for r in data if r[at] is not None and r[at] == r[at] and r[3] is not None]
            test = [int(_digest(split, id)[:8], 16) / 2**32 < 0.3 for id, *_ in held]
            fits = []
            for tree in range(3):
                drawn = [(_draw("42", tree, [id, split]), v, y) for (id, v, y), t in zip(held, test) if not t]
                fits.append(_one_tree([d for d in drawn if d[0]], 2, 1, 2, lambda node: [0]))
            asked = [(y, np.mean([f(v) for f in fits])) for (_, v, y), t in zip(held, test) if t]
            y, p = np.array(asked).T
            scores.append(1 - ((y - p) ** 2).sum() / (y.var() * len(y)))
        assert got[feature] == pytest.approx(np.mean(scores), abs=0.0006)


def test_sweep_sorts_few_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "t", float(i % 2), float(1 + i % 7)) for i in range(4000)],
                                 "id int, trial string, x double, y double")
    written = written_rows(monkeypatch)
    models.prediction_sweep(rows, ["trial"], ["id"]).collect()
    assert [n for name, n in written if name == "sweep-split"] == [4000]
    assert max(n for name, n in written if name == "ranged") < 400


def test_grid_search_repeats_no_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 5), float(20 + i % 7)) for i in range(3000)], "id int, x double, y double")
    written = written_rows(monkeypatch)
    models.grid_search(rows, "x", "y", ["id"], [{"numTrees": 2, "maxDepth": 2}], svr_grid=[{"C": 1.0, "epsilon": 0.1}])
    assert max(n for _, n in written) <= 3000


@pytest.mark.parametrize("k", [1, 3])
def test_outermost_rows_hold_all_neighbours(spark, k):
    data = [(i // 2, i % 2, None if i % 29 == 0 else float(i * i % 9), float(i)) for i in range(200)]
    data += [(None, 0, 4.0, 0.5), (3, 0, 7.0, 0.25), (3, 0, 7.0, 0.25)]
    rows = spark.createDataFrame(data, "id int, k int, x double, y double").repartition(4)
    kept = outermost(rows, ["k"], "x", ["id"], k)
    assert kept.groupBy("k", "x").count().agg(F.max("count")).first()[0] == 2 * k
    asked = spark.createDataFrame([(i % 2, i / 2) for i in range(24)], "k int, x double")
    found = [sorted((r.k, r.query, r.place, r.distance, str(r.id), r.y) for r in nearest(
        train, asked, ["k"], "x", ["id", "y"], k).collect()) for train in (rows, kept)]
    assert found[0] == found[1]


@pytest.mark.parametrize("lot", [7, 1 << 20])
def test_grid_svr_on_sorted_lists(spark, monkeypatch, lot):
    monkeypatch.setattr(models, "SVR_LOT", lot)
    monkeypatch.setattr(models, "SVR_LISTS", 2)
    monkeypatch.setattr(models, "SCORED_AT_ONCE", 2)
    data = [(i, float(i % 4) if i % 3 else i / 7, float(50 + i * i % 40)) for i in range(150)] + [(200, None, 1.0)]
    folded = models.with_folds(spark.createDataFrame(data, "id int, x double, y double"), ["id"]).repartition(3)
    grid = [{"C": c, "epsilon": e} for c, e in ((1.0, 0.1), (0.05, 0.7), (0.5, 0.0))]
    got = {(r.C, r.epsilon): r.mean_test_score for r in models.grid_svr(folded, "x", "y", grid, iterations=20).collect()}
    held = np.array([(r.fold, r.x, r.y) for r in folded.collect() if r.x is not None])
    for p in grid:
        errs = []
        for f in range(3):
            train, test = held[held[:, 0] != f], held[held[:, 0] == f]
            (_, mx, my), (_, sx, sy) = train.mean(0), train.std(0)
            u, v = (train[:, 1] - mx) / sx, (train[:, 2] - my) / sy
            w = b = 0.0
            steps = []
            for step in range(1, 21):
                error = v - (b + w * u)
                side = np.sign(error) * (np.abs(error) > p["epsilon"])
                size = 0.5 / math.sqrt(step)
                w, b = (w - size * (w / (p["C"] * len(u)) - (u * side).sum() / len(u)), b + size * side.sum() / len(u))
                steps.append((w, b))
            w, b = np.mean(steps[10:], axis=0)
            line = my + sy * (b + w * (test[:, 1] - mx) / sx)
            errs.append(np.sqrt(np.mean(((test[:, 2] - line) / test[:, 2]) ** 2)))
        assert got[p["C"], p["epsilon"]] == pytest.approx(-np.mean(errs))


@pytest.mark.parametrize("most", [1, 100])
def test_tree_sums_of_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(trees, "CELLS_HELD", most)
    keys, labels = ["a", "b", None], [1.5, None, float("nan"), float("inf"), 4.0, -2.0]
    data = [(i, keys[i % 3], None if i % 5 == 0 else float(i % 2), labels[i % 6] if i < 60 else 3.0) for i in range(150)]
    rows = spark.createDataFrame(data, "id int, k string, x double, y double").repartition(3)
    want = {}
    for id, k, x, y in data:
        for tree in range(10):
            w = _draw("s", tree, [id])
            if w:
                cell = want.setdefault((k, x, tree), [0, 0.0])
                cell[0] += w
                cell[1] += w * (y or 0.0)
    got = trees.tree_sums(rows, ["k", "x"], "y", ["id"], 10, "s").filter("bootstrap").collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.w, r.s) == pytest.approx(tuple(want[r.k, r.x, r.tree]), nan_ok=True)
    tall = trees.tree_sums(rows, ["k"], "y", ["id"], 10, "s", {"one": "x"})
    assert {(r.k, r.feature, r._x, r.tree) for r in tall.filter("bootstrap").collect()} == {
        (k, "one", x, tree) for k, x, tree in want if x is not None}
    assert tall.filter("NOT bootstrap").agg(F.sum("w")).first()[0] == sum(x is not None for _, _, x, _ in data)


def test_no_rows_to_grow_on(spark):
    cells = spark.createDataFrame([("a", 1.0, 0.0, 0.0)], "k string, x double, w double, s double")
    nodes, placed = trees.grow(cells, ["k"], ["x"])
    assert nodes.count() == placed.count() == 0
    rows = spark.createDataFrame([(i, 1.0, 3.0) for i in range(9)], "id int, x double, y double")
    ranked = models.rank_features_by_forest(rows, ["x"], "y", ["id"], splits=2).collect()
    assert [tuple(r) for r in ranked] == [("x", None)]


# ---- mixtures -------------------------------------------------------------------------


def pool_rows(spark):
    r = random.Random(3)
    labels = [("two", round(r.gauss(10, 1), 3)) for _ in range(150)]
    labels += [("two", round(r.gauss(50, 2), 3)) for _ in range(50)]
    labels += [("one", 7.0)]
    df = spark.createDataFrame(labels, "pool string, label double")
    return df.groupBy("pool", "label").agg(F.count(F.lit(1)).alias("copies")), labels


def test_mixture_properties(spark):
    pools, labels = pool_rows(spark)
    fitted = {r.pool: r.mixture for r in mixtures.fit_mixtures(pools, ["pool"], 2, 15).collect()}
    low, high = fitted["two"]
    assert (low["mean"], high["mean"]) == (pytest.approx(10, abs=0.3), pytest.approx(50, abs=1))
    assert (low["weight"], high["weight"]) == (pytest.approx(0.75, abs=0.01), pytest.approx(0.25, abs=0.01))
    assert low["weight"] + high["weight"] == pytest.approx(1)
    # A single label cannot carry two components.
    assert [(c["mean"], c["weight"]) for c in fitted["one"]] == [(7.0, 1.0)]
    assert fitted["one"][0]["var"] == pytest.approx(mixtures.VARIANCE_FLOOR)


def test_likelihood_never_falls(spark):
    pools, _ = pool_rows(spark)
    two = pools.filter("pool = 'two'")
    seen = []
    for steps in (1, 3, 6):
        fitted = mixtures.fit_mixtures(two, ["pool"], 2, steps)
        scored = two.join(fitted, "pool").agg(
            F.sum(mixtures.log_likelihood(F.col("mixture"), F.col("label")) * F.col("copies"))
        )
        seen.append(scored.first()[0])
    assert seen == sorted(seen)


def test_one_component_is_the_closed_form(spark):
    pools, labels = pool_rows(spark)
    fitted = mixtures.fit_mixtures(pools.filter("pool = 'two'"), ["pool"], 1, 2).first().mixture[0]
    values = np.array([v for p, v in labels if p == "two"])
    assert fitted["mean"] == pytest.approx(values.mean())
    assert fitted["var"] == pytest.approx(values.var() + 1e-6, rel=1e-6)
    single = mixtures.fit_single(spark.createDataFrame(labels, "pool string, label double"), ["pool"], "label")
    assert {r.pool: r["mean"] for r in single.collect()}["two"] == pytest.approx(values.mean())


def test_density_helpers(spark):
    df = spark.createDataFrame(
        [([(1.0, 4.0, 0.5), (3.0, 1.0, 0.5)], 2.0)], "mixture array<struct<mean:double,var:double,weight:double>>, y double"
    )
    m, y = F.col("mixture"), F.col("y")
    row = df.select(mixtures.log_likelihood(m, y), mixtures.responsibilities(m, y), mixtures.nearest_mean(m, y)).first()
    pdf = [0.5 * math.exp(-0.5 * (2 - mu) ** 2 / v) / math.sqrt(2 * math.pi * v) for mu, v in ((1, 4), (3, 1))]
    assert row[0] == pytest.approx(math.log(sum(pdf)))
    assert row[1] == pytest.approx([p / sum(pdf) for p in pdf])
    assert row[2] == 1.0  # a tie goes to the earlier component
    assert df.agg(mixtures.nearest_component_rmsre(m, y)).first()[0] == pytest.approx(0.5)
    assert df.agg(mixtures.nearest_component_rmsre(m, y, swap=True)).first()[0] == pytest.approx(1.0)


def test_leaf_pools(spark):
    train = spark.createDataFrame([([0, 5], 1.0), ([0, 6], 1.0), ([1, 6], 4.0)], "leaves array<int>, label double")
    test = spark.createDataFrame([([0, 6],), ([0, 6],), ([1, 5],)], "leaves array<int>")
    assert {(r.tree, r.leaf, r.label): r.copies for r in mixtures.leaf_samples(train).collect()} == {
        (0, 0, 1.0): 2, (0, 1, 4.0): 1, (1, 5, 1.0): 1, (1, 6, 1.0): 1, (1, 6, 4.0): 1,
    }
    numbered, asked = mixtures.number_leaves(train, test)
    pools = mixtures.sample_pools(asked, numbered).groupBy("pool", "label").agg(F.sum("copies").alias("n"))
    vectors = asked.select("pool", "leaves").distinct()
    got = {(tuple(r.leaves), r.label): r.n for r in pools.join(vectors, "pool").collect()}
    assert got == {((0, 6), 1.0): 3, ((0, 6), 4.0): 1, ((1, 5), 4.0): 1, ((1, 5), 1.0): 1}
    (one,) = mixtures.number_leaves(spark.createDataFrame([([7], 2.0)], "leaves array<int>, label double"))
    assert mixtures.sample_pools(one, one).first().copies == 2


def test_component_tuning_improves_with_more_components(spark):
    pools, labels = pool_rows(spark)
    pools = pools.filter("pool = 'two'").select(F.lit(1).alias("pool"), "label", "copies")
    test = spark.createDataFrame([(1, v) for p, v in labels if p == "two"], "pool int, label double")
    got = {r.num_component: r.rmsre for r in mixtures.tune_components(test, pools, counts=(1, 2), iterations=10).collect()}
    assert got[2] < got[1]


def grown_tree(xs, ys):
    """Fully grown regression tree on one feature, by exhaustive variance splits."""
    values = sorted(set(xs))
    mean = sum(ys) / len(ys)
    if len(values) == 1 or max(ys) == min(ys):
        return lambda q: mean
    def cost(cut):
        total = 0.0
        for side in ([y for x, y in zip(xs, ys) if x <= cut], [y for x, y in zip(xs, ys) if x > cut]):
            m = sum(side) / len(side)
            total += sum((y - m) ** 2 for y in side)
        return total
    cut = min(((a + b) / 2 for a, b in zip(values, values[1:])), key=cost)
    left = grown_tree(*zip(*[(x, y) for x, y in zip(xs, ys) if x <= cut]))
    right = grown_tree(*zip(*[(x, y) for x, y in zip(xs, ys) if x > cut]))
    return lambda q: left(q) if q <= cut else right(q)


def test_two_stage_equals_grown_trees(spark, limit):
    r = random.Random(8)
    train = [([r.randrange(3), r.randrange(2)], float(r.randrange(9)), float(r.randrange(30))) for _ in range(90)]
    test = [(i, [r.randrange(3), r.randrange(2)], float(r.randrange(-2, 22)) / 2) for i in range(40)]
    out = mixtures.two_stage_predict(
        spark.createDataFrame(train, "leaves array<int>, e double, label double"),
        spark.createDataFrame(test, "id int, leaves array<int>, e double"), ["id"], "e",
    )
    got = {row.id: row.prediction for row in out.collect()}
    for i, leaves, e in test:
        expected = []
        for tree, leaf in enumerate(leaves):
            xs, ys = zip(*[(x, y) for ls, x, y in train if ls[tree] == leaf])
            expected.append(grown_tree(xs, ys)(e))
        assert got[i] == pytest.approx(sum(expected) / len(expected))


def test_scaled_error_inverts_first(spark):
    rows = [(10.0, 12.0), (20.0, 15.0), (40.0, 44.0)]
    df = spark.createDataFrame(rows, "y double, p double")
    scaler = prep.StandardScaler.fit(df, ["y"])
    scaled = df.select(*[scaler.forward(F.col(c), "y").alias(c) for c in ("y", "p")])
    y, p = F.col("y"), F.col("p")
    got = scaled.agg(errors.rmsre_scaled(y, p, scaler, "y")).first()[0]
    assert got == pytest.approx(df.agg(errors.rmsre(y, p)).first()[0])
    far = scaled.agg(errors.rmsre_scaled(y, p + 1e6, scaler, "y")).first()[0]
    assert far == math.inf


def test_least_squares_per_key(spark):
    draw = random.Random(7)
    rows = []
    for key, size in ((0, 400), (1, 9), (None, 60)):
        for _ in range(size):
            a, b = draw.uniform(0, 9), draw.uniform(1e6, 1e6 + 5)
            rows.append((key, a, b, draw.gauss(0, 1), 3.0, 2 * a - 1, a + 0.5 * b + draw.gauss(0, 0.1)))
    rows += [(2, 1.0, 2.0, 3.0, 3.0, 1.0, 8.0)]  # a single row: the label is the answer
    rows += [(0, None, 1.0, 1.0, 3.0, 1.0, 9.0), (0, math.nan, 1.0, 1.0, 3.0, 1.0, 9.0), (3, 1.0, 1.0, 1.0, 3.0, 1.0, None)]
    names = ["a", "b", "c", "flat", "twice"]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, flat double, twice double, y double")
    fitted = {r.k: r for r in models.least_squares(df, ["k"], names, "y").collect()}
    assert {k: r.n for k, r in fitted.items()} == {0: 400, 1: 9, None: 60, 2: 1}
    for key in (0, 1, None):
        mine = [r for r in rows if r[0] == key and r[1] is not None and not math.isnan(r[1])]
        x, y = np.array([r[1:4] for r in mine]), np.array([r[6] for r in mine])
        w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
        assert fitted[key].weights[:3] == pytest.approx(list(w), abs=1e-6)
        assert fitted[key].weights[3:] == [0.0, 0.0]
        assert fitted[key].intercept == pytest.approx(y.mean() - w @ x.mean(0), rel=1e-6)
    assert fitted[2].weights == [0.0] * 5 and fitted[2].intercept == 8.0
    out = models.predict_linear(df, df, ["k"], names, "y").collect()
    assert len(out) == len(rows)
    assert {r.prediction is None for r in out if r.k == 3} == {True}
    assert {r.prediction is None for r in out if r.a is None} == {True}
    whole = models.predict_linear(df.filter("k = 1"), df.filter("k = 1"), [], names, "y").collect()
    again = {(r.a, r.prediction) for r in out if r.k == 1}
    assert sorted(r.prediction for r in whole) == pytest.approx(sorted(p for _a, p in again))
    assert models.least_squares(df.limit(0), [], names, "y").count() == 0


def test_least_squares_equals_the_line_of_one_feature(spark):
    rows = [(float(i % 7), float(i * i % 11)) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y double")
    many = models.predict_linear(df, df, [], ["x"], "y").orderBy("x", "y").collect()
    line = models.predict_line(df, df, "x", "y").orderBy("x", "y").collect()
    assert [r.prediction for r in many] == pytest.approx([r.prediction for r in line])


def test_pools_of_shared_parts_equal_written_out_ones(spark, monkeypatch):
    """Pools given as links to parts fit like their labels written out, in chunks and blocks of any size."""
    labels = spark.createDataFrame(
        [(i % 4, float((i * 37) % 101) + 200.0 * (i % 2), 1 + i % 3) for i in range(400)] + [(0, None, 2)],
        "part int, label double, copies int")
    links = spark.createDataFrame(
        [(p, q, 1 + (p * q) % 3) for p in range(5) for q in range(4) if (p + q) % 4], "pool int, part int, weight int")
    whole = labels.join(links, "part").selectExpr("pool", "label", "copies * weight AS copies")
    expected = {r.pool: r for r in mixtures.fit_mixtures(whole, ["pool"], 2).collect()}
    monkeypatch.setattr(mixtures, "CHUNK", 7)
    monkeypatch.setattr(mixtures, "BLOCK", 2)
    got = mixtures.fit_pools(labels, links, ["pool"], 2).collect()
    assert len(got) == len(expected) == 5
    for r in got:
        other = expected[r.pool]
        assert (r.steps, r.converged) == (other.steps, other.converged)
        for a, b in zip(r.mixture, other.mixture, strict=True):
            assert tuple(a) == pytest.approx(tuple(b), rel=1e-9)


def test_fit_deals_crowded_partitions_anew(spark, monkeypatch):
    """No task of a fit holds more rows than the limit, and small inputs stay as they are."""
    class Seen:
        def fit(self, data):
            return data.rdd.glom().map(len).collect()

    rows = spark.range(0, 100, 1, 2).selectExpr("id AS features", "id AS label")
    assert models.fit(Seen(), rows) == [50, 50]
    monkeypatch.setattr(models, "FIT_ROWS", 10)
    sizes = models.fit(Seen(), rows)
    assert sum(sizes) == 100 and max(sizes) <= 10


def stepped(x, n, k, iterations):
    """Expectation maximisation over all labels in arrays: steps, and components by rising mean."""
    mu = (x * n).sum() / n.sum()
    sd = math.sqrt((n * (x - mu) ** 2).sum() / n.sum())
    z, w, m, v = (x - mu) / sd, np.full(k, 1 / k), (2.0 * np.arange(k) - k + 1) / k, np.ones(k)
    fit = None
    for step in range(1, iterations + 1):
        log = np.log(w) - 0.5 * (np.log(2 * math.pi * v) + (z[:, None] - m) ** 2 / v)
        top = log.max(1, keepdims=True)
        share = np.exp(log - top)
        seen = ((top + np.log(share.sum(1, keepdims=True)))[:, 0] * n).sum() / n.sum()
        share *= n[:, None] / share.sum(1, keepdims=True)
        w = share.sum(0)
        old, m = m, (share * z[:, None]).sum(0) / w
        v = (share * (z[:, None] - old) ** 2).sum(0) / w - (m - old) ** 2 + mixtures.VARIANCE_FLOOR / sd ** 2
        w /= n.sum()
        if fit is not None and abs(seen - fit) < mixtures.TOLERANCE:
            break
        fit = seen
    return step, sorted(zip(m * sd + mu, v * sd * sd, w))


def spied(monkeypatch):
    written, real = [], mixtures.materialize
    monkeypatch.setattr(mixtures, "materialize", lambda df, name, *a: (written.append(name), real(df, name, *a))[1])
    return written


def test_pools_of_many_labels_settle_in_one_pass(spark, monkeypatch):
    """Sums at the points of cells give the mixture of all labels, without a job per step."""
    draw = np.random.default_rng(5)
    values = np.unique(np.round(np.r_[draw.uniform(0, 4000, 30_000), draw.lognormal(7, 0.6, 10_000), [1e6, -7e4]], 2))
    # few and many labels of a cell in one part, and a part that two pools share
    labels = spark.createDataFrame([(i % 3 if i % 50 else 3, float(x), 1 + i % 4) for i, x in enumerate(values)],
                                   "part int, label double, copies int")
    pairs = {"a": {0: 1, 1: 2, 3: 5}, "b": {1: 1, 2: 3}}
    links = spark.createDataFrame([(p, q, w) for p, of in pairs.items() for q, w in of.items()],
                                  "pool string, part int, weight int")
    tried = links.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    monkeypatch.setattr(mixtures, "CELLS", 512)
    written = spied(monkeypatch)
    fitted = mixtures.fit_pools(labels, tried, ["pool", "k"], "k", 25, 4).collect()
    assert "mixture-pools" not in written and len(fitted) == 6
    i = np.arange(len(values))
    part, copies = np.where(i % 50 > 0, i % 3, 3), 1 + i % 4
    for r in fitted:
        n = copies * np.array([pairs[r.pool].get(q, 0) for q in range(4)])[part]
        steps, expected = stepped(values, n.astype(float), r.k, 25)
        assert (r.steps, len(r.mixture)) == (steps, r.k)
        for a, b in zip(r.mixture, expected, strict=True):
            assert tuple(a) == pytest.approx(b, rel=1e-8)


def test_components_too_narrow_for_cells_take_all_labels(spark, monkeypatch):
    draw = np.random.default_rng(6)
    values = np.unique(np.r_[draw.uniform(0, 1000, 30_000), draw.normal(700, 0.01, 30_000)])
    labels = spark.createDataFrame([(0, float(x), 1) for x in values], "part int, label double, copies int")
    links = spark.createDataFrame([(0, 0, 1)], "pool int, part int, weight int")
    monkeypatch.setattr(mixtures, "CELLS", 512)
    written = spied(monkeypatch)
    (r,) = mixtures.fit_pools(labels, links, ["pool"], 2, 8).collect()
    assert "pool-steps" in written and "mixture-pools" in written
    steps, expected = stepped(values, np.ones(len(values)), 2, 8)
    assert r.steps == steps == 8 and not r.converged
    for a, b in zip(r.mixture, expected, strict=True):
        assert tuple(a) == pytest.approx(b, rel=1e-8)


def test_pools_without_known_labels(spark):
    labels = spark.createDataFrame([(0, None, 3), (1, 4.0, 2), (1, None, 1)], "part int, label double, copies int")
    links = spark.createDataFrame([(p, p, 1) for p in range(2)], "pool int, part int, weight int")
    got = {r.pool: r for r in mixtures.fit_pools(labels, links, ["pool"], 2, 5).collect()}
    assert (got[0].mixture, got[0].steps, got[0].converged) == ([], 5, False)
    assert sum(c.weight for c in got[1].mixture) == pytest.approx(2 / 3)


def test_counted_rows_stand_for_rows(spark):
    rows = [([i % 3, i % 2], float(i % 4), 1 + i % 2) for i in range(24)]
    counted = spark.createDataFrame(rows, "leaves array<int>, label double, copies int")
    plain = spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "leaves array<int>, label double")
    (plain,), (counted,) = mixtures.number_leaves(plain), mixtures.number_leaves(counted)
    expected = [sorted(map(tuple, df.collect())) for df in mixtures.pool_parts(plain, plain)]
    vectors = counted.select("pool", "leaves").distinct()
    got = mixtures.pool_parts(vectors, counted.drop("leaves"), copies="copies", vectors=vectors)
    assert [sorted(map(tuple, df.collect())) for df in got] == expected
    pairs = [(4.0, 5.0, 3), (2.0, 1.0, 1), (None, 1.0, 2), (8.0, None, 4)]
    y, p, n = (F.col(c) for c in "ypn")
    whole = spark.createDataFrame([r[:2] for r in pairs for _ in range(r[2])], "y double, p double")
    held = spark.createDataFrame(pairs, "y double, p double, n int")
    assert held.agg(errors.rmsre(y, p, n)).first()[0] == pytest.approx(whole.agg(errors.rmsre(y, p)).first()[0])
    assert held.limit(0).agg(errors.rmsre(y, p, n)).first()[0] is None


def test_grow_makes_its_cells_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    cells = spark.createDataFrame([(i % 2, float(i), 1.0, float(i * i)) for i in range(20)],
                                  "k int, x double, w double, s double")
    trees.grow(cells.mapInArrow(counted, cells.schema), ["k"], ["x"], 2)[1].count()
    assert made.value == 20


def test_digests_of_batches():
    draw = random.Random(4)
    texts = ["", "|", "|7", "é" * 20, "x" * 49, "y" * 50, "z" * 51, "w" * 300] + [
        "|" + str(draw.randrange(10 ** draw.randrange(1, 19))) for _ in range(300)]
    heads = [b"42.0", b"42.9", b"42.10", b"", b"long head "]
    whole = pa.array(texts)
    found = digests.digests(whole, heads)
    assert [[d.tobytes() for d in row] for row in found] == [
        [hashlib.md5(h + t.encode()).digest() for h in heads] for t in texts]
    assert (digests.digests(whole.slice(3, 40), heads) == found[3:43]).all()
    assert digests.digests(whole.slice(0, 0), heads).shape == (0, 5, 16)
