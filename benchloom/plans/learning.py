"""Queries: dataset preparation, models, mixtures."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import mixtures, models, neighbours, prep, trees
from ..session import materialize
from .registry import query, r6

# Line items are runs: quantity, discount and tax are knobs, the price is the measurement.
UNIQUE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY = ", ".join(UNIQUE)
X, Y = "l_quantity", "l_extendedprice"
FEATURES = [X, "l_discount", "l_tax"]


def _md5(seed: str, *columns: str) -> str:
    return "md5(concat_ws('|', '" + seed + "', " + ", ".join(f"{c}::VARCHAR" for c in columns) + "))"


def _runs(t):
    return t.lineitem.select(*UNIQUE, *FEATURES, Y)


def _cents(t):
    """Runs with prices in cents: whole numbers add up exactly, whatever the order of the rows."""
    return _runs(t).withColumn(Y, F.round(F.col(Y) * 100))


def _halves(t):
    """Reproducible train and test halves."""
    folded = models.with_folds(_runs(t), UNIQUE, 2, "1")
    return folded.filter("fold = 0"), folded.filter("fold = 1")


# Spark's fold number: first 32 bits of the digest.
HALVES = f"""folded AS (
  SELECT *, ('0x' || left({_md5('1', *UNIQUE)}, 8))::BIGINT % 2 AS fold FROM lineitem),
train AS (SELECT * FROM folded WHERE fold = 0),
test AS (SELECT * FROM folded WHERE fold = 1)"""


# ---- preparation ----------------------------------------------------------------------


@query(
    "per_feature_split",
    f"""
    WITH r AS (SELECT o_custkey, o_orderkey,
                      row_number() OVER (PARTITION BY o_custkey ORDER BY {_md5('2', 'o_orderkey')}, o_orderkey) AS r,
                      count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, o_orderkey, 'test' AS part FROM r WHERE n * 0.25 < 1 OR r <= ceil(n * 0.25)
    UNION ALL
    SELECT o_custkey, o_orderkey, 'train' FROM r WHERE n * 0.25 < 1 OR r > ceil(n * 0.25)
    """,
)
def per_feature_split(t):
    rows = t.orders.select("o_custkey", "o_orderkey")
    return prep.per_feature_split(rows, "o_custkey", ["o_orderkey"], 0.25, "2")


@query(
    "outlier_filter",
    f"""
    SELECT {KEY}, {Y} FROM lineitem WHERE {Y} < (SELECT quantile_cont({Y}, 0.99) FROM lineitem)
    """,
)
def outlier_filter(t):
    return prep.outlier_filter(t.lineitem.select(*UNIQUE, Y), Y)


@query(
    "label_encode",
    """
    SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
           dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority,
           dense_rank() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS o_custkey
    FROM orders
    """,
)
def label_encode(t):
    frame = t.orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey")
    )
    # The status encoder is fitted first and handed in, the others are made here.
    status = prep.label_codes(frame, "o_orderstatus")
    encoded, _ = prep.label_encode(frame, encoders={"o_orderstatus": status})
    return encoded


_SCALED = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}"
    for c in [*FEATURES, Y]
)


@query("standard_scale", f"SELECT {KEY}, {_SCALED} FROM lineitem")
def standard_scale(t):
    rows = _runs(t)
    scaled = prep.StandardScaler.fit(rows, [*FEATURES, Y]).transform(rows)
    return scaled.withColumns({c: r6(c) for c in [*FEATURES, Y]})


@query(
    "inverse_scale",
    f"SELECT {KEY}, round({X}, 6) AS {X}, round({Y}, 6) AS {Y} FROM lineitem",
)
def inverse_scale(t):
    rows = t.lineitem.select(*UNIQUE, X, Y)
    scaler = prep.StandardScaler.fit(rows, [X, Y])
    restored = scaler.inverse_transform(scaler.transform(rows))
    return restored.withColumns({c: r6(c) for c in (X, Y)})


@query("variance_select", f"SELECT {X}, l_tax, {Y} FROM lineitem")
def variance_select(t):
    rows = t.lineitem.select(X, "l_tax", F.lit(4.0).alias("constant"), Y, (F.col("l_tax") * 0).alias("zero"))
    return rows.select(*prep.variance_select(rows, rows.columns))


@query(
    "dataset_xy",
    f"""
    SELECT {KEY}, {_SCALED.replace(f'AS {X}', 'AS f0').replace('AS l_discount', 'AS f1')
                  .replace('AS l_tax', 'AS f2').replace(f'AS {Y}', 'AS label')}
    FROM lineitem
    """,
)
def dataset_xy(t):
    frame = _runs(t).withColumn("jct", F.col(Y)).withColumn("flat", F.lit(1.0)).drop(Y)
    data, names, _ = prep.dataset_xy(
        frame, "jct", lambda cols: [c for c in cols if c != "jct"], UNIQUE,
        scaler=prep.StandardScaler, feature_select=True,
    )
    cells = vector_to_array("features")
    return data.select(*UNIQUE, *[r6(cells[i]).alias(f"f{i}") for i in range(len(names))],
                       r6("label").alias("label"))


# Trees of cells ``(keys, x, w, s)``, level by level: the best split of every node, ties to the
# smaller threshold.  Every level's rows stay, so that a tree can be read at any depth.
def _grown(keys: str, depth: int, min_leaf: str = "1", min_split: str = "2") -> str:
    group = f"PARTITION BY {keys}, node"
    return f"""grown AS (
  SELECT 0 AS depth, 1::BIGINT AS node, {keys}, x, w, s FROM cells
  UNION ALL
  SELECT depth + 1, 2 * node + (x > threshold)::INT, {keys}, x, w, s
  FROM grown JOIN (
    SELECT {keys}, node, (x + next) / 2 AS threshold FROM (
      SELECT *, sum(w) OVER ({group} ORDER BY x) AS wl, sum(s) OVER ({group} ORDER BY x) AS sl,
             sum(w) OVER ({group}) AS wt, sum(s) OVER ({group}) AS st, lead(x) OVER ({group} ORDER BY x) AS next
      FROM grown WHERE w > 0)
    WHERE next IS NOT NULL AND wl >= {min_leaf} AND wt - wl >= {min_leaf} AND wt >= {min_split}
      AND sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) - st * st / wt > 1e-12 * (st * st / wt)
    QUALIFY row_number() OVER ({group} ORDER BY sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) DESC, x) = 1)
  USING ({keys}, node) WHERE depth < {depth}),
nodes AS (SELECT depth, {keys}, node, sum(s) / sum(w) AS value FROM grown GROUP BY ALL HAVING sum(w) > 0)"""


# Poisson draws from the hex digits of digests, as bootstrap samples hold rows.
_DRAWN = " + ".join(f"(h >= '{mark}')::INT" for mark in trees.poisson_marks())


def _samples(rows: str, by: str, n_trees: int, seed: str, unique: str) -> str:
    return f"""(SELECT {by}, tree, sum(w)::DOUBLE AS w, sum(w * y) AS s FROM (
      SELECT {by}, y, (8 * b + i)::INT AS tree, {_DRAWN} AS w FROM (
        SELECT {by}, y, b, i, substr(d, 4 * i + 1, 4) AS h FROM (
          SELECT {by}, y, b, md5(concat_ws('|', '{seed}.' || b, {unique})) AS d
          FROM {rows}, range({-(-n_trees // 8)}) AS t(b)), range(8) AS r(i)))
    WHERE w > 0 AND tree < {n_trees} GROUP BY ALL)"""


@query(
    "rank_features_by_forest",
    f"""
    WITH RECURSIVE tall AS MATERIALIZED (
      SELECT {KEY}, round({Y} * 100) AS y, feature, x, split,
             ('0x' || left(md5(concat_ws('|', split, {KEY})), 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 AS test
      FROM (SELECT {KEY}, {Y}, unnest(['{FEATURES[0]}', '{FEATURES[1]}', '{FEATURES[2]}']) AS feature,
                   unnest([{", ".join(FEATURES)}]) AS x FROM lineitem), range(3) AS s(split)),
    sums AS (SELECT * FROM {_samples('(SELECT * FROM tall WHERE NOT test)', 'feature, split, x', 20, '42', KEY + ', split')}),
    cells AS MATERIALIZED (SELECT feature, split, tree, x, coalesce(w, 0) AS w, coalesce(s, 0) AS s FROM sums FULL JOIN (
      SELECT DISTINCT feature, split, x, tree FROM tall, range(20) AS t(tree) WHERE test) USING (feature, split, x, tree)),
    {_grown('feature, split, tree', 4)},
    ends AS (SELECT feature, split, tree, x, arg_max(node, depth) AS node FROM grown GROUP BY ALL),
    means AS (SELECT feature, split, x, avg(value) AS p
              FROM ends JOIN (SELECT DISTINCT feature, split, tree, node, value FROM nodes) USING (feature, split, tree, node)
              GROUP BY ALL)
    SELECT feature, round(avg(r2), 3) AS r2 FROM (
      SELECT feature, split, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2
      FROM tall JOIN means USING (feature, split, x) WHERE test GROUP BY ALL)
    GROUP BY feature
    """,
)
def rank_features_by_forest(t):
    return models.rank_features_by_forest(_cents(t), FEATURES, Y, UNIQUE)


# ---- models ---------------------------------------------------------------------------


@query(
    "model_linear",
    f"""
    WITH {HALVES}, fit AS (SELECT regr_slope({Y}, {X}) AS a, regr_intercept({Y}, {X}) AS b FROM train)
    SELECT {KEY}, round(a * {X} + b, 3) AS prediction FROM test, fit
    """,
)
def model_linear(t):
    train, test = _halves(t)
    out = models.predict_line(train, test, X, Y)
    return out.select(*UNIQUE, r6("prediction", 3).alias("prediction"))


# Normal equations of three features per key, centred; x0 to x2 are the features.
_GRAM = ", ".join(
    f"covar_pop(x{i}, {'y' if j == 3 else f'x{j}'}) AS a{i}{j}" for i in range(3) for j in range(i, 4)
)


@query(
    "model_linear_per_key",
    f"""
    WITH {HALVES},
    g AS (SELECT k, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, {_GRAM}
          FROM (SELECT l_suppkey AS k, {X} AS x0, l_discount AS x1, l_tax AS x2, {Y} AS y FROM train) GROUP BY k),
    g1 AS (SELECT *, a11 - a01 * a01 / a00 AS b11, a12 - a01 * a02 / a00 AS b12, a13 - a01 * a03 / a00 AS b13,
                  a22 - a02 * a02 / a00 AS b22, a23 - a02 * a03 / a00 AS b23 FROM g),
    g2 AS (SELECT *, (b23 - b12 * b13 / b11) / (b22 - b12 * b12 / b11) AS w2 FROM g1),
    g3 AS (SELECT *, (b13 - b12 * w2) / b11 AS w1 FROM g2),
    g4 AS (SELECT *, (a03 - a01 * w1 - a02 * w2) / a00 AS w0 FROM g3)
    SELECT {KEY}, round(my + w0 * ({X} - m0) + w1 * (l_discount - m1) + w2 * (l_tax - m2), 2) AS prediction
    FROM test LEFT JOIN g4 ON k = l_suppkey
    """,
)
def model_linear_per_key(t):
    train, test = _halves(t)
    out = models.predict_linear(train, test, ["l_suppkey"], FEATURES, Y)
    return out.select(*UNIQUE, r6("prediction", 2).alias("prediction"))


@query(
    "model_knn",
    f"""
    WITH {HALVES},
    numbered AS (SELECT {X} AS x, {Y} AS y, row_number() OVER (ORDER BY {X}, {KEY}) AS pos FROM train),
    -- every distinct test value against every train row
    placed AS (SELECT q, y, abs(x - q) AS d, row_number() OVER (
                 PARTITION BY q ORDER BY abs(x - q), x >= q, CASE WHEN x >= q THEN pos ELSE -pos END) AS place
               FROM (SELECT DISTINCT {X} + l_tax AS q FROM test), numbered),
    predicted AS (SELECT q, coalesce(avg(y) FILTER (d = 0), sum(y / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)) AS p,
                         avg(y) AS u FROM placed WHERE place <= 5 GROUP BY q)
    SELECT {KEY}, round(p, 4) AS by_distance, round(u, 4) AS uniform
    FROM test JOIN predicted ON q = {X} + l_tax
    """,
)
def model_knn(t):
    train, test = _halves(t)
    # Off-grid test values, so that neighbours lie on both sides.
    asked = test.select(*UNIQUE, (F.col(X) + F.col("l_tax")).alias(X))
    named = {"by_distance": "distance", "uniform": "uniform"}
    out = neighbours.knn_regress(train, asked, X, Y, UNIQUE, 5, named)
    return out.select(*UNIQUE, *[r6(n, 4).alias(n) for n in named])


@query(
    "model_knn_vectors",
    f"""
    WITH {HALVES},
    points AS (SELECT {X}::DOUBLE AS x, (l_discount * 100)::DOUBLE AS d, (l_tax * 100)::DOUBLE AS t, {Y} AS y, {KEY} FROM train),
    asked AS (SELECT DISTINCT ({X} + 0.5)::DOUBLE AS qx, round(l_discount * 100)::DOUBLE AS qd, round(l_tax * 100)::DOUBLE AS qt FROM test),
    placed AS (SELECT qx, qd, qt, y, s, row_number() OVER (PARTITION BY qx, qd, qt ORDER BY s, x, d, t, {KEY}) AS place
               FROM (SELECT *, (x - qx) ** 2 + (d - qd) ** 2 + (t - qt) ** 2 AS s
                     FROM asked, (SELECT * REPLACE (round(d) AS d, round(t) AS t) FROM points))),
    predicted AS (SELECT qx, qd, qt, avg(y) AS u, sum(y / sqrt(s)) / sum(1 / sqrt(s)) AS w
                  FROM placed WHERE place <= 5 GROUP BY ALL)
    SELECT {KEY}, round(w, 4) AS by_distance, round(u, 4) AS uniform
    FROM test JOIN predicted ON qx = ({X} + 0.5)::DOUBLE AND qd = round(l_discount * 100) AND qt = round(l_tax * 100)
    """,
)
def model_knn_vectors(t):
    train, test = (
        half.withColumns({c: F.round(F.col(c) * 100) for c in FEATURES[1:]}) for half in _halves(t)
    )
    # Off-grid test values: no distance is zero.
    asked = test.withColumn(X, F.col(X) + 0.5).select(*UNIQUE, *FEATURES)
    named = {"by_distance": "distance", "uniform": "uniform"}
    out = neighbours.knn_regress_vectors(train, asked, FEATURES, Y, UNIQUE, 5, named)
    return out.select(*UNIQUE, *[r6(n, 4).alias(n) for n in named])


@query("model_forest")
def model_forest(t):
    train, test = _halves(t)
    model = models.fit(models.forest(), models.assemble(train, FEATURES, Y))
    predicted = model.transform(models.assemble(test, FEATURES, Y))
    return predicted.select(*UNIQUE, F.col("label").alias("y"), "prediction")


@query("model_svr_linear")
def model_svr_linear(t):
    train, test = _halves(t)
    scaler = prep.StandardScaler.fit(train, [X, Y])
    weights = models.fit_svr_linear(scaler.transform(train), [X], Y)
    predicted = models.apply_linear(scaler.transform(test), weights)
    return predicted.select(*UNIQUE, scaler.backward(F.col("prediction"), Y).alias("prediction"))


_KINDS = "fold, bootstrap, min_leaf, min_split, tree"


@query(
    "grid_search",
    f"""
    WITH RECURSIVE folded AS MATERIALIZED (
      SELECT {KEY}, {X}::DOUBLE AS x, round({Y} * 100) AS y, (('0x' || left({_md5('0', *UNIQUE)}, 8))::BIGINT % 3)::INT AS fold
      FROM lineitem),
    outside AS (SELECT f.fold, x, y, {KEY} FROM folded JOIN range(3) AS f(fold) ON f.fold <> folded.fold),
    -- lines
    line AS (SELECT fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, sum(x * y) / sum(x * x) AS o
             FROM outside GROUP BY fold),
    line_errors AS (SELECT fold, unnest(['fit_intercept=true', 'fit_intercept=false']) AS params,
        unnest([sqrt(avg(((y - (a * x + b)) / y) ** 2)), sqrt(avg(((y - o * x) / y) ** 2))]) AS error
      FROM folded JOIN line USING (fold) GROUP BY fold),
    -- neighbours: every distinct value of a fold against the rows outside
    placed AS (SELECT fold, q, y, d, row_number() OVER (
        PARTITION BY fold, q ORDER BY d, above, CASE WHEN above THEN pos ELSE -pos END) AS place
      FROM (SELECT fold, q, y, pos, abs(x - q) AS d, x >= q AS above
            FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY x, {KEY}) AS pos FROM outside)
            JOIN (SELECT DISTINCT fold, x AS q FROM folded) USING (fold)) QUALIFY place <= 32),
    near AS (SELECT fold, q, k, avg(y) AS u, coalesce(avg(y) FILTER (d = 0),
        sum(y / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)) AS w
      FROM placed, (SELECT unnest([1, 2, 4, 8, 16, 32]) AS k) WHERE place <= k GROUP BY ALL),
    near_errors AS (SELECT folded.fold, unnest(['n_neighbors=' || k || ',weights=uniform', 'n_neighbors=' || k || ',weights=distance']) AS params,
        unnest([sqrt(avg(((y - u) / y) ** 2)), sqrt(avg(((y - w) / y) ** 2))]) AS error
      FROM folded JOIN near ON near.fold = folded.fold AND q = x GROUP BY folded.fold, k),
    -- forests
    sums AS MATERIALIZED (
      SELECT fold, x, true AS bootstrap, tree, w, s FROM {_samples('folded', 'fold, x', 100, '0', KEY)}
      UNION ALL SELECT fold, x, false, 0, count(*)::DOUBLE, sum(y) FROM folded GROUP BY fold, x),
    inner_sums AS (SELECT f.fold, x, bootstrap, tree, sum(w) AS w, sum(s) AS s
             FROM sums JOIN range(3) AS f(fold) ON f.fold <> sums.fold GROUP BY ALL),
    cells AS MATERIALIZED (SELECT fold, x, bootstrap, tree, min_leaf, min_split, coalesce(w, 0) AS w, coalesce(s, 0) AS s
      FROM inner_sums FULL JOIN (SELECT DISTINCT fold, x, bootstrap, tree FROM (SELECT DISTINCT fold, x FROM folded),
             (SELECT DISTINCT bootstrap, tree FROM sums)) USING (fold, x, bootstrap, tree),
        (SELECT unnest([1, 10]) AS min_leaf), (SELECT unnest([2, 10]) AS min_split)),
    {_grown(_KINDS, 62, 'min_leaf', 'min_split')},
    cut AS (SELECT {_KINDS}, x, most, arg_max(node, depth) AS node
            FROM grown, (SELECT unnest([1, 10, 62]) AS most) WHERE depth <= most GROUP BY ALL),
    means AS (SELECT fold, bootstrap, min_leaf, min_split, x, most, n, avg(value) AS p
              FROM cut JOIN (SELECT DISTINCT {_KINDS}, node, value FROM nodes) USING ({_KINDS}, node),
                   (SELECT unnest([1, 10, 100]) AS n) WHERE tree < n GROUP BY ALL),
    forest_errors AS (SELECT fold, 'bootstrap=' || bootstrap || ',featureSubsetStrategy=' || strategy || ',maxDepth=' || deep
          || ',minInstancesPerNode=' || min_leaf || ',minInstancesToSplit=' || min_split || ',numTrees=' || n AS params, error
      FROM (SELECT fold, bootstrap, min_leaf, min_split, most, n, sqrt(avg(((y - p) / y) ** 2)) AS error
            FROM folded JOIN means USING (fold, x) GROUP BY ALL),
        (SELECT unnest([1, 10, 62, 62]) AS most_of, unnest(['1', '10', '100', 'none']) AS deep),
        (SELECT unnest(['all', 'sqrt']) AS strategy) WHERE most_of = most),
    -- support vectors: averaged sub-gradient steps on scaled rows
    scales AS MATERIALIZED (SELECT fold, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy
               FROM outside GROUP BY fold),
    scaled AS MATERIALIZED (SELECT fold, (x - mx) / sx AS u, (y - my) / sy AS v, count(*) AS m
               FROM outside JOIN scales USING (fold) GROUP BY ALL),
    steps AS (
      SELECT 0 AS step, fold, c, e, 0::DOUBLE AS w, 0::DOUBLE AS b, 0::DOUBLE AS mw, 0::DOUBLE AS mb
      FROM scales, (SELECT unnest([0.01, 0.05, 0.1, 0.5, 1.0, 2.0])::DOUBLE AS c),
        (SELECT unnest([0.01, 0.05, 0.1, 0.5, 1.0, 2.0])::DOUBLE AS e)
      UNION ALL
      SELECT step, fold, c, e, w, b, CASE WHEN step > 30 THEN mw + (w - mw) / (step - 30) ELSE mw END,
             CASE WHEN step > 30 THEN mb + (b - mb) / (step - 30) ELSE mb END
      FROM (SELECT step + 1 AS step, fold, c, e, mw, mb,
                   w - 0.5 / sqrt(step + 1) * (w / (c * n) - coalesce(pw, 0) / n) AS w,
                   b + 0.5 / sqrt(step + 1) * coalesce(pb, 0) / n AS b
            FROM steps JOIN scales USING (fold) LEFT JOIN (
              SELECT fold, c, e, sum(u * m * sign(v - (b + u * w))) AS pw, sum(m * sign(v - (b + u * w))) AS pb
              FROM steps JOIN scaled USING (fold) WHERE abs(v - (b + u * w)) > e GROUP BY ALL) USING (fold, c, e)
            WHERE step < 60)),
    svm_errors AS (SELECT fold, 'C=' || c || ',epsilon=' || e AS params,
        sqrt(avg(((y - (my + sy * (mb + mw * (x - mx) / sx))) / y) ** 2)) AS error
      FROM folded JOIN scales USING (fold) JOIN (SELECT * FROM steps WHERE step = 60) USING (fold) GROUP BY fold, c, e),
    scored AS (SELECT family, params, avg(-error) AS mean, stddev_pop(error) AS dev FROM (
        SELECT 'linear_regression' AS family, * FROM line_errors UNION ALL SELECT 'nearest_neighbors', * FROM near_errors
        UNION ALL SELECT 'random_forest', * FROM forest_errors UNION ALL SELECT 'svm', * FROM svm_errors) GROUP BY ALL)
    SELECT family, params, round(mean, 6) AS mean_test_score, round(dev, 6) AS std_test_score FROM scored
    QUALIFY row_number() OVER (PARTITION BY family ORDER BY round(mean, 9) DESC, params) = 1
    """,
)
def grid_search(t):
    best = models.grid_search(
        _cents(t), X, Y, UNIQUE, forest_grid=models.settings(models.FOREST_GRID),
        svr_grid=models.settings(models.SVR_GRID),
    )
    return best.withColumns({c: r6(c) for c in ("mean_test_score", "std_test_score")})


@query(
    "predict_best_possible",
    f"""
    WITH best AS (SELECT {X}, l_tax, sum(1 / {Y}) / sum(1 / ({Y} * {Y})) AS p FROM lineitem GROUP BY {X}, l_tax)
    SELECT {KEY}, round(p, 4) AS prediction FROM lineitem JOIN best USING ({X}, l_tax)
    """,
)
def predict_best_possible(t):
    out = models.predict_best_possible(_runs(t), [X, "l_tax"], Y)
    return out.select(*UNIQUE, r6("prediction", 4).alias("prediction"))


@query("predict_naive", f"SELECT {KEY}, round((SELECT avg({Y}) FROM lineitem), 4) AS prediction FROM lineitem")
def predict_naive(t):
    out = models.predict_naive(_runs(t), Y)
    return out.select(*UNIQUE, r6("prediction", 4).alias("prediction"))


@query(
    "baseline_mean",
    f"""
    WITH {HALVES}, m AS (SELECT avg({Y}) AS m FROM train)
    SELECT round(sqrt(avg(({Y} - m) ** 2)) / avg({Y}), 6) AS rrmse FROM test, m
    """,
)
def baseline_mean(t):
    train, test = _halves(t)
    return models.baseline_mean(train, test, Y).select(r6("rrmse").alias("rrmse"))


@query(
    "prediction_sweep",
    f"""
    WITH tall AS (
      SELECT {KEY}, l_returnflag AS trial, 'quantity' AS feature, 'price' AS target, l_quantity AS x, {Y} AS y FROM lineitem
      UNION ALL SELECT {KEY}, l_returnflag, 'tax', 'price', l_tax, {Y} FROM lineitem
      UNION ALL SELECT {KEY}, l_returnflag, 'discount', 'quantity', l_discount, l_quantity FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY trial, feature, target, x ORDER BY {_md5('4', *UNIQUE)}, {KEY}) AS r,
                 count(*) OVER (PARTITION BY trial, feature, target, x) AS n FROM tall),
    train AS (SELECT * FROM r WHERE n * 0.5 < 1 OR r > ceil(n * 0.5)),
    test AS (SELECT * FROM r WHERE n * 0.5 < 1 OR r <= ceil(n * 0.5)),
    fit AS (SELECT trial, feature, target, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, avg(y) AS m
            FROM train GROUP BY ALL),
    best AS (SELECT trial, feature, target, x, sum(1 / y) / sum(1 / (y * y)) AS p FROM train GROUP BY ALL)
    SELECT trial, feature, target, round(sqrt(avg(((y - (a * x + b)) / y) ** 2)), 6) AS linear,
           round(sqrt(avg(((y - coalesce(p, m)) / y) ** 2)), 6) AS best_possible,
           round(sqrt(avg(((y - m) / y) ** 2)), 6) AS naive
    FROM test LEFT JOIN best USING (trial, feature, target, x) JOIN fit USING (trial, feature, target) GROUP BY ALL
    """,
)
def prediction_sweep(t):
    spec = lambda feature, target, x, y: F.struct(
        F.lit(feature).alias("feature"), F.lit(target).alias("target"),
        F.col(x).alias("x"), F.col(y).alias("y"),
    )
    specs = F.array(
        spec("quantity", "price", X, Y), spec("tax", "price", "l_tax", Y),
        spec("discount", "quantity", "l_discount", X),
    )
    tall = t.lineitem.select(*UNIQUE, F.col("l_returnflag").alias("trial"), F.inline(specs))
    out = models.prediction_sweep(tall, ["trial", "feature", "target"], UNIQUE, 0.5, "4")
    return out.select("trial", "feature", "target",
                      *[r6(c).alias(c) for c in ("linear", "best_possible", "naive")])


# ---- forests with leaves --------------------------------------------------------------


def _leaves(t, n_trees=100, depth=2):
    """Quantities of the train and the test rows with the leaves of a forest fitted on them, and
    the rows of both (prices in cents), counted by quantity and price and as they are."""
    rows = models.with_folds(_cents(t), UNIQUE, 2, "1").withColumnRenamed(Y, "label")
    counts = materialize(rows.groupBy("fold", X, "label").agg(F.count(F.lit(1)).alias("copies")), "counts")
    halves, counted = ([df.filter(f"fold = {i}") for i in (0, 1)] for df in (rows, counts))
    met = [c.select(X).distinct() for c in counted]
    vectors = mixtures.number_leaves(
        *mixtures.forest_leaves(*halves, [X], "label", UNIQUE, n_trees, depth, frames=met))
    return vectors, counted, halves


def _pools(t):
    """Label pools (parts and links), the test rows counted and as they are, with their pools."""
    (train_at, test_at), (train, test), (_, rows) = _leaves(t)
    numbers = test_at.select(X, "pool")
    parts = mixtures.pool_parts(test_at, train.join(train_at.select(X, "pool"), X), copies="copies", vectors=train_at)
    return (*parts, test.join(numbers, X), rows.join(numbers, X))


def _pool_labels(n_trees: int = 100, asked: str = "fold = 1", depth: int = 2) -> str:
    """The labels ``(pool, label, copies)`` of each leaf vector, and ``test`` with its ``pool``."""
    return f"""folded AS MATERIALIZED (
      SELECT {KEY}, {X}::DOUBLE AS x, round({Y} * 100) AS y, ('0x' || left({_md5('1', *UNIQUE)}, 8))::BIGINT % 2 AS fold
      FROM lineitem),
    cells AS MATERIALIZED (SELECT x, tree, coalesce(w, 0) AS w, coalesce(s, 0) AS s
      FROM {_samples('(SELECT * FROM folded WHERE fold = 0)', 'x', n_trees, '42', KEY)}
      FULL JOIN (SELECT DISTINCT x, tree::INT AS tree FROM folded, range({n_trees}) AS t(tree)) USING (x, tree)),
    {_grown('tree', depth)},
    ends AS MATERIALIZED (SELECT x, tree, arg_max(node, depth) AS node FROM grown GROUP BY ALL),
    vectors AS MATERIALIZED (SELECT x, list(node ORDER BY tree) AS leaves FROM ends GROUP BY x),
    pool_of AS MATERIALIZED (SELECT x, dense_rank() OVER (ORDER BY leaves) AS pool FROM vectors),
    reached AS (SELECT DISTINCT pool, tree, node FROM ends JOIN pool_of USING (x)),
    shared AS (SELECT a.pool, b.pool AS vector, count(*) AS trees FROM reached a JOIN reached b USING (tree, node)
               WHERE a.pool IN (SELECT pool FROM folded JOIN pool_of USING (x) WHERE {asked})
               GROUP BY a.pool, b.pool),
    counted AS (SELECT shared.pool, y AS label, sum(trees) AS copies
                FROM folded JOIN pool_of USING (x) JOIN shared ON vector = pool_of.pool WHERE fold = 0 GROUP BY ALL),
    pools AS MATERIALIZED (SELECT pool, label,
        (CASE WHEN sum(copies) OVER (PARTITION BY pool) < 2 THEN 2 ELSE copies END)::DOUBLE AS copies FROM counted),
    test AS (SELECT {KEY}, x, y, pool FROM folded JOIN pool_of USING (x) WHERE fold = 1)"""


def _em(keys: str, k_max: int, wanted: str) -> str:
    """Expectation maximisation; a pool goes on while its last gain is not below the tolerance."""
    js = range(k_max)
    each = lambda text, sep=", ": sep.join(text.format(j=j) for j in js)
    return f"""moments AS (SELECT {keys}, sum(copies) AS n, sum(label * copies) / sum(copies) AS mu,
        least(any_value({wanted}), sum(copies))::INT AS k FROM asked GROUP BY {keys}),
    scale AS MATERIALIZED (SELECT {keys}, n, mu, k, CASE WHEN dev > 0 THEN dev ELSE 1 END AS sd FROM (
      SELECT {keys}, n, mu, k, sqrt(sum((label - mu) * (label - mu) * copies) / sum(copies)) AS dev
      FROM asked JOIN moments USING ({keys}) GROUP BY ALL)),
    standard AS MATERIALIZED (SELECT {keys}, (label - mu) / sd AS x, copies FROM asked JOIN scale USING ({keys})),
    em AS (
      SELECT 0 AS step, {keys}, n, {mixtures.VARIANCE_FLOOR}::DOUBLE / (sd * sd) AS least,
             {each('CASE WHEN {j} < k THEN 1::DOUBLE / k ELSE 0 END AS w{j}, (2::DOUBLE * {j} - k + 1) / k AS m{j}, 1::DOUBLE AS v{j}')},
             NULL::DOUBLE AS fit, NULL::DOUBLE AS gain FROM scale
      UNION ALL
      SELECT step + 1, {keys}, n, least,
             {each('s{j} / n, coalesce(sx{j} / nullif(s{j}, 0), 0), greatest(coalesce(sxx{j} / nullif(s{j}, 0) - (sx{j} / nullif(s{j}, 0) - m{j}) ** 2, 1), 0) + least')},
             seen / n, abs(seen / n - fit)
      FROM (SELECT step, {keys}, n, least, fit, {each('m{j}')}, sum((top + ln(total)) * copies) AS seen,
                   {each('sum(e{j} / total * copies) AS s{j}, sum(e{j} / total * copies * x) AS sx{j}, sum(e{j} / total * copies * (x - m{j}) ** 2) AS sxx{j}')}
            FROM (SELECT *, {each('e{j}', ' + ')} AS total FROM (
                SELECT *, {each('exp(l{j} - top) AS e{j}')} FROM (
                  SELECT *, greatest({each('l{j}')}) AS top FROM (
                    SELECT em.*, x, copies,
                           {each('CASE WHEN w{j} > 0 THEN ln(w{j}) - 0.5::DOUBLE * (ln(2 * pi() * v{j}) + (x - m{j}) ** 2 / v{j}) ELSE -1e300::DOUBLE END AS l{j}')}
                    FROM em JOIN standard USING ({keys})
                    WHERE step < {mixtures.MOST_STEPS} AND (gain IS NULL OR gain >= {mixtures.TOLERANCE})))))
            GROUP BY step, {keys}, n, least, fit, {each('m{j}')})),
    fitted AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY step DESC) = 1),
    mixture AS MATERIALIZED (
      SELECT {keys}, step AS steps, coalesce(gain < {mixtures.TOLERANCE}, false) AS converged, c.mean, c.var, c.weight,
             row_number() OVER (PARTITION BY {keys} ORDER BY c.mean, c.var, c.weight) - 1 AS component
      FROM (SELECT {keys}, step, gain, unnest([{each("{{'mean': m{j} * sd + mu, 'var': v{j} * sd * sd, 'weight': w{j}}}")}]) AS c
            FROM fitted JOIN scale USING ({keys})) WHERE c.weight > 0)"""


# Components of a mixture as rows, rounded so that the order of sums does not show.
_COMPONENTS = """SELECT pool, steps, converged, round(mean, 2) AS mean, round(sqrt(var), 2) AS deviation,
           round(weight, 6) AS weight FROM mixture"""


def _components(fitted):
    parts = fitted.select("pool", "steps", "converged", F.inline("mixture"))
    return parts.select("pool", "steps", "converged", r6("mean", 2).alias("mean"),
                        r6(F.sqrt("var"), 2).alias("deviation"), r6("weight").alias("weight"))


# Log densities of the test labels under the components of their pool.
_DENSITY = f"""logs AS (SELECT {KEY}, x, component, ln(weight) - 0.5::DOUBLE * (ln(2 * pi() * var) + (y - mean) ** 2 / var) AS l
      FROM test JOIN mixture USING (pool)),
    tops AS (SELECT *, max(l) OVER (PARTITION BY {KEY}) AS top FROM logs),
    density AS (SELECT *, top + ln(sum(exp(l - top)) OVER (PARTITION BY {KEY})) AS total FROM tops)"""


# Leaf arrays that SQL can write too: tree i parts the quantities at multiples of 13, shifted
# by 7 i.  A fitted forest gives such arrays as well (``mixtures.with_leaves``).
_TREES = 5
_GRID = f"""{HALVES},
grid AS (SELECT {KEY}, l_tax, {Y} AS label, fold,
                [floor(({X} + 7 * i) / 13)::INT FOR i IN range(0, {_TREES})] AS leaves FROM folded),
train_cells AS (SELECT *, unnest(leaves) AS leaf, unnest(range(0, {_TREES})) AS tree FROM grid WHERE fold = 0),
test_cells AS (SELECT *, unnest(leaves) AS leaf, unnest(range(0, {_TREES})) AS tree FROM grid WHERE fold = 1)"""


def _grid_leaves(t):
    leaves = F.array(*[F.floor((F.col(X) + 7 * i) / 13).cast("int") for i in range(_TREES)])
    return [
        part.select(*UNIQUE, X, "l_tax", F.col(Y).alias("label"), leaves.alias("leaves"))
        for part in _halves(t)
    ]


@query(
    "leaf_samples",
    f"WITH {_GRID} SELECT tree::INT AS tree, leaf, label, count(*) AS copies FROM train_cells GROUP BY ALL",
)
def leaf_samples(t):
    train, _ = _grid_leaves(t)
    return mixtures.leaf_samples(train)


@query(
    "leaf_sample_join",
    f"""
    WITH {_GRID},
    stats AS (SELECT tree, leaf, count(*) AS n, avg(label) AS mean FROM train_cells GROUP BY tree, leaf)
    SELECT {KEY}, tree::INT AS tree, leaf, n, round(mean, 3) AS mean FROM test_cells JOIN stats USING (tree, leaf)
    """,
)
def leaf_sample_join(t):
    """Label statistics of the leaf each test row reaches in each tree."""
    train, test = _grid_leaves(t)
    stats = mixtures.leaf_samples(train).groupBy("tree", "leaf").agg(
        F.sum("copies").alias("n"),
        r6(F.sum(F.col("label") * F.col("copies")) / F.sum("copies"), 3).alias("mean"),
    )
    reached = test.select(*UNIQUE, F.posexplode("leaves").alias("tree", "leaf"))
    return reached.join(stats, ["tree", "leaf"])


@query(
    "forest_sample_pool",
    f"""
    WITH {_GRID},
    numbers AS (SELECT leaves, row_number() OVER (ORDER BY leaves) AS pool
                FROM (SELECT DISTINCT leaves FROM grid)),
    asked AS (SELECT DISTINCT leaves, tree, leaf FROM test_cells),
    held AS (SELECT DISTINCT leaves, tree, leaf FROM train_cells),
    shared AS (SELECT a.leaves AS pool_leaves, h.leaves, count(*) AS trees
               FROM asked a JOIN held h USING (tree, leaf) GROUP BY ALL),
    sums AS (SELECT pool_leaves, label, sum(trees) AS copies
             FROM shared JOIN (SELECT leaves, label FROM grid WHERE fold = 0) USING (leaves) GROUP BY ALL)
    SELECT pool, label,
           (CASE WHEN sum(copies) OVER (PARTITION BY pool) < 2 THEN 2 ELSE copies END)::BIGINT AS copies
    FROM sums JOIN numbers ON numbers.leaves = pool_leaves
    """,
)
def forest_sample_pool(t):
    train, test = mixtures.number_leaves(*_grid_leaves(t))
    pools = mixtures.sample_pools(test, train)
    return pools.groupBy("pool", "label").agg(F.sum("copies").alias("copies"))


@query("fit_mixture", f"""
    WITH RECURSIVE {_pool_labels()}, asked AS (SELECT * FROM pools), {_em('pool', 2, '2')} {_COMPONENTS}
    """)
def fit_mixture(t):
    labels, links, _, _ = _pools(t)
    return _components(mixtures.fit_pools(labels, links, ["pool"], 2))


@query(
    "fit_mixture_single",
    f"""
    WITH cents AS (SELECT {X}, l_tax, round({Y} * 100) AS label FROM lineitem)
    SELECT {X}, l_tax, round(avg(label), 6) AS mean, round(sqrt(var_pop(label) + 1e-6), 4) AS deviation
    FROM cents GROUP BY {X}, l_tax
    """,
)
def fit_mixture_single(t):
    # Whole cents add up exactly, whatever the order of the rows.
    cents = t.lineitem.select(X, "l_tax", F.round(F.col(Y) * 100).alias("label"))
    out = mixtures.fit_single(cents, [X, "l_tax"], "label")
    return out.select(X, "l_tax", r6("mean").alias("mean"), r6(F.sqrt("var"), 4).alias("deviation"))


@query("tree_mixture", f"""
    WITH RECURSIVE {_pool_labels(1, 'true')}, asked AS (SELECT * FROM pools), {_em('pool', 2, '2')} {_COMPONENTS}
    """)
def tree_mixture(t):
    (train_at, test_at), (train, _), _ = _leaves(t, n_trees=1)
    labels, links = mixtures.pool_parts(train_at.unionByName(test_at), train.join(train_at.select(X, "pool"), X),
                                        copies="copies", vectors=train_at)
    return _components(mixtures.fit_pools(labels, links, ["pool"], 2))


def _with_mixture(t):
    labels, links, _, test = _pools(t)
    return test.join(mixtures.fit_pools(labels, links, ["pool"], 2), "pool")


@query("mixture_proba", f"""
    WITH RECURSIVE {_pool_labels()}, asked AS (SELECT * FROM pools), {_em('pool', 2, '2')}, {_DENSITY}
    SELECT {KEY}, component::INT AS component, round(exp(l - total), 6) AS share FROM density
    """)
def mixture_proba(t):
    rows = _with_mixture(t)
    shares = mixtures.responsibilities(F.col("mixture"), F.col("label"))
    return (rows.select(*UNIQUE, F.posexplode(shares).alias("component", "share"))
            .withColumn("share", r6("share")))


@query("mixture_score", f"""
    WITH RECURSIVE {_pool_labels()}, asked AS (SELECT * FROM pools), {_em('pool', 2, '2')}, {_DENSITY}
    SELECT x AS {X}, round(avg(total), 6) AS score FROM density WHERE component = 0 GROUP BY x
    """)
def mixture_score(t):
    return mixtures.mixture_score(_with_mixture(t), [X]).withColumn("score", r6("score"))


@query(
    "nearest_component_rmsre",
    f"""
    WITH c AS (SELECT {X}, l_returnflag, avg({Y}) AS mean FROM lineitem GROUP BY ALL),
    g AS (SELECT l.l_tax, l.{Y} AS y, arg_min(c.mean, struct_pack(gap := abs(c.mean - l.{Y}), flag := c.l_returnflag)) AS chosen
          FROM lineitem l JOIN c ON c.{X} = l.{X} GROUP BY {', '.join('l.' + u for u in UNIQUE)}, l.l_tax, l.{Y})
    SELECT l_tax, round(sqrt(avg(((y - chosen) / y) ** 2)), 6) AS rmsre,
           round(sqrt(avg(((chosen - y) / chosen) ** 2)), 6) AS swapped
    FROM g GROUP BY l_tax
    """,
)
def nearest_component_rmsre(t):
    # Three components per quantity, one for each return flag.
    parts = t.lineitem.groupBy(X, "l_returnflag").agg(F.avg(Y).alias("mean"))
    cell = lambda flag: F.struct(
        F.max(F.when(F.col("l_returnflag") == flag, F.col("mean"))).alias("mean")
    )
    mixture = parts.groupBy(X).agg(F.array(cell("A"), cell("N"), cell("R")).alias("mixture"))
    rows = _runs(t).join(mixture, X)
    measure = lambda swap: r6(
        mixtures.nearest_component_rmsre(F.col("mixture"), F.col(Y), swap)
    )
    return rows.groupBy("l_tax").agg(measure(False).alias("rmsre"), measure(True).alias("swapped"))


@query("tune_components", f"""
    WITH RECURSIVE {_pool_labels()},
    asked AS (SELECT *, num_component AS wanted FROM pools, (SELECT unnest([1, 2, 3, 4, 5]) AS num_component)),
    {_em('pool, num_component', 5, 'wanted')},
    nearest AS (SELECT num_component, y, arg_min(mean, struct_pack(gap := abs(mean - y), component := component)) AS chosen
                FROM test JOIN mixture USING (pool) GROUP BY {KEY}, num_component, y)
    SELECT num_component, round(sqrt(avg(((y - chosen) / y) ** 2)), 6) AS rmsre FROM nearest GROUP BY num_component
    """)
def tune_components(t):
    labels, links, test, _ = _pools(t)
    return mixtures.tune_pools(test, labels, links, copies="copies").withColumn("rmsre", r6("rmsre"))


@query(
    "two_stage_forest",
    f"""
    WITH {_GRID},
    stage AS (SELECT tree, leaf, l_tax::DOUBLE AS extra, avg(label) AS mean FROM train_cells GROUP BY ALL),
    asked AS (SELECT DISTINCT tree, leaf, l_tax::DOUBLE AS extra FROM test_cells),
    found AS (SELECT tree, leaf, a.extra, s.mean FROM asked a JOIN stage s USING (tree, leaf)
              QUALIFY row_number() OVER (PARTITION BY tree, leaf, a.extra
                                         ORDER BY abs(s.extra - a.extra), s.extra) = 1)
    SELECT {KEY}, round(avg(mean), 3) AS prediction
    FROM test_cells JOIN found ON found.tree = test_cells.tree AND found.leaf = test_cells.leaf
                              AND found.extra = l_tax::DOUBLE
    GROUP BY ALL
    """,
)
def two_stage_forest(t):
    train, test = _grid_leaves(t)
    out = mixtures.two_stage_predict(train, test, UNIQUE, "l_tax")
    return out.withColumn("prediction", r6("prediction", 3))
