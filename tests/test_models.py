import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from wakeline import session
from wakeline.constants import CLUSTER_FEATURES, FEATURES
from wakeline.models import cells, classifiers, clustering, components, dbscan, meanshift, neighbours, store
from wakeline.operators import quality
from wakeline.operators.pairwise import reduce_pairs
from wakeline.plans import classification

NAMES = ["a", "b", "c", "d"]


def frame(spark, points, columns=NAMES):
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in columns))


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    root = np.arange(len(x))
    changed = True
    while changed:
        lowest = np.where(near & core[None, :] & core[:, None], root[None, :], len(x)).min(1)
        new = np.where(core, np.minimum(root, lowest), root)
        changed, root = bool((new != root).any()), new
    reach = np.where(near & core[None, :], root[None, :], len(x)).min(1)
    label = np.where(reach < len(x), reach, -1)
    order = {r: i for i, r in enumerate(sorted(set(label[label >= 0])))}
    return near.sum(1), core, np.array([order.get(v, -1) for v in label])


@pytest.fixture(scope="module")
def blobs():
    draw = np.random.default_rng(5)
    # A crowded spot with a third of the points, a chain, scattered noise.
    crowd = draw.normal(0, 0.05, (70, 4))
    chain = np.column_stack([np.linspace(2, 5, 40), *[draw.normal(0, 0.05, 40) for _ in range(3)]])
    noise = draw.uniform(-6, 6, (60, 4))
    return np.concatenate([crowd, chain, noise])


def test_dbscan_equals_brute_force(spark, blobs):
    counts, core, labels = brute_dbscan(blobs, 0.5, 5)
    points = frame(spark, blobs)
    got = dbscan.core_points(points, NAMES, 0.5, 5).orderBy("id").collect()
    assert [r.neighbours for r in got] == counts.tolist() and [r.core for r in got] == core.tolist()
    got = dbscan.dbscan(points, NAMES, 0.5, 5).orderBy("id").collect()
    assert [r.cluster for r in got] == labels.tolist() and labels.max() >= 1 and -1 in labels


def test_dbscan_without_any_core_point(spark):
    points = frame(spark, [[0, 0, 0, 0], [9, 9, 9, 9]])
    assert [r.cluster for r in dbscan.dbscan(points, NAMES).collect()] == [-1, -1]


def test_components_of_paths_and_a_star(spark):
    path = [(i, i + 1) for i in range(50)]
    star = [(100, 100 + i) for i in range(1, 40)]
    edges = spark.createDataFrame(path + star + [(7, 7)], "u bigint, v bigint")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}}


def test_pairs_are_reduced_whole_whatever_the_blocks(spark, blobs):
    points = frame(spark, blobs)
    got = reduce_pairs(
        points, points, None, lambda h, c: h[["id"]].assign(n=len(c)), "id long, n long", home_rows=17, candidate_rows=23
    ).groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert len(got) == len(blobs) and {r.n for r in got} == {len(blobs)}


def test_cell_index_finds_every_box_in_reach():
    draw = np.random.default_rng(8)
    points = np.concatenate([draw.normal(0, 1, (700, 3)), np.tile([[0.5, 0.5, 0.5]], (300, 1)), draw.normal(9, 0.01, (100, 3))])
    index = cells.Cells.of_sample(points[draw.permutation(len(points))[:200]], 32)
    cell = index.find(points)
    boxes = [(c, *points[cell == c].min(0), *points[cell == c].max(0)) for c in np.unique(cell)]
    index.measure(pd.DataFrame(boxes, columns=["cell", "low0", "low1", "low2", "high0", "high1", "high2"]), 3)
    limit = draw.uniform(0, 2, len(points))
    row, found = index.within(points, limit)
    reached = set(zip(row.tolist(), found.tolist()))
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= limit[:, None]
    assert {(i, cell[j]) for i, j in zip(*np.nonzero(near))} <= reached
    assert len(np.unique(cell)) > 8 and len(reached) < 0.7 * len(points) * len(boxes)
    assert cells.Cells.of_sample(np.zeros((0, 3)), 8).find(points[:2]).tolist() == [0, 0]


def nearest_by_force(x, ids, queries, k):
    distance = ((queries[:, None] - x[None]) ** 2).sum(-1)
    return [[ids[j] for j in np.lexsort((ids, row))[:k]] for row in distance]


def test_nearest_through_cells_equals_brute_force(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(0, 1, (500, 4)), np.tile([[0.25] * 4], (250, 1)), [[50.0] * 4], draw.integers(0, 3, (150, 4))])
    rows = frame(spark, x).withColumn("Type", F.lit(30))
    train, test = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")
    ids = np.array([i for i in range(len(x)) if i % 3])
    asked = [i for i in range(len(x)) if i % 3 == 0]
    for k in (1, 5):
        got = {}
        for r in neighbours.nearest(train, test, NAMES, k, cell_rows=40).collect():
            got.setdefault(r.id, []).append((r["rank"], r.neighbour))
        assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == dict(zip(asked, nearest_by_force(x[ids], ids, x[asked], k)))


def test_nearest_with_fewer_rows_than_asked_for(spark):
    rows = frame(spark, [[0, 0, 0, 0], [1, 0, 0, 0], [5, 0, 0, 0]]).withColumn("Type", F.lit(1))
    got = neighbours.nearest(rows.where("id < 2"), rows, NAMES, 5).collect()
    assert sorted((r.id, r.neighbour) for r in got) == [(i, j) for i in range(3) for j in range(2)]
    assert neighbours.nearest(rows.where("id < 0"), rows, NAMES).count() == 0


def test_cells_spare_most_distances(spark):
    rows = spark.range(6000).select("id", *(F.randn(seed=i).alias(c) for i, c in enumerate(NAMES[:2]))).cache()
    index = cells.build(rows, NAMES[:2], 60)
    base = cells.with_cell(rows, index, NAMES[:2]).cache()
    index = cells.measured(index, base, NAMES[:2])
    wider = cells.other_cells(base.withColumn("limit", F.lit(0.01)), index, NAMES[:2], "limit")
    assert neighbours.pairs_compared(base, base, wider) < 0.05 * 6000 * 6000


def test_knn_equals_brute_force(spark, blobs):
    kinds = [30 if i % 3 else 70 for i in range(len(blobs))]
    rows = frame(spark, blobs, FEATURES).withColumn("Type", F.when(F.col("id") % 3 != 0, 30).otherwise(70))
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    got = {r.id: r.predicted for r in neighbours.knn_predictions(train, test, FEATURES).collect()}
    ids = [i for i in range(len(blobs)) if i % 4]
    for i in range(0, len(blobs), 4):
        order = sorted(ids, key=lambda j: (((blobs[i] - blobs[j]) ** 2).sum(), j))[:5]
        votes = [kinds[j] for j in order]
        assert got[i] == min(set(votes), key=lambda v: (-votes.count(v), v))


def test_squared_silhouette_equals_brute_force(spark, blobs):
    x = blobs + 1e4
    label = np.array([0] * 70 + [1] * 40 + [2] * 59 + [3])
    rows = frame(spark, x).withColumn("cluster", F.when(F.col("id") < 70, 0).when(F.col("id") < 110, 1).when(F.col("id") < 169, 2).otherwise(3))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    score = []
    for i, own in enumerate(label):
        mean = {k: d[i, label == k].sum() / ((label == k).sum() - (k == own) or 1) for k in range(4)}
        b = min(v for k, v in mean.items() if k != own)
        score.append(0.0 if own == 3 else (b - mean[own]) / max(b, mean[own]))
    holed = rows.unionByName(frame(spark, [[0, 0, 0, 0]]).withColumn("a", F.lit(None).cast("double")).withColumn("cluster", F.lit(1)))
    assert quality.silhouette_squared(holed, NAMES).first()[0] == pytest.approx(np.mean(score), rel=1e-9)
    assert quality.silhouette_squared(rows.withColumn("cluster", F.lit(1)), NAMES).count() == 0
    assert quality.silhouette_squared(rows.withColumn("cluster", F.col("id").cast("int")), NAMES).count() == 0
    assert quality.silhouette_squared(rows.limit(0), NAMES).count() == 0


def test_clusters_are_numbered_over_ranges(spark):
    roots = spark.range(0, 5000, 7).withColumnRenamed("id", "root").repartition(9)
    assert [(r.root, r.cluster) for r in dbscan._numbered(roots).orderBy("root").collect()] == [(7 * i, i) for i in range(715)]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_base(Context())


def test_indices_equal_brute_force(spark, blobs):
    label = np.array([0] * 70 + [1] * 40 + [2] * 59 + [3])
    rows = frame(spark, blobs).withColumn(
        "cluster", F.when(F.col("id") < 70, 0).when(F.col("id") < 110, 1).when(F.col("id") < 169, 2).otherwise(3))
    d = np.sqrt(((blobs[:, None] - blobs[None]) ** 2).sum(-1))
    score = []
    for i, own in enumerate(label):
        mean = {k: d[i, label == k].sum() / ((label == k).sum() - (k == own) or 1) for k in range(4)}
        b = min(v for k, v in mean.items() if k != own)
        score.append(0.0 if (label == own).sum() == 1 else (b - mean[own]) / max(b, mean[own]))
    centre = np.array([blobs[label == k].mean(0) for k in range(4)])
    within = sum(((blobs[label == k] - centre[k]) ** 2).sum() for k in range(4))
    between = sum((label == k).sum() * ((centre[k] - blobs.mean(0)) ** 2).sum() for k in range(4))
    spread = [np.sqrt(((blobs[label == k] - centre[k]) ** 2).sum(1)).mean() for k in range(4)]
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in range(4) if j != i) for i in range(4)]
    got = {r.metric: r.value for r in quality.quality(rows, NAMES).collect()}
    assert got["silhouette"] == pytest.approx(np.mean(score))
    assert got["calinski_harabasz"] == pytest.approx((between / 3) / (within / (len(blobs) - 4)))
    assert got["davies_bouldin"] == pytest.approx(np.mean(worst))


def test_indices_are_absent_for_one_cluster(spark, blobs):
    rows = frame(spark, blobs).withColumn("cluster", F.lit(0))
    assert quality.quality(rows, NAMES).count() == 0


def test_mean_shift_finds_two_crowds(spark):
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(0, 0.1, (60, 4)), draw.normal(5, 0.1, (40, 4))])
    got = {r.id: r.cluster for r in meanshift.mean_shift(frame(spark, points), NAMES).collect()}
    assert len(got) == 100
    assert {got[i] for i in range(60)} == {0} and {got[i] for i in range(60, 100)} == {1}


def test_components_and_loadings(spark, blobs):
    scaled = (blobs - blobs.mean(0)) / blobs.std(0)
    points = frame(spark, scaled)
    model = clustering.fit_pca(points, NAMES)
    values, vectors = np.linalg.eigh(np.cov(scaled.T))
    top = vectors[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(0), [0, 1]])
    loadings = {r.feature: (r.component_1, r.component_2) for r in clustering.pca_loadings(model, points, NAMES).collect()}
    expected = top * np.sqrt(values[::-1][:2])
    assert np.array([loadings[n] for n in NAMES]) == pytest.approx(expected, abs=1e-6)
    got = np.array([(r.component_1, r.component_2) for r in clustering.pca_components(model, points, NAMES).orderBy("id").collect()])
    assert got == pytest.approx(scaled @ top, abs=1e-6)


@pytest.fixture(scope="module")
def learnable(spark):
    draw = np.random.default_rng(4)
    kinds = np.array([30, 60, 70])[draw.integers(0, 3, 300)]
    x = draw.normal(0, 1, (300, 4)) + (kinds / 10)[:, None]
    rows = frame(spark, x, FEATURES).join(
        spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds)], "id bigint, Type int"), "id").cache()
    return rows.where("id < 240"), rows.where("id >= 240")


@pytest.mark.parametrize("name", ["decision_tree", "logistic"])
def test_classifiers_beat_the_majority(learnable, name):
    train, test = learnable
    got = classifiers.CLASSIFIERS[name](train, test).collect()
    assert len(got) == 60
    assert np.mean([r.actual == r.predicted for r in got]) > 0.6


def test_boosting_beats_the_majority(learnable):
    got = classifiers.ada_boost(*learnable, rounds=4).collect()
    assert np.mean([r.actual == r.predicted for r in got]) > 0.6


def test_saved_model_predicts_the_same(learnable, tmp_path):
    train, test = learnable
    model = classifiers.fit(DecisionTreeClassifier(maxDepth=5, seed=1), train)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert sorted(classifiers.predict(loaded, test).collect()) == sorted(classifiers.predict(model, test).collect())


FAST = {
    "random_forest": lambda rows: store._plain(store.RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), rows),
    "gradient_boosting": lambda rows: store._boosted_trees(rows, 2),
    "adaboost": lambda rows: store._boosted_stumps(rows, 3),
}


@pytest.mark.parametrize("kind", [*store.LEARNERS, "knn"])
def test_stored_models_predict_alike_without_a_type(spark, learnable, tmp_path, monkeypatch, kind):
    for name, quick in FAST.items():
        monkeypatch.setitem(store.LEARNERS, name, quick)
    monkeypatch.setattr(store.learners, "TREES", 5)
    monkeypatch.setattr(store.learners, "ITERATIONS", 15)
    train, test = learnable
    model = store.train(kind, train)
    model.save(str(tmp_path / "model"))
    loaded = store.load(spark, str(tmp_path / "model"))
    assert loaded.kind == kind
    want = {r.id: r.predicted for r in model.predict(test).collect()}
    got = {r.id: r.predicted for r in loaded.predict(test.drop("Type")).collect()}
    assert got == want and len(got) == 60
    kinds = {r.id: r.Type for r in test.collect()}
    assert np.mean([kinds[i] == p for i, p in got.items()]) > 0.5


@pytest.mark.parametrize("kind", ["decision_tree", "logistic", "knn"])
def test_stored_models_are_those_of_the_classifiers(learnable, kind):
    train, test = learnable
    direct = classification.knn(train, test) if kind == "knn" else classifiers.CLASSIFIERS[kind](train, test)
    assert {r.id: r.predicted for r in store.train(kind, train).predict(test).collect()} == {r.id: r.predicted for r in direct.collect()}


@pytest.mark.parametrize("kind", ["kmeans", "mixture"])
def test_stored_clusters_label_alike(spark, blobs, tmp_path, kind):
    points = frame(spark, blobs * 1000, CLUSTER_FEATURES)
    model = store.train_clusters(kind, points, 3)
    model.save(str(tmp_path / "model"))
    want = sorted((r.id, r.cluster) for r in model.label(points).collect())
    assert sorted((r.id, r.cluster) for r in store.load(spark, str(tmp_path / "model")).label(points).collect()) == want
    assert len({c for _, c in want}) == 3


def test_weights_balance_the_classes(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "Type int")
    assert {r.Type: r.weight for r in classifiers.class_weights(df).collect()} == {1: pytest.approx(2 / 3), 2: 2.0}
