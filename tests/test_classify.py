from pyspark.sql import functions as F

from cpelink import constants as K
from cpelink.operators import classify as CL
from cpelink.plans import catalog as CT

SF01 = "/root/testdata/sf0.01"


def test_forest_rejects_unlabelled_containment_candidates(spark):
    # brand2x publishers contain vendor brand2 but are different vendors; only the
    # brand1x cases are labelled, so the forest has to generalise from them
    got = CT.QUERIES["classify"](spark, SF01).collect()
    assert {(r.publisher0, r.vendor_X) for r in got} == {(f"brand2{i}_inc", "brand2") for i in range(6)}
    assert all(r.match == 0 for r in got)


def test_best_match_and_dedup_keep_first(spark):
    rows = [("v", "s1", "t1", "d", "r", "1", 90, "c1"), ("v", "s2", "t2", "d", "r", "1", 95, "c2"),
            ("v", "s0", "t0", "d", "r", "1", 95, "c0"), ("w", "s", "t", "d", "r", "1", 10, "c")]
    df = spark.createDataFrame(rows, "vendor_X string, software_X string, title_X string, DisplayName0 string, "
                                     "release_X string, Version0 string, fz_uwratio int, t_cve_name string")
    best = {(r.vendor_X, r.t_cve_name) for r in CL.best_match(df).collect()}
    assert best == {("v", "c0"), ("w", "c")}


def test_label_lookup_dedups_conflicting_labels(spark):
    pairs = spark.createDataFrame([("p", "v", 1)], "publisher0 string, vendor_X string, x int")
    labels = spark.createDataFrame([("p", "v", 0), ("p", "v", 1)], "publisher0 string, vendor_X string, match int")
    out = CL.label_lookup(pairs, labels, K.VENDOR_KEYS).collect()
    assert len(out) == 1 and out[0].match == 1
    assert F is not None


def _labelled(spark, n=160):
    import random
    rnd, rows = random.Random(4), []
    for k in range(n):
        match = k % 2
        rows.append((f"p{k}", 60 + 30 * match + rnd.randint(-12, 12), 50 + rnd.randint(-40, 40), match))
    rows += [("p1", *rows[1][1:3], 0), ("bad", None, 1, 1)]      # a key with two labels, an incomplete row
    return spark.createDataFrame(rows, "key string, a int, b int, match int")


def test_folds_and_confusion(spark):
    import hashlib

    from cpelink.operators import evaluate as EV
    rows = EV.labelled_rows(_labelled(spark), ["key"], ["a", "b"], 4).collect()
    assert len(rows) == 160 and all(r.fold == int(hashlib.md5(r.key.encode()).hexdigest()[:8], 16) % 4 for r in rows)
    assert {r.match for r in rows if r.key == "p1"} == {1}
    told = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)], "match int, predicted int, g int")
    got = {r.g: tuple(r)[1:] for r in EV.confusion(told, ["g"]).collect()}
    assert got == {0: (3, 1, 1, 1, 0, 1 / 3, 0.5, 0.5), 1: (2, 1, 0, 0, 1, 1.0, 1.0, 1.0)}
    none = EV.confusion(told.where("false")).first()
    assert none.n == 0 and none.accuracy is None and none.precision is None


def test_families_against_plain_versions(spark):
    """Each row predicted by what is learnt from the other folds alone."""
    import numpy as np

    from cpelink.operators import evaluate as EV
    feats = ["a", "b"]
    made = EV.other_families(_labelled(spark), ["key"], feats, folds=4)
    rows = {r.key: r for r in EV.labelled_rows(_labelled(spark), ["key"], feats, 4).collect()}
    want = {name: {} for name in ("nearest_centroid", "ridge", "nearest_neighbours")}
    for k in range(4):
        train = sorted((r for r in rows.values() if r.fold != k), key=lambda r: r.mark)
        x, y = np.array([[r.a, r.b] for r in train], float), np.array([r.match for r in train])
        mean = np.array([x[y == c].mean(axis=0) for c in (0, 1)])
        z = np.hstack((np.ones((len(x), 1)), x))
        w = np.linalg.solve(z.T @ z + np.diag([0.0, 1.0, 1.0]), z.T @ (2.0 * y - 1))
        for r in (r for r in rows.values() if r.fold == k):
            p = np.array([r.a, r.b], float)
            want["nearest_centroid"][r.key] = int(((mean - p) ** 2).sum(axis=1).argmin())
            want["ridge"][r.key] = int(w[0] + w[1:] @ p > 0)
            near = np.argsort(((x - p) ** 2).sum(axis=1), kind="stable")[:EV.NEIGHBOURS]
            want["nearest_neighbours"][r.key] = int((2 * y[near] - 1).sum() > 0)
    for name, expected in want.items():
        assert {r.key: r.predicted for r in made[name].collect()} == expected, name
    online = EV.confusion(made["passive_aggressive"]).first()
    assert online.n == 160 and online.accuracy > 0.8
