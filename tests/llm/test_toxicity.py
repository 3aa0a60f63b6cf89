import numpy as np

from recordloom.llm import toxicity as T


def _docs(n=400):
    r = np.random.default_rng(1)
    rows = []
    for i in range(n):
        words = [f"w{chr(97 + k)}x" for k in r.integers(0, 26, 40)]
        toxic = int(i % 4 == 0)
        if toxic:
            words += ["vile"] * int(r.integers(1, 15)) + ["nastyfolk"] * int(r.integers(1, 3))
        r.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_ordered_thresholds_share_weights():
    grades = np.array([0, 1, 2, 3] * 50)
    w, cuts = T.fit_ordinal(np.arange(200), np.zeros(200, np.int64), grades.astype(float), grades, 1)
    assert w[0] > 0 and (np.diff(cuts) > 0).all()
    pred = [(1 / (1 + np.exp(cuts - w[0] * g))).sum() for g in range(4)]
    assert np.allclose(pred, range(4), atol=0.35)


def test_held_out_accuracy(spark):
    rows = _docs()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(got[i].toxic_pred, y) for i, _, y in rows if i % 3 == 0]
    assert sum(a == bool(y) for a, y in held) >= 0.98 * len(held)
    mild, severe = model.score("vile wax"), model.score("vile " * 14 + "nastyfolk nastyfolk")
    assert severe[0] > mild[0] > model.score("wax wbx")[0]


def test_edges(spark):
    rows = _docs(80)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "a"), (901, "", "b"), (901, "", "b"), (902, "vile " * 50_000, "c")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == 84 and {r.doc_id for r in got if r.toxic_pred} >= {902}
    assert not any(r.toxic_pred for r in got if r.doc_id in (900, 901))
    assert T.score(docs.limit(0), T.fit(docs, labels)).count() == 0
    empty = T.fit(docs, labels.limit(0))
    assert [r.severity for r in T.score(docs.limit(2), empty).collect()] == [0.0, 0.0]


def test_labelled_documents_without_features(spark):
    """Rows of the sample without any selected word leave empty arrays."""
    rows = _docs(80) + [(900 + i, t, 0) for i, t in enumerate(["", None, "zz"])]
    m = T.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len(m.cuts) == T.GRADES


def test_gradient_of_the_likelihood():
    r = np.random.default_rng(1)
    z, cuts, grades = r.normal(size=40) * 3, np.array([-0.5, 0.7, 2.0]), r.integers(0, 4, 40)
    loss, by_z, by_cut = T.likelihood(z, cuts, grades)
    p = 1 / (1 + np.exp(cuts[None] - z[:, None]))
    own = np.column_stack([1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1] - p[:, 2], p[:, 2]])
    assert abs(loss + np.log(own[np.arange(40), grades]).sum()) < 1e-9
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert abs((T.likelihood(z, cuts + step, grades)[0] - T.likelihood(z, cuts - step, grades)[0]) / 2e-6 - by_cut[k]) < 1e-4
    for i in range(40):
        step = np.eye(40)[i] * 1e-6
        assert abs((T.likelihood(z + step, cuts, grades)[0] - T.likelihood(z - step, cuts, grades)[0]) / 2e-6 - by_z[i]) < 1e-4


def test_scores_keep_columns_and_follow_the_model(spark):
    m = T.OrdinalModel({"bad": 0, "good": 1}, np.array([3.0, -1.0]), np.array([1.0, 2.0, 4.0]))
    rows = [(1, "bad bad good", "x"), (2, None, "y"), (None, "bad " * 50_000, "z")]
    got = {r.doc_id: r for r in T.score(spark.createDataFrame(rows, "doc_id long, text string, _s string"), m).collect()}
    for i, bad, good in ((1, 2, 1), (2, 0, 0), (None, 50_000, 0)):
        z = 3 * np.log1p(bad) - np.log1p(good)
        p = 1 / (1 + np.exp(m.cuts - z))
        assert abs(got[i].severity - p.sum()) < 1e-9 and abs(got[i].p_toxic - p[0]) < 1e-9 and got[i].toxic_pred == (p[0] >= 0.5)
    assert [got[i]._s for i in (1, 2, None)] == ["x", "y", "z"]
