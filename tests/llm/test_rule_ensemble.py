import random

import numpy as np

from trackplace.llm.rule_ensemble import FEATURES, compiled, fit_rules, lasso, score_quality, statistics, tree_rules


def corpus(spark, tracks_of, n=400):
    rng = random.Random(6)
    plain = "the way to pass and ridge is of long for with lake stone hut on".split()
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        bad = i % 4 == 0
        if bad:
            words = [words[0]] * 40 if i % 8 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "gps"))
        labels.append((i, int(not bad)))
    return tracks_of(docs), spark.createDataFrame(labels, "track_id long, quality int")


def test_held_out_documents_are_told_apart(spark, tracks_of):
    tracks, labels = corpus(spark, tracks_of)
    rows = score_quality(tracks, labels).collect()
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == int(r.track_id % 4 != 0) for r in held)
    assert len(rows) == 400 and len(held) > 80 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_the_expression_is_the_model(spark, tracks_of):
    tracks, labels = corpus(spark, tracks_of, 200)
    model = fit_rules(tracks, labels)
    assert model[1] and model == fit_rules(tracks.repartition(5), labels)
    for r in statistics(tracks).withColumn("score", compiled(model)).collect():
        odds = model[0] + sum(
            w for rule, w in model[1] if all((r[FEATURES[f]] > at) == above for f, above, at in rule))
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-9


def test_lasso_drops_what_does_not_help():
    rng = np.random.default_rng(1)
    x = rng.random((400, 4))
    y = (x[:, 1] > 0.5).astype(float)
    rules = tree_rules(x, y, 10, 2, 16)
    held = np.stack([np.all([(x[:, f] > at) == above for f, above, at in r], 0) for r in rules], 1).astype(float)
    start, weights = lasso(held, y, 0.02)
    assert 0 < (weights != 0).sum() < len(rules) / 2
    assert (((held @ weights + start) > 0) == (y > 0)).mean() > 0.97


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (5, 7), (99, 0)], "track_id long, quality int")
    rows = score_quality(odd, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(none, labels).count() == 0
    assert {r.score for r in score_quality(odd, labels.limit(0)).collect()} == {0.5}
