"""Quality scores and mixing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from feedweir.llm import mixing, quality

LABELS = "doc_id bigint, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def graded(spark):
    """Prose and symbol noise, half of it labelled."""
    draw, rows = random.Random(9), []
    for i in range(400):
        good = i % 3 > 0
        words = [draw.choice(["the", "river", "house", "of", "green", "and", "morning", "walks"]) for _ in range(draw.randrange(20, 80))]
        rows.append((i, " ".join(words) + "." if good else " | ".join(x + "%%" for x in words), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, y, 0, "own column") for i, _, y in rows if i % 2] + [(None, 1, 0, ""), (3, None, 0, "")], LABELS)
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_documents_are_told_apart(graded):
    docs, labels, truth = graded
    got = quality.score(docs, labels).collect()
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_change_nothing(graded, spark):
    docs, labels, _ = graded
    held = quality.held_out(labels["doc_id"])
    flipped = labels.withColumn("quality", mixing.F.when(held, 1 - labels["quality"]).otherwise(labels["quality"]))
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs, flipped).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_accepted_rows_are_those_predicted(graded):
    docs, labels, _ = graded
    want = sorted(r.doc_id for r in quality.score(docs, labels).collect() if r.predicted)
    assert sorted(r.doc_id for r in quality.accepted(docs, labels).collect()) == want


def test_messy_and_empty_tables(messy, none, rows, graded, spark):
    _, labels, _ = graded
    assert quality.score(messy, labels).count() == len(rows)
    assert quality.accepted(messy, labels).schema == messy.schema
    nothing = labels.limit(0)
    assert {r.score for r in quality.score(messy, nothing).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0


def test_isotonic_equals_brute_force():
    draw = np.random.default_rng(5)
    value, total = np.arange(30.0), draw.integers(1, 5, 30).astype(float)
    ones = np.array([draw.integers(0, n + 1) for n in total], float)
    knots, levels = quality.isotonic(value, total, ones)
    assert (np.diff(levels) > 0).all()
    fitted, k = [], 0
    best = np.array([max(min(ones[a : b + 1].sum() / total[a : b + 1].sum() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)])
    for i in range(30):
        k = int(np.argmin(np.abs(levels - best[i])))
        fitted.append(levels[k])
    assert np.allclose(fitted, best) and len(knots) == len(levels)


def test_rates_solve_the_nonnegative_problem(spark):
    draw = np.random.default_rng(6)
    p = draw.dirichlet([0.4, 0.4, 0.4], 60)
    tokens = draw.integers(1, 500, 60)
    held = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens bigint, posterior array<double>")
    names, targets = ["a", "b", "c"], {"a": 0.7, "b": 0.25, "c": 0.05}
    descent, report = mixing.descend(held, names, targets, steps=150)
    rate = descent.rates(p)
    goal = np.array([targets[n] for n in names]) * tokens.sum()
    assert (rate >= 0).all() and np.abs((tokens * rate) @ p - goal).max() < 1e-4 * tokens.sum()
    assert report["residuals"][-1] < 1e-4
    # beyond what the documents can give, the optimality conditions of the projected problem hold
    sharp = spark.createDataFrame([(100, [0.9, 0.1]), (100, [0.6, 0.4])], "tokens bigint, posterior array<double>")
    descent, _ = mixing.descend(sharp, ["a", "b"], {"a": 0.0, "b": 1.0}, steps=60)
    rate = descent.rates(np.array([[0.9, 0.1], [0.6, 0.4]]))
    assert rate[0] == 0 and rate[1] > 0


def test_mixing_repeats_and_leaves_out(graded, messy, none, rows):
    docs, labels, truth = graded
    labelled = labels.selectExpr("doc_id", "if(quality = 1, 'good', 'bad') AS domain").where("quality is not null")
    out, names, report = mixing.rated(docs, labelled, {"good": 0.9, "bad": 0.1})
    got = out.collect()
    assert names == ["bad", "good"] and len(got) == 400 and report["residuals"][-1] < 1e-3
    right = np.mean([np.argmax(r.posterior) == truth[r.doc_id] for r in got])
    assert right > 0.95
    tokens = np.array([r.tokens * r.rate for r in got]) @ np.array([r.posterior for r in got])
    assert abs(tokens[1] / tokens.sum() - 0.9) < 0.01
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)
    again = mixing.mixed(docs, labelled, {"good": 0.9, "bad": 0.1}).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in again} == {r.doc_id: r.copies for r in got if r.copies}
    assert mixing.mixed(messy, labelled, {"good": 1.0}).schema == messy.schema
    assert mixing.mixed(messy, labelled.limit(0), {"good": 1.0}).count() == len(rows)
    assert mixing.mixed(none, labelled, {"good": 1.0}).count() == 0
