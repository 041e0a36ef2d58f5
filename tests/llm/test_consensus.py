import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boxmeter.llm import consensus as C

T0 = datetime(2026, 1, 1)
SCHEMA = "annotation_id long, annotator string, part string, severity string, action string, labeled_at timestamp_ntz, loaded_at timestamp_ntz"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("field", F.lit("clash")).withColumn("label", F.lit(1))


def simulated(n=400, seed=1):
    """Items with known values; good annotators, one that turns actions around, one that guesses, and one with few labels."""
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        part, sev, act = r.choice(C.LABEL_FIELDS["part"]), r.choice(C.LABEL_FIELDS["severity"]), r.choice(C.LABEL_FIELDS["action"])
        truth[i] = {"part": part, "severity": sev, "action": act}
        for a in r.sample(["g1", "g2", "g3", "anti", "guess"], 4) + (["few"] if i < 8 else []):
            good = r.random() < 0.93
            p = part if good else r.choice(C.LABEL_FIELDS["part"])
            s = sev if good else r.choice(C.LABEL_FIELDS["severity"])
            c = act if good else r.choice(C.LABEL_FIELDS["action"])
            if a == "guess":
                p, s, c = (r.choice(v) for v in (C.LABEL_FIELDS["part"], C.LABEL_FIELDS["severity"], C.LABEL_FIELDS["action"]))
            if a == "anti":
                c = "repair" if c == "replacement" else "replacement"
            rows.append((i, a, p, s, c, T0, T0))
    return rows, truth


def test_known_values_are_found_and_both_ways_agree(spark):
    rows, truth = simulated()
    labels = frame(spark, rows)
    model = C.fit(labels)
    got = C.consensus(model).collect()
    right = {f: [truth[r.annotation_id][f] == r.consensus for r in got if r.field == f and r.n_values > 1] for f in C.FIELDS}
    assert all(sum(v) / len(v) > 0.93 for v in right.values())
    votes = {}
    for i, a, p, s, c, *_ in rows:
        votes.setdefault(i, []).append(c)
    mode = sum(max(set(v), key=v.count) == truth[i]["action"] for i, v in votes.items()) / len(votes)
    assert sum(truth[r.annotation_id]["action"] == r.consensus for r in got if r.field == "action") / len(truth) > mode
    trust = {(r.annotator, r.field): r.reliability for r in C.reliability(model, labels).collect()}
    assert trust["anti", "action"] < 0.2 < 0.85 < trust["g1", "action"] and trust["guess", "part"] < 0.3 and 0.3 < trust["few", "part"] < 1
    spread = C.fit(labels, broadcast_annotators=1)
    assert {(r.annotation_id, r.field): r.consensus for r in C.consensus(spread).collect()} == {(r.annotation_id, r.field): r.consensus for r in got}


def test_which_labels_count(spark):
    later = T0 + timedelta(days=1)
    rows = [
        (1, "a", "Door ", "minor", "?", T0, T0), (1, "a", "hood", "minor", None, later, T0), (1, "a", "hood", "minor", None, later, T0), (1, "b", "door", " MINOR", "repair", T0, T0),
        (1, None, "wheel", "severe", "repair", T0, T0), (None, "a", "wheel", "severe", "repair", T0, T0), (2, "a", None, "", "n/a", None, None),
    ]
    got = {(r.annotation_id, r.field): r for r in C.consensus(C.fit(frame(spark, rows))).collect()}
    assert set(got) == {(1, "part"), (1, "severity"), (1, "action")}
    assert (got[1, "part"].n_values, got[1, "part"].agreement) == (2, 0.0) and (got[1, "severity"].n_values, got[1, "severity"].agreement) == (1, 1.0)
    assert got[1, "action"].n_labels == 1 and got[1, "action"].agreement is None


def test_empty(spark):
    model = C.fit(frame(spark, []))
    assert C.consensus(model).count() == 0 and C.reliability(model, frame(spark, [])).count() == 0


def test_special_functions():
    import math

    import numpy as np

    x = np.array([0.01, 0.5, 1.0, 3.3, 50.0])
    assert np.allclose(C._lgamma(x), [math.lgamma(v) for v in x], atol=1e-9)
    h = 1e-5
    assert np.allclose(C._digamma(x[1:]), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x[1:]], atol=1e-5)
