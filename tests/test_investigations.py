"""Investigations on small hand-made rows: nulls, empty tables, fillers, ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import investigations as I

EVENTS = "host string, event_id long, ts timestamp, event_type string, process_name string, pid long, command string, dst_ip string, dst_port int"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_chain_evidence_and_summary(spark):
    rows = [
        ("a", 1, None, "process", "svchost.exe", 7, "X -EncodedCommand lsass", None, None),
        ("a", 2, None, "net", None, None, None, "8.8.8.8", 53),
        ("a", 3, None, "network", None, None, None, "10.0.0.1", 53),
        ("a", 4, None, "network", None, None, None, None, None),
        ("b", 5, None, "auth", None, None, "mimikatz", None, None),
        (None, 6, None, "process", None, None, None, None, None),
    ]
    chained = I.chain(events(spark, rows), "host", ["ts", "event_id"])
    found = {(r.host, r.position): (r.kind, r.title, r.subtitle) for r in chained.collect()}
    assert found[("a", 1)] == ("proc", "svchost.exe", "PID: 7") and found[("a", 2)] == ("net", "Socket 8.8.8.8", "Port 53")
    assert found[("a", 4)] == ("net", None, None) and found[("b", 1)] == (None, None, None) and found[(None, 1)] == ("proc", None, None)
    signs = I.evidence(chained, "host")
    assert sorted((r.evidence_id, r.weight, r.technique_id) for r in signs.collect()) == [
        ("EV-1001", 25, "T1059.001"), ("EV-2001", 30, "T1003.001"), ("EV-4001", -15, None), ("EV-5002", 25, "T1071.001")]
    out = {r.host: r for r in I.investigations(chained, signs, "host").collect()}
    assert (out["a"].n_events, out["a"].n_chain, out["a"].supporting_weight, out["a"].contradicting_weight) == (4, 4, 80, 15)
    assert (out["b"].n_chain, out["b"].n_supporting, out["b"].techniques) == (0, 0, [])


def test_empty_tables(spark):
    none = events(spark, [])
    chained = I.chain(none, "host", ["ts", "event_id"])
    signs = I.evidence(chained, "host")
    assert chained.count() == signs.count() == I.investigations(chained, signs, "host").count() == 0


@pytest.mark.parametrize("kind,novelty,counts", [("APT", 0.9, {"process": 12, "network": 9, "file": 30, "all": 80}), ("Benign", 0.2, None), ("Ransomware", 0.71, {"process": 5, "file": 9})])
def test_contributions_follow_the_rules(spark, kind, novelty, counts):
    vector = [((i * 37) % 19 - 9) / 7 for i in range(128)]
    mean = sum(abs(x) for x in vector[68:]) / 60
    m = sum(vector[:43]) / 43
    spread, peak = sum((x - m) ** 2 for x in vector[:43]) / 43, max(abs(x) for x in vector[43:68])
    shown, c = {}, counts or {}
    for name, what, above, whole in (("privilege_escalation", "process", 5, 20), ("network_beacon", "network", 3, 15), ("command_control", "network", 3, 12), ("data_exfiltration", "file", 8, 25),
                                     ("file_encryption", "file", 8, 20), ("lateral_movement", "all", 50, 100)):
        if c.get(what, 0) > above:
            shown[name] = min(1, c[what] / whole)
    for cond, pairs in ((mean > 0.6, (("persistence_mechanism", mean), ("credential_access", mean * 0.8))), (spread > 0.1, (("defense_evasion", spread * 2), ("process_injection", spread * 1.5))),
                        (peak > 0.7, (("reconnaissance", peak * 0.9), ("execution_anomaly", peak * 0.7)))):
        shown |= {n: min(1, x) for n, x in pairs} if cond else {}
    want = {n.replace("_", " ").title(): min(1, max(0.05, I.FEATURES[n][1] * a * I.AFFINITY.get(kind, {}).get(n, 1) * (1 + 0.3 * novelty if novelty > 0.7 else 1))) for n, a in shown.items()}
    want = sorted(want.items(), key=lambda x: -round(x[1], 12))[:5]
    v = F.array(*map(F.lit, vector))
    top = I.contributions(I.activations(v, counts=counts and {k: F.lit(n) for k, n in counts.items()}), F.lit(kind), F.lit(novelty))
    got = spark.range(1).select(top.alias("t"), I.by_dimension(top).alias("d")).first()
    assert [(r.name, pytest.approx(r.weight)) for r in got.t] == want
    assert sum(map(len, got.d.values())) == 5 and set(got.d) == set(I.DIMENSIONS)


def test_fillers_and_largest_places(spark):
    v = F.array(*[F.lit(0.0)] * 128)
    row = spark.range(1).select(I.contributions(I.activations(v), F.lit("APT"), F.lit(1.0)).alias("t"), I.top_activations(F.array(*map(F.lit, [0.5, -2.0, 0.5]))).alias("a")).first()
    assert [(r.name, r.weight) for r in row.t] == list(I.FILLERS.items())
    assert [(r.name, r.weight) for r in row.a] == [("embedding_dim_1", 2.0), ("embedding_dim_2", 0.5), ("embedding_dim_0", 0.5)]


def test_importance_beyond_a_short_vector(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.0]), (2, None)], "id long, v array<double>")
    importance = spark.createDataFrame([(0, 0.5), (1, 0.5), (7, 0.9)], "place int, importance double")
    got = I.top_by_importance(rows, "id", "v", importance, 3).orderBy("id", "rank").collect()
    assert [(r.id, r.rank, r.name, r.weight) for r in got] == [(1, 2, "feature_0", 0.5), (1, 3, "feature_1", 1.0)]


def test_records_by_id_keep_order_of_tables(spark):
    asked = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "id string")
    first, second = spark.createDataFrame([(1, "x")], "id long, a string"), spark.createDataFrame([(1, "y"), (2, "z")], "id long, a string")
    got = {r.id: (r.origin, r.record) for r in I.by_id(asked, "id", ("one", first), ("two", second)).collect()}
    assert got == {"1": ("one", '{"id":1,"a":"x"}'), "2": ("two", '{"id":2,"a":"z"}'), "3": (None, None), None: (None, None)}


@pytest.mark.parametrize("name", ["feature_contributions", "contribution_dimensions"])
def test_signals_of_a_vector_are_worked_out_once(spark, name):
    from duskwatch import catalog

    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 4
