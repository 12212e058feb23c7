"""What redaction changes stands in the result of the whole analysis, and commands as they came don't."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions.text import redact
from duskwatch.operators import graphs
from duskwatch.plans import analysis


def test_evidence_of_graphs_is_redacted(spark):
    secret = "login --password=hunter22 now"
    rows = [("a", i, "impact" if i in (3, 9, 20) else "process", 60 * i, 1, secret if i in (1, 9, 15) else f"run {i}") for i in range(30)]
    rows += [("b", 100 + i, "process", None if i == 2 else i, 1, None if i == 0 else f"open /home/{name}/x") for i, name in enumerate(("ann", "bob", "cy", "di"))]
    rows += [("c", 200 + i, "persistence", i, 1, f"step {i:02}") for i in range(14)]
    events = spark.createDataFrame(rows, "g string, event_id long, event_type string, t long, pid long, command string").selectExpr("g", "event_id", "event_type", "timestamp_seconds(t) ts", "pid", "command").repartition(3)
    known = graphs.embed_graphs(events, "g", "event_id", "event_type", "ts", "pid").select(F.col("graph").alias("name"), F.lit("APT").alias("threat"), "embedding")
    got = {r.graph: r for r in analysis.analyse(events, known, "g").collect()}
    clean = spark.range(1).select(redact(F.lit(secret))).first()[0]
    assert "hunter22" not in str(got) and "hunter22" not in clean
    assert (got["a"].redacted, got["a"].evidence) == (3, ["run 0", clean, "run 2", "run 3", clean, "run 20"])
    assert (got["b"].redacted, got["b"].evidence) == (3, ["open /home/[REDACTED_USER]/x", None, "open /home/[REDACTED_USER]/x"])
    assert (got["c"].redacted, got["c"].evidence) == (0, [f"step {i:02}" for i in range(10)])
    assert {g: (r.pattern, r.n_nodes) for g, r in got.items()} == {"a": ("a", 30), "b": ("b", 4), "c": ("c", 14)}
