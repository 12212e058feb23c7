"""Every part is asked for its most similar ones."""

from __future__ import annotations

from duskwatch.plans import more_queries


def test_similar_patterns_of_every_part(spark, tmp_path):
    names = ["Hot ring", "hot bolt", "old plate", "ring HOT"]
    spark.createDataFrame([(i, names[i % 4] if i < 90 else "unlike") for i in range(91)] + [(91, None)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {}
    for r in more_queries.similar_patterns(spark, str(tmp_path)).collect():
        got.setdefault(r.p_partkey, {})[r.other] = r.score
    words = [set(n.lower().split()) for n in names]
    want = {}
    for i in range(90):
        scored = [(-100 * len(words[i % 4] & words[k % 4]) / len(words[i % 4] | words[k % 4]), k) for k in range(90) if k != i]
        want[i] = {k: round(-s, 6) for s, k in sorted(scored)[:5] if -s > 30}
    assert got == want
