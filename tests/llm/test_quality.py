import numpy as np

from docloom.llm import quality as Q
from docloom.llm.rules import induce
from docloom.llm.samples import labelled


def test_rules_on_documents_not_learned_from(spark):
    held = labelled(60, seed=97)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string").selectExpr("*", "'x' AS kind", "1 AS n_words")
    got = {r.doc_id: r.kind for r in Q.classified(df).collect()}
    right = sum(got[i] == k for i, (_, k) in enumerate(held)) / len(held)
    assert right > 0.93
    for kind in ("list", "table", "junk", "prose"):
        found = [k for i, (_, k) in enumerate(held) if got[i] == kind]
        assert sum(k == kind for k in found) / len(found) > 0.88
    assert {r.doc_id: r.kind for r in Q.not_prose(df).collect()} == {i: k for i, k in got.items() if k != "prose"}


def test_induced_rules_and_their_sql(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    y = np.where(x["a"] > 0.7, "hot", np.where((x["b"] < 0.2) & (x["a"] < 0.5), "low", "mid")).astype(object)
    rules = induce(x, y, ["hot", "low"], "mid")
    assert (rules.predict(x) == y).mean() > 0.97
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x["a"], x["b"])], "a double, b double").selectExpr(f"{rules.sql()} AS k")
    assert [r.k for r in df.collect()] == rules.predict(x).tolist()


def test_statistics_of_odd_rows(spark):
    rows = [(1, "The cat sat on the mat.\nIt was 12 years old!"), (2, None), (3, ""), (4, " \n"), (5, "a\n" * 20000), (1, "x"), (None, "그러나 결과는 아직 분명하지 않다.")]
    got = Q.classified(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert len(got) == 7 and by[1, 44].n_words == 10 and by[1, 44].end_share == 1.0 and by[1, 44].n_lines == 2
    assert by[2, None].kind is None and by[3, 0].kind is None and by[4, 2].kind is None and by[5, 40000].line_repeat > 0.99
    assert Q.not_prose(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0
