from docloom.llm import mixing as M

TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("none", 0.1, 3), (None, 0.2, 1)]


def documents(spark, n=3000):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, ("a" if i % 3 else "b") if i % 11 else "c", " ".join(words[(i + k) % 8] for k in range(5 + i % 40))) for i in range(n)]
    return spark.createDataFrame([*rows, (-1, None, "x"), (-2, "a", None), (-3, "a", ""), (-4, "other", "x y")], "doc_id long, source string, text string").selectExpr("*", "0 AS slot", "0 AS n_tokens")


def test_mixture_keeps_shares_and_caps(spark):
    docs, targets = documents(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    got = M.mixture(docs, targets, block=256).toPandas()
    total = got.n_tokens.sum()
    share = (got.groupby("source").n_tokens.sum() / total).to_dict()
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(share[s] - want) < 0.01
    copies = got.groupby(["source", "doc_id"]).size()
    assert all(copies[s].max() <= most for s, most in (("a", 1), ("b", 4), ("c", 2))) and (got.doc_id > 0).any() and (got.doc_id >= 0).all()
    assert not got.duplicated(["doc_id", "copy"]).any()
    ordered = got.sort_values(["slot", "place"])
    first = ordered.head(len(ordered) // 5)
    assert abs((first.groupby("source").n_tokens.sum() / first.n_tokens.sum())["b"] - 3 / 9) < 0.05
    report = {r.source: r for r in M.shares(docs, targets, block=256).collect()}
    assert report["none"].actual_share == 0 and report["other"].tokens == 0 and abs(report["a"].actual_share - share["a"]) < 1e-9
    assert M.mixture(docs, targets, block=256).exceptAll(M.mixture(docs.repartition(7), targets, block=256)).count() == 0


def test_wanted_size_and_empty_tables(spark):
    docs, targets = documents(spark, 600), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    small = M.mixture(docs, targets, block=128, total=4000).toPandas()
    assert abs(small.n_tokens.sum() - 4000) < 1000
    assert M.mixture(docs.limit(0), targets).count() == 0 == M.mixture(docs, targets.limit(0)).count()


def test_schedule_fills_every_block(spark):
    plans = [M.Plan("a", 0.5, 0.5, 1, 1, 1, 700, 0, 0.5), M.Plan("b", 0.4, 0.4, 1, 1, 1, 560, 0.5, 0.9), M.Plan("c", 0.1, 0.1, 1, 1, 1, 140, 0.9, 1)]
    got = M.schedule(spark, plans).toPandas()
    assert got.groupby("source").block_no.apply(lambda x: sorted(x) == list(range(len(x)))).all() and got.groupby("source").size().to_dict() == {"a": 700, "b": 560, "c": 140}
