from tracewell.operators import store


def test_long_chains_are_followed_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(store, "_ROUNDS", 3, raising=False)  # the former bound, made small
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)] + [(8, 2)], "a long, b long")
    actions = spark.createDataFrame([(0,), (5,)], "action long")
    got = {r.line: r.action_line for r in store.least_reached(edges, actions).collect()}
    assert got == {k: 0 for k in range(9)}
