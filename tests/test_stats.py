import pytest

from nullweave.operators import stats as ST
from nullweave.schema import coalesce_edges, normalize_edges, normalize_probabilities


def by_node(df):
    return {r["node"]: r.asDict() for r in df.collect()}


def test_node_stats_by_hand(edges):
    e = edges([(0, 1, 2), (0, 2, 3), (1, 2, 4), (2, 0, 5)])
    got = by_node(ST.node_stats(e))
    assert [got[i]["strength_out"] for i in range(3)] == [5, 4, 5]
    assert [got[i]["strength_in"] for i in range(3)] == [5, 2, 7]
    assert [got[i]["degree_out"] for i in range(3)] == [2, 1, 1]
    assert [got[i]["y2_out"] for i in range(3)] == pytest.approx([13 / 25, 1, 1])
    assert [got[i]["y2_in"] for i in range(3)] == pytest.approx([1, 1, 25 / 49])
    assert [got[i]["k_nn_out"] for i in range(3)] == pytest.approx([1.5, 2, 1])
    assert [got[i]["k_nn_in"] for i in range(3)] == pytest.approx([1, 2, 1.5])
    assert [got[i]["s_nn_out"] for i in range(3)] == pytest.approx([5, 7, 5])
    assert [got[i]["s_nn_in"] for i in range(3)] == pytest.approx([5, 5, 31 / 7])
    assert [(r["weight"], r["count"]) for r in ST.weight_distribution(e).collect()] == [(2, 1), (3, 1), (4, 1), (5, 1)]


def test_unseen_nodes_and_empty_tables(edges):
    got = by_node(ST.directed_strengths(edges([(0, 3, 2)])))
    assert len(got) == 4 and got[1]["out"] == 0 and got[3]["incoming"] == 2
    assert ST.directed_strengths(edges([])).count() == 0
    assert ST.clustering(edges([])).count() == 0
    assert ST.totals(edges([])).first()["nodes"] == 0


def test_clustering(edges):
    triangle = edges([(0, 1, 1), (1, 2, 1), (2, 0, 1)])
    assert [r["value"] for r in ST.clustering(triangle).collect()] == [1, 1, 1]
    assert all(r["value"] == pytest.approx(0.5) for r in ST.weighted_clustering(triangle).collect())
    assert all(r["value"] == pytest.approx(1.0) for r in ST.weighted_clustering(triangle, normalise=True).collect())
    star = by_node(ST.clustering(edges([(0, 1, 1), (0, 2, 1), (0, 3, 1)])))
    assert star[0]["value"] == 0


def test_validation(spark, edges):
    with pytest.raises(ValueError, match="non-negative"):
        normalize_edges(spark.createDataFrame([(0, 1, 1.5)], "source long, target long, weight double"))
    with pytest.raises(ValueError, match="non-negative"):
        normalize_edges(edges([(0, 1, -1)]))
    assert normalize_edges(edges([(0, 1, 0), (0, 1, 2)])).count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        normalize_probabilities(spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.25)], "source long, target long, probability double"))
    with pytest.raises(ValueError, match=r"\[0, 1\]"):
        normalize_probabilities(spark.createDataFrame([(0, 1, 1.5)], "source long, target long, probability double"))
    assert coalesce_edges(edges([(0, 1, 1), (0, 1, 2)])).first()["weight"] == 3
