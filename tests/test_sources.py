import io

import pytest

from nullweave import cli
from nullweave.sources import edges as IO
from nullweave.streaming.windows import windowed_edges


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables(spark, edges, tmp_path):
    e = edges([(0, 1, 2), (1, 2, 3)])
    for name in ("a.csv", "a.tsv", "a.parquet", "a.arrow"):
        IO.write_edges(e, str(tmp_path / name))
        assert rows(IO.read_edges(spark, str(tmp_path / name))) == [(0, 1, 2), (1, 2, 3)]
    with pytest.raises(ValueError, match="unknown format"):
        IO.read_edges(spark, "a.xyz")


def test_graph_formats(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="edge" attr.name="weight" attr.type="int"/><graph edgedefault="directed"><edge source="0" target="1"><data key="d0">3</data></edge><edge source="1" target="2"><data key="d0">4</data></edge></graph></graphml>')
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n3 3 2\n1 2 3\n2 3 4\n")
    (tmp_path / "p.net").write_text('*Vertices 3\n1 "a"\n*Arcs\n1 2 3\n2 3 4\n')
    for name in ("g.graphml", "m.mtx", "p.net"):
        assert rows(IO.read_edges(spark, str(tmp_path / name))) == [(0, 1, 3), (1, 2, 4)]
    (tmp_path / "b.graphml").write_text('<graphml><key id="d0" attr.name="weight"/><graph><edge source="0" target="1"><data key="d0">1.5</data></edge></graph></graphml>')
    with pytest.raises(Exception, match="non-negative integer"):
        IO.read_edges(spark, str(tmp_path / "b.graphml")).collect()


def test_text_lists(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# a comment\n0 1\n1\t2\n")
    assert rows(IO.read_snap(spark, str(tmp_path / "s.txt"))) == [(0, 1, 1), (1, 2, 1)]
    (tmp_path / "d.csv").write_text("source,target\n0,1\n")
    assert rows(IO.read_delimited(spark, str(tmp_path / "d.csv"))) == [(0, 1, 1)]
    (tmp_path / "r.csv").write_text("source,target,rate\n0,1,7.5\n")
    assert rows(IO.read_rates(spark, str(tmp_path / "r.csv"))) == [(0, 1, 7.5)]
    (tmp_path / "c.csv").write_text("x,y\n0,1\n2,3\n")
    assert rows(IO.read_coordinates(spark, str(tmp_path / "c.csv"))) == [(0, 0.0, 1.0), (1, 2.0, 3.0)]
    (tmp_path / "n.str").write_text("# id out in\n0 3 4\n1 5 6\n")
    assert rows(IO.read_columns(spark, str(tmp_path / "n.str"), ["id", "out", "in"])) == [(0.0, 3.0, 4.0), (1.0, 5.0, 6.0)]


def test_flights(spark):
    airports = spark.createDataFrame([("A", 0.0, 0.0), ("B", 10.0, 10.0), ("C", 5.0, 5.0)], "code string, lon double, lat double")
    routes = spark.createDataFrame([("A", "B"), ("A", "B"), ("B", "A"), ("A", "X")], "source_code string, target_code string")
    edges, nodes = IO.flights(spark, airports, routes)
    assert rows(edges) == [(0, 1, 2), (1, 0, 1)] and nodes.count() == 2


def test_command_line(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,weight\n0,1,4\n1,2,3\n2,0,5\n0,2,1\n")
    path, out = str(tmp_path / "e.csv"), io.StringIO()
    assert cli.main(["summary", path], spark, out) == 0 and "num_edges: 4" in out.getvalue()
    out = io.StringIO()
    assert cli.main(["fit", path], spark, out) == 0 and '"converged": true' in out.getvalue()
    out = io.StringIO()
    assert cli.main(["sample", path, "--seed", "3"], spark, out) == 0 and out.getvalue().startswith("source,target,weight")
    out = io.StringIO()
    assert cli.main(["filter", path, "--alpha", "0.5"], spark, out) == 0 and "compatible" in out.getvalue()
    assert cli.main(["filter", path, "--output", str(tmp_path / "f")], spark, out) == 0
    assert (tmp_path / "f" / "upper.csv").exists()


def test_windows(spark):
    events = spark.sql("select timestamp'2024-01-01 01:00:00' ts, 1 a, 2 b union all select timestamp'2024-01-01 02:00:00', 1, 2 union all select timestamp'2024-01-02 02:00:00', 1, 2")
    assert sorted(r.weight for r in windowed_edges(events, "ts", "a", "b").collect()) == [1, 2]


def test_stream(spark, tmp_path):
    from nullweave.operators.fit import fit
    from nullweave.streaming.windows import filter_stream

    spark.sql("select timestamp'2024-01-01 01:00:00' ts, 0 a, 1 b from range(30) union all select timestamp'2024-01-02 01:00:00', 0, 1 from range(20) union all select timestamp'2024-01-09 01:00:00', 1, 0").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, a int, b int").parquet(str(tmp_path / "in"))
    model = fit("strength", "me", [2.0, 1.0], [1.0, 2.0])
    q = filter_stream(windowed_edges(stream, "ts", "a", "b"), model, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.start.day, r.weight) for r in got) == [(1, 30), (2, 20)]  # each window's edge once
