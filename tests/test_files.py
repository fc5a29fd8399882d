import pytest
from pyspark.sql import functions as F

from skein.sources import files


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


GML = """Creator "someone [else]"
# node [ id 99 ]
graph
[
  directed 0
  node [ id 0 graphics [ x 1 y 2 fill [ color "red" ] ] label "a [b]" kind 3 ]
  node
  [
    id 1
    label "two words"
    label "again"
    graphics
    [
      x 5.5
    ]
    kind -4
  ] node [ id 2 ]
  edge [ source 0 target 1 weight 2 graphics [ source 7 ] ]
  edge
  [
    source 1 target 2 ]
]
"""


@pytest.mark.parametrize("split", ["128m", "64b", "17b"])
def test_gml_by_bracket_depth_in_splits(spark, tmp_path, split):
    path, before = write(tmp_path / "g.gml", GML), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        assert (spark.read.text(path).rdd.getNumPartitions() > 1) == (split != "128m")
        found = [(r["at"], r["id"], r["attrs"]) for r in files.gml_nodes(spark, path).orderBy("at").collect()]
        assert found == [(0, "0", {"label": "a [b]", "kind": "3"}), (1, "1", {"label": "two words", "kind": "-4"}), (2, "2", {})]
        assert sorted(map(tuple, files.gml_edges(spark, path).collect())) == [("0", "1"), ("1", "2")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gml_without_anything(spark, tmp_path):
    for k, text in enumerate(("", "graph [ ]", "graph [ node [ ] ]")):
        path = write(tmp_path / f"{k}.gml", text)
        assert files.gml_edges(spark, path).count() == 0
        assert [tuple(r) for r in files.gml_nodes(spark, path).collect()] == ([(0, None, {})] if k == 2 else [])


def test_graphml_defaults(spark, tmp_path):
    path = write(tmp_path / "g.graphml", """<graphml><key id="d0" for="node" attr.name="size"><default>7</default></key><key id="d1" for="node" attr.name="kind"/><key id="d2" for="edge" attr.name="w"><default>1</default></key>
<graph><node id="a"><data key="d1">x</data></node><node id="b"><data key="d0">9</data><data key="d2">5</data></node><node id="c"/><edge source="a" target="b"/></graph></graphml>""")
    found = {r["id"]: r["attrs"] for r in files.graphml_nodes(spark, path).collect()}
    assert found == {"a": {"size": "7", "kind": "x"}, "b": {"size": "9"}, "c": {"size": "7"}}


def test_places_follow_files_whatever_their_sizes(spark, tmp_path):
    """Spark orders splits by size; rows are placed by path and line all the same."""
    for name, n in (("a", 3), ("b", 4000), ("c", 50)):
        write(tmp_path / f"{name}.csv", "i,v\n" + "".join(f"{k},{name}{k}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        found = [r["v"] for r in files.positional(spark, f"file://{tmp_path}/*.csv", lambda names: F.col(names[1]), "v").orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [f"{name}{k}" for name, n in (("a", 3), ("b", 4000), ("c", 50)) for k in range(n)]


def test_matrix_of_more_columns_than_a_frame_takes(spark, tmp_path):
    n = 21_000
    rows = {0: {7: "1", 20_999: "0.5"}, 3: {3: "2"}, 20_999: {0: "1"}}
    lines = [f"{i}," + ",".join(cells.get(j, "0") for j in range(n)) for i, cells in rows.items()]
    for k in range(2):  # every file of a folder has the header
        (tmp_path / f"m{k}.csv").write_text("\n".join(["id," + ",".join(f"c{j}" for j in range(n)), *lines[k::2]]) + "\n")
    assert {tuple(r) for r in files.adjacency_csv(spark, f"file://{tmp_path}").collect()} == {(0, 7), (0, 20_999), (3, 3)}
    assert files.matrix_size(spark, f"file://{tmp_path}") == 3


def test_matrix_cells(spark, tmp_path):
    assert files.nonzero_cells(b"5,0,1,0.0,,-2.5,00,1e-3") == ("5", {1: 1.0, 4: -2.5, 6: 0.001})
    assert files.nonzero_cells(b'"5","0","1",0, 3') == ("5", {1: 1.0, 3: 3.0})
    assert files.nonzero_cells(b"5") == ("5", {}) and files.nonzero_cells(b"5,") == ("5", {})
    path = write(tmp_path / "m.csv", 'n,"a,b",c\n0,0,1\n1,1,0,9\n')  # what has no column in the header doesn't count
    assert {tuple(r) for r in files.adjacency_csv(spark, path).collect()} == {(0, 1)}
