"""A mesh file in parts, written and read by several tasks."""

import os

from axisloom.operators import mesh
from axisloom.sources import meshlines, vtk


def test_mesh_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vtk, "LINES", 20)
    nodes, cells, path = mesh.box_nodes(spark, (5, 3, 2)), mesh.box_mesh(spark, (5, 3, 2)), str(tmp_path / "m")
    vtk.write_mesh(nodes, cells, path, values={"b": nodes.selectExpr("node", "x + 1 AS v"), "a": nodes.selectExpr("node", "y AS v")})
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    assert len(files) > 5
    text = "".join((tmp_path / "m" / f).read_text() for f in files)
    assert text.startswith("# vtk") and text.count("POINTS") == 1
    (tmp_path / "one.vtk").write_text(text)
    one, some = meshlines.place_lines(spark, str(tmp_path / "one.vtk")), meshlines.place_lines(spark, path, parts=True)
    rows = lambda df: sorted(map(tuple, df.drop("file").collect()))
    assert rows(meshlines.incidence(some)) == rows(meshlines.incidence(one)) == rows(cells)
    assert rows(meshlines.nodes(some)) == rows(meshlines.nodes(one)) == rows(nodes)
    assert rows(meshlines.values(some)) == rows(meshlines.values(one)) and meshlines.values(some).count() == 144
