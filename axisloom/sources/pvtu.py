"""Meshes in pieces as a Spark data source: VTU files (ASCII XML) that a PVTU index lists.

    spark.dataSource.register(pvtu.Pvtu)
    pvtu.cells(nodes, incidence).write.format("pvtu").mode("overwrite").save(path)
    spark.read.format("pvtu").load(path)

Each task writes its cells in pieces of at most ``cells`` (an option). The index is put in place on commit and lists the
pieces of the tasks that count; it alone says what belongs to the mesh. An attempt that fails removes what it wrote, and a
failed job all its pieces. Paths are those that Arrow's file systems open. One writer at a time.
"""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from axisloom.sources.vtk import HEX_ORDER, HEXAHEDRON

INDEX = "mesh.pvtu"
#: Cell type of a tetrahedron. Fixed value.
TETRAHEDRON = 10


def cells(nodes: DataFrame, incidence: DataFrame) -> DataFrame:
    """``elem``, ``node`` and ``xyz`` (flat) of every cell from (node, x, y, z) and (elem, lid, node), corners by lid."""
    corner = F.struct("lid", "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    packed = incidence.join(nodes, "node", "left").groupBy("elem").agg(F.array_sort(F.collect_list(corner)).alias("c"))
    return packed.select(F.col("elem").cast("long").alias("elem"), F.col("c.node").cast("array<long>").alias("node"), F.flatten(F.transform("c", lambda s: F.array(s.x, s.y, s.z))).alias("xyz"))


def incidence(read: DataFrame) -> DataFrame:
    """(elem, lid, node, x, y, z) of cells that were read."""
    flat = read.select("elem", F.posexplode("node").alias("lid", "node"), "xyz")
    return flat.select("elem", "lid", "node", *(F.element_at("xyz", 3 * F.col("lid") + c + 1).alias(name) for c, name in enumerate("xyz")))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).rstrip("/"))


def _array(parent: ET.Element, name: str, kind: str, values: np.ndarray, **more: str) -> None:
    ET.SubElement(parent, "DataArray", type=kind, Name=name, format="ascii", **more).text = " ".join(map(repr, values.tolist()))


def piece(table: pa.Table) -> bytes:
    """A VTU file of the cells (elem, node, xyz); points are those of the cells, once each."""
    elem = table.column("elem").combine_chunks().to_numpy(zero_copy_only=False)
    corners, places = (table.column(c).combine_chunks() for c in ("node", "xyz"))
    size = pa.compute.list_value_length(corners).to_numpy(zero_copy_only=False)
    if table.column("elem").null_count or corners.null_count or places.null_count or corners.flatten().null_count or places.flatten().null_count:
        raise ValueError("a cell has a number, and its corners nodes and places")
    if not np.isin(size, (4, 8)).all() or (pa.compute.list_value_length(places).to_numpy(zero_copy_only=False) != 3 * size).any():
        raise ValueError("cells are tetrahedra or hexahedra with three coordinates for each corner")
    node, xyz = corners.flatten().to_numpy(), places.flatten().to_numpy().reshape(-1, 3)
    first = np.cumsum(size) - size
    order = np.arange(len(node))
    hexes = first[size == 8]
    order[hexes[:, None] + np.arange(8)] = hexes[:, None] + np.array(HEX_ORDER)
    node, xyz = node[order], xyz[order]
    points, one, local = np.unique(node, return_index=True, return_inverse=True)
    top = ET.Element("VTKFile", type="UnstructuredGrid", version="1.0", byte_order="LittleEndian", header_type="UInt64")
    part = ET.SubElement(ET.SubElement(top, "UnstructuredGrid"), "Piece", NumberOfPoints=str(len(points)), NumberOfCells=str(len(elem)))
    _array(ET.SubElement(part, "PointData", GlobalIds="node"), "node", "Int64", points)
    _array(ET.SubElement(part, "CellData", GlobalIds="elem"), "elem", "Int64", elem)
    _array(ET.SubElement(part, "Points"), "Points", "Float64", xyz[one].ravel(), NumberOfComponents="3")
    listed = ET.SubElement(part, "Cells")
    _array(listed, "connectivity", "Int64", local)
    _array(listed, "offsets", "Int64", first + size)
    _array(listed, "types", "UInt8", np.where(size == 8, HEXAHEDRON, TETRAHEDRON))
    return ET.tostring(top, xml_declaration=True, encoding="utf-8")


def parsed(data: bytes) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Cell numbers, and the nodes and flat coordinates of each cell's corners, of a VTU file."""
    part = ET.fromstring(data).find("UnstructuredGrid/Piece")
    column = lambda path, name, kind: np.array((part.find(f"{path}/DataArray[@Name='{name}']").text or "").split(), kind)
    points, elem = column("PointData", "node", np.int64), column("CellData", "elem", np.int64)
    xyz, local = column("Points", "Points", float).reshape(-1, 3), column("Cells", "connectivity", np.int64)
    nodes, places = [], []
    for corners in np.split(local, column("Cells", "offsets", np.int64)[:-1]):
        at = corners[list(HEX_ORDER)] if len(corners) == 8 else corners
        nodes.append(points[at])
        places.append(xyz[at].ravel())
    return elem, nodes, places


def index(pieces: list[str]) -> bytes:
    top = ET.Element("VTKFile", type="PUnstructuredGrid", version="1.0", byte_order="LittleEndian", header_type="UInt64")
    grid = ET.SubElement(top, "PUnstructuredGrid", GhostLevel="0")
    ET.SubElement(ET.SubElement(grid, "PPointData", GlobalIds="node"), "PDataArray", type="Int64", Name="node")
    ET.SubElement(ET.SubElement(grid, "PCellData", GlobalIds="elem"), "PDataArray", type="Int64", Name="elem")
    ET.SubElement(ET.SubElement(grid, "PPoints"), "PDataArray", type="Float64", Name="Points", NumberOfComponents="3")
    for name in pieces:
        ET.SubElement(grid, "Piece", Source=name)
    return ET.tostring(top, xml_declaration=True, encoding="utf-8")


def listed(path: str) -> list[str]:
    """The pieces that the index names; none where there is no index."""
    store, root = _store(path)
    if store.get_file_info(f"{root}/{INDEX}").type == fs.FileType.NotFound:
        return []
    with store.open_input_file(f"{root}/{INDEX}") as f:
        return [x.get("Source") for x in ET.fromstring(f.read()).iter("Piece")]


@dataclass
class Pieces(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


@dataclass
class Piece(InputPartition):
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, most: int, overwrite: bool):
        self.path, self.most, self.overwrite = path, most, overwrite
        self.folder = f"pieces-{uuid.uuid4().hex}"

    def _slabs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, self.most):
                part = batch.slice(at, self.most)
                if n and n + part.num_rows > self.most:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield pa.Table.from_batches(held)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        store, root = _store(self.path)
        made = Pieces()
        try:
            for slab in self._slabs(iterator):
                data = piece(slab)
                store.create_dir(f"{root}/{self.folder}", recursive=True)
                made.names.append(f"{self.folder}/{uuid.uuid4().hex}.vtu")
                with store.open_output_stream(f"{root}/{made.names[-1]}") as out:
                    out.write(data)
        except BaseException:
            for name in made.names:
                if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    store.delete_file(f"{root}/{name}")
            raise
        return made

    def commit(self, messages: list[Pieces | None]) -> None:
        store, root = _store(self.path)
        new = sorted(name for m in messages if m is not None for name in m.names)
        old = listed(self.path)
        store.create_dir(root, recursive=True)
        beside = f"{root}/{self.folder}.index"
        with store.open_output_stream(beside) as out:
            out.write(index(new if self.overwrite else old + new))
        store.move(beside, f"{root}/{INDEX}")
        # pieces of attempts that don't count, and what was replaced
        self._remove(store, root, {self.folder}, keep={f"{root}/{n}" for n in new})
        if self.overwrite:
            self._remove(store, root, {n.split("/")[0] for n in old}, keep=set())

    def abort(self, messages: list[Pieces | None]) -> None:
        store, root = _store(self.path)
        self._remove(store, root, {self.folder}, keep=set())

    @staticmethod
    def _remove(store: fs.FileSystem, root: str, folders: set[str], keep: set[str]) -> None:
        for folder in folders:
            found = store.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))
            for f in found:
                if f.path not in keep:
                    store.delete_file(f.path)
            if not keep and store.get_file_info(f"{root}/{folder}").type != fs.FileType.NotFound:
                store.delete_dir(f"{root}/{folder}")


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        return [Piece(name) for name in listed(self.path)]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.name:  # a mesh without pieces
            return
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as f:
            elem, nodes, places = parsed(f.read())
        yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(elem)), pa.array(elem), pa.array(nodes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.float64()))], names=["piece", "elem", "node", "xyz"])


class Pvtu(DataSource):
    """Format ``pvtu``: writes (elem, node, xyz), reads these and the ``piece`` each cell is in."""

    @classmethod
    def name(cls) -> str:
        return "pvtu"

    def schema(self) -> str:
        return "piece string, elem long, node array<long>, xyz array<double>"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a mesh has a path")
        return self.options["path"]

    def reader(self, schema) -> Reader:
        return Reader(self._path())

    def writer(self, schema, overwrite: bool) -> Writer:
        most = int(self.options.get("cells", 1 << 17))
        if most < 1 or not {"elem", "node", "xyz"} <= set(schema.fieldNames()):
            raise ValueError("pieces hold a cell at least, of elem, node and xyz")
        return Writer(self._path(), most, overwrite)
