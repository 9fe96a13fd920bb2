"""Graphs in a folder that Spark can reach: tables as Parquet, and a manifest for each version.

A version is published by giving its manifest, written under another name, the name of the version, which fails if that is taken:
readers see whole manifests only, and of two writers that start from one version one wins and the other has a conflict. That holds
on local disks (a hard link) and on HDFS (a rename); object stores whose rename is a copy do not exclude a second writer. Tables that a version shares with the one before are not written again. Rows are sorted
by their identifiers, so that a lookup reads few row groups.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import SerializationConflict, Unavailable
from .graph import EdgeTable, NodeTable, PropertyGraph, Route, wide


class DiskStore:
    def __init__(self, spark: SparkSession, root: str, graph: PropertyGraph | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self._written: dict[int, tuple[object, dict]] = {}
        if graph is not None:
            self.commit(-1, graph)

    # --- files
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._path("")
        if not fs.exists(path):
            return []
        found = (re.fullmatch(r"manifest-(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(path))
        return sorted(int(m[1]) for m in found if m)

    def _read(self, version: int) -> dict:
        fs, path = self._path(f"manifest-{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    # --- versions
    def snapshot(self, version: int | None = None) -> tuple[int, PropertyGraph]:
        known = self.versions()
        if not known:
            raise Unavailable(f"no graph in {self.root}")
        version = known[-1] if version is None else version
        manifest = self._read(version)
        route = lambda r: None if r is None else Route(*r)
        nodes = tuple(self._table(x, lambda df, x: NodeTable(df, None if x["labels"] is None else tuple(x["labels"]), route(x.get("route")))) for x in manifest["nodes"])
        edges = tuple(self._table(x, lambda df, x: EdgeTable(df, x["type"], *[None if e is None else tuple(e) for e in x["ends"]], *x.get("single", (False, False)), *map(route, x.get("routes", (None, None))))) for x in manifest["edges"])
        return version, PropertyGraph(self.spark, nodes, edges, manifest["name"], manifest["number"], manifest["complete"])

    def _table(self, entry: dict, make):
        made = make(self.spark.read.parquet(f"{self.root}/{entry['path']}"), entry)
        self._written[id(made)] = (made, entry)
        return made

    def _write(self, table, keys: list[str]) -> str:
        path = f"tables/{uuid.uuid4().hex}"
        table.df.sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        return path

    def commit(self, base: int, graph: PropertyGraph) -> int:
        if base != (self.versions() or [-1])[-1]:
            raise SerializationConflict("the graph has changed since the transaction began")
        entries: dict[str, list] = {"nodes": [], "edges": []}
        for kind, tables, keys in (("nodes", graph.nodes, ["$id"]), ("edges", graph.edges, ["$src", "$dst", "$rank"])):
            for t in tables:
                held = self._written.get(id(t))
                if held is None or held[0] is not t:
                    told = lambda r: None if r is None else [r.column, r.first, r.span]
                    more = {"labels": None if t.labels is None else list(t.labels), "route": told(t.route)} if kind == "nodes" else {"type": t.type, "ends": [t.src_labels, t.dst_labels], "single": [t.src_single, t.dst_single], "routes": [told(t.src_route), told(t.dst_route)]}
                    entry = {"path": self._write(t, keys)} | more
                    self._written[id(t)] = held = (t, entry)
                entries[kind].append(held[1])
        manifest = {"name": graph.name, "number": graph.number, "complete": graph.complete, **entries}
        self._publish(f"manifest-{base + 1}.json", json.dumps(manifest).encode())
        return base + 1

    def _publish(self, name: str, content: bytes) -> None:
        fs, draft = self._path(f"draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(content))
        stream.close()
        path = self._path(name)[1]
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":
                nio = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI("file://" + p.toUri().getPath()))
                jvm.java.nio.file.Files.createLink(nio(path), nio(draft))
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, path, options)
        except Exception as e:
            raise SerializationConflict("another transaction came first") from e
        finally:
            fs.delete(draft, False)


def read_table(spark: SparkSession, path: str, form: str | None = None, schema: str | None = None) -> DataFrame:
    """A file of nodes or edges: CSV with a header, JSON lines, ORC or Parquet, by its ending or as told."""
    form = form or {"csv": "csv", "jsonl": "json", "json": "json", "ndjson": "json", "orc": "orc"}.get(path.rstrip("/").rsplit(".", 1)[-1], "parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if form == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return wide(reader.format(form).load(path))
