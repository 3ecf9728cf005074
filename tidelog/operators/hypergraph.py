"""Hypergraphs as incidence rows (edge_id, vertex)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .utility import numbered


class Hypergraph:
    """Immutable: every change is a new graph over lazily derived frames. ``vertices`` has those without an edge too."""

    def __init__(self, incidence: DataFrame, vertices: DataFrame | None = None) -> None:
        self.incidence = incidence.select("edge_id", "vertex").distinct()
        own = self.incidence.select("vertex")
        self.vertices = (own if vertices is None else own.union(vertices.select("vertex"))).distinct()

    @classmethod
    def empty(cls, spark: SparkSession, kind: str = "long") -> Hypergraph:
        return cls(spark.createDataFrame([], f"edge_id long, vertex {kind}"), spark.createDataFrame([], f"vertex {kind}"))

    @classmethod
    def from_sets(cls, sets: DataFrame, order: str, vertices: str) -> Hypergraph:
        """One edge for each distinct non-empty set in array column ``vertices``; ids 0, 1, … by the sets' smallest ``order``."""
        canon = sets.select(F.array_sort(F.array_distinct(F.filter(vertices, lambda v: v.isNotNull()))).alias("s"), F.col(order).alias("o")).where(F.size("s") > 0)
        first = canon.groupBy("s").agg(F.min("o").alias("o"))
        return cls(numbered(first, "o", "s", name="edge_id").select("edge_id", F.explode("s").alias("vertex")))

    def add_vertex(self, vertex: object) -> Hypergraph:
        more = self.vertices.sparkSession.createDataFrame([(vertex,)], self.vertices.schema)
        return Hypergraph(self.incidence, self.vertices.union(more))

    def add_hyperedge(self, *members: object) -> Hypergraph:
        """With the next id; an empty or known set of vertices changes nothing."""
        if not members:
            return self
        spark = self.vertices.sparkSession
        new = spark.createDataFrame([(m,) for m in set(members)], self.vertices.schema)
        same = self.incidence.groupBy("edge_id").agg(F.array_sort(F.collect_set("vertex")).alias("s")).join(new.agg(F.array_sort(F.collect_set("vertex")).alias("s")), "s")
        if same.limit(1).count():
            return self
        top = self.incidence.agg(F.max("edge_id")).collect()[0][0]
        edge = new.select(F.lit(0 if top is None else top + 1).cast("long").alias("edge_id"), "vertex")
        return Hypergraph(self.incidence.union(edge), self.vertices)

    def remove_vertex(self, vertex: object) -> Hypergraph:
        """Edges lose it; an edge that had nothing else goes."""
        return Hypergraph(self.incidence.where(F.col("vertex") != vertex), self.vertices.where(F.col("vertex") != vertex))

    def remove_hyperedge(self, edge_id: int) -> Hypergraph:
        """Its vertices go too where they are in no other edge."""
        rest = self.incidence.where(F.col("edge_id") != edge_id)
        gone = self.incidence.where(F.col("edge_id") == edge_id).select("vertex").join(rest, "vertex", "left_anti")
        return Hypergraph(rest, self.vertices.join(gone, "vertex", "left_anti"))

    def hyperedges(self) -> DataFrame:
        return self.incidence.groupBy("edge_id").agg(F.array_sort(F.collect_set("vertex")).alias("vertices"))

    def edges_of(self, vertex: object) -> DataFrame:
        return self.incidence.where(F.col("vertex") == vertex).select("edge_id").distinct()

    def vertices_of(self, edge_id: int) -> DataFrame:
        return self.incidence.where(F.col("edge_id") == edge_id).select("vertex")

    def neighbors(self, vertex: object) -> DataFrame:
        """Vertices that share an edge with ``vertex``, without itself."""
        return self.incidence.join(self.edges_of(vertex), "edge_id", "left_semi").where(F.col("vertex") != vertex).select("vertex").distinct()

    def incident(self, edge_id: int, vertex: object) -> bool:
        return bool(self.incidence.where((F.col("edge_id") == edge_id) & (F.col("vertex") == vertex)).limit(1).count())
