"""Components of a growing graph: stored labels, to which each batch of edges adds by touching only the components that it joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longtext.operators.components import connected_components, dealt
from longtext.operators.ranges import Save
from longtext.sources.versions import VersionedTable


#: Edges of a batch up to which Spark may send its tables to all tasks; a larger batch is dealt out by key in every join.
MOST_SENT = 25_000


@dataclass
class StoredComponents:
    """Labels (node, component) of all edges added so far, under `path`; a component is named by its least node.

    Two versioned tables hold them, one dealt by node and one by component, so that a batch reads the partitions of its own nodes and of
    the components that change their name. The labels are the truth: a batch writes the members first and takes the old ones out last, and
    members that the labels do not confirm are passed over, so a batch that dies in between can be added again.
    """

    spark: SparkSession
    path: str
    save: Save
    buckets: int = 64
    most: int = MOST_SENT

    def __post_init__(self):
        self._labels = VersionedTable(self.spark, f"{self.path}/labels", ("node",), self.buckets)
        self._members = VersionedTable(self.spark, f"{self.path}/members", ("component", "node"), self.buckets, ("component",))

    def labels(self) -> DataFrame:
        return self._labels.read()

    def add(self, edges: DataFrame, a: str = "a", b: str = "b") -> dict[str, int]:
        """Add edges; how many of the partitions of labels and members were read, and how many nodes got a label. Nulls are passed over, a loop makes its node known."""
        pairs = self.save(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct(), "new-edges")
        ends = self.save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "new-nodes")
        small = pairs.count() <= self.most
        met = (lambda df: df) if small else dealt
        told = {"labels_read": 0, "members_read": 0, "changed": 0}
        if self._labels.exists():
            told["labels_read"] = len(self._labels.touched(ends))
            known = self._labels.lookup(ends, small)
        else:
            known = ends.limit(0).withColumn("component", F.col("node"))
        named = ends.join(met(known), "node", "left").select("node", "component", F.coalesce("component", "node").alias("now"))
        named = self.save(named, "new-named")
        # the batch as edges between components: its size is the batch's, not the graph's
        x, y = named.select(F.col("node").alias("a"), F.col("now").alias("u")), named.select(F.col("node").alias("b"), F.col("now").alias("v"))
        joined = connected_components(pairs.join(met(x), "a").join(met(y), "b").select("u", "v").distinct(), "u", "v", self.save, most=self.most)
        renamed = self.save(joined.select(F.col("node").alias("now"), F.col("component").alias("new")), "renamed")
        fresh = named.filter("component is null").join(met(renamed), "now").select("node", F.col("new").alias("component"))
        gone = renamed.filter("now != new").select(F.col("now").alias("component"), "new").join(met(named.filter("component is not null").select("component").distinct()), "component", "left_semi")
        gone = self.save(gone, "gone")
        moved = fresh.limit(0).withColumn("old", F.col("component"))
        if self._members.exists() and gone.limit(1).count():
            told["members_read"] = len(self._members.touched(gone))
            # a small batch may rename a large component
            held = self.save(self._members.lookup(gone, small), "held")
            few = held.count() <= self.most
            true = self._labels.lookup(held.select("node").distinct(), few)
            held = held.join(true if few else dealt(true), ["node", "component"], "left_semi")
            moved = held.join(met(gone), "component").select("node", F.col("new").alias("component"), F.col("component").alias("old"))
        moved = self.save(moved, "moved")
        changes = self.save(fresh.union(moved.select("node", "component")), "changes")
        told["changed"] = changes.count()
        if told["changed"]:
            self._members.upsert(changes.select("component", "node"))
            self._labels.upsert(changes)
            if moved.limit(1).count():
                self._members.delete(moved.select(F.col("old").alias("component"), "node"))
        return told
