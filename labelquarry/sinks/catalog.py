"""Catalog tables that several rows are added to together, or not at all.

A commit writes the new rows of each table as ``data/<table>/v=<n>`` and then one manifest ``v=<n>``: which versions
make up each table, and the next free id of each. What no complete manifest names does not exist, so a commit that
fails on its way shows nothing, and readers see all tables of one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelquarry.session import children, complete_versions, remove_tree

TABLES = {
    "training_sets": "id long, name string, type string, dataset_id long, iterations int, filename string",
    "classes": "id long, name string, training_set_id long, color string, label int",
    "training_objs": "training_set_id long, cell_id string, iteration int, class_id long",
    "test_sets": "id long, name string, dataset_id long, filename string, pos_name string, neg_name string",
}
# What a saved session is called and coloured.
SET_TYPE, LOST_FILE = "binary", "lost filename"
POSITIVE_COLOR, NEGATIVE_COLOR = "green", "red"

MANIFEST = "table string, versions array<long>, next_id long"


class CatalogTables:
    """The tables of :data:`TABLES` below ``root``. One writer at a time: a second one that commits on the same version
    meets the first one's manifest and fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """The last complete commit, 0 before the first."""
        return max(complete_versions(self.spark, f"{self.root}/manifests"), default=0)

    def _manifest(self, version: int) -> dict[str, tuple[list[int], int]]:
        if version == 0:
            return {name: ([], 1) for name in TABLES}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v={version}").collect()
        return {r["table"]: (list(r["versions"]), r["next_id"]) for r in rows}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        versions, _ = self._manifest(self.version() if version is None else version)[name]
        paths = [f"{self.root}/data/{name}/v={v}" for v in versions]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def next_ids(self, name: str, count: int) -> range:
        """Ids that the next commit may give out in a table."""
        first = self._manifest(self.version())[name][1]
        return range(first, first + count)

    def commit(self, added: dict[str, DataFrame], ids_used: dict[str, int]) -> int:
        """Adds rows to several tables at once and moves their next ids on. Returns the new version."""
        before = self.version()
        manifest, new = self._manifest(before), before + 1
        for name, rows in added.items():
            folder = f"{self.root}/data/{name}"
            if f"v={new}" in children(self.spark, folder):
                remove_tree(self.spark, f"{folder}/v={new}")  # what a failed commit left
            typed = rows.to(self.spark.createDataFrame([], TABLES[name]).schema)
            typed.write.parquet(f"{folder}/v={new}")
        now = [
            (name, versions + ([new] if name in added else []), next_id + ids_used.get(name, 0))
            for name, (versions, next_id) in manifest.items()
        ]
        if new not in complete_versions(self.spark, f"{self.root}/manifests") and f"v={new}" in children(self.spark, f"{self.root}/manifests"):
            remove_tree(self.spark, f"{self.root}/manifests/v={new}")
        self.spark.createDataFrame(now, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifests/v={new}")
        return new


def save_training_session(
    tables: CatalogTables, name: str, dataset_id: int, iterations: int, filename: str | None, positive: str, negative: str, samples: DataFrame,
) -> int:
    """Saves a finished session: a training set, its two classes and its objects, in one commit. Returns the set's id.

    ``samples`` has (id, label, iteration); label 1 is the positive class, any other the negative one. Without a file name
    the set says so.
    """
    (set_id,), (pos_id, neg_id) = tables.next_ids("training_sets", 1), tables.next_ids("classes", 2)
    spark = tables.spark
    file = filename if filename and filename.strip() else LOST_FILE
    class_id = F.when(F.col("label") == 1, F.lit(pos_id)).otherwise(F.lit(neg_id))
    tables.commit({
        "training_sets": spark.createDataFrame([(set_id, name, SET_TYPE, dataset_id, iterations, file)], TABLES["training_sets"]),
        "classes": spark.createDataFrame([
            (pos_id, positive, set_id, POSITIVE_COLOR, 1), (neg_id, negative, set_id, NEGATIVE_COLOR, -1)], TABLES["classes"]),
        "training_objs": samples.select(
            F.lit(set_id).cast("long").alias("training_set_id"), F.col("id").cast("string").alias("cell_id"), F.col("iteration").cast("int").alias("iteration"),
            class_id.cast("long").alias("class_id")),
    }, {"training_sets": 1, "classes": 2})
    return set_id


def save_picker_session(tables: CatalogTables, name: str, dataset_id: int, filename: str, positive: str, negative: str) -> int:
    """Saves a finished picker session: a test set. Returns its id."""
    (ident,) = tables.next_ids("test_sets", 1)
    row = tables.spark.createDataFrame([(ident, name, dataset_id, filename, positive, negative)], TABLES["test_sets"])
    tables.commit({"test_sets": row}, {"test_sets": 1})
    return ident
