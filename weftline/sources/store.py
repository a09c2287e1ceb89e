"""A stored graph that takes upserts: only the parts that a batch touches are written again, and each batch counts once."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import Steps, drop, filesystem
from weftline.sources.tables import upsert_nodes

#: What decides the part of a row, by table.
KEYS = {"nodes": "node_id", "edges": "src"}


def merge_edges(target: DataFrame, updates: DataFrame) -> DataFrame:
    """One edge for each (project_id, src, dst, label): the one written first, of those the one with the least place."""
    key = ["project_id", "src", "dst", "label"]
    rows = target.unionByName(updates.select(*target.columns))
    rest = [c for c in target.columns if c not in (*key, "written_at", "pos")]
    return rows.groupBy(*key).agg(F.min(F.struct("written_at", "pos", *rest)).alias("_e")).select(*(F.col(c) if c in key else F.col(f"_e.{c}") for c in target.columns))


MERGE = {"nodes": upsert_nodes, "edges": merge_edges}


class GraphStore:
    """Nodes and edges below ``path``, for one writer at a time and any number of readers.

    A project's rows are dealt over ``buckets`` parts by a hash of node_id (edges:
    src). A batch writes the parts that it touches, whole, as a version of its
    own number, and then a ledger that names the version of every part. A
    ledger counts once it is complete: a batch that failed is written anew when it
    is run again, and one that is in the ledgers already changes nothing. Parts
    that are not touched keep their files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _ledger_path(self, batch: int) -> str:
        return f"{self.path}/ledger/{batch:012d}"

    def committed(self) -> list[int]:
        """Numbers of the batches that count, in order."""
        fs, at = filesystem(self.spark, f"{self.path}/ledger")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n) for n in names if fs.exists(filesystem(self.spark, f"{self.path}/ledger/{n}/_SUCCESS")[1]))

    def _parts(self, batch: int | None) -> dict[str, dict[str, int]]:
        """For each table the version of every part after a batch: file names of a kind, one for some thousands of rows."""
        out = {t: {} for t in KEYS}
        if batch is not None:
            for r in self.spark.read.parquet(self._ledger_path(batch)).collect():
                out[r.kind][r.part] = r.version
        return out

    def _read(self, table: str, parts: dict[str, int], schema) -> DataFrame:
        places = [f"{self.path}/{table}/version={v}/part={p}" for p, v in sorted(parts.items())]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def part(self, key: str):
        """Column: the part of a row. Projects share none (but by a clash of 64-bit hashes, which costs work and no rows)."""
        return F.concat(F.lower(F.hex(F.xxhash64("project_id"))), F.lit("-"), F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("string"))

    def _schema(self, table: str, version: int):
        return self.spark.read.option("basePath", f"{self.path}/{table}/version={version}").parquet(f"{self.path}/{table}/version={version}").drop("part").schema

    def read(self, project_id: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) after the last batch; with a project its parts alone are opened."""
        done = self.committed()
        if not done:
            raise ValueError(f"no graph at {self.path}")
        now, out = self._parts(done[-1]), []
        prefix = None if project_id is None else self.spark.range(1).select(F.lower(F.hex(F.xxhash64(F.lit(project_id))))).first()[0] + "-"
        for table in KEYS:
            parts = {p: v for p, v in now[table].items() if prefix is None or p.startswith(prefix)}
            rows = self._read(table, parts, self._schema(table, max(now[table].values(), default=done[0])))
            out.append(rows if project_id is None else rows.where(F.col("project_id") == project_id))
        return out[0], out[1]

    def upsert(self, nodes: DataFrame, edges: DataFrame, batch: int | None = None) -> bool:
        """Merges rows in as batch number ``batch`` (by default the next one); false if that batch counts already."""
        done = self.committed()
        batch = (done[-1] + 1 if done else 0) if batch is None else batch
        if batch in done:
            return False
        before = self._parts(done[-1] if done else None)
        steps = Steps(self.spark, "upsert")
        for table, rows in (("nodes", nodes), ("edges", edges)):
            rows = steps.write(rows.withColumn("part", self.part(KEYS[table])), table)
            touched = [r.part for r in rows.select("part").distinct().collect()]  # names of parts, not rows
            known = {p: before[table][p] for p in touched if p in before[table]}
            updates = rows.drop("part")
            old = self._read(table, known, updates.schema)
            merged = MERGE[table](old, updates).withColumn("part", self.part(KEYS[table]))
            at = f"{self.path}/{table}/version={batch}"
            merged.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(at)
            before[table] |= dict.fromkeys(touched, batch)
        lines = [(t, p, v) for t, parts in before.items() for p, v in parts.items()]
        self.spark.createDataFrame(lines, "kind string, part string, version long").coalesce(1).write.mode("overwrite").parquet(self._ledger_path(batch))
        steps.drop("nodes", "edges")
        return True

    def vacuum(self) -> int:
        """Deletes parts and ledgers that the last ledger does not need; no reader may be busy with them. Returns the number of parts deleted.

        The ledgers' own folders stay, emptied, so that old batches are still known to count.
        """
        done = self.committed()
        if not done:
            return 0
        now, gone = self._parts(done[-1]), 0
        for table in KEYS:
            fs, at = filesystem(self.spark, f"{self.path}/{table}")
            for version in fs.listStatus(at):
                for part in fs.listStatus(version.getPath()):
                    name = part.getPath().getName()
                    if name.startswith("part=") and now[table].get(name.removeprefix("part=")) != int(version.getPath().getName().removeprefix("version=")):
                        drop(self.spark, part.getPath().toString())
                        gone += 1
        for batch in done[:-1]:
            fs, at = filesystem(self.spark, self._ledger_path(batch))
            for f in fs.listStatus(at):
                if f.getPath().getName() != "_SUCCESS":
                    fs.delete(f.getPath(), False)
        return gone
