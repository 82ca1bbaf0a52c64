"""A materialized view of a join with sums and counts that follows its sources by signed changes, batch by batch."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, StructType

COPIES = "__copies"  # how often a stored row stands in its table; in changes how often it comes (above zero) or goes (below)


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Signed rows: an update is the old row deleted and the new one inserted."""
    signed = [rows.withColumn(COPIES, F.lit(n).cast("long")) for rows, n in ((inserted, 1), (deleted, -1)) if rows is not None]
    return reduce(DataFrame.unionByName, signed)


class JoinView:
    """SELECT keys, measures, count(*) FROM left JOIN right ON left.on = right.on GROUP BY keys, kept in ``path`` as tables of ``parts`` partitions.

    ``keys`` and ``measures`` are expressions by name on the columns of both sides, which share no name; measures are sums of whole numbers or decimals, as sums of
    floating point cannot be taken back exactly. Null keys are a group, null join keys meet nothing, a sum over nulls alone is null. Least and greatest values cannot be taken back either and are not offered.

    ``apply`` joins what changed on one side with the partitions of the other that hold its join keys, adds the signed sums to the states of the groups touched, and
    writes these partitions alone, each batch in folders of its own. A small file for each batch, written under another name and then renamed, says which batch last wrote each partition: readers see a batch whole or not at all, a batch
    that broke off is written again, and one that was applied already (its number is not above the last) changes nothing. Each batch leaves the older folders for readers still at work; ``vacuum`` removes those that the last batch no longer names.
    """

    TABLES = ("left", "right", "states")

    def __init__(self, spark: SparkSession, path: str, left: StructType, right: StructType, on: tuple[str, str], keys: Mapping[str, Column], measures: Mapping[str, Column], parts: int = 64):
        self.spark, self.path, self.on, self.keys, self.measures, self.parts = spark, path.rstrip("/"), on, dict(keys), dict(measures), parts
        self.schemas = {"left": left, "right": right}
        if set(left.names) & set(right.names):
            raise ValueError("the two sides share column names")
        probe = self._joined(*(self._empty(s) for s in ("left", "right")))
        states = self._summed(probe)
        for name in self.measures:
            if not isinstance(probe.schema[name].dataType, IntegralType | DecimalType):
                raise ValueError(f"{name} is neither a whole number nor a decimal")
        # sums of sums would widen a decimal with each batch: a state keeps one type
        self.schemas["states"] = StructType([f for f in states.schema if not f.name.startswith("__part")])

    # files

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        """The last batch applied and, for each table and partition, the batch whose folder holds it: at most three times ``parts`` numbers."""
        jvm, fs = self._files()
        found = [s.getPath().getName() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/applied/batch-*")) or ()]
        if not found:
            return {"batch": -1, **{t: {} for t in self.TABLES}}
        last = max(found, key=lambda n: int(n.removeprefix("batch-")))
        return json.loads(self.spark.read.text(f"{self.path}/applied/{last}", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        jvm, fs = self._files()
        new = jvm.org.apache.hadoop.fs.Path(f"{self.path}/applied/.{uuid.uuid4().hex}")
        stream = fs.create(new)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.path}/applied/batch-{manifest['batch']}")):
            raise RuntimeError(f"batch {manifest['batch']} was applied by another writer")

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[name]).withColumn(COPIES, F.lit(0).cast("long"))

    def _stored(self, manifest: dict, name: str, parts: Sequence[int] | None = None) -> DataFrame:
        """Rows of a table's partitions (all where none are named)."""
        schema = self.schemas[name] if name == "states" else StructType([*self.schemas[name]]).add(COPIES, "long")
        folders = [f"{self.path}/{name}/{folder}/__part={p}" for p, folder in manifest[name].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, manifest: dict, name: str, folder: str, rows: DataFrame, parts: Sequence[int]) -> None:
        """Partitions as folders of this batch. A partition left without rows is no longer named."""
        path = f"{self.path}/{name}/{folder}"
        rows.write.mode("overwrite").partitionBy("__part").parquet(path)
        jvm, fs = self._files()
        for p in parts:
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/__part={p}")):
                manifest[name][str(p)] = folder
            else:
                manifest[name].pop(str(p), None)

    # rows

    def _part(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.parts)).cast("int")

    def _joined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Keys and measures of the pairs with their signed number."""
        both = left.withColumnRenamed(COPIES, "__l").join(right.withColumnRenamed(COPIES, "__r"), F.col(self.on[0]) == F.col(self.on[1]))
        return both.select(*(c.alias(n) for n, c in self.keys.items()), *(c.alias(n) for n, c in self.measures.items()), (F.col("__l") * F.col("__r")).alias(COPIES))

    def _summed(self, pairs: DataFrame) -> DataFrame:
        """Signed states: of each measure the sum and the number of values that are not null."""
        made = [F.sum(COPIES).alias("n")]
        for m in self.measures:
            made += [F.coalesce(F.sum(F.col(m) * F.col(COPIES)), F.lit(0)).cast(self._wide(pairs, m)).alias(m), F.coalesce(F.sum(F.when(F.col(m).isNotNull(), F.col(COPIES))), F.lit(0)).alias(f"__n_{m}")]
        return pairs.groupBy(*self.keys).agg(*made)

    @staticmethod
    def _wide(pairs: DataFrame, measure: str) -> str:
        kind = pairs.schema[measure].dataType
        return f"decimal(38,{kind.scale})" if isinstance(kind, DecimalType) else "long"

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select("__part").distinct().collect())  # at most ``parts``

    def _side(self, manifest: dict, name: str, changed: DataFrame) -> tuple[DataFrame, list[int]]:
        """The new rows of the partitions that changed."""
        columns = self.schemas[name].names
        parts = self._touched(changed)
        old = self._stored(manifest, name, parts).withColumn("__part", self._part(F.col(self.on[0 if name == "left" else 1])))
        # dealt once, by partition and a share of it, which is how they are netted and written
        shares = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.parts)
        dealt = old.unionByName(changed).withColumn("__share", F.pmod(F.xxhash64(*columns), F.lit(shares))).repartition("__part", "__share")
        rows = dealt.groupBy(*columns, "__part", "__share").agg(F.sum(COPIES).alias(COPIES)).filter(f"{COPIES} <> 0").drop("__share")
        absent = F.raise_error(F.concat(F.lit(f"a row to be deleted is not in {name}: "), F.to_json(F.struct(*columns))))
        return rows.withColumn(COPIES, F.when(F.col(COPIES) < 0, absent).otherwise(F.col(COPIES))), parts

    def apply(self, batch: int, left: DataFrame | None = None, right: DataFrame | None = None) -> bool:
        """Apply the signed ``changes`` of both sides as batch number ``batch``; False if it was applied before."""
        manifest = self._manifest()
        if batch <= manifest["batch"]:
            return False
        folder = f"batch-{batch}-{uuid.uuid4().hex[:8]}"
        deltas = {}
        for name, rows, on in (("left", left, self.on[0]), ("right", right, self.on[1])):
            columns = self.schemas[name].names
            rows = self._empty(name) if rows is None else rows.select(*columns, COPIES)
            signed = rows.withColumn("__part", self._part(F.col(on)))  # signed sums need no netting; ``_side`` nets the rows it writes
            path = f"{self.path}/changes/{name}/{folder}"
            signed.write.parquet(path)
            deltas[name] = self.spark.read.schema(signed.schema).parquet(path)
        old = {t: dict(manifest[t]) for t in self.TABLES}
        for name in ("left", "right"):
            rows, parts = self._side(old, name, deltas[name])
            if parts:
                self._write(manifest, name, folder, rows, parts)
        # (L + dL)(R + dR) - LR = dL R + (L + dL) dR
        d_left, d_right = deltas["left"], deltas["right"]
        with_old = self._joined(d_left.drop("__part"), self._stored(old, "right", self._touched(d_left)))
        with_new = self._joined(self._stored(manifest, "left", self._touched(d_right)), d_right.drop("__part"))
        group = self._part(*(F.col(k) for k in self.keys)) if self.keys else F.lit(0)
        signed = self._summed(with_old.unionByName(with_new)).withColumn("__part", group)
        path = f"{self.path}/changes/states/{folder}"
        signed.write.parquet(path)
        signed = self.spark.read.schema(signed.schema).parquet(path)
        parts = self._touched(signed)
        if parts:
            both = self._stored(old, "states", parts).withColumn("__part", group).unionByName(signed)
            sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in self.schemas["states"] if f.name not in self.keys]
            self._write(manifest, "states", folder, both.groupBy(*self.keys, "__part").agg(*sums).filter("n <> 0").hint("rebalance", "__part"), parts)
        self._publish(manifest | {"batch": batch})
        return True

    def read(self) -> DataFrame:
        """The view as of the last batch: keys, measures and ``n``."""
        states = self._stored(self._manifest(), "states")
        return states.select(*self.keys, *(F.when(F.col(f"__n_{m}") > 0, F.col(m)).alias(m) for m in self.measures), "n")

    def vacuum(self) -> int:
        """Remove the changes of applied batches and partitions that the last batch no longer names; how many folders went. Not while a batch is being applied or an older one read."""
        manifest, gone = self._manifest(), 0
        jvm, fs = self._files()
        path = jvm.org.apache.hadoop.fs.Path
        for name in self.TABLES:
            kept = {(folder, f"__part={p}") for p, folder in manifest[name].items()}
            for s in fs.globStatus(path(f"{self.path}/{name}/batch-*/__part=*")) or ():
                if (s.getPath().getParent().getName(), s.getPath().getName()) not in kept:
                    gone += bool(fs.delete(s.getPath(), True))
        for s in fs.globStatus(path(f"{self.path}/changes/*/batch-*")) or ():
            gone += bool(fs.delete(s.getPath(), True))
        return gone
