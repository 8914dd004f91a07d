"""A ledger of batches over Parquet folders: what a batch writes becomes visible, all of it at once, by one ledger row.

Every attempt at a batch writes its tables under folders of its own. The ledger row names the batch and the attempt that
counts and is written last, so a run that is lost in between leaves nothing that a reader sees, and the next attempt at
the same batch neither loses nor doubles rows. A batch that has its row is not run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_KEYS = "batch_id long, attempt string"


class Ledger:
    """Tables under one folder, each with a fixed schema; ``build`` functions give a batch's rows of any of them.

    ``table`` reads the rows of all batches, ``latest`` the newest row of each key, ``state`` the rows of the last batch
    that wrote the table (for small tables that every batch writes whole, such as marks).
    """

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas: dict[str, StructType] = {n: _parse_datatype_string(s) for n, s in schemas.items()}
        keys = _parse_datatype_string(_KEYS)
        self._read = {n: StructType([*s.fields, *keys.fields]) for n, s in self.schemas.items()}
        self._row = StructType([*_parse_datatype_string("attempt string, tables array<string>").fields, keys["batch_id"]])
        for name, schema in {**self._read, "ledger": self._row}.items():
            parts = ("batch_id",) if name == "ledger" else ("batch_id", "attempt")
            # An empty write makes the folder and is nothing to readers; one that exists is kept.
            spark.createDataFrame([], schema).write.mode("append").partitionBy(*parts).parquet(self._at(name))

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def batches(self) -> DataFrame:
        """(batch_id, attempt, tables) of every batch that counts."""
        return self.spark.read.schema(self._row).parquet(self._at("ledger")).select("batch_id", "attempt", "tables")

    def done(self, batch_id: int) -> bool:
        return self.batches().where(F.col("batch_id") == batch_id).limit(1).count() > 0

    def _visible(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(self._read[name]).parquet(self._at(name))
        return rows.join(self.batches().where(F.array_contains("tables", name)).select("batch_id", "attempt"), ["batch_id", "attempt"], "left_semi")

    def table(self, name: str) -> DataFrame:
        return self._visible(name).select(*self.schemas[name].names)

    def latest(self, name: str, keys: list[str]) -> DataFrame:
        """Of each key the row that the newest batch has written."""
        rest = [c for c in self.schemas[name].names if c not in keys]
        newest = self._visible(name).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
        return newest.select(*keys, "_row.*").select(*self.schemas[name].names)

    def state(self, name: str) -> DataFrame:
        last = self.batches().where(F.array_contains("tables", name)).agg(F.max_by("batch_id", "batch_id").alias("b"), F.max_by("attempt", "batch_id").alias("a")).first()
        rows = self.spark.read.schema(self._read[name]).parquet(self._at(name))
        # Literals: only the folder of that attempt is listed and read.
        return rows.where((F.col("batch_id") == F.lit(last.b)) & (F.col("attempt") == F.lit(last.a))).select(*self.schemas[name].names)

    def run(self, batch_id: int, build: Callable[[], Mapping[str, DataFrame]], before_commit: Callable[[], None] | None = None) -> bool:
        """Write what build gives as one batch; False if the batch had been done. ``before_commit`` runs between data and ledger row."""
        if self.done(batch_id):
            return False
        attempt = uuid.uuid4().hex
        made = build()
        for name, rows in made.items():
            self._stage(name, rows, batch_id, attempt)
        if before_commit:
            before_commit()
        row = self.spark.createDataFrame([(attempt, sorted(made))], "attempt string, tables array<string>")
        # What an attempt that was lost while it wrote its row has left is replaced.
        row.coalesce(1).write.mode("overwrite").parquet(f"{self._at('ledger')}/batch_id={batch_id}")
        return True

    def _stage(self, name: str, rows: DataFrame, batch_id: int, attempt: str) -> None:
        given = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name].fields])
        given.write.mode("errorifexists").parquet(f"{self._at(name)}/batch_id={batch_id}/attempt={attempt}")

    def staged(self, name: str, rows: DataFrame) -> DataFrame:
        """rows written beside the tables and read again, for a build that uses them more than once."""
        path = f"{self.path}/scratch/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def sink(self, build: Callable[[DataFrame], Mapping[str, DataFrame]], before_commit: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: each micro-batch is a batch of the ledger."""
        def write(batch: DataFrame, number: int) -> None:
            self.run(number, lambda: build(batch), (lambda: before_commit(number)) if before_commit else None)
        return write
