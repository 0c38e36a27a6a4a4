"""Stored results of tests: p-values of sequences and, made from them, of terms.

A store is a folder that all tasks share. Values are written once into folders of their own; a version is a small table
of what belongs to it, renamed into place, and fails if its number is taken. Readers keep the version they began with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "column string, title string, method string, path string, term_method string, term_cutoff double, term_path string"
#: Fixed value: the cutoff of a column without a stored one.
CUTOFF = 0.05


class Results:
    """Columns of p-values: ``save`` those of sequences, then ``save_terms`` those of terms that were tested with them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._disk = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._fs.Path(path)

    def version(self) -> int:
        """The last version; 0 where nothing is stored."""
        root = f"{self.path}/versions"
        if not self._disk.exists(self._at(root)):
            return 0
        names = [s.getPath().getName() for s in self._disk.listStatus(self._at(root))]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def columns(self, version: int | None = None) -> DataFrame:
        """column, title, method, path, term_method, term_cutoff, term_path of a version, the last one by default."""
        v = self.version() if version is None else version
        return self.spark.read.schema(ROW).parquet(f"{self.path}/versions/v{v:06d}") if v else self.spark.createDataFrame([], ROW)

    def _commit(self, column: str, **values) -> int:
        version = self.version()
        rows = {r["column"]: r.asDict() for r in self.columns(version).collect()}  # a row per column of p-values
        rows[column] = {**rows.get(column, {"column": column}), **values}
        names = [f.split()[0] for f in ROW.split(", ")]
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows.values()], ROW).coalesce(1).write.parquet(staged)
        target = self._at(f"{self.path}/versions/v{version + 1:06d}")
        self._disk.mkdirs(self._at(f"{self.path}/versions"))
        if self._disk.exists(target) or not self._disk.rename(self._at(staged), target):
            raise RuntimeError(f"version {version + 1} is there already: another writer was first")
        return version + 1

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.path}/values/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def save(self, column: str, rows: DataFrame, title: str = "", method: str = "") -> int:
        """Store seq_id, p as a column, which replaces one of that name; p-values of terms that were made from that one go
        with it. Returns the version."""
        path = self._write(rows.select("seq_id", F.col("p").cast("double").alias("p")))
        return self._commit(column, title=title, method=method, path=path, term_method=None, term_cutoff=None, term_path=None)

    def save_terms(self, column: str, rows: DataFrame, cutoff: float, method: str) -> int:
        """Store gonum, p of terms tested with a stored column's sequences below ``cutoff``. A p-value that is no number is
        stored as a null; a column that is not stored is an error."""
        if not self.columns().where(F.col("column") == column).head(1):
            raise KeyError(f"{column} is not stored")
        p = F.col("p").cast("double")
        path = self._write(rows.select("gonum", F.when(~F.isnan(p), p).alias("p")))
        return self._commit(column, term_path=path, term_cutoff=float(cutoff), term_method=method)

    def _values(self, kind: str, columns: list[str] | None, version: int | None) -> DataFrame:
        key, schema = ("gonum", "gonum int, p double") if kind == "term_path" else ("seq_id", "seq_id long, p double")
        listed = {r["column"]: r[kind] for r in self.columns(version).collect() if r[kind]}
        rows = self.spark.createDataFrame([], f"column string, {schema}")
        for c in listed if columns is None else [c for c in columns if c in listed]:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(listed[c]).select(F.lit(c).alias("column"), key, "p"))
        return rows

    def sequence_values(self, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
        """column, seq_id, p."""
        return self._values("path", columns, version)

    def term_values(self, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
        """column, gonum, p."""
        return self._values("term_path", columns, version)

    def cutoffs(self, columns: list[str], version: int | None = None) -> dict[str, float]:
        """The cutoff that each column's terms were tested with, or the usual one."""
        stored = {r["column"]: r.term_cutoff for r in self.columns(version).collect()}
        return {c: stored.get(c) if stored.get(c) is not None else CUTOFF for c in columns}

    def with_term_values(self, terms: DataFrame, columns: list[str], version: int | None = None) -> DataFrame:
        """Rows of terms with a column for each of ``columns``: its p-value, null where the term has none."""
        wide = self.term_values(columns, version).groupBy("gonum").pivot("column", columns).agg(F.min("p"))
        return terms.join(wide, "gonum", "left")
