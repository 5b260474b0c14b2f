"""Tables that grow together: rows of all tables are written by one job and become visible by one commit, or not at all.

A Python data source: tasks write Parquet files aside and report them, the driver publishes the list of files that
succeeded. A task that fails, or is lost and runs again, leaves files that no list names. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.assertions import required

FORMAT, TABLE = "table_set", "_table"


def _place(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return system, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: table and name."""

    files: list


class TableSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool):
        return TableSetWriter(self.options["root"], json.loads(self.options["columns"]), int(self.options["version"]))


class TableSetWriter(DataSourceArrowWriter):
    def __init__(self, root: str, columns: dict[str, list[str]], version: int):
        self.root, self.columns, self.version, self.run = root, columns, version, uuid.uuid4().hex

    def write(self, iterator):
        system, path = _place(self.root)
        open_files, files = {}, []
        try:
            for batch in iterator:
                names = batch.column(batch.schema.get_field_index(TABLE))
                for table in names.unique().to_pylist():
                    part = batch.filter(pc.equal(names, table)).select(self.columns[table])
                    if table not in open_files:
                        system.create_dir(f"{path}/data/{self.run}/{table}")
                        name = f"data/{self.run}/{table}/{uuid.uuid4().hex}.parquet"
                        open_files[table] = pq.ParquetWriter(f"{path}/{name}", part.schema, filesystem=system, compression="zstd")
                        files.append([table, name])
                    open_files[table].write_batch(part)
        finally:
            for f in open_files.values():
                f.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, path = _place(self.root)
        system.create_dir(f"{path}/commits")
        target = f"{path}/commits/{self.version:012d}.json"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            raise RuntimeError(f"version {self.version} of {self.root} was committed by someone else")
        body = {"version": self.version, "tables": self.columns, "files": [f for m in messages if m is not None for f in m.files]}
        with system.open_output_stream(f"{path}/.{self.run}.tmp") as out:
            out.write(json.dumps(body).encode())
        system.move(f"{path}/.{self.run}.tmp", target)

    def abort(self, messages) -> None:
        system, path = _place(self.root)
        if system.get_file_info(f"{path}/data/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/data/{self.run}")


def _commits(root: str) -> list[dict]:
    system, path = _place(root)
    found = system.get_file_info(fs.FileSelector(f"{path}/commits", allow_not_found=True))
    names = sorted(f.path for f in found if f.extension == "json")
    return [json.loads(system.open_input_stream(n).read()) for n in names]


def read_set(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables as of the last commit. The driver sees names of files only."""
    commits = _commits(root)
    base = root if "://" in root or root.startswith("file:") else f"file://{root}"
    out = {}
    for table in {t for c in commits for t in c["tables"]}:
        paths = [f"{base.rstrip('/')}/{n}" for c in commits for t, n in c["files"] if t == table]
        if paths:
            out[table] = spark.read.parquet(*paths)
    return out


def _refusal(rows: DataFrame, code: str, table: str, key: list[str]) -> DataFrame:
    return rows.select(F.lit("-").alias("tenant_id"), F.lit(code).alias("code"), F.concat_ws("|", F.lit(table), *key).alias("detail"))


def insert(spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: dict[str, list[str]], once: dict[str, list[str]] | None = None) -> None:
    """Inserts what is absent by key into every table, as one commit.

    keys: the key of each table; rows whose key is stored already are left out, equal rows are one, and one key with
    different rows fails the job as AMBIGUOUS_KEY. once: columns of a table that a key fixes for good; another value for a stored key fails the job as
    WRITTEN_ONCE and commits nothing. Columns of one name have one type in all tables. Tables without rows are part of a
    commit without files.
    """
    spark.dataSource.register(TableSet)
    stored, parts, wrong = read_set(spark, root), [], []
    for name, df in tables.items():
        key = keys[name]
        new = df.dropDuplicates(key)
        twice = df.groupBy(*key).agg(F.count_distinct(F.to_json(F.struct(*df.columns))).alias("n")).where("n > 1")
        wrong.append(_refusal(twice, "AMBIGUOUS_KEY", name, key))
        if name in stored:
            for column in (once or {}).get(name, []):
                fixed = stored[name].select(*key, F.col(column).alias("_fixed"))
                bad = new.join(fixed, key).where(~F.col(column).eqNullSafe(F.col("_fixed")))
                wrong.append(_refusal(bad, "WRITTEN_ONCE", name, key))
            new = new.join(stored[name].select(*key).distinct(), key, "left_anti")
        parts.append(new.select(F.lit(name).alias(TABLE), *df.columns))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = required(rows, reduce(DataFrame.unionByName, wrong))
    columns = {n: df.columns for n, df in tables.items()}
    rows.write.format(FORMAT).mode("append").option("root", root).option("columns", json.dumps(columns)).option("version", str(len(_commits(root)) + 1)).save()
