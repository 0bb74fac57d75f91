"""Immutable versions of a table in a directory, with a manifest, quality gates and a pointer to the published one.

Layout: ``root/versions/<version>/data/part_month=...`` (parquet, one part if no date column is named),
``root/versions/<version>/manifest.json`` and ``root/published/<number>.json``. A manifest names for each part
the version that holds it, so a version that replaces some months writes only these. A version is written
whole before its manifest, and the manifest before the pointer, so a lost job leaves nothing that a reader
can see. All files go through Hadoop's file system, so a root may lie on any store that Spark reads.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotPublished(ValueError):
    """A gate failed, or there is nothing to read."""


def _file(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target and renames, so that it appears whole; a file of that name must not exist.

    The rename refuses a name that is taken, so of several writers of a name one succeeds.
    """
    system, target = _file(spark, path)
    _, beside = _file(spark, f"{path}.{uuid4().hex}.new")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(beside, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        system.delete(beside, False)
        raise FileExistsError(path) from e


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, read by the driver; None where there is no such file."""
    system, target = _file(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete_file(spark: SparkSession, path: str) -> None:
    system, target = _file(spark, path)
    system.delete(target, False)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    system, target = _file(spark, path)
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def fingerprint(df: DataFrame) -> Column:
    """Order-independent content hash of all rows: the sum of row hashes and their count."""
    # the sum is taken over decimals, so that it neither overflows nor depends on the order
    return F.concat_ws("-", F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")).cast("string"), F.count(F.lit(1)).cast("string"))


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, month_of: str | None = None):
        self.spark, self.root, self.month_of = spark, root, month_of

    def _at(self, version: str) -> str:
        return f"{self.root}/versions/{version}"

    def write(self, df: DataFrame, version: str, gates: Mapping[str, Column] | None = None, carried: Mapping[str, dict] | None = None) -> dict:
        """Writes a version and checks it. ``gates``: name to a boolean aggregate over the version's rows.

        ``carried``: parts of earlier versions that belong to this one as they are. An existing version is
        never written over. Returns the manifest: rows and fingerprint of each part (a month, or the whole),
        and the version that holds it.
        """
        data = f"{self._at(version)}/data"
        out = df.withColumn("part_month", F.coalesce(F.date_format(self.month_of, "yyyy-MM"), F.lit("none")) if self.month_of else F.lit("all"))
        # rows of a month meet in one task per month and hash, so a month is a few files, not one per task
        spread = out.repartition("part_month", F.pmod(F.xxhash64(*df.columns), F.lit(4))) if self.month_of else out
        spread.write.mode("errorifexists").partitionBy("part_month").parquet(data)
        schema = json.loads(out.schema.json())
        stored = self.spark.read.schema(out.schema).parquet(data)
        # a row per month
        counted = stored.groupBy("part_month").agg(F.count(F.lit(1)).alias("rows"), fingerprint(stored.select(*df.columns)).alias("fingerprint")).collect()
        parts = dict(carried or {}) | {r["part_month"]: {"version": version, "rows": r["rows"], "fingerprint": r["fingerprint"]} for r in counted}
        manifest = {"version": version, "rows": sum(p["rows"] for p in parts.values()), "parts": parts, "columns": df.columns, "schema": schema, "gates": {}}
        if gates:
            row = self._rows(manifest, parts).agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in gates.items()]).first()
            manifest["gates"] = {k: bool(row[k]) for k in gates}
        write_text(self.spark, f"{self._at(version)}/manifest.json", json.dumps(manifest, sort_keys=True))
        return manifest

    def _rows(self, manifest: dict, parts: Mapping[str, dict]) -> DataFrame:
        """The rows of some of a version's parts, each from the version that holds it."""
        schema = T.StructType.fromJson(manifest["schema"])
        found = None
        for holder in sorted({p["version"] for p in parts.values()}):
            data = f"{self._at(holder)}/data"
            own = [f"{data}/part_month={m}" for m, p in sorted(parts.items()) if p["version"] == holder]
            df = self.spark.read.schema(schema).option("basePath", data).parquet(*own)
            found = df if found is None else found.unionByName(df)
        return (found if found is not None else self.spark.createDataFrame([], schema)).select(*manifest["columns"])

    def manifest(self, version: str) -> dict | None:
        text = read_text(self.spark, f"{self._at(version)}/manifest.json")
        return json.loads(text) if text else None

    def _publications(self) -> list[str]:
        return sorted(n for n in list_names(self.spark, f"{self.root}/published") if n.endswith(".json"))

    def publish(self, version: str, expected: str | None = None) -> None:
        """Points readers to a version whose gates all hold; ``expected`` must be the one published before (None: any).

        Publications are numbered; the next number's file is created only if it isn't there, so of two
        publishers that both saw the same one before, one fails.
        """
        manifest = self.manifest(version)
        if manifest is None or not all(manifest["gates"].values()):
            raise NotPublished(f"{version}: {'no manifest' if manifest is None else [k for k, ok in manifest['gates'].items() if not ok]}")
        before = self._publications()
        if expected is not None and self._read_publication(before) != expected:
            raise NotPublished(f"{self._read_publication(before)} is published, not {expected}")
        number = int(before[-1].removesuffix(".json")) + 1 if before else 1
        try:
            write_text(self.spark, f"{self.root}/published/{number:09d}.json", json.dumps({"version": version}))
        except FileExistsError as e:
            raise NotPublished(f"another version was published before {version}") from e

    def _read_publication(self, names: list[str]) -> str | None:
        return json.loads(read_text(self.spark, f"{self.root}/published/{names[-1]}"))["version"] if names else None

    def published(self) -> str | None:
        return self._read_publication(self._publications())

    def read(self, version: str | None = None, start: str | None = None, end: str | None = None, verify: bool = False) -> DataFrame:
        """A version (by default the published one); with ``start`` and ``end``, only the months that can hold them are read."""
        version = version or self.published()
        manifest = self.manifest(version) if version else None
        if manifest is None:
            raise NotPublished("nothing is published")
        parts = manifest["parts"]
        if verify:
            for m, p in parts.items():
                own = self._rows(manifest, {m: p})
                if own.agg(fingerprint(own)).first()[0] != p["fingerprint"]:
                    raise NotPublished(f"{version}: its content has changed")
        if self.month_of and (start or end):
            parts = {m: p for m, p in parts.items() if m != "none" and m >= (start or "0000")[:7] and m <= (end or "9999-99")[:7]}
        df = self._rows(manifest, parts)
        if self.month_of and start:
            df = df.where(F.col(self.month_of) >= F.lit(start).cast("date"))
        if self.month_of and end:
            df = df.where(F.col(self.month_of) <= F.lit(end).cast("date"))
        return df

    def replace_months(self, parent: str, version: str, changed: DataFrame, gates: Mapping[str, Column] | None = None) -> dict:
        """A new version: the months of ``changed``, and the parent's others, which stay where they are and are not written again."""
        before = self.manifest(parent)
        if before is None:
            raise NotPublished(f"there is no version {parent}")
        # a row per month
        months = {r[0] for r in changed.select(F.coalesce(F.date_format(self.month_of, "yyyy-MM"), F.lit("none"))).distinct().collect()}
        return self.write(changed.select(*before["columns"]), version, gates, {m: p for m, p in before["parts"].items() if m not in months})


def upsert(target: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key among ``target`` and ``changes``; changes win ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c not in key]
    best = both.groupBy(*key).agg(F.max(F.struct(*order, "_new", *[c for c in rest if c not in order])).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*target.columns)


def as_json(df: DataFrame, column: str = "payload") -> DataFrame:
    """Each row as one JSON string, NULL fields kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def from_json_rows(df: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """Rows back from JSON strings; a malformed one is a row of NULL."""
    return df.select(F.from_json(column, schema).alias("_r")).select("_r.*")


def read_csv(spark: SparkSession, path: str, schema: str, null: str = ".") -> DataFrame:
    """CSV with a header and a fixed schema; ``null`` marks missing values."""
    return spark.read.csv(path, header=True, schema=schema, nullValue=null, mode="PERMISSIVE", enforceSchema=False)
