"""Sources and sinks: delimited text, Parquet snapshots, key discovery, genotype files, model tables, run catalogues."""

from __future__ import annotations

import json
import re
import struct
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.functions.columns import nan_to_null
from tessera.operators import prep


def cleaned(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column, once, at the scan."""
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c, t in df.dtypes if t in ("double", "float")})


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header at any address Spark reads (s3a:// too). Give the schema for large files: inferring it reads them twice."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    return cleaned(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))


def tsv(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    return csv(spark, path, schema, "\t", encoding)


def snapshot(spark: SparkSession, root: str, namespace: str, version: str) -> DataFrame:
    """One version of a namespace, kept as Parquet below ``root``."""
    return cleaned(spark.read.parquet(f"{root}/{namespace}/{version}"))


def keys(df: DataFrame, pattern: str) -> list[str]:
    """Columns that a pattern finds."""
    return prep.columns_like(df.columns, pattern)


def expand(df: DataFrame, wanted: str, source_keys: list[str]) -> list[str]:
    """A covariate expression as columns: by pattern in the frame, else as an exact name or pattern among the source's keys."""
    return keys(df, wanted) or [k for k in source_keys if re.search(f"^{wanted}$", k)]


def two_header_csv(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """A table whose first line gives each column's role and whose second names it; the third line, of index names, may follow. Also role -> columns."""
    roles, names = (line.split(",") for line in spark.read.text(path).limit(2).toPandas()["value"])
    for i in range(1, len(roles)):
        roles[i] = roles[i] or roles[i - 1]
    n = len(names)
    index = [names[i] or f"index{i}" for i in range(n)]
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in index)).csv(path)
    drop = {tuple(roles), tuple(names)}
    body = raw.where(~F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in index]).isin(*[",".join(x) for x in drop], ",".join(spark.read.text(path).limit(1).first()[0].split(","))))
    by: dict[str, list[str]] = {}
    for role, name in zip(roles, index, strict=True):
        by.setdefault(role or "index", []).append(name)
    values = [c for r, cs in by.items() if r != "index" for c in cs]
    return body.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in values}), by


# -- sinks ------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str, append: bool = False, header: bool = True, sep: str = ",") -> None:
    df.write.mode("append" if append else "overwrite").option("header", header).option("sep", sep).csv(path)


def associations(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Association results (variant, chrom, pos, beta, p) from CSV, or Avro where the session has that source."""
    schema = "variant string, chrom string, pos long, beta double, p double"
    return csv(spark, path, schema) if kind == "csv" else cleaned(spark.read.format("avro").load(path).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]))


def compute_once(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet at ``path``, made and written first if it isn't complete."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_run(spark: SparkSession, folder: str, info: dict) -> None:
    """A run's facts as one JSON line."""
    spark.createDataFrame([(json.dumps(info, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/info.json")


def runs(spark: SparkSession, root: str, by: str = "precision") -> DataFrame:
    """All runs below ``root``, best first, each with its folder."""
    df = spark.read.json(f"{root}/*/info.json").withColumn("run", F.regexp_extract(F.input_file_name(), r"/([^/]+)/info\.json/", 1))
    return df.orderBy(F.col(by).desc_nulls_last(), "run")


def save_model(spark: SparkSession, path: str, model: dict) -> None:
    """A nested model (numbers, text, lists, arrays, dictionaries) as a table of dotted names and JSON values, with its version."""
    rows: list[tuple[str, str, str]] = [("version", "json", json.dumps(1))]

    def walk(prefix: str, v) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(f"{prefix}.{k}" if prefix else str(k), x)
        elif isinstance(v, np.ndarray):
            rows.append((prefix, f"array:{v.dtype.str}:{','.join(map(str, v.shape))}", json.dumps(v.ravel().tolist())))
        else:
            rows.append((prefix, "json", json.dumps(v.item() if isinstance(v, np.generic) else v)))

    walk("model", model)
    spark.createDataFrame(rows, "name string, kind string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    """What ``save_model`` wrote; the table holds one model, so it is small."""
    out: dict = {}
    for r in spark.read.parquet(path).where("name <> 'version'").collect():
        value = json.loads(r.value)
        if r.kind.startswith("array:"):
            _, dtype, shape = r.kind.split(":")
            value = np.array(value, dtype).reshape([int(x) for x in shape.split(",") if x])
        at = out
        *parents, last = r.name.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out.get("model", {})


# -- genotypes ----------------------------------------------------------------------
class BedPartition(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class BedSource(DataSource):
    """PLINK's BED, BIM and FAM files as (sample, variant, dosage) rows; each partition reads one block of variants.

    Options: path (without extension, on storage that all executors see), block (variants of a partition, 10000).
    """

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "sample string, variant string, dosage tinyint"

    def reader(self, schema: StructType) -> BedReader:
        return BedReader(self.options)


class BedReader(DataSourceReader):
    #: Fixed values of the format: dosage of each 2-bit code; -9 is missing.
    CODES = (2, -9, 1, 0)
    MAGIC = b"\x6c\x1b\x01"

    def __init__(self, options) -> None:
        self.path, self.block = options["path"], int(options.get("block", "10000"))

    def _lines(self, ext: str) -> list[list[str]]:
        with open(f"{self.path}.{ext}") as f:
            return [line.split() for line in f if line.strip()]

    def partitions(self) -> list[BedPartition]:
        n = len(self._lines("bim"))
        return [BedPartition(i, min(i + self.block, n)) for i in range(0, n, self.block)]

    def read(self, part: BedPartition):
        samples, variants = [x[1] for x in self._lines("fam")], [x[1] for x in self._lines("bim")[part.start : part.stop]]
        width = -(-len(samples) // 4)
        with open(f"{self.path}.bed", "rb") as f:
            if f.read(3) != self.MAGIC:
                raise ValueError("not a variant-major BED file")
            f.seek(3 + part.start * width)
            for v in variants:
                raw = np.frombuffer(f.read(width), np.uint8)
                codes = (raw[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[: len(samples)]
                for s, d in zip(samples, np.array(self.CODES, np.int8)[codes].tolist(), strict=True):
                    yield s, v, d


def write_bed(path: str, samples: list[str], variants: list[str], dosages: np.ndarray) -> None:
    """A small BED file set (variants by samples; below 0: missing), for fixtures."""
    code = {d: i for i, d in enumerate(BedReader.CODES)}
    stem = str(PurePosixPath(path))
    with open(f"{stem}.fam", "w") as f:
        f.writelines(f"{s} {s} 0 0 0 -9\n" for s in samples)
    with open(f"{stem}.bim", "w") as f:
        f.writelines(f"1\t{v}\t0\t{i}\tA\tC\n" for i, v in enumerate(variants))
    with open(f"{stem}.bed", "wb") as f:
        f.write(BedReader.MAGIC)
        for row in dosages:
            codes = [code[int(d) if d >= 0 else -9] for d in row]
            codes += [0] * (-len(codes) % 4)
            f.write(struct.pack(f"{len(codes) // 4}B", *[a | b << 2 | c << 4 | d << 6 for a, b, c, d in zip(*[iter(codes)] * 4, strict=True)]))


def wide_genotypes(g: DataFrame, variants: list[str]) -> DataFrame:
    """Samples by chosen variants; the list makes the pivot one pass."""
    return g.where(F.col("variant").isin(*variants)).groupBy("sample").pivot("variant", variants).agg(F.first("dosage"))


def variants_in(spark: SparkSession, positions: DataFrame, ranges: list[str]) -> DataFrame:
    """Rows (chrom, pos, ..) within "chr_start-end" ranges."""
    from tessera.operators.relate import interval_join

    rows = []
    for x in ranges:
        chrom, span = x.rsplit("_", 1)
        a, b = span.split("-")
        rows.append((chrom.removeprefix("chr"), int(a), int(b)))
    return interval_join(positions, spark.createDataFrame(rows, "c string, start long, end long").withColumnRenamed("c", "chrom"), "chrom", "pos", "start", "end", 100_000)


def exon_ranges(df: DataFrame, column: str) -> DataFrame:
    """A cell "[1-5, 9-12]" as one row for each interval."""
    parts = F.explode(F.split(F.regexp_replace(column, r"[\[\] ]", ""), ","))
    return df.withColumn("_x", parts).withColumns({"start": F.split("_x", "-")[0].cast("long"), "end": F.split("_x", "-")[1].cast("long")}).drop("_x")
