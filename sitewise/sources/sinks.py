"""Publication: tables written once or verified, with a manifest as the commit marker, and plain CSV."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.hashing import bucket


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: sums of row hashes, exact, from one aggregation."""
    h = [F.xxhash64(F.lit(s), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})) for s in (1, 2)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(x.cast("decimal(38,0)")).alias(f"h{i}") for i, x in enumerate(h))).first()
    return f"{got['n']}:{got['h0'] or 0}:{got['h1'] or 0}"


def _fs(df: DataFrame, path: str):  # noqa: ANN202
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, spark._jvm.org.apache.hadoop.fs.Path


def _manifest(df: DataFrame, path: str) -> dict:
    fs, where, _ = _fs(df, f"{path}/_manifest.json")
    stream = fs.open(where)
    try:
        return json.loads(df.sparkSession._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(df: DataFrame, path: str, **identity: str) -> str:
    """Write df once under path: staged, renamed, manifest last. If path is published, it must hold the same; returns the digest."""
    fs, target, make = _fs(df, path)
    manifest = f"{path}/_manifest.json"
    spark = df.sparkSession
    if fs.exists(make(manifest)):
        known = _manifest(df, path)
        if known["digest"] != table_digest(df):
            raise ValueError(f"{path} is published with other content")
        return known["digest"]
    if fs.exists(target):
        raise ValueError(f"{path} exists without a manifest")
    staging = f"{path}._staging"
    fs.delete(make(staging), True)
    df.write.parquet(staging)
    digest = table_digest(spark.read.schema(df.schema).parquet(staging))
    if not fs.rename(make(staging), target):
        raise OSError(f"{path} could not be renamed into place")
    out = fs.create(make(manifest), False)
    try:
        out.write(bytearray(json.dumps({"digest": digest, **identity}, sort_keys=True).encode()))
    finally:
        out.close()
    return digest


def read_published(df_or_spark, path: str) -> DataFrame:  # noqa: ANN001
    """A published table; an absent manifest or another content than it names is an error."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    df = spark.read.parquet(path)
    known = _manifest(df, path)
    if table_digest(df) != known["digest"]:
        raise ValueError(f"{path} is not what its manifest says")
    return df


def write_buckets(df: DataFrame, path: str, split: str, key: Column) -> None:
    """Partitioned by split and by the two-digit bucket of the key, so a key's rows are found without a scan."""
    df.withColumn("bucket", bucket(key)).write.partitionBy(split, "bucket").parquet(path)


def csv_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order as text cells: nulls are empty, lists are joined by ';'. Unknown columns are an error."""
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    kinds = dict(df.dtypes)
    cell = lambda c: F.array_join(F.col(c).cast("array<string>"), ";") if kinds[c].startswith("array") else F.col(c).cast("string")
    return df.select(*(F.coalesce(cell(c), F.lit("")).alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    csv_text(df, columns).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)
