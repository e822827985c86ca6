"""File identities, strict CSV, JSON lines and archives."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sitewise.functions.ids import edge_parts, plain_id
from sitewise.shared import ship

HASH_LIMIT = 10 << 20


def file_identity(spark: SparkSession, path: str, limit: int = HASH_LIMIT) -> DataFrame:
    """(path, n_bytes, modified, sha256) of the files of a folder; larger files than limit have no digest."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"), F.when(F.col("length") <= limit, F.sha2("content", 256)).alias("sha256"))


def read_csv(spark: SparkSession, path: str, wanted: list[str], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """The wanted columns of CSV files as text; a missing or forbidden column is an error, short rows are dropped."""
    bad = set(wanted) & set(forbidden)
    if bad:
        raise ValueError(f"forbidden columns asked for: {sorted(bad)}")
    header = spark.read.option("header", True).csv(path).limit(0).columns
    missing = set(wanted) - set(header)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    schema = ", ".join(f"`{c}` string" for c in header) + ", `_short` string"
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_short").schema(schema).csv(path)
    return rows.where("_short is null").select(*wanted)


def jsonl_profile(spark: SparkSession, path: str) -> DataFrame:
    """(kind, n): lines of JSON-lines files that are a header, typed, untyped, no object, or don't parse."""
    t = spark.read.text(path).where(F.btrim("value") != "")
    keys = F.json_object_keys("value")
    ok = F.try_parse_json("value").isNotNull()
    kind = F.when(~ok, "unparsed").when(~F.col("value").rlike(r"^\s*\{"), "no_object").when(F.array_contains(keys, "x-optimade"), "header").when(F.get_json_object("value", "$.type").isNotNull(), F.get_json_object("value", "$.type")).otherwise("untyped")
    return t.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[_Archive]:
        import glob

        return [_Archive(p) for p in sorted(glob.glob(self.path))]

    def read(self, part: _Archive) -> Iterator[tuple]:
        with zipfile.ZipFile(part.path) as z:  # the central directory only; nothing is unpacked
            for i in z.infolist():
                yield part.path, i.filename, i.file_size, i.compress_size, i.CRC, i.header_offset, bool(i.flag_bits & 1)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, name string, n_bytes long, n_packed long, crc long, header_offset long, encrypted boolean"

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001, ARG002
        return ArchiveReader(self.options)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of ZIP archives with the kind and step of what they are: (…, edge_id, kind, step)."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    m = spark.read.format("archive_members").load(path)
    inside = F.regexp_extract("name", r"([^/]+)\.neb/(.*)$", 2)
    edge = F.nullif(F.regexp_extract("name", r"([^/]+)\.neb/", 1), F.lit(""))
    step = F.nullif(F.regexp_extract(inside, r"^band_optim_step_(\d+)\.(?:traj|xyz)$", 1), F.lit("")).try_cast("int")
    kind = F.when(edge.isNull(), "none").when(inside == "", "directory").when(step.isNotNull(), "band_optim_step").when(inside.isin("source.xyz", "target.xyz"), F.regexp_extract(inside, r"^(\w+)\.", 1)).when(inside.isin("traj_init.xyz", "traj_init.traj"), "traj_init").otherwise("other")
    return m.select("*", edge.alias("edge_id"), kind.alias("kind"), step.alias("step"))


def member_contents(members: DataFrame) -> DataFrame:
    """(archive, name, content): contents of the members asked for, size and CRC checked; an encrypted one is an error."""
    ship(members.sparkSession)

    def read(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in frames:
            out = []
            for path, group in pdf.groupby("archive", sort=False):
                with zipfile.ZipFile(path) as z:
                    for r in group.itertuples():
                        if r.encrypted:
                            raise ValueError(f"{r.name} is encrypted")
                        data = z.read(r.name)  # raises where the CRC differs
                        if len(data) != r.n_bytes:
                            raise ValueError(f"{r.name} has another size")
                        out.append((path, r.name, data))
            yield pd.DataFrame(out, columns=["archive", "name", "content"])

    return members.select("archive", "name", "n_bytes", "encrypted").mapInPandas(read, "archive string, name string, content binary")


def short_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each CSV file: n_rows, and n_short, those with another number of cells than the header or with none filled."""
    header = spark.read.option("header", True).csv(path).limit(0).columns
    schema = ", ".join(f"`{c}` string" for c in header) + ", `_short` string"
    rows = spark.read.option("header", True).option("columnPruning", False).option("columnNameOfCorruptRecord", "_short").schema(schema).csv(path)
    # Spark doesn't read the mark of bad rows alone, so a cell is looked at too: a row without any is short in any case
    short = F.col("_short").isNotNull() | F.coalesce(*(F.col(f"`{c}`") for c in header)).isNull()
    return rows.select(F.col("_metadata.file_path").alias("path"), short.alias("short")).groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("short").alias("n_short"))


def select_index(spark: SparkSession, paths: list[str], required: list[str]) -> str:
    """The one CSV file among paths whose header has all required columns; none or several is an error."""
    fit = [p for p in paths if set(required) <= set(spark.read.option("header", True).csv(p).limit(0).columns)]
    if len(fit) != 1:
        raise ValueError(f"{len(fit)} files have the columns {required}")
    return fit[0]


def datasets(listing: DataFrame, root: str, variants: tuple[str, ...] = ("", "_subsample", "_sample")) -> DataFrame:
    """(dataset, variant, path) of the files below root: a dataset is a folder's name without its variant's ending.

    Of a dataset's variants only the first of `variants` that has files is kept, so they are never mixed. listing: path.
    """
    inner = F.regexp_extract("path", rf"{root.rstrip('/')}/([^/]+)/", 1)
    ending = F.lit("")
    for v in (x for x in variants if x):
        ending = F.when(F.lower(inner).endswith(v), v).otherwise(ending)
    place = F.array_position(F.array(*(F.lit(v) for v in variants)), ending)
    rows = listing.where(inner != "").select(F.substring(inner, F.lit(1), F.length(inner) - F.length(ending)).alias("dataset"), ending.alias("variant"), "path", place.alias("_place"))
    best = rows.groupBy("dataset").agg(F.min("_place").alias("_place"))
    return rows.join(best, ["dataset", "_place"]).select("dataset", "variant", "path")


def jsonl_summary(spark: SparkSession, path: str, line_limit: int = 1_000_000, examples: int = 20) -> DataFrame:
    """One row about the first line_limit lines of JSON-lines files (gzip too): lines, truncated, header_present, ids and
    how many, structures without id, distinct attribute keys, unparsed lines."""
    lines = spark.read.text(path).where(F.btrim("value") != "").limit(line_limit + 1).withColumn("n", F.monotonically_increasing_id())
    total = lines.count()
    t = lines.limit(line_limit)
    kind = F.get_json_object("value", "$.type")
    ok = F.try_parse_json("value").isNotNull()
    header = ok & F.coalesce(F.array_contains(F.json_object_keys("value"), "x-optimade"), F.lit(False))
    structure = ok & ~header & F.coalesce(kind == "structures", F.lit(False))
    own = F.nullif(F.get_json_object("value", "$.id"), F.lit(""))
    keys = F.coalesce(F.json_object_keys(F.get_json_object("value", "$.attributes")), F.array().cast("array<string>"))
    one = t.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.bool_or(header), F.lit(False)).alias("header_present"), F.countDistinct(F.when(structure, own)).alias("n_ids"), F.count_if(structure & own.isNull()).alias("n_without_id"), F.count_if(~ok).alias("n_unparsed"))
    attributes = t.where(structure).select(F.explode(keys).alias("key")).distinct().agg(F.array_sort(F.collect_set("key")).alias("attribute_keys"))  # names of a schema
    first = t.where(structure & own.isNotNull()).select(own.alias("id")).distinct().orderBy("id").limit(examples).agg(F.array_sort(F.collect_list("id")).alias("id_examples"))
    return one.crossJoin(attributes).crossJoin(first).withColumn("truncated", F.lit(total > line_limit))


#: The classes of words that a text about the data may touch on.
KEYWORDS = {
    "material": r"\bmaterial\w*",
    "structure": r"\bstructure\w*",
    "trajectory": r"\btrajector\w*",
    "temperature": r"\btemperature\w*",
    "timestep": r"\btime\s*step\w*",
    "diffusion": r"\bdiffusion\w*|\bdiffusivit\w*",
    "msd": r"\bmsd\b|mean[- ]squared?[- ]displacement",
    "energy": r"\benerg\w*",
    "force": r"\bforce\w*",
    "stress": r"\bstress\w*",
    "provenance": r"\bprovenance\w*",
}


def keywords(text):  # noqa: ANN001, ANN201
    """The classes of KEYWORDS that a text column touches, joined by ';'."""
    t = F.lower(text)
    return F.array_join(F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(k)) for k, p in KEYWORDS.items()))), ";")


def file_sketch(spark: SparkSession, path: str, limit: int = HASH_LIMIT) -> DataFrame:
    """(path, format, n_lines, n_rows, columns, keys, keywords) of the text files of a folder up to limit bytes.

    A CSV has its header's columns and its rows, a YAML file the keys at the left of its lines, a text its keyword
    classes; another file only its format.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= limit)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin("md", "txt", "rst"), "text").when(suffix.isin("yaml", "yml"), "yaml").when(suffix == "csv", "csv").otherwise(F.when(suffix != "", suffix).otherwise("unknown"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s != "")
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:- )?([A-Za-z_][\w.-]*)\s*:(?:\s|$)"), 1)))
    return f.select("path", kind.alias("format"), F.size(lines).alias("n_lines"), F.when(kind == "csv", F.greatest(F.size(lines) - 1, F.lit(0))).alias("n_rows"), F.when(kind == "csv", F.split(F.get(lines, F.lit(0)), ",")).alias("columns"), F.when(kind == "yaml", keys).alias("keys"), F.when(kind.isin("text", "yaml"), keywords(text)).alias("keywords"))


def archive_containers(spark: SparkSession, path: str, markers: tuple[str, ...] = ("metadata.json", "db.sqlite3", "data.json"), limit: int = 1 << 20) -> DataFrame:
    """(archive, is_zip, n_members, has_<marker>..., metadata_keys): what a container is, without unpacking it; the keys
    of metadata.json are read up to limit bytes."""
    import glob

    ship(spark)
    found = sorted(glob.glob(path.removeprefix("file://")))
    names = [f"has_{m.replace('.', '_')}" for m in markers]

    def run(frames):  # noqa: ANN001, ANN202
        import json

        import pandas as pd

        for pdf in frames:
            rows = []
            for p in pdf["archive"]:
                if not zipfile.is_zipfile(p):
                    rows.append((p, False, 0, *(False for _ in names), None))
                    continue
                with zipfile.ZipFile(p) as z:
                    inside, keys = z.namelist(), None
                    if "metadata.json" in inside and z.getinfo("metadata.json").file_size <= limit:
                        value = json.loads(z.read("metadata.json"))
                        keys = sorted(value) if isinstance(value, dict) else None
                    rows.append((p, True, len(inside), *(m in inside for m in markers), keys))
            yield pd.DataFrame(rows, columns=["archive", "is_zip", "n_members", *names, "metadata_keys"])

    schema = ", ".join(["archive string, is_zip boolean, n_members long", *(f"{n} boolean" for n in names), "metadata_keys array<string>"])
    return spark.createDataFrame([(p,) for p in found], "archive string").mapInPandas(run, schema)


def archive_hops(members: DataFrame) -> DataFrame:
    """(archive, material_id, edge_id, n_steps, last_step, contiguous, n_endpoints, n_other) of archive_members(): one
    row for each hop folder; material_id is null where the edge id doesn't parse."""
    step = F.when(F.col("kind") == "band_optim_step", F.col("step"))
    a = members.where("edge_id is not null").groupBy("archive", "edge_id").agg(F.countDistinct(step).alias("n_steps"), F.max(step).alias("last_step"), F.min(step).alias("_first"), F.countDistinct(F.when(F.col("kind").isin("source", "target", "traj_init"), F.col("kind"))).alias("n_endpoints"), F.count_if(F.col("kind") == "other").alias("n_other"))
    return a.select("archive", edge_parts(plain_id(F.col("edge_id")))["material"].alias("material_id"), "edge_id", "n_steps", "last_step", ((F.col("_first") == 0) & (F.col("last_step") == F.col("n_steps") - 1)).alias("contiguous"), "n_endpoints", "n_other")


def archive_problems(members: DataFrame) -> DataFrame:
    """(archive, name, problem): duplicate (another member of its hop, kind and step stands before it), no_hop,
    unparseable (of a hop whose id isn't one), unrecognised (in a hop, but none of its files)."""
    w = Window.partitionBy("archive", "edge_id", "kind", "step").orderBy("header_offset")
    known = F.col("kind").isin("band_optim_step", "source", "target", "traj_init")
    rows = members.withColumn("_again", F.row_number().over(w) > 1).withColumn("_material", edge_parts(plain_id(F.col("edge_id")))["material"])
    found = F.array_compact(F.array(F.when(known & F.col("_again"), "duplicate"), F.when(F.col("edge_id").isNull(), "no_hop"), F.when(F.col("edge_id").isNotNull() & F.col("_material").isNull(), "unparseable"), F.when(F.col("kind") == "other", "unrecognised")))
    return rows.select("archive", "name", F.explode(found).alias("problem"))


def member_frames(members: DataFrame, labels: bool = True) -> DataFrame:
    """(archive, name, place, values of the frame...) of the extended XYZ members asked for; another kind of member is an error."""
    from sitewise.sources.extxyz import VALUES, _names, parse_frame

    def run(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                if not r.name.endswith((".xyz", ".extxyz")):
                    raise ValueError(f"{r.name} is no extended XYZ")
                lines, at, place = r.content.decode().rstrip("\n").split("\n"), 0, 0
                while at < len(lines):
                    if not lines[at].strip().isdigit():
                        raise ValueError(f"{r.name}: no frame at line {at + 1}")
                    end = at + int(lines[at]) + 2
                    got = parse_frame(lines[at:end], labels=labels)
                    rows.append((r.archive, r.name, place, *(got.get(n) for n in _names(VALUES))))
                    at, place = end, place + 1
            yield pd.DataFrame(rows, columns=["archive", "name", "place", *_names(VALUES)])

    return member_contents(members).mapInPandas(run, f"archive string, name string, place int, {VALUES}")


def load_config(path: str, required: tuple[str, ...], outputs: tuple[str, ...] = (), data_root: str | None = None) -> dict:
    """A JSON configuration read on the driver: missing keys, and outputs below the data's root, are errors."""
    import json
    from pathlib import Path

    value = json.loads(Path(path).read_text())
    missing = [k for k in required if k not in value]
    if missing:
        raise ValueError(f"the configuration lacks {missing}")
    for k in outputs:
        if data_root is not None and Path(value[k]).resolve().is_relative_to(Path(data_root).resolve()):
            raise ValueError(f"{k} lies below the data")
    return value
