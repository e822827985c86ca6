"""Extended XYZ as a data source: one input partition for each byte range, one row for each frame.

A range's reader starts at the first frame that begins in it and reads on past its end until that frame is complete,
so ranges need no index and no planning pass. A frame begins at a line that is only a whole number followed by a line
of key=value fields. Paths are folders, files or globs of any file system that the cluster's Hadoop client knows, read
through its mount or, for file://, directly.

mode 'failfast' (default) raises on a malformed frame; 'permissive' gives a row with `error` and null values and goes
on at the next frame. Where a frame must begin (at byte 0 and after every frame) a line that begins none, a blank one
too, is malformed; the range that has the frame before it answers for it, so this depends on no range's edge. With
labels 'false' the label columns (forces, energy) are never converted.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sitewise.functions.elements import NUMBER_OF, SYMBOLS
from sitewise.operators.prefix import join_value, prefix_by_value
from sitewise.shared import ship

VALUES = "n_atoms int, material_id string, numbers array<int>, positions array<array<double>>, cell array<array<double>>, pbc array<boolean>, cell_volume double, forces array<array<double>>, energy double, error string"
SCHEMA = f"source_file string, byte_offset long, byte_length long, {VALUES}"
CHUNK = 32 << 20


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_header(line: str) -> dict[str, str]:
    """The fields of a header line: words key=value, where a value with blanks stands in double quotes. Words without
    an equals sign are flags and have no value. A repeated key or an open quote is an error."""
    fields: dict[str, str] = {}
    rest = line.strip()
    while rest:
        key, equals, after = rest.partition("=")
        word = key.split()
        if not equals:
            break  # only flags are left
        name = word[-1] if word and not key[-1:].isspace() else ""
        if after.startswith('"'):
            value, closed, rest = after[1:].partition('"')
            if not closed:
                raise ValueError("a quote isn't closed in the header")
        else:
            value, _, rest = after.partition(" ")
        if not name:
            raise ValueError("a header value has no key")
        if name in fields:
            raise ValueError(f"the header has {name} twice")
        fields[name] = value
        rest = rest.lstrip()
    return fields


def layout(properties: str) -> dict[str, slice]:
    """name -> its columns in an atom line, from a Properties value of name:type:width entries."""
    entries = properties.split(":") if properties else []
    names, kinds, widths = entries[0::3], entries[1::3], entries[2::3]
    if len(names) != len(widths) or len(set(names)) != len(names) or not set(kinds) <= set("SRIL") or not all(w.isdecimal() for w in widths):
        raise ValueError("Properties must be distinct entries of name, type and width")
    ends = list(accumulate(int(w) for w in widths))
    return {name: slice(end - int(width), end) for name, end, width in zip(names, ends, widths, strict=True)}


def parse_frame(lines: list[str], *, labels: bool = True) -> dict:
    """Values of one frame from its lines (count, header, atoms)."""
    fields = read_header(lines[1])
    at, n = layout(fields.get("Properties", "")), int(lines[0])
    if n < 1 or len(lines) != n + 2:
        raise ValueError("wrong number of atom lines")
    needed = {"species": 1, "pos": 3} | ({"forces": 3} if labels else {})
    for name, width in needed.items():
        if name not in at or at[name].stop - at[name].start != width:
            raise ValueError(f"Properties lacks {name} of width {width}")
    if labels and "energy" not in fields:
        raise ValueError("the header lacks energy")
    words = [line.split() for line in lines[2:]]
    if {len(w) for w in words} != {max(s.stop for s in at.values())}:
        raise ValueError("an atom line has another number of columns")
    table = np.array(words, object)
    symbols = table[:, at["species"].start]
    strange = sorted(set(symbols) - set(NUMBER_OF))
    if strange:
        raise ValueError(f"unknown element {strange[0]}")
    vectors = lambda name: table[:, at[name]].astype(float)
    out = {"n_atoms": n, "material_id": fields.get("material_id"), "numbers": [NUMBER_OF[s] for s in symbols], "positions": vectors("pos").tolist()}
    if "Lattice" in fields:
        cell = np.array(fields["Lattice"].split(), float)
        if cell.size != 9:
            raise ValueError("Lattice must be nine numbers")
        cell = cell.reshape(3, 3)
        out |= {"cell": cell.tolist(), "cell_volume": float(abs(np.linalg.det(cell)))}
    periodic = fields.get("pbc", "T T T").upper().split()
    if len(periodic) != 3 or not {p[0] for p in periodic} <= {"T", "F"}:
        raise ValueError("pbc must be three flags")
    out["pbc"] = [p[0] == "T" for p in periodic]
    if labels:
        forces, energy = vectors("forces"), float(fields["energy"])
        if not (np.isfinite(energy) and np.isfinite(forces).all()):
            raise ValueError("energy and forces must be finite")
        out |= {"forces": forces.tolist(), "energy": energy}
    return out


def _local(path: str) -> str:
    """A path as Python opens it; folders on other file systems must be mounted."""
    return path.removeprefix("file://").removeprefix("file:")


def _files(path: str) -> list[str]:
    where = _local(path)
    found = glob.glob(os.path.join(where, "*")) if os.path.isdir(where) else glob.glob(where)
    return sorted(p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class ExtxyzReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.mode = options["path"], options.get("mode", "failfast")
        self.labels, self.chunk = options.get("labels", "true") == "true", int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Range]:
        found = _files(self.path)
        if not found:
            raise FileNotFoundError(self.path)
        return [Range(p, s, min(s + self.chunk, n)) for p in found for n in (os.path.getsize(p),) for s in range(0, max(n, 1), self.chunk)]

    def read(self, part: Range) -> Iterator[tuple]:
        names = _names(SCHEMA)
        with open(part.path, "rb") as f:
            f.seek(max(part.start - 1, 0))
            if part.start:
                f.readline()  # the rest of the line that the range before has
            at = f.tell()
            line = f.readline()
            due = part.start == 0  # a frame must begin here
            while line and (at < part.end or due):
                text = line.decode().strip()
                after = f.tell()
                head = f.readline() if text.isdigit() else b""
                if b"=" not in head:  # inside a frame that began before this range, or not a frame
                    if due and self.mode == "failfast":
                        raise ValueError(f"{part.path}: no frame at byte {at}")
                    if due:
                        row = {"source_file": os.path.basename(part.path), "byte_offset": at, "byte_length": after - at, "error": "no frame begins here"}
                        yield tuple(row.get(k) for k in names)
                    due = False
                    at = after
                    f.seek(after)
                    line = f.readline()
                    continue
                if at >= part.end:  # the next range has it
                    break
                body = [f.readline() for _ in range(int(text))]
                end = f.tell()
                row, due = {"source_file": os.path.basename(part.path), "byte_offset": at, "byte_length": end - at}, True
                try:
                    row |= parse_frame([text, head.decode(), *(x.decode() for x in body if x.strip())], labels=self.labels)
                except (ValueError, UnicodeDecodeError) as why:
                    if self.mode == "failfast":
                        raise ValueError(f"{part.path}: frame at byte {at}: {why}") from why
                    row["error"], due = str(why), False
                    f.seek(after)  # go on at the next frame, wherever it begins
                    f.readline()
                yield tuple(row.get(k) for k in names)
                at = f.tell()
                line = f.readline()


class ExtxyzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extxyz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExtxyzReader:  # noqa: ANN001, ARG002
        return ExtxyzReader(self.options)


def read_extxyz(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Frames of a file, a folder or a glob."""
    ship(spark)
    spark.dataSource.register(ExtxyzSource)
    return spark.read.format("extxyz").options(**options).load(path)


def numbered(frames: DataFrame) -> DataFrame:
    """frames with frame_index, counted from 0 within each file by byte offset; by prefix sums, as a file may be large."""
    places = prefix_by_value(frames.select("source_file", "byte_offset"), ["source_file"], "byte_offset", {"_n": F.lit(1)})
    return join_value(frames, places.withColumn("frame_index", F.col("_n_upto") - 1), ["source_file"], "byte_offset", ["frame_index"])


def frame_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a scan: source_file, frame_index, byte_offset, byte_length, n_atoms, material_id, cell_volume and the
    file's digest. A malformed frame or one without material or cell raises."""
    rows = read_extxyz(spark, path).select("source_file", "byte_offset", "byte_length", "n_atoms", "material_id", "cell_volume")
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a frame lacks {c}"))).otherwise(F.col(c)).alias(c)
    whole = numbered(rows.select("source_file", "byte_offset", "byte_length", "n_atoms", need("material_id"), need("cell_volume")))
    return whole.join(digests(spark, path).select("source_file", "sha256"), "source_file")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_file, n_bytes, sha256) of files of any size, each streamed by one task."""
    ship(spark)
    found = _files(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                with open(p, "rb") as f:
                    rows.append((p, os.path.basename(p), os.path.getsize(p), hashlib.file_digest(f, "sha256").hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "source_file", "n_bytes", "sha256"])

    return spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, len(found))).mapInPandas(run, "path string, source_file string, n_bytes long, sha256 string")


def frame_texts(index: DataFrame) -> DataFrame:
    """index(path, byte_offset, byte_length, ...) with `text`: the bytes of each range; one past the file's end raises."""
    ship(index.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.Series(index=pdf.index, dtype=object)
            for p, rows in pdf.groupby("path", sort=False):
                with open(_local(p), "rb") as f:
                    for i, offset, length in zip(rows.index, rows["byte_offset"], rows["byte_length"], strict=True):
                        f.seek(int(offset))
                        data = f.read(int(length))
                        if len(data) != length:
                            raise ValueError(f"{p}: bytes {offset} to {offset + length} go past the end")
                        out[i] = data.decode()
            yield pdf.assign(text=out)

    schema = ", ".join(f"`{n}` {t}" for n, t in index.dtypes)
    return index.mapInPandas(run, f"{schema}, text string")


def read_at(index: DataFrame, labels: bool = True) -> DataFrame:
    """index(path, byte_offset, byte_length) with the values of the frame that stands in each range, and only there."""
    kept = index.select("path", "byte_offset", "byte_length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _names(VALUES)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                lines = text.rstrip("\n").split("\n")
                if not lines[0].strip().isdigit() or len(lines) != int(lines[0]) + 2:
                    raise ValueError("a range doesn't hold exactly one frame")
                got = parse_frame(lines, labels=labels)
                rows.append(tuple(got.get(n) for n in names))
            yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return frame_texts(kept).mapInPandas(run, f"path string, byte_offset long, byte_length long, {VALUES}")


def frame_text() -> Column:
    """One frame as extended XYZ text, from numbers, positions, forces, cell, energy, material_id."""
    symbols = F.array(*(F.lit(s) for s in SYMBOLS))
    show = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), " ")
    atoms = F.transform(F.arrays_zip("numbers", "positions", "forces"), lambda a: F.concat_ws(" ", F.element_at(symbols, a["numbers"]), show(a["positions"]), show(a["forces"])))
    head = F.concat(F.lit('Lattice="'), show(F.flatten("cell")), F.lit('" Properties=species:S:1:pos:R:3:forces:R:3 energy='), F.col("energy").cast("string"), F.coalesce(F.concat(F.lit(' material_id="'), "material_id", F.lit('"')), F.lit("")), F.lit(' pbc="T T T"'))
    return F.concat_ws("\n", F.size("numbers").cast("string"), head, F.array_join(atoms, "\n"))


def write_extxyz(frames: DataFrame, path: str) -> None:
    """Frames as text files of a new folder; rows without positions, forces, cell or energy can't be written and raise."""
    whole = F.col("positions").isNotNull() & F.col("forces").isNotNull() & F.col("cell").isNotNull() & F.col("energy").isNotNull()
    text = F.when(whole, frame_text()).otherwise(F.raise_error(F.lit("a frame lacks geometry or labels")).cast("string"))
    frames.select(text.alias("value")).write.mode("errorifexists").text(path)
