import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from sitewise.sources import extxyz, files, sinks

FRAME = '2\nLattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:forces:R:3 energy=-1.5 material_id=mp-1\nLi 0 0 {i} 0.1 0 0\nO 1 1 1 0 0 0\n'


def test_byte_ranges_give_every_frame_once(spark, tmp_path):
    (tmp_path / "a_train.xyz").write_text("".join(FRAME.format(i=i) for i in range(50)))
    whole = extxyz.read_extxyz(spark, str(tmp_path / "a_train.xyz"))
    cut = extxyz.numbered(extxyz.read_extxyz(spark, str(tmp_path / "a_train.xyz"), chunk="100")).orderBy("frame_index").collect()
    assert whole.count() == 50 and [r.positions[0][2] for r in cut] == [float(i) for i in range(50)] and [r.frame_index for r in cut] == list(range(50))
    assert cut[0].numbers == [3, 8] and cut[0].cell_volume == pytest.approx(64) and cut[0].pbc == [True] * 3


def test_malformed(spark, tmp_path):
    (tmp_path / "b.xyz").write_text(FRAME.format(i=0) + "2\nProperties=species:S:1:pos:R:3 energy=1\nLi 0 0 0\nLi 0 0 0\n" + FRAME.format(i=2))
    rows = extxyz.read_extxyz(spark, str(tmp_path / "b.xyz"), mode="permissive").orderBy("byte_offset").collect()
    assert [r.error is None for r in rows] == [True, False, True]
    with pytest.raises(Exception, match="forces"):
        extxyz.read_extxyz(spark, str(tmp_path / "b.xyz")).count()
    assert extxyz.read_extxyz(spark, str(tmp_path / "b.xyz"), labels="false").where("forces is null and error is null").count() == 3
    with pytest.raises(ValueError, match="twice"):
        extxyz.read_header("a=1 a=2")


def test_header_and_layout():
    got = extxyz.read_header('flag Lattice="4 0 0 0 4 0 0 0 4" energy=-1.5 other name="a = b" empty= last')
    assert got == {"Lattice": "4 0 0 0 4 0 0 0 4", "energy": "-1.5", "name": "a = b", "empty": ""}
    assert extxyz.layout("species:S:1:pos:R:3") == {"species": slice(0, 1), "pos": slice(1, 4)}
    for bad in ('x="open', "=1", "a =1"):
        with pytest.raises(ValueError):
            extxyz.read_header(bad)
    for bad in ("species:S", "a:S:1:a:S:1", "a:Q:1", "a:R:x"):
        with pytest.raises(ValueError):
            extxyz.layout(bad)


def test_frames_by_offset(spark, tmp_path):
    """Every frame is found again at its place in the index; a range that isn't one frame is an error."""
    path = tmp_path / "a_val.xyz"
    path.write_text("".join(FRAME.format(i=i) for i in range(9)))
    index = extxyz.frame_index(spark, str(tmp_path)).withColumn("path", F.lit(str(path)))
    rows = index.orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == list(range(9)) and rows[0].sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    assert rows[-1].byte_offset + rows[-1].byte_length == path.stat().st_size
    got = extxyz.read_at(index.where("frame_index in (3, 7)")).orderBy("byte_offset").collect()
    assert [r.positions[0][2] for r in got] == [3.0, 7.0] and got[0].energy == -1.5
    with pytest.raises(Exception, match="exactly one frame"):
        extxyz.read_at(index.withColumn("byte_length", F.col("byte_length") * 2).where("frame_index = 0")).collect()
    with pytest.raises(Exception, match="past the end"):
        extxyz.read_at(index.withColumn("byte_length", F.col("byte_length") * 20)).collect()


@pytest.mark.parametrize("chunk", ["100", "1000000"])
def test_blank_lines_between_frames_are_malformed(spark, tmp_path, chunk):
    (tmp_path / "c.xyz").write_text(FRAME.format(i=0) + "\n" + FRAME.format(i=1) + FRAME.format(i=2))
    rows = extxyz.read_extxyz(spark, str(tmp_path / "c.xyz"), mode="permissive", chunk=chunk).orderBy("byte_offset").collect()
    assert [r.error is None for r in rows] == [True, False, True, True]
    with pytest.raises(Exception, match="no frame at byte"):
        extxyz.read_extxyz(spark, str(tmp_path / "c.xyz"), chunk=chunk).count()


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "raw.zip", "w") as z:
        for n in ("raw/mp-1_0_1_0_0_0.neb/band_optim_step_3.traj", "raw/mp-1_0_1_0_0_0.neb/source.xyz", "raw/mp-1_0_1_0_0_0.neb/", "README.txt", "raw/mp-1_0_1_0_0_0.neb/notes"):
            z.writestr(n, "content")
    m = files.archive_members(spark, str(tmp_path / "*.zip"))
    assert {(r.kind, r.step) for r in m.collect()} == {("band_optim_step", 3), ("source", None), ("directory", None), ("none", None), ("other", None)}
    assert [bytes(r.content) for r in files.member_contents(m.where("kind = 'source'")).collect()] == [b"content"]


def test_csv_json_and_identity(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n4,5\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), ["c", "a"]).collect()] == [("3", "1")]
    with pytest.raises(ValueError, match="missing"):
        files.read_csv(spark, str(tmp_path / "t.csv"), ["z"])
    with pytest.raises(ValueError, match="forbidden"):
        files.read_csv(spark, str(tmp_path / "t.csv"), ["a"], ("a",))
    (tmp_path / "o.jsonl").write_text('{"x-optimade": {}}\n{"type": "structures"}\n{"id": 1}\n[1]\n{bad\n')
    assert {r.kind: r.n for r in files.jsonl_profile(spark, str(tmp_path / "o.jsonl")).collect()} == {"header": 1, "structures": 1, "untyped": 1, "no_object": 1, "unparsed": 1}
    i = {r.path.rsplit("/", 1)[1]: r for r in files.file_identity(spark, str(tmp_path), 30).collect()}
    assert i["t.csv"].sha256 and i["o.jsonl"].sha256 is None


def test_publish_once(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.range(10).withColumn("v", F.when(F.col("id") > 5, F.col("id")))
    assert sinks.publish(df, path, code="x") == sinks.publish(df.orderBy(F.desc("id")), path)
    with pytest.raises(ValueError, match="other content"):
        sinks.publish(df.limit(9), path)
    assert sinks.read_published(spark, path).count() == 10
    with pytest.raises(ValueError, match="unknown"):
        sinks.csv_text(df, ["zz"])
