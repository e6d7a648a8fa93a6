"""Ray and model files as splittable sources."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seisframe.sources import binary


def chunk(inr, npr, nrr, seed):
    rng = np.random.default_rng(seed)
    whole, real = rng.integers(1, 9, (3, npr)).astype("<i4"), rng.normal(size=(3, npr)).astype("<f4")
    arrays = [whole[0], whole[1], real[0], real[1], real[2], whole[2], *rng.normal(size=(2, nrr)).astype("<f4")]
    return struct.pack("<3i", inr, npr, nrr) + b"".join(a.tobytes() for a in arrays)


def test_a_file_of_many_chunks_is_many_tasks(spark, tmp_path):
    chunks = [chunk(i, i % 5, 3 * (i % 7), i) for i in range(200)]
    data = struct.pack("<i", 200) + b"".join(chunks)
    (tmp_path / "many").write_bytes(data)
    (tmp_path / "none").write_bytes(struct.pack("<i", 0))
    (tmp_path / "_hidden").write_bytes(b"not a ray file")
    whole = binary.read_rayfiles(spark, str(tmp_path))
    split = binary.read_rayfiles(spark, str(tmp_path), split_bytes=1000)
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 10
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect())) and split.count() == 200
    # read, written and read again: the same bytes in each chunk
    binary.write_rayfiles(split.coalesce(1).orderBy("inr"), str(tmp_path / "copy"))
    copies = [f for f in (tmp_path / "copy").iterdir() if f.suffix == ".rays"]
    assert [f.read_bytes() for f in copies] == [data]
    assert not [f for f in (tmp_path / "copy").iterdir() if f.is_dir()]
    both = binary.read_rayfiles(spark, [str(tmp_path / "many"), str(copies[0])])
    assert both.groupBy("inr").count().where("count = 2").count() == 200


def test_models_are_read_by_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    files = {}
    for name, (nx, nz, nr) in {"a": (7, 5, 2), "b": (3, 4, 0)}.items():
        files[name] = struct.pack("<3i4f", nx, nz, nr, 0, 250, -2, 60) + rng.normal(size=nx * nr).astype("<f4").tobytes() + rng.integers(1, 3, nx * nr).astype("<i4").tobytes() + rng.normal(size=nx * nz * (nr + 1)).astype("<f4").tobytes()
        (tmp_path / name).write_bytes(files[name])
    meta, boundary, velocity = binary.read_velocity_model(spark, str(tmp_path), split_bytes=50)
    assert (meta.count(), boundary.count(), velocity.count()) == (2, 14, 7 * 5 * 3 + 12)
    assert velocity.rdd.getNumPartitions() > 8 and boundary.rdd.getNumPartitions() == 2
    assert [r.nx for r in meta.orderBy("path").collect()] == [7, 3]
    v = np.frombuffer(files["a"], "<f4", offset=28 + 8 * 14).reshape(3, 7, 5)
    one = velocity.where(F.col("path").endswith("a") & (F.col("ir") == 3) & (F.col("ix") == 6) & (F.col("iz") == 2)).first()
    assert one.v == v[2, 5, 1]
    binary.write_velocity_model(meta.where("nr > 0"), boundary, velocity, str(tmp_path / "copy"))
    assert (tmp_path / "copy" / "a").read_bytes() == files["a"]


def test_overwriting_and_wrong_chunks(spark, tmp_path):
    rows = binary.read_rayfiles(spark, str(_one(tmp_path)))
    for _ in range(2):
        binary.write_rayfiles(rows, str(tmp_path / "out"), "overwrite")
    assert binary.read_rayfiles(spark, str(tmp_path / "out")).count() == 1
    binary.write_rayfiles(rows, str(tmp_path / "out"))
    assert binary.read_rayfiles(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="different lengths"):
        binary.write_rayfiles(rows.withColumn("fas", F.slice("fas", 1, 1)), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*")) and binary.files_of({"path": str(tmp_path / "out")})


def _one(folder):
    (folder / "in").mkdir()
    (folder / "in" / "r").write_bytes(struct.pack("<i", 1) + chunk(4, 3, 6, 1))
    return folder / "in"
