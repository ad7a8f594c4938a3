import struct
import zlib

import numpy as np
import pytest

from oscillar.sources import arrays


def compressed(content):
    z = zlib.compress(content[128:])
    return content[:128] + struct.pack("<II", arrays.MAT_COMPRESSED, len(z)) + z


def struct_bytes(field, content):
    """A MAT file with the struct s whose only field is the matrix of another file."""
    element = lambda kind, c: struct.pack("<II", kind, len(c)) + c + bytes(-len(c) % 8)
    inner = content[128:]
    parts = element(6, struct.pack("<II", 2, 0)) + element(5, struct.pack("<ii", 1, 1)) + struct.pack("<HH4s", 1, 1, b"s")
    parts += struct.pack("<HHi", 5, 4, 32) + element(1, field.encode().ljust(32, b"\0")) + inner
    return content[:128] + element(arrays.MAT_MATRIX, parts)


M = np.arange(60, dtype=np.float64).reshape(20, 3) / 4


@pytest.mark.parametrize("form", ["npy", "fortran", "int16", "npz", "deflated", "mat", "mat_deflated", "mat_struct", "channel_rows", "wide_rows"])
def test_every_form_gives_the_same_ranges(tmp_path, form, monkeypatch):
    """Each partition is read by itself, in blocks of seven samples, from arrays in every order."""
    monkeypatch.setattr(arrays, "BATCH", 7)
    node, axis, m = "signal", 0, M
    if form in ("npy", "fortran", "int16", "channel_rows"):
        node = "data"
        m = (M * 4).astype("<i2") if form == "int16" else M.T.copy() if form == "channel_rows" else np.asfortranarray(M) if form == "fortran" else M
        axis = int(form == "channel_rows")
        np.save(tmp_path / "a.npy", m)
    elif form in ("npz", "deflated", "wide_rows"):
        axis = int(form == "wide_rows")
        (np.savez_compressed if form == "deflated" else np.savez)(tmp_path / "a.npz", signal=M.T.copy() if axis else M, other=np.arange(5))
    else:
        content = arrays.mat_bytes("signal", M)
        content = compressed(content) if form == "mat_deflated" else struct_bytes("f", content) if form == "mat_struct" else content
        node = "s/f/signal" if form == "mat_struct" else "signal"
        (tmp_path / "a.mat").write_bytes(content)
    reader = arrays.ArrayReader(str(tmp_path), {"x": (node, 0), "z": (node, 2)}, axis, 8)
    parts = reader.partitions()
    assert [(p.first, p.end) for p in parts] == ([(0, 20)] if "deflated" in form else [(0, 8), (8, 16), (16, 20)])
    got = [b for p in parts for b in reader.read(p)]
    scale = 4 if form == "int16" else 1
    assert np.array_equal(np.concatenate([np.column_stack([b.column(2), b.column(3)]) for b in got]), M[:, [0, 2]] * scale)
    assert np.concatenate([b.column(1) for b in got]).tolist() == list(range(20))


def test_bounds_become_ranges(spark, tmp_path):
    arrays.write_arrays(spark.range(0, 1000, 1, 3).selectExpr("id", "id * 2.0D AS twice"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*.npz"))) == 3 and not list((tmp_path / "out").glob(".part*"))
    read = lambda: arrays.read_arrays(spark, str(tmp_path / "out"), {"n": ("signal", 0), "twice": ("signal", 1)}, most=100)
    assert sorted(r["n"] for r in read().collect()) == list(range(1000)) and read().rdd.getNumPartitions() == 12
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
        some = read().filter("seq >= 50 AND seq < 60 AND twice >= 0")
        assert some.count() == 30 and some.rdd.getNumPartitions() == 3
        assert read().filter("seq = 5").count() == 3 and read().filter("seq > 400").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_a_failed_task_leaves_nothing_to_see(spark, tmp_path):
    bad = spark.range(0, 100, 1, 4).selectExpr("IF(id = 99, raise_error('broken'), CAST(id AS DOUBLE)) AS x")
    with pytest.raises(Exception, match="broken"):
        arrays.write_arrays(bad, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("part-*"))
    assert arrays.data_files(str(tmp_path / "out"), arrays.ENDINGS) == []


def test_unsound_files_are_errors(tmp_path):
    np.savez(tmp_path / "a.npz", one=np.float64(3), text=np.array(["a"]), cube=np.zeros((2, 2, 2)), x=np.zeros(4), y=np.zeros(5), single=np.zeros((1, 1)))
    plan = lambda axes: arrays.ArrayReader(str(tmp_path / "a.npz"), axes, 0, 10).partitions()
    for axes, says in (({"x": ("gone", 0)}, "no array"), ({"x": ("one", 0)}, "scalar"), ({"x": ("text", 0)}, "not numeric"), ({"x": ("cube", 0)}, "dimensions"), ({"x": ("x", 1)}, "outside"), ({"x": ("x", 0), "y": ("y", 0)}, "differ")):
        with pytest.raises(ValueError, match=says):
            plan(axes)
    assert [(p.first, p.end) for p in plan({"x": ("single", 0)})] == [(0, 1)]
    (tmp_path / "b.npy").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="numeric arrays"):
        arrays.ArrayReader(str(tmp_path / "b.npy"), {"x": ("data", 0)}, 0, 10).partitions()


def test_text_arrays(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t ; x\n0,5; 1.25\n;\n1;-2e1\n")
    assert [tuple(r) for r in arrays.read_text_arrays(spark, str(tmp_path / "a.csv"), {"time": "t", "x": "x"}).collect()] == [(0.5, 1.25), (1.0, -20.0)]
    (tmp_path / "b.csv").write_text("t,x\n1,two\n")
    with pytest.raises(Exception, match="no number in column x: two"):
        arrays.read_text_arrays(spark, str(tmp_path / "b.csv"), {"x": "x"}).collect()
