"""MATLAB files: what the format holds, what is read of them, and damage."""

import struct

import numpy as np
import pytest

from tessera.sources import mat_source as ms


@pytest.fixture(scope="module")
def mat(spark):
    ms.register(spark)
    return spark


VARIABLES = {
    "x": np.arange(24.0).reshape(2, 3, 4),
    "i": np.array([[1, -2], [3, 4]], np.int16),
    "f": np.array([[1.5, 2.5]], np.float32),
    "z": np.array([[1 + 2j, 3 - 4j]]),
    "yes": np.array([[True, False, True]]),
    "name": "CTé α",
    "none": np.zeros((0, 3)),
    "s": {"dice": np.array([[0.5, 0.75]]), "who": "a", "deep": {"n": np.array([[7]], np.uint8)}},
    "c": ["one", np.array([[2.0]]), ["in"]],
}


def rows_of(df):
    return {r.variable: r for r in df.collect()}


@pytest.mark.parametrize("compress", [False, True])
def test_arrays_texts_cells_and_structures(mat, tmp_path, compress):
    (tmp_path / "a.mat").write_bytes(ms.write_mat(VARIABLES, compress))
    got = rows_of(mat.read.format("mat").load(str(tmp_path)))
    assert got["x"].dims == [2, 3, 4] and got["x"].values == VARIABLES["x"].ravel(order="F").tolist()
    assert got["i"]["class"] == "int16" and got["i"].values == [1.0, 3.0, -2.0, 4.0]
    assert got["f"]["class"] == "single" and got["f"].values == [1.5, 2.5]
    assert got["z"].values == [1.0, 3.0] and got["z"].imag == [2.0, -4.0] and got["x"].imag is None
    assert got["yes"]["class"] == "logical" and got["yes"].values == [1.0, 0.0, 1.0]
    assert got["name"].text == "CTé α" and got["name"].values is None
    assert got["none"].dims == [0, 3] and got["none"].values == []
    assert got["s.dice"].values == [0.5, 0.75] and got["s.who"].text == "a" and got["s.deep.n"].values == [7.0]
    assert got["c{1}"].text == "one" and got["c{2}"].values == [2.0] and got["c{3}{1}"].text == "in"
    assert {r.name_of for r in got.values()} == set(VARIABLES) and all(r.error is None for r in got.values())


@pytest.mark.parametrize("compress", [False, True])
def test_other_variables_are_stepped_over(mat, tmp_path, compress):
    r = np.random.default_rng(1)
    big = {f"big{n}": r.normal(size=(100, 100)) for n in range(5)}
    (tmp_path / "a.mat").write_bytes(ms.write_mat(big | {"small": np.array([[3.0]])} | {"last": r.normal(size=(100, 100))}, compress))
    every = mat.read.format("mat").load(str(tmp_path))
    some = mat.read.format("mat").option("variables", "small, nothing").load(str(tmp_path)).collect()
    assert [(x.variable, x.values) for x in some] == [("small", [3.0])]
    assert some[0].bytes_read < 10_000 < 400_000 < max(x.bytes_read for x in every.collect())


def big_endian(name, values):
    """One double row vector, with its name in the short form."""
    element = lambda kind, data: struct.pack(">2I", kind, len(data)) + data + bytes(-len(data) % 8)
    short = struct.pack(">2H", len(name), 1) + name.ljust(4, b"\0")
    body = element(6, struct.pack(">2I", 6, 0)) + element(5, struct.pack(">2i", 1, len(values))) + short + element(9, np.array(values, ">f8").tobytes())
    return b"MATLAB 5.0".ljust(124) + struct.pack(">H", 0x0100) + b"MI" + element(14, body)


def sparse():
    element = lambda kind, data: struct.pack("<2I", kind, len(data)) + data + bytes(-len(data) % 8)
    body = element(6, struct.pack("<2I", 5, 3)) + element(5, struct.pack("<2i", 3, 2)) + element(1, b"sp") + element(5, struct.pack("<3i", 0, 2, 1)) + element(5, struct.pack("<3i", 0, 2, 3)) + element(9, np.array([1.0, 2.0, 3.0]).tobytes())
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + element(14, body)


def test_byte_orders_sparse_and_damage(mat, tmp_path):
    good = ms.write_mat({"a": np.array([[1.0, 2.0]]), "b": np.arange(50.0)})
    files = {"big": big_endian(b"v", [1.0, -2.5]), "sparse": sparse(), "cut": good[:-100], "short": b"x", "hdf": b"MATLAB 7.3".ljust(124) + struct.pack("<H", 0x0200) + b"IM", "bare": good[:128], "odd": good[:128] + struct.pack("<2I", 99, 8) + bytes(8)}
    for name, raw in files.items():
        (tmp_path / f"{name}.mat").write_bytes(raw)
    (tmp_path / "other.txt").write_bytes(b"no")
    got = {}
    for r in mat.read.format("mat").load(str(tmp_path)).collect():
        got.setdefault(r.name, []).append(r)
    assert [(x.variable, x.values) for x in got["big.mat"]] == [("v", [1.0, -2.5])]
    assert got["sparse.mat"][0].values == [1.0, 0.0, 2.0, 0.0, 3.0, 0.0] and got["sparse.mat"][0]["class"] == "sparse"
    assert [x.variable for x in got["cut.mat"]] == ["a", None] and "ends before" in got["cut.mat"][1].error
    assert got["short.mat"][0].error and got["hdf.mat"][0].error and "type 99" in got["odd.mat"][0].error
    assert "bare.mat" not in got and "other.txt" not in got
