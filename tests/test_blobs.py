"""Blobs: put, removed, put again; sizes of key ranges."""

from lodeseek.sources import store as st


def test_blobs(spark, tmp_path):
    path = str(tmp_path / "blobs")
    rows = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"")), ("c", None)], "key string, data binary")
    st.put_blobs(rows, path)
    keys = spark.createDataFrame([("a",), ("b",), ("x",)], "key string")
    exists = lambda: {r["key"]: r["exists"] for r in st.blob_exists(spark, path, keys).collect()}
    assert exists() == {"a": True, "b": True, "x": False}
    st.remove_blobs(keys.filter("key <> 'b'"), path)
    assert exists() == {"a": False, "b": True, "x": False}
    assert sorted(r["key"] for r in st.get_blobs(spark, path).collect()) == ["b", "c"]
    st.put_blobs(rows.filter("key = 'a'"), path)
    assert exists()["a"] and {r["key"]: r["data"] for r in st.get_blobs(spark, path).collect()}["a"] == b"one"


def test_range_size(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "é")], "key string, value string")
    assert [st.range_size(rows, *r).first()["bytes"] for r in (("a", "b"), ("a", "c"), ("c", "d"), ("x", "z"))] == [3, 4, 3, 0]
