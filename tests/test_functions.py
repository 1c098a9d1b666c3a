import pytest
from pyspark.sql import functions as F

from statelake.functions import (
    absolute_path, canonical_int, date_text, day_number, extension, file_name, hex_rank, is_surrogate, iso_seconds,
    name_index, norm_hex, numeric_max_hex, render_binary, short_hex, stem, to_hex,
)


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_norm_hex(spark):
    given = ["0x000AB", "0x0", "0x", "0x00", "0X0a", "12", None, "text", "0xg"]
    assert apply(spark, norm_hex, given) == ["0xab", "0x0", "0x0", "0x0", "0X0a", "12", None, "text", "0xg"]


def test_numeric_order_of_hex(spark):
    df = spark.createDataFrame([("0x9",), ("0x10",), ("0x00a",)], "n string")
    assert df.agg(numeric_max_hex(F.col("n"))).first()[0] == "0x10"
    assert df.agg(F.max("n")).first()[0] == "0x9"
    assert [r[0] for r in df.orderBy(hex_rank(F.col("n"))).collect()] == ["0x9", "0x00a", "0x10"]


def test_hex_rendering(spark):
    assert apply(spark, to_hex, [b"\x00\xff", b"", None], "binary") == ["0x00ff", "0x", None]
    assert apply(spark, short_hex, [bytes(16), bytes(17), b"\x01", None], "binary") == [
        "0x" + "00" * 16, "0x" + "00" * 16 + "…", "0x01", ""
    ]
    df = spark.createDataFrame([(1, b"\x0a", "s")], "a int, b binary, `c.d` string")
    assert tuple(render_binary(df).first()) == (1, "0x0a", "s")


def test_wide_integers(spark):
    edge = 2 ** 127
    assert apply(spark, canonical_int, ["0012", "0", "000", None, str(2 ** 250), "-05", "+7", " 3 ", "-0"]) == [
        "12", "0", "0", None, str(2 ** 250), "-5", "7", "3", "0"]
    for bad in ("0x10", "abc", "1e3", "", "1 2", "+"):
        with pytest.raises(Exception, match="not an integer"):
            apply(spark, canonical_int, [bad])
    assert apply(spark, is_surrogate, [str(2 ** 127), str(2 ** 127 - 1), "-" + str(2 ** 130)]) == [True, False, False]
    assert apply(spark, is_surrogate, [str(edge - 1), str(edge), str(2 ** 250), "9", None]) == [False, True, True, False, None]


def test_times(spark):
    assert apply(spark, day_number, [0, 86399, 86400, 1754784000], "long") == [0, 0, 1, 20310]
    assert apply(spark, date_text, [0, 1704067199, 1704067200], "long") == ["1970-01-01", "2023-12-31", "2024-01-01"]
    given = ["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00", "2024-01-01", "junk", "2024-01-01T02:00:00+02:00", "", None]
    expected = [1704067200, 1704067200, 1704067200, None, 1704067200, None, None]
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert apply(spark, iso_seconds, given) == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("given,expected", [
    ("http://a/b.PARQUET?x=1.y", ".parquet"), ("a.b/c", ".bin"), ("./x/.bashrc", ".bin"), ("u/a.", "."),
    ("x.tar.gz#frag.js", ".gz"), ("http://host.name", ".bin"), ("", ".bin"), ("/k/z_1.blob.gz", ".gz"),
])
def test_extension(spark, given, expected):
    assert apply(spark, extension, [given]) == [expected]


def test_paths(spark):
    given = ["https://x/y", "././a/b", "/a", "a", "s3://b/k", "", None]
    base = "https://h/data/"
    assert apply(spark, lambda c: absolute_path(c, base), given) == [
        "https://x/y", base + "a/b", base + "a", base + "a", "s3://b/k", base, None
    ]
    assert apply(spark, file_name, ["/a/b.c", "b", "x/"]) == ["b.c", "b", ""]
    assert apply(spark, name_index, ["/l/blob_000012.blob.gz", "blob_7", "a_1_2.arrow", "blob.gz", "x_y.gz"]) == [12, 7, 2, None, None]
    assert apply(spark, stem, ["/a/b.c.d", ".x", "b"]) == ["b.c", ".x", "b"]
    assert apply(spark, lambda c: stem(c, ".blob.gz"), ["/a/b.blob.gz", "c.arrow"]) == ["b", "c.arrow"]
