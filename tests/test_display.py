"""Scalar displays on values that the small tables lack."""

import base64

from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import admission as A


def test_long_blobs_are_shown_in_one_line(spark, tmp_path):
    blobs = [b"\xff" + b"a" * n for n in (0, 56, 57, 113, 114, 500)] + [b"", b"a\r\n" * 100, None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b binary").select("i", A.blob_display(F.col("b")).alias("shown"))
    want = {i: b if b is None else b.decode() if b[:1] != b"\xff" else "base64:" + base64.b64encode(b).decode() for i, b in enumerate(blobs)}
    assert dict(rows.collect()) == want
    url = "http://example.net/" + "x" * 150
    spark.createDataFrame([(3, url), (4, url)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    shown = dict(plans.QUERIES["blob_display"](spark, str(tmp_path)).collect())
    assert shown == {3: "base64:" + base64.b64encode(b"\xff" + url.encode()).decode(), 4: url}


def test_bytes_beyond_a_long_are_exact(spark, tmp_path):
    scales = {0: 1, 1: 999, 2: 1048577, 3: 1073741823, 4: 1099511627777}

    def shown(n):
        power = next((p for p in (4, 3, 2, 1) if n >= 1024**p), 0)
        return f"{n / 1024**power:.1f} {('KiB', 'MiB', 'GiB', 'TiB')[power - 1]}" if power else f"{n} B"

    def check(name, keys, kind):
        spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        got = plans.QUERIES["format_bytes"](spark, f"{tmp_path}/{name}")
        assert dict(got.dtypes)["n"] == kind
        products = {k: None if k is None else k * (scales[k % 5] if k >= 0 else scales[-(-k % 5) % 5] if k % 5 == 0 else scales[4]) for k in keys}
        assert {r[0]: (r[1] if r[1] is None else int(r[1]), r[2]) for r in got.collect()} == {k: (n, None if n is None else shown(n)) for k, n in products.items()}

    fits = [0, 1, 4, 1_023, 8_388_604, 8_388_608, -1, -4, -5, None]
    check("fits", fits, "bigint")
    check("wide", [*fits, 8_388_609, 8_400_004, 8_999_999, 10**12 + 4, 2**63 - 3], "decimal(38,0)")
