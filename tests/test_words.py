"""256-bit words read from bytes."""

import random

import pytest
from pyspark.sql import functions as F

from tapeline.functions.hexwords import numbers
from tapeline.sources import onchain as oc


def test_numbers_equal_python(spark):
    rng = random.Random(1)
    values = [0, 1, 2**255, 2**256 - 1, 10**38 - 1, 10**38, 2**126, 2**64, 2**64 - 1]
    values += [rng.getrandbits(rng.choice([10, 60, 64, 100, 128, 200, 256])) for _ in range(300)]
    rows = [(i, "0x" * (i % 2) + "".join(f"{v:064x}" for v in (a, b))) for i, (a, b) in enumerate(zip(values, values[::-1]))]
    rows += [(-1, ""), (-2, None), (-3, f"{7:064x}ab"), (-4, f"{7:064X}a"), (-5, "zz")]
    df = spark.createDataFrame(rows, "id int, data string").repartition(3)
    for kind in ("unsigned", "signed", "exact", "fits"):
        read = df.select("id", numbers(F.col("data"), [kind, kind]).alias("n")).collect()
        got = {r["id"]: (r["n"]["w0"], r["n"]["w1"]) for r in read}
        for i, pair in enumerate(zip(values, values[::-1])):
            for v, g in zip(pair, got[i]):
                if kind == "exact":
                    assert g is None if v >= 10**38 else int(g) == v
                elif kind == "fits":
                    assert g == (v < 10**38)
                else:
                    w = v - 2**256 if kind == "signed" and v >= 2**255 else v
                    assert g == pytest.approx(float(w), rel=1e-15)
        assert got[-1] == got[-2] == got[-5] == (None, None)
        assert got[-3][0] == got[-4][0] == (True if kind == "fits" else 7) and got[-3][1] is None


def test_wide_indices_go_to_dead_letters(spark):
    word = "{:064x}".format
    rows = [
        (f"t{i}", i, "0x" + word(1) * 3 + word(index) + word(5))
        for i, index in enumerate([10**27, 10**38, 2**200])
    ]
    logs = spark.createDataFrame(rows, "tx_hash string, log_index int, data string").select(
        "*", F.lit("p").alias("pool"), F.lit(1).alias("block_ts"),
        F.array(F.lit(oc.RESERVE_DATA_UPDATED), F.lit("0x" + word(9))).alias("topics"),
    )
    updates, _ = oc.src_lending_logs(logs)
    assert [r.liquidity_index for r in updates.collect()] == [10**27, None, None]
    dead = oc.lending_dead_letters(logs).orderBy("log_index").collect()
    assert [r.log_index for r in dead] == [1, 2] and all("liquidity_index" in r.error for r in dead)
