import random

import pytest
from pyspark.sql import functions as F

from tests.util import make, rows
from tracelake import functions as fn
from tracelake.functions.names import REGISTRY_OPS, WAIT_REASONS


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = ((h ^ b) * 1099511628211) % (1 << 64)
    return h


def signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def test_start_key_is_bit_exact(spark):
    rng = random.Random(1)
    cases = [(rng.getrandbits(32), rng.getrandbits(32), rng.getrandbits(64) or 1) for _ in range(200)]
    cases += [(0xFFFFFFFF, 0xFFFFFFFF, (1 << 64) - 1), (0, 0, 1)]
    df = make(spark, "pid bigint, parent bigint, ptr bigint", *[(p, q, signed(r)) for p, q, r in cases])
    got = df.select("pid", "parent", "ptr", fn.pseudo_start_key(F.col("pid"), F.col("parent"), F.col("ptr")).alias("key"))
    for pid, parent, ptr, key in rows(got):
        data = (ptr % (1 << 64)).to_bytes(8, "little") + pid.to_bytes(4, "little") + parent.to_bytes(4, "little")
        assert key == signed(fnv(data))


def test_pointer_zero_has_no_key(spark):
    assert one(spark, fn.pseudo_start_key(F.lit(1), F.lit(2), F.lit(0))) is None


def test_sequence_and_failure_keys(spark):
    assert one(spark, fn.sequence_start_key(F.lit(3), F.lit(77))) == (3 << 48) | 77
    key = fn.failure_key(F.lit(1), F.lit(1), F.lit(0xFFFF))
    assert one(spark, key) == (1 << 24) | (1 << 16) | 0xFFFF
    assert tuple(one(spark, fn.unpack_failure_key(key))) == (1, 1, 0xFFFF)


@pytest.mark.parametrize("code, name", [(0, "Executive"), (37, "MaximumWaitReason"), (38, None), (255, None), (-1, None)])
def test_wait_reason(spark, code, name):
    assert one(spark, fn.wait_reason_name(F.lit(code))) == name


@pytest.mark.parametrize("code, name", [(10, "create"), (27, "close"), (33, "mount_hive"), (9, None), (34, None)])
def test_registry_op(spark, code, name):
    assert one(spark, fn.registry_op_name(F.lit(code))) == name


def test_enumerations(spark):
    assert len(WAIT_REASONS) == 38 and len(REGISTRY_OPS) == 24
    assert [one(spark, fn.disk_op_name(F.lit(i))) for i in range(3)] == ["read", "write", "flush"]
    assert [one(spark, fn.protocol_name(F.lit(i))) for i in range(3)] == ["tcp", "udp", "unknown"]
    assert [one(spark, fn.address_family_name(F.lit(i))) for i in (2, 23, 99)] == ["ipv4", "ipv6", "ipv4"]
    assert [one(spark, fn.result_name(F.lit(i))) for i in (0, 1, 0xC0000034)] == ["success", "failure", "failure"]


@pytest.mark.parametrize("path, base", [("C:\\x\\foo.SYS", "foo.SYS"), ("/a/b", "b"), ("plain", "plain"), ("C:\\x/y", "y")])
def test_base_name(spark, path, base):
    assert one(spark, fn.base_name(F.lit(path))) == base


def test_labels_and_units(spark):
    assert [one(spark, fn.hex_label(F.lit(v).cast("bigint"))) for v in (0, 255, 4096)] == ["0x0", "0xff", "0x1000"]
    assert [one(spark, fn.micros(F.lit(v).cast("bigint"))) for v in (999, 1000, -1500)] == [0, 1, -1]
    assert one(spark, fn.millis(F.lit(1_500_000).cast("bigint"))) == 1.5
    assert [one(spark, fn.is_exe(F.lit(v))) for v in ("a.EXE", "exe", "a.exe.txt")] == [True, False, False]
    assert [one(spark, fn.is_full_path(F.lit(v))) for v in ("a\\b", "a/b")] == [True, False]


def test_addresses_keep_unsigned_order(spark):
    values = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    df = make(spark, "i int, bits bigint", *[(i, signed(v)) for i, v in enumerate(values)])
    flipped = df.select("i", fn.to_signed_address(F.col("bits")).alias("a"), "bits")
    assert [r["i"] for r in flipped.orderBy("a").collect()] == [0, 1, 2, 3, 4]
    assert flipped.filter(fn.from_signed_address(F.col("a")) != F.col("bits")).count() == 0
