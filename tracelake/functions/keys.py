"""Start keys, packed keys and address representation.

64-bit unsigned values are carried as ``bigint`` bit patterns. Keys are only compared for
equality, so the bit pattern is enough; addresses also need order and have their sign bit
flipped by :func:`to_signed_address`.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# 64-bit FNV-1a offset basis (as two 32-bit halves) and prime (2^40 + 0x1B3).
FNV_BASIS_HIGH = 0xCBF29CE4
FNV_BASIS_LOW = 0x84222325
FNV_PRIME_LOW = 0x1B3

LOW32 = 0xFFFFFFFF
SIGN_BIT = -(1 << 63)
BOOT_SHIFT = 48


def _little_endian(value: Column, width: int) -> list[Column]:
    return [F.shiftright(value.cast("bigint"), 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(width)]


def pseudo_start_key(pid: Column, parent_pid: Column, process_ptr: Column) -> Column:
    """64-bit FNV-1a over (pointer, pid, parent pid); null for pointer 0.

    The running hash is held as two 32-bit halves, because one 64-bit product would
    overflow and raise in ANSI mode. Multiplying by the prime adds ``low << 8`` to the upper half
    (its 2^40 term) and ``0x1B3 * half`` to each half.
    """
    data = F.array(*_little_endian(process_ptr, 8), *_little_endian(pid, 4), *_little_endian(parent_pid, 4))

    def absorb(acc: Column, byte: Column) -> Column:
        low = acc["low"].bitwiseXOR(byte)
        scaled = low * F.lit(FNV_PRIME_LOW).cast("bigint")
        high = (
            acc["high"] * F.lit(FNV_PRIME_LOW).cast("bigint")
            + F.shiftright(scaled, 32)
            + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        )
        mask = F.lit(LOW32).cast("bigint")
        return F.struct(high.bitwiseAND(mask).alias("high"), scaled.bitwiseAND(mask).alias("low"))

    basis = F.struct(
        F.lit(FNV_BASIS_HIGH).cast("bigint").alias("high"), F.lit(FNV_BASIS_LOW).cast("bigint").alias("low")
    )
    key = F.aggregate(data, basis, absorb, lambda acc: F.shiftleft(acc["high"], 32).bitwiseOR(acc["low"]))
    return F.when(process_ptr != 0, key)


def sequence_start_key(boot_id: Column, sequence: Column) -> Column:
    """Boot id in the upper 16 bits, per-boot process sequence number below."""
    return F.shiftleft(boot_id.cast("bigint"), BOOT_SHIFT).bitwiseOR(sequence.cast("bigint"))


def failure_key(protocol: Column, address_family: Column, code: Column) -> Column:
    """Protocol, address family and code packed as 8 + 8 + 16 bits."""
    return (
        F.shiftleft(protocol.cast("bigint"), 24)
        .bitwiseOR(F.shiftleft(address_family.cast("bigint"), 16))
        .bitwiseOR(code.cast("bigint"))
    )


def unpack_failure_key(key: Column) -> Column:
    return F.struct(
        F.shiftright(key, 24).alias("protocol"),
        F.shiftright(key, 16).bitwiseAND(F.lit(0xFF)).alias("address_family"),
        key.bitwiseAND(F.lit(0xFFFF)).alias("failure_code"),
    )


def to_signed_address(bits: Column) -> Column:
    """Map an unsigned 64-bit pattern to a bigint that sorts in unsigned order."""
    return bits.bitwiseXOR(F.lit(SIGN_BIT).cast("bigint"))


def from_signed_address(address: Column) -> Column:
    return address.bitwiseXOR(F.lit(SIGN_BIT).cast("bigint"))
