"""Name tables for small enumerations, and the column functions that apply them.

Each lookup is a literal map (or a short ``when``), so it stays inside the generated
code of the surrounding stage and needs no join.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thread wait reasons, in code order 0..37.
WAIT_REASONS = (
    "Executive", "FreePage", "PageIn", "PoolAllocation", "DelayExecution", "Suspended", "UserRequest",
    "WrExecutive", "WrFreePage", "WrPageIn", "WrPoolAllocation", "WrDelayExecution", "WrSuspended",
    "WrUserRequest", "WrEventPair", "WrQueue", "WrLpcReceive", "WrLpcReply", "WrVirtualMemory",
    "WrPageOut", "WrRendezvous", "WrKeyedEvent", "WrTerminated", "WrProcessInSwap", "WrCpuRateControl",
    "WrCalloutStack", "WrKernel", "WrResource", "WrPushLock", "WrMutex", "WrQuantumEnd", "WrDispatchInt",
    "WrPreempted", "WrYieldExecution", "WrFastMutex", "WrGuardedMutex", "WrRundown", "MaximumWaitReason",
)

# Registry operations, in opcode order starting at FIRST_REGISTRY_OPCODE.
FIRST_REGISTRY_OPCODE = 10
REGISTRY_OPS = (
    "create", "open", "delete", "query", "set_value", "delete_value", "query_value", "enumerate_key",
    "enumerate_value_key", "query_multiple_value", "set_information", "flush", "kcb_create", "kcb_delete",
    "kcb_rundown_begin", "kcb_rundown_end", "virtualize", "close", "set_security", "query_security",
    "commit", "prepare", "rollback", "mount_hive",
)

# Disk operations, protocols, address families.
DISK_OPS = ("read", "write", "flush")
PROTOCOLS = ("tcp", "udp")
ADDRESS_FAMILIES = ("ipv4", "ipv6")
IPV6_PROTO = 23

# Identifiers with a meaning of their own.
SYSTEM_PID = 4
INVALID_ID = 0xFFFFFFFF
UNKNOWN_START_KEY = 1
UNKNOWN_PROCESS = "unknown_process"
TAGLESS_PROCESSES = ("System", "MemCompression")


def _nth(names: tuple[str, ...], index: Column) -> Column:
    """The name at zero-based ``index``, null when outside the table."""
    inside = index.between(0, len(names) - 1)
    return F.when(inside, F.get(F.array(*[F.lit(n) for n in names]), index.cast("int")))


def wait_reason_name(code: Column) -> Column:
    return _nth(WAIT_REASONS, code)


def registry_op_name(opcode: Column) -> Column:
    return _nth(REGISTRY_OPS, opcode - F.lit(FIRST_REGISTRY_OPCODE))


def disk_op_name(op: Column) -> Column:
    return _nth(DISK_OPS, op)


def protocol_name(protocol: Column) -> Column:
    return F.coalesce(_nth(PROTOCOLS, protocol), F.lit("unknown"))


def address_family_name(proto: Column) -> Column:
    """Only the IPv6 protocol number reads as ipv6; any other number is ipv4."""
    return F.when(proto == IPV6_PROTO, F.lit("ipv6")).otherwise(F.lit("ipv4"))


def result_name(status: Column) -> Column:
    return F.when(status == 0, F.lit("success")).otherwise(F.lit("failure"))
