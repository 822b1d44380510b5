"""Event schema, class layouts and routes.

Unsigned 32-bit fields are bigints (0xFFFFFFFF is a live value), 64-bit ones are bit patterns in a bigint.
Times are integer nanoseconds (``ts_ns``) for arithmetic, with ``ts`` beside them for watermarks.
"""

from dataclasses import dataclass

from pyspark.sql import types as T

RAW_EVENTS = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("cpu", T.IntegerType()),
    T.StructField("header_pid", T.LongType()),
    T.StructField("provider", T.StringType()),
    T.StructField("opcode", T.IntegerType()),
    T.StructField("pointer_bytes", T.IntegerType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("cls", T.StringType()),
])

# Typed rows of any class in one table; columns a class does not have are null.
WIDE_EVENTS = T.StructType([
    *[
        T.StructField(n, RAW_EVENTS[n].dataType)
        for n in ("host", "seq", "ts", "ts_ns", "cpu", "header_pid", "cls", "opcode", "provider")
    ],
    *[
        T.StructField(n, T.LongType())
        for n in (
            "start_key", "pid", "parent_pid", "session_id", "pe_checksum", "tid", "sub_process_tag", "new_tid",
            "old_wait_reason", "initial_ns", "routine", "disk", "size", "issuing_tid", "proto", "failure_code",
            "status", "base", "tag",
        )
    ],
    *[
        T.StructField(n, T.StringType())
        for n in ("process_name", "file_name", "service_name", "manufacturer", "drive_letter", "file_system")
    ],
])


@dataclass(frozen=True)
class Field:
    """A little-endian unsigned field of ``width`` bytes; ``narrow`` is its offset with 4-byte pointers."""

    name: str
    width: int
    offset: int
    narrow: int | None = None


@dataclass(frozen=True)
class Layout:
    """Fixed part of a payload. In a lenient layout, fields beyond the end of a short payload read 0."""

    fields: tuple[Field, ...]
    lenient: bool = False


_THREAD = Layout((Field("pid", 4, 0), Field("tid", 4, 4), Field("sub_process_tag", 4, 64)), lenient=True)
_TRANSFER = Layout((Field("pid", 4, 0), Field("size", 4, 4)))
_CONNECTION = Layout((Field("pid", 4, 0),))
_FAILURE = Layout((Field("proto", 2, 0), Field("failure_code", 2, 2)))
_DISK_MOVE = Layout((Field("disk", 4, 0), Field("size", 4, 8), Field("issuing_tid", 4, 48, narrow=40)))

# Offsets of the fields in use, per event class.
LAYOUTS = {
    "cswitch": Layout((Field("new_tid", 4, 0), Field("old_wait_reason", 1, 12))),
    "ready_thread": Layout(()),
    "thread_start": _THREAD,
    "thread_end": _THREAD,
    "isr": Layout((Field("initial_ns", 8, 0), Field("routine", 8, 8), Field("vector", 2, 17))),
    "dpc": Layout((Field("initial_ns", 8, 0), Field("routine", 8, 8))),
    "disk_read": _DISK_MOVE,
    "disk_write": _DISK_MOVE,
    "disk_flush": Layout((Field("disk", 4, 0),)),
    "tcp_send": _TRANSFER,
    "tcp_recv": _TRANSFER,
    "tcp_connect": _CONNECTION,
    "tcp_accept": _CONNECTION,
    "tcp_retransmit": _CONNECTION,
    "tcp_fail": _FAILURE,
    "udp_send": _TRANSFER,
    "udp_recv": _TRANSFER,
    "udp_fail": _FAILURE,
    "hard_fault": Layout((Field("tid", 4, 32),)),
    "registry_op": Layout((Field("status", 4, 8),)),
}

# Classes whose payload has variable-length text; sources deliver them as typed tables.
TYPED_CLASSES = (
    "process_start", "process_end", "image_load", "image_unload", "disk_physical", "disk_logical", "service_config",
)

# Provider ids.
THREAD = "3d6fa8d1-fe05-11d0-9dda-00c04fd7ba7c"
PROCESS = "3d6fa8d0-fe05-11d0-9dda-00c04fd7ba7c"
DISK_IO = "3d6fa8d4-fe05-11d0-9dda-00c04fd7ba7c"
PAGE_FAULT = "3d6fa8d3-fe05-11d0-9dda-00c04fd7ba7c"
TCP_IP = "9a280ac0-c8e0-11d1-84e2-00c04fb998a2"
UDP_IP = "bf3a50c5-a9c9-4988-a005-2df0b7c80f80"
PERF_INFO = "ce1dbfb4-137e-4da6-87b0-3f59aa102cbc"
IMAGE = "2cb15d1d-5fc1-11d2-abe1-00a0c911f518"
REGISTRY = "ae53722e-c863-11d2-8659-00c04fa321a1"
SYSTEM_CONFIG = "01853a65-418f-4f36-aefc-dc0f1d2fd235"
KERNEL_PROCESS = "22fb2cd6-0e7b-422b-a0c7-2fad1fd0e716"
KERNEL_DISK = "c7bde69a-e1e0-4177-b6ef-283ad1525271"
KERNEL_NETWORK = "7dd42a49-5329-4832-8dfd-43d979153a88"
KERNEL_FILE = "edd08927-9cc4-4e65-b970-c2560fb5c289"
KERNEL_EVENT_TRACING = "b675ec37-bdb6-4648-bc92-f3fdc74d3ca2"
SYSTEM_PROCESS = "151f55dc-467d-471f-83b5-5f889d46ff66"
SYSTEM_SCHEDULER = "599a2a76-4d91-4910-9ac7-7d33f2e97a6c"
SYSTEM_INTERRUPT = "d4bbee17-b545-4888-858b-744169015b25"
SYSTEM_MEMORY = "82958ca9-b6cd-47f8-a3a8-03ae85a4bc24"
SYSTEM_IO = "3d5c43e3-0f1c-4202-b817-174c0070dc79"
SYSTEM_CONFIG_PROVIDER = "fef3a8b6-318d-4b67-a96a-3b0f6b8f18fe"
SYSTEM_REGISTRY = "16156bd9-fab4-4cfa-a232-89d1099058e3"

_THREAD_IDS = {"thread_start": (1, 3, 4), "thread_end": (2,), "cswitch": (36,), "ready_thread": (50,)}
_DISK_IDS = {"disk_read": (10,), "disk_write": (11,), "disk_flush": (14,)}
_TCP_IDS = {
    "tcp_send": (10, 26), "tcp_recv": (11, 27), "tcp_connect": (12, 28), "tcp_accept": (15, 31),
    "tcp_retransmit": (14, 30), "tcp_fail": (17,),
}
_UDP_IDS = {"udp_send": (42, 58), "udp_recv": (43, 59), "udp_fail": (49,)}
_IMAGE_IDS = {"image_load": (10, 3, 4), "image_unload": (2,)}
_PERF_IDS = {"isr": (67,), "dpc": (66, 68, 69)}
_FAULT_IDS = {"hard_fault": (32,)}
_CONFIG_IDS = {"disk_physical": (11,), "disk_logical": (12,), "service_config": (15,)}
_REGISTRY_IDS = {"registry_op": tuple(range(10, 34))}

# Event ids per provider and class. The combined I/O provider reuses ids 10, 11 and 14 for disk and
# TCP; without a class in the data they read as TCP.
ROUTES = {
    THREAD: _THREAD_IDS,
    SYSTEM_SCHEDULER: _THREAD_IDS,
    PROCESS: {"process_start": (1, 3), "process_end": (2,)},
    KERNEL_PROCESS: {
        "process_start": (1, 15), "process_end": (2,), "thread_start": (3,), "thread_end": (4,),
        "image_load": (5,), "image_unload": (6,),
    },
    IMAGE: _IMAGE_IDS,
    SYSTEM_PROCESS: _IMAGE_IDS,
    DISK_IO: _DISK_IDS,
    KERNEL_DISK: _DISK_IDS,
    TCP_IP: _TCP_IDS,
    UDP_IP: _UDP_IDS,
    KERNEL_NETWORK: {**_TCP_IDS, **_UDP_IDS},
    SYSTEM_IO: {**_TCP_IDS, **_UDP_IDS},
    PERF_INFO: _PERF_IDS,
    SYSTEM_INTERRUPT: _PERF_IDS,
    PAGE_FAULT: _FAULT_IDS,
    SYSTEM_MEMORY: _FAULT_IDS,
    REGISTRY: _REGISTRY_IDS,
    SYSTEM_REGISTRY: _REGISTRY_IDS,
    SYSTEM_CONFIG: _CONFIG_IDS,
    SYSTEM_CONFIG_PROVIDER: _CONFIG_IDS,
}

# The provider name each class, or else each provider id, is reported under.
PROVIDER_OF_CLASS = {
    "microsoft-windows-kernel-disk": ("disk_read", "disk_write", "disk_flush"),
    "microsoft-windows-kernel-process": ("process_start", "process_end"),
    "thread-kernel": ("thread_start", "thread_end", "cswitch", "ready_thread"),
    "perfinfo-kernel": ("isr", "dpc"),
    "system-config-kernel": ("disk_physical", "disk_logical", "service_config"),
    "image-kernel": ("image_load", "image_unload"),
    "pagefault-kernel": ("hard_fault",),
    "microsoft-windows-kernel-network": tuple(_TCP_IDS) + tuple(_UDP_IDS),
    "microsoft-windows-kernel-registry": ("registry_op",),
}
PROVIDER_OF_ID = {
    KERNEL_DISK: "microsoft-windows-kernel-disk", DISK_IO: "microsoft-windows-kernel-disk",
    KERNEL_PROCESS: "microsoft-windows-kernel-process", PROCESS: "microsoft-windows-kernel-process",
    THREAD: "thread-kernel", SYSTEM_SCHEDULER: "thread-kernel", KERNEL_FILE: "microsoft-windows-kernel-file",
    PERF_INFO: "perfinfo-kernel", SYSTEM_INTERRUPT: "perfinfo-kernel", SYSTEM_CONFIG: "system-config-kernel",
    IMAGE: "image-kernel", PAGE_FAULT: "pagefault-kernel", SYSTEM_MEMORY: "pagefault-kernel",
    TCP_IP: "microsoft-windows-kernel-network", UDP_IP: "microsoft-windows-kernel-network",
    KERNEL_NETWORK: "microsoft-windows-kernel-network", REGISTRY: "microsoft-windows-kernel-registry",
    SYSTEM_REGISTRY: "microsoft-windows-kernel-registry",
    KERNEL_EVENT_TRACING: "microsoft-windows-kernel-eventtracing",
}
