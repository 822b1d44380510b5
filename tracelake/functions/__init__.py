from tracelake.functions.keys import (
    failure_key,
    from_signed_address,
    pseudo_start_key,
    sequence_start_key,
    to_signed_address,
    unpack_failure_key,
)
from tracelake.functions.names import (
    address_family_name,
    disk_op_name,
    protocol_name,
    registry_op_name,
    result_name,
    wait_reason_name,
)
from tracelake.functions.text import base_name, hex_label, is_exe, is_full_path
from tracelake.functions.units import micros, millis

__all__ = [
    "address_family_name", "base_name", "disk_op_name", "failure_key", "from_signed_address",
    "hex_label", "is_exe", "is_full_path", "micros", "millis", "protocol_name",
    "pseudo_start_key", "registry_op_name", "result_name", "sequence_start_key",
    "to_signed_address", "unpack_failure_key", "wait_reason_name",
]
