"""Network family. Traffic of unknown processes is dropped everywhere, totals included.

``events``: host, ts_ns, cls, pid, size (transfers), proto and failure_code (failures).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.names import address_family_name
from tracelake.operators.attribute import attribute_by_pid, attribute_system, known_only
from tracelake.plans.rollup import drop_zero, rollup_programs

CLASSES = (
    "tcp_send", "tcp_recv", "tcp_connect", "tcp_accept", "tcp_retransmit", "tcp_fail", "udp_send", "udp_recv", "udp_fail",
)
TRANSFERS = ("tcp_send", "udp_send", "tcp_recv", "udp_recv")
#: The classes that carry a pid.
OWNED = (*TRANSFERS, "tcp_connect", "tcp_accept", "tcp_retransmit")


def protocol_of(cls: Column) -> Column:
    return F.when(cls.startswith("udp_"), F.lit("udp")).otherwise(F.lit("tcp"))


def narrow(events: DataFrame) -> DataFrame:
    """What the series read of the events; only transfers have a size."""
    size = F.when(F.col("cls").isin(*TRANSFERS), F.col("size")).alias("size")
    return events.select("host", "ts_ns", "cls", "pid", size, *[c for c in ("proto", "failure_code") if c in events.columns])


def known_traffic(events: DataFrame, processes: DataFrame, **options) -> DataFrame:
    """Events of the classes with a pid whose process is known, with its start key and the protocol.

    Bytes, connections and retransmissions take it as ``known``: one who needs several of them looks up the owners once.
    """
    known = _known(events, processes, OWNED, ["size"], options, None)
    return known.select("host", "start_key", "cls", "protocol", "size")


def _known(
    events: DataFrame, processes: DataFrame, classes: tuple[str, ...], columns: list[str], options: dict, known: DataFrame | None
) -> DataFrame:
    if known is not None:
        return known.filter(F.col("cls").isin(*classes))
    picked = events.filter(F.col("cls").isin(*classes)).select("host", "ts_ns", "pid", "cls", *columns)
    return known_only(attribute_by_pid(picked, processes, **options)).withColumn("protocol", protocol_of(F.col("cls")))


def _direction_sums() -> dict[str, Column]:
    def moved(suffix: str) -> Column:
        return F.sum(F.when(F.col("cls").endswith(suffix), F.col("size")).otherwise(F.lit(0)))

    return {"sent_bytes": moved("_send"), "received_bytes": moved("_recv")}


def network_bytes(
    events: DataFrame, processes: DataFrame, level: str = "program", known: DataFrame | None = None, **options
) -> DataFrame:
    """Bytes per (host, program, protocol), sent and received. ``known``: the ``known_traffic``, where the caller has it."""
    moved = _known(events, processes, TRANSFERS, ["size"], options, known)
    return rollup_programs(moved, processes, ["protocol"], _direction_sums(), level)


def network_totals(events: DataFrame, processes: DataFrame, **options) -> DataFrame:
    """Bytes per (host, protocol) of attributed traffic, sent and received."""
    known = _known(events, processes, TRANSFERS, ["size"], options, None)
    return known.groupBy("host", "protocol").agg(*[c.alias(n) for n, c in _direction_sums().items()])


def connections(
    events: DataFrame, processes: DataFrame, level: str = "program", known: DataFrame | None = None, **options
) -> DataFrame:
    """Connections per (host, program, protocol), attempted and accepted."""
    made = _known(events, processes, ("tcp_connect", "tcp_accept"), [], options, known)
    return rollup_programs(
        made, processes, ["protocol"],
        {"attempted": F.count_if(F.col("cls") == "tcp_connect"), "accepted": F.count_if(F.col("cls") == "tcp_accept")}, level
    )


def connections_failed(events: DataFrame, processes: DataFrame, level: str = "program", **options) -> DataFrame:
    """Failures per (host, program, protocol, address family, code). They carry no pid and belong to System."""
    failed = events.filter(F.col("cls").isin("tcp_fail", "udp_fail")).select(
        "host", "ts_ns", protocol_of(F.col("cls")).alias("protocol"),
        address_family_name(F.col("proto")).alias("address_family"), "failure_code",
    )
    owned = known_only(attribute_system(failed, processes, **options))
    dims = ["protocol", "address_family", "failure_code"]
    return rollup_programs(owned, processes, dims, {"value": F.count(F.lit(1))}, level)


def retransmissions(
    events: DataFrame, processes: DataFrame, level: str = "program", known: DataFrame | None = None, **options
) -> DataFrame:
    """TCP retransmissions per (host, program)."""
    again = _known(events, processes, ("tcp_retransmit",), [], options, known)
    return drop_zero(rollup_programs(again, processes, [], {"value": F.count(F.lit(1))}, level))
