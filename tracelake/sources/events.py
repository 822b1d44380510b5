"""Event source, routing and bulk payload decode."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.sources.schema import (
    LAYOUTS,
    PROVIDER_OF_CLASS,
    PROVIDER_OF_ID,
    RAW_EVENTS,
    ROUTES,
    WIDE_EVENTS,
    Field,
    Layout,
)


def read_events(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    classes: Sequence[str] | None = None,
    schema: StructType = RAW_EVENTS,
    **options: str,
) -> DataFrame:
    """Events from Parquet, once or as a stream: raw, or typed with ``schema=WIDE_EVENTS``.

    Write events partitioned by ``cls`` (see ``write_events``): then ``classes`` prunes directories.
    ``options`` go to the reader (``maxFilesPerTrigger`` and the like).
    """
    reader = (spark.readStream if streaming else spark.read).schema(schema).options(**options)
    events = reader.parquet(path)
    return events if classes is None else events.filter(F.col("cls").isin(*classes))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write events by class, each file sorted by host and time so that row groups prune on both.

    Range partitioning splits a busy host or class over many files.
    """
    ranged = events.repartitionByRange("cls", "host", "ts_ns").sortWithinPartitions("cls", "host", "ts_ns", "seq")
    ranged.write.mode(mode).partitionBy("cls").parquet(path)


def scope_host(events: DataFrame, boot_id: str = "boot_id") -> DataFrame:
    """Fold a boot id into ``host`` where process and thread ids repeat across boots."""
    return events.withColumn("host", F.concat_ws("/", "host", F.col(boot_id).cast("string")))


def classify(raw: DataFrame) -> DataFrame:
    """Set ``cls`` from (provider id, event id) where the data has none, and name the provider.

    The route table is a constant of about 130 rows, so its broadcast does not grow with the data.
    """
    routes = [(p, i, cls) for p, classes in ROUTES.items() for cls, ids in classes.items() for i in ids]
    table = raw.sparkSession.createDataFrame(routes, "_provider string, _opcode int, _cls string")
    id_of = F.lower(F.regexp_replace("provider", "[{}]", ""))
    routed = raw.withColumn("provider_id", id_of).join(
        F.broadcast(table), (F.col("provider_id") == F.col("_provider")) & (F.col("opcode") == F.col("_opcode")), "left"
    )
    cls = F.coalesce("cls", "_cls") if "cls" in raw.columns else F.col("_cls")
    classed = routed.withColumn("cls", cls).drop("_provider", "_opcode", "_cls")
    return classed.withColumn("provider", provider_name(F.col("cls"), F.col("provider_id")))


def provider_name(cls: Column, provider_id: Column) -> Column:
    """Report name by class, else by provider id."""
    by_class = None
    for name, classes in PROVIDER_OF_CLASS.items():
        test = cls.isin(*classes)
        by_class = F.when(test, F.lit(name)) if by_class is None else by_class.when(test, F.lit(name))
    by_id = None
    for guid, name in PROVIDER_OF_ID.items():
        test = provider_id == guid
        by_id = F.when(test, F.lit(name)) if by_id is None else by_id.when(test, F.lit(name))
    return F.coalesce(by_class, by_id)


def _last_byte(layout: Layout, pointer_bytes: Column) -> Column:
    ends = [
        F.lit(f.offset + f.width) if f.narrow is None
        else F.when(pointer_bytes == 4, F.lit(f.narrow + f.width)).otherwise(F.lit(f.offset + f.width))
        for f in layout.fields
    ]
    return F.greatest(F.lit(0), *ends) if ends else F.lit(0)


def _little_endian(payload: Column, start: Column, width: int) -> Column:
    digits = F.hex(F.substring(payload, start + F.lit(1), F.lit(width)))
    # Bytes in reverse, as hex text. Base -10 makes conv return a signed number for 64-bit fields.
    reverse = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.conv(reverse, 16, -10 if width == 8 else 10).cast("bigint")


def _read(field: Field, lenient: bool, payload: Column, pointer_bytes: Column) -> Column:
    start = F.lit(field.offset)
    if field.narrow is not None:
        start = F.when(pointer_bytes == 4, F.lit(field.narrow)).otherwise(start)
    value = _little_endian(payload, start, field.width)
    if lenient:
        value = F.when(F.length(payload) >= start + F.lit(field.width), value).otherwise(F.lit(0).cast("bigint"))
    return value


def _pointer_bytes(raw: DataFrame) -> Column:
    return F.coalesce("pointer_bytes", F.lit(8)) if "pointer_bytes" in raw.columns else F.lit(8)


def _short(raw: DataFrame, cls: str) -> Column:
    layout = LAYOUTS[cls]
    if layout.lenient or not layout.fields:
        return F.lit(False)
    return F.coalesce(F.length("payload"), F.lit(0)) < _last_byte(layout, _pointer_bytes(raw))


def decode_events(raw: DataFrame, *classes: str) -> DataFrame:
    """Typed rows of some classes, from one scan. Payloads too short for their class are left out (see ``decode_errors``).

    Fields a class does not have are null. Fields are independent expressions: those nobody
    uses are pruned from the plan.
    """
    rows = raw.filter(F.col("cls").isin(*classes)).filter(~_undecodable(raw, classes))
    header = [c for c in raw.columns if c not in ("payload", "pointer_bytes")]
    users: dict[tuple[str, Field, bool], list[str]] = {}
    for cls in classes:
        for field in LAYOUTS[cls].fields:
            users.setdefault((field.name, field, LAYOUTS[cls].lenient), []).append(cls)
    columns: dict[str, Column] = {}
    for (name, field, lenient), having in users.items():
        value = _read(field, lenient, F.col("payload"), _pointer_bytes(raw))
        if len(having) < len(classes):
            value = F.when(F.col("cls").isin(*having), value)
        columns[name] = F.coalesce(columns[name], value) if name in columns else value
    return rows.select(*header, *[value.alias(name) for name, value in columns.items()])


def wide_events(typed: DataFrame) -> DataFrame:
    """Bring typed rows (with ``cls``) to the columns of ``WIDE_EVENTS``."""
    return typed.select(
        *[
            (F.col(f.name) if f.name in typed.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in WIDE_EVENTS.fields
        ]
    )


def _undecodable(raw: DataFrame, classes: Sequence[str]) -> Column:
    test = F.lit(False)
    for cls in classes:
        test = test | ((F.col("cls") == cls) & _short(raw, cls))
    return test


def short_payloads(raw: DataFrame) -> DataFrame:
    """Rows whose payload is too short for their class."""
    return raw.filter(_undecodable(raw, list(LAYOUTS)))


def decode_errors(raw: DataFrame) -> DataFrame:
    """Number of undecodable rows per (host, class)."""
    return short_payloads(raw).groupBy("host", "cls").agg(F.count(F.lit(1)).alias("errors"))
