"""Address to image resolution: a range join over addresses, as-of over time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.asof import BROADCAST_ROWS_PER_KEY, OPEN_END, asof_join, measured, row_bytes
from tracelake.operators.carry import CHUNK_NS, neighbour_time
from tracelake.operators.materialise import materialise

# Bucket widths as powers of two. An image is filed at the narrowest width that is at least its size, where it
# touches two buckets at most; a distinct address looks once at every width in use.
BUCKET_BITS = (12, 16, 20, 24, 28, 32, 62)

# Images and the epochs of addresses are broadcast up to this size, measured. Hashed they take half as much again, and the driver
# holds them more than once while it sends them out. Larger ones are merged: their files are so small that the planner would send them.
SMALL_BYTES = 32 << 20


def _width(size: Column) -> Column:
    width = F.lit(BUCKET_BITS[-1])
    for bits in reversed(BUCKET_BITS[:-1]):
        width = F.when(size <= F.lit(1 << bits).cast("bigint"), F.lit(bits)).otherwise(width)
    return width


def match_addresses(addresses: DataFrame, images: DataFrame) -> DataFrame:
    """All (host, address) x image epochs with ``base <= address < base + size``, time not yet considered.

    ``addresses`` should be distinct. Addresses and bases are bigints in unsigned order (see
    ``to_signed_address``). Only equal (host, width, bucket) rows meet, then the exact range filters.
    """
    filed = (
        images.withColumn("_bits", _width(F.col("size")))
        .withColumn("_end", F.coalesce(F.try_add("base", "size"), F.lit(OPEN_END)))
        .withColumn("_low", F.call_function("shiftright", F.col("base"), F.col("_bits")))
        .withColumn("_high", F.call_function("shiftright", F.col("_end") - F.lit(1), F.col("_bits")))
        .withColumn("_bucket", F.explode(F.sequence("_low", "_high")))
        .drop("_low", "_high")
    )
    keys = ["host", "_bits", "_bucket"]
    # One job measures the filed images and lists the widths in use, at most as many as there are.
    size = F.sum(row_bytes(filed, filed.columns))
    per_bucket = filed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))
    total, top, used = per_bucket.agg(F.sum("bytes"), F.max("n"), F.collect_set("_bits")).first()
    widths = F.array(*[F.lit(b) for b in sorted(used) or BUCKET_BITS[:1]])
    probes = addresses.select("host", "address", F.explode(widths).alias("_bits"))
    probes = probes.withColumn("_bucket", F.call_function("shiftright", F.col("address"), F.col("_bits")))
    small = (total or 0) <= SMALL_BYTES and (top or 0) <= BROADCAST_ROWS_PER_KEY
    build = F.broadcast(filed) if small else filed.hint("merge")
    inside = (F.col("address") >= F.col("base")) & (F.col("address") < F.col("_end"))
    return probes.join(build, keys).filter(inside).drop("_bits", "_bucket", "_end")


def holding_epochs(epochs: DataFrame, chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Cut the epochs of each (host, address) so that one holds it at a time: of those live, the latest load, then the highest base and seq.

    When the holder ends, an older one that still lives holds the address again. Addresses without an overlap stay as they are. Elsewhere every epoch is
    filed under the binary intervals of time that make it up, at most two per power of two; of an interval only its best epoch counts; and the stretch
    between two starts or ends looks at the intervals around it, one per power of two. So n epochs over one address, however they overlap, take some n log n rows,
    in groups that are combined before the shuffle, and the neighbours in time are found in chunks.
    """
    keys, order = ["host", "address"], ["valid_from", "base", "seq"]
    followed = neighbour_time(epochs.filter(F.col("valid_from") < F.col("valid_to")), keys, order, "_after", backward=True, chunk_ns=chunk_ns)
    followed = materialise(followed)
    live = followed.select(*epochs.columns)
    mixed = followed.filter(F.col("_after") < F.col("valid_to")).select(*keys).distinct()
    several = live.join(mixed, keys, "left_semi")
    intervals = several.select(*keys, F.struct(*epochs.columns).alias("_epoch"), F.explode(_binary_intervals(F.col("valid_from"), F.col("valid_to"))).alias("_at"))
    rank = F.struct(*[F.col(f"_epoch.{c}") for c in order])
    best = materialise(intervals.groupBy(*keys, "_at.level", "_at.node").agg(F.max_by("_epoch", rank).alias("_epoch")))
    edges = several.select(*keys, F.explode(F.array("valid_from", "valid_to")).alias("_from")).distinct()
    stretches = neighbour_time(edges, keys, ["_from"], "_to", backward=True, chunk_ns=chunk_ns).filter(F.col("_to").isNotNull())
    levels = sorted(r[0] for r in best.select("level").distinct().collect())  # at most 63 numbers
    around = stretches.select("*", F.explode(F.array(*[F.lit(x) for x in levels or [0]])).alias("level"))
    around = around.withColumn("node", F.call_function("shiftright", F.col("_from"), F.col("level")))
    held = around.join(best.hint("merge"), [*keys, "level", "node"]).groupBy(*keys, "_from", "_to").agg(F.max_by("_epoch", rank).alias("_epoch"))
    bounds = {"valid_from": "_from", "valid_to": "_to"}
    held = held.select(*[F.col(bounds.get(c, f"_epoch.{c}")).alias(c) for c in epochs.columns])
    return live.join(mixed, keys, "left_anti").select(*epochs.columns).unionByName(held)


def _binary_intervals(start: Column, end: Column) -> Column:
    """Array of (level, node): the intervals [node * 2^level, (node + 1) * 2^level) that make up [start, end), none twice."""

    def at(level: Column) -> Column:
        low = -F.call_function("shiftright", -start, level)
        high = F.call_function("shiftright", end, level)
        one = lambda node, used: F.when((low < high) & (F.abs(used % 2) == 1), F.struct(level.alias("level"), node.alias("node")))
        return F.array(one(low, low), one(high - F.lit(1), high))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), at)))


def resolve_images(
    events: DataFrame,
    images: DataFrame,
    payload: tuple[str, ...] = ("image_name",),
    addresses: DataFrame | None = None,
    chunk_ns: int = CHUNK_NS,
    strategy: str = "auto",
) -> DataFrame:
    """Add the image that holds ``address`` at ``ts_ns``; null if none does.

    Routine addresses repeat, so the range join runs over distinct addresses, written once. The answer is, per
    address, a list of epochs, joined as of the event time. Where epochs overlap, the latest load
    (then the highest base) holds the address while it lives (see ``holding_epochs``). ``addresses`` may name a cheaper DataFrame that
    holds at least the (host, address) of ``events``. Epochs of more than ``SMALL_BYTES`` are scanned whatever the ``strategy``.
    """
    source = events if addresses is None else addresses
    distinct = source.select("host", "address").filter(F.col("address").isNotNull()).distinct()
    epochs = materialise(match_addresses(distinct, images))
    keys = ["host", "address"]
    top = measured(epochs, keys, epochs.columns)[1]
    if strategy == "auto":
        strategy = "broadcast" if top <= BROADCAST_ROWS_PER_KEY else "scan"
    cut = epochs
    if top > 1:
        cut = materialise(holding_epochs(epochs, chunk_ns))
    if strategy == "broadcast" and measured(cut, keys, cut.columns)[0] > SMALL_BYTES:
        strategy = "scan"
    return asof_join(events, cut, keys, list(payload), chunk_ns=chunk_ns, strategy=strategy)
