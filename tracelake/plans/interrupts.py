"""Interrupt family: queued and executed deferred calls, latency, duration by driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.units import NS_PER_S, micros, whole
from tracelake.operators.carry import CHUNK_NS
from tracelake.operators.histogram import DURATION_BOUNDS_US, LATENCY_BOUNDS_US, histogram
from tracelake.operators.images import resolve_images
from tracelake.operators.materialise import materialise
from tracelake.operators.pairing import finalised_dpcs, pair_isr_dpc
from tracelake.plans.rollup import full_keys


def dpc_counts(
    isr: DataFrame, dpc: DataFrame, cswitch: DataFrame, per_cpu: bool = False, chunk_ns: int = CHUNK_NS, finalised: DataFrame | None = None
) -> DataFrame:
    """Calls queued (interrupts) and executed (finalised calls), per host or per (host, cpu), zeros filled.

    ``finalised``: the finalised calls, where the caller has them.
    """
    done = finalised_dpcs(dpc, cswitch, chunk_ns) if finalised is None else finalised
    keys = ["host", "cpu"] if per_cpu else ["host"]
    queued = isr.groupBy(*keys).agg(F.count(F.lit(1)).alias("queued"))
    executed = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("executed"))
    return full_keys(queued, executed, keys, ["queued", "executed"])


def dpc_pressure(
    isr: DataFrame, dpc: DataFrame, cswitch: DataFrame, window_ns: int = 60 * NS_PER_S, chunk_ns: int = CHUNK_NS
) -> DataFrame:
    """Per (host, cpu, window): queued and executed calls and the difference of their rates per second.

    A call counts as executed when it is finalised.
    """
    keys = ["host", "cpu", "window_id"]
    queued = isr.groupBy("host", "cpu", whole(F.col("ts_ns"), window_ns).alias("window_id")).agg(
        F.count(F.lit(1)).alias("queued")
    )
    executed = (
        finalised_dpcs(dpc, cswitch, chunk_ns)
        .groupBy("host", "cpu", whole(F.col("end_ns"), window_ns).alias("window_id"))
        .agg(F.count(F.lit(1)).alias("executed"))
    )
    rate = (F.col("queued") - F.col("executed")) / F.lit(window_ns / NS_PER_S)
    return full_keys(queued, executed, keys, ["queued", "executed"]).withColumn("pressure", rate)


def isr_dpc_latency(
    isr: DataFrame, dpc: DataFrame, cswitch: DataFrame, max_isr_age_ms: int | None = None, chunk_ns: int = CHUNK_NS,
    finalised: DataFrame | None = None,
) -> DataFrame:
    """Histogram of whole-microsecond latency from interrupt to deferred call, per host.

    Hosts with interrupts or calls but no pair have an empty histogram, not none. ``finalised``: the finalised calls, where the caller has them.
    """
    if finalised is None:
        # Pairing looks at the finalised calls more than once; switches, far more numerous, are read only for this.
        finalised = materialise(finalised_dpcs(dpc, cswitch, chunk_ns))
    pairs = pair_isr_dpc(isr, finalised, max_isr_age_ms, chunk_ns).select("host", micros(F.col("latency_ns")).alias("us"))
    hosts = isr.select("host").distinct().unionByName(dpc.select("host").distinct()).distinct()
    padded = pairs.unionByName(hosts.withColumn("us", F.lit(None).cast("bigint")))
    h = histogram(padded, F.col("us"), ["host"], LATENCY_BOUNDS_US)
    return h.withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))


def dpc_durations(dpc: DataFrame, cswitch: DataFrame, chunk_ns: int = CHUNK_NS, finalised: DataFrame | None = None) -> DataFrame:
    """Finalised calls with ``duration_us``, whole microseconds."""
    done = finalised_dpcs(dpc, cswitch, chunk_ns) if finalised is None else finalised
    return done.withColumn("duration_us", micros(F.col("duration_ns")))


def dpc_duration_by_image(
    durations: DataFrame,
    images: DataFrame,
    prune_unloaded: bool = True,
    dpc: DataFrame | None = None,
    chunk_ns: int = CHUNK_NS,
    **options,
) -> DataFrame:
    """Histogram of call duration per (host, image). Calls at unknown addresses are left out.

    An image is looked up when the call is finalised. With ``prune_unloaded`` the series of a driver
    restarts when an image of that name is unloaded: only calls after the last unload count. ``dpc``, the calls
    the durations come from, gives the routine addresses without a second pass over the pairing.
    """
    calls = durations.select(
        "host", F.col("end_ns").alias("ts_ns"), F.col("routine").alias("address"), "duration_us"
    )
    addresses = None if dpc is None else dpc.select("host", F.col("routine").alias("address"))
    named = with_last_unload(images) if prune_unloaded else images.withColumn("gone_ns", F.lit(None).cast("bigint"))
    resolved = resolve_images(calls, named, ("image_name", "gone_ns"), addresses, chunk_ns, **options)
    current = F.col("gone_ns").isNull() | (F.col("ts_ns") > F.col("gone_ns"))
    counted = resolved.filter(F.col("image_name").isNotNull() & current)
    return histogram(counted, F.col("duration_us"), ["host", "image_name"], DURATION_BOUNDS_US)


def with_last_unload(images: DataFrame) -> DataFrame:
    """Add to each image epoch when an image of its name was last unloaded. Joined here, to the images, and not to the calls:
    one driver may own a large part of them."""
    unloads = images.filter(F.col("unload_ns").isNotNull())
    unloads = unloads.groupBy("host", "image_name").agg(F.max("unload_ns").alias("gone_ns"))
    return images.join(unloads, ["host", "image_name"], "left")
