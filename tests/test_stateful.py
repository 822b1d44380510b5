"""State in the state store against the batch operators, over shuffled micro-batches with a restart before each."""

import random

import pytest
from pyspark.sql import functions as F

from tests.util import rows
from tracelake.functions.units import whole
from tracelake.operators.attribute import attribute_by_pid, attribute_by_tid
from tracelake.operators.entities import process_intervals, thread_intervals
from tracelake.operators.pairing import MAX_PAIR_NS, finalised_dpcs, pair_isr_dpc
from tracelake.sources.events import wide_events
from tracelake.streaming import stateful

MS = 1_000_000
HOUR = 3600 * 1000 * MS
GRACE = 30 * MS


def feed(spark, root, df, slices, jitter, run):
    """Slices of time in folders, rows up to ``jitter`` ns too late; then the end marker."""
    timed = df.withColumn("ts", F.timestamp_micros(whole(F.col("ts_ns"), 1000)))
    last = df.agg(F.max("ts_ns")).first()[0]
    late = F.pmod(F.xxhash64("seq", "cls"), F.lit(jitter))
    place = F.least(whole((F.col("ts_ns") + late) * slices, last + 1), F.lit(slices - 1))
    end = stateful.end_marker(spark, last + 3 * MAX_PAIR_NS).withColumn("ts", F.timestamp_micros(whole(F.col("ts_ns"), 1000)))
    for i in range(slices + 1):
        (timed.filter(place == i) if i < slices else end).write.parquet(f"{root}/in/s{i}")
        run(spark.readStream.schema(timed.schema).parquet(f"{root}/in/s*"))


def test_pairs_equal_the_batch(spark, tmp_path):
    """Nested interrupts, calls without any, latency 0, an interrupt an hour back, a call that nothing ends, and random rows on two CPUs."""
    stateful.use_state_store(spark)
    rng, values, seq = random.Random(3), [], 0
    for cpu, at in ((0, 0), (1, 0)):
        for _ in range(150):
            at += rng.choice([0, 1, 2, 5]) * MS
            cls = rng.choice(["isr", "isr", "dpc", "dpc", "cswitch"])
            values.append((cls, at, seq, cpu, at - (rng.randrange(3) * 100_000 if cls == "dpc" else 0)))
            seq += 1
    edge = [("dpc", 1), ("cswitch", 2), ("isr", 3), ("isr", 4), ("dpc", 5), ("dpc", 6), ("cswitch", 7), ("isr", 8), ("dpc", 8), ("cswitch", 9), ("isr", 20), ("dpc", 20 + HOUR // MS), ("cswitch", 21 + HOUR // MS), ("isr", 22 + HOUR // MS), ("dpc", 23 + HOUR // MS)]
    values += [(cls, at * MS, seq + i, 2, at * MS) for i, (cls, at) in enumerate(edge)]
    df = wide_events(spark.createDataFrame([("h", *v) for v in values], "host string, cls string, ts_ns long, seq long, cpu int, initial_ns long"))

    def run(events):
        pairs = stateful.interrupt_pairs(events, "400 milliseconds", call_limit_ns=MS)
        stateful.write_stream(pairs, f"{tmp_path}/ck", f"{tmp_path}/out").awaitTermination()

    feed(spark, tmp_path, df, 2, 300 * MS, run)
    of = lambda cls: df.filter(F.col("cls") == cls).select("host", "cpu", "ts_ns", "seq", "initial_ns")
    want = pair_isr_dpc(of("isr"), finalised_dpcs(of("dpc"), of("cswitch")))
    got = spark.read.schema(stateful.PAIRS).parquet(f"{tmp_path}/out")
    columns = ("cpu", "dpc_seq", "isr_seq", "latency_ns")
    assert rows(got, *columns) == rows(want, *columns)
    assert [r[3] // MS for r in rows(got.filter("cpu = 2"), *columns)] == [1, 3, 0]


@pytest.fixture
def lives():
    """Starts, repeated sightings and ends of few pids and tids, with facts between and after them."""
    rng, out, at, current, threads = random.Random(4), [], 0, {}, {}
    for seq in range(500):
        at += rng.choice([0, 1, 3, 9]) * MS // 2
        pid, tid, kind = rng.randrange(4, 9), rng.randrange(100, 106), rng.random()
        if kind < 0.12 or pid not in current:
            current[pid] = 1000 + seq
            out.append(("process_start", at, seq, pid, None, current[pid]))
        elif kind < 0.2:
            out.append(("process_end", at, seq, pid, None, rng.choice([None, current[pid]])))
        elif kind < 0.24:
            out.append(("process_start", at, seq, pid, None, current[pid]))  # seen again by a snapshot
        elif kind < 0.4:
            threads[tid] = pid
            out.append(("thread_start", at, seq, pid, tid, None))
            if rng.random() < 0.2:  # a process that starts a little after its thread
                current[pid] = 5000 + seq
                out.append(("process_start", at + MS // 4, seq + 10_000, pid, None, current[pid]))
        elif kind < 0.5 and tid in threads:
            out.append(("thread_end", at, seq, threads[tid], tid, None))
        else:
            out.append((rng.choice(["tcp_send", "hard_fault"]), at, seq, pid, tid, None))
    return out


def test_owners_equal_the_batch(spark, tmp_path, lives):
    stateful.use_state_store(spark)
    fields = "host string, cls string, ts_ns long, seq long, pid long, tid long, start_key long, process_name string, session_id long"
    df = wide_events(spark.createDataFrame([("h", *v, "a.exe", 0) for v in lives], fields))

    def run(events):
        owned = stateful.process_owners(events, "80 milliseconds", ["tcp_send"], GRACE)
        stateful.write_stream(owned, f"{tmp_path}/ck1", f"{tmp_path}/owned").awaitTermination()
        facts = stateful.thread_owners(stateful.read_stream(spark, f"{tmp_path}/owned"), events, "80 milliseconds", ["hard_fault"], GRACE)
        stateful.write_stream(facts, f"{tmp_path}/ck2", f"{tmp_path}/facts").awaitTermination()

    feed(spark, tmp_path, df, 2, 60 * MS, run)
    of = lambda cls: df.filter(F.col("cls") == cls)
    processes = process_intervals(of("process_start").drop("parent_pid", "service_name", "pe_checksum"), of("process_end"), GRACE)
    threads = thread_intervals(of("thread_start"), of("thread_end"), processes, GRACE)
    sends = of("tcp_send").select("host", "seq", "ts_ns", "pid")
    faults = of("hard_fault").select("host", "seq", "ts_ns", "tid")
    owned, facts = (spark.read.schema(stateful.OWNED).parquet(f"{tmp_path}/{n}") for n in ("owned", "facts"))
    assert rows(owned.filter("cls = 'tcp_send'"), "seq", "start_key") == rows(attribute_by_pid(sends, processes), "seq", "start_key")
    assert rows(facts, "seq", "start_key") == rows(attribute_by_tid(faults, threads), "seq", "start_key")
    assert owned.filter("cls = 'thread_start' AND start_key = 1").count() and facts.filter("start_key > 1").count()


class _State:
    """One state that counts the calls made to it."""

    calls = 0

    def __getattr__(self, name):
        def call(*args):
            _State.calls += 1
            return {"get": [], "iterator": [], "values": [], "exists": False, "containsKey": False}.get(name)

        return call


def test_a_start_asks_the_state_store_nothing():
    """The states of a pid are read once before its rows and written once after them."""
    owners = stateful.ProcessOwners(GRACE)
    owners.owner, owners.threads, owners.orphans, owners.replaced = (_State() for _ in range(4))
    owners.load()
    before = _State.calls
    steps = [r for i in range(50) for r in owners.step(("h", 1), (i * MS, 0, i, "process_start", 10 + i, None, None, None, "a", 0, 0))]
    again = list(owners.step(("h", 1), (60 * MS, 0, 60, "process_start", 10, None, None, None, "a", 0, 0)))
    assert _State.calls == before and len(steps) == 50 and again == []
    assert list(owners.settle(("h", 1), 10**18)) == []
    owners.save()
    assert _State.calls <= before + 4
