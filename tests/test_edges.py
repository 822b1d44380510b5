"""Hand-written rows for the rules that random data seldom meets."""

import pytest
from pyspark.sql import functions as F

from tests.util import S, make, rows
from tracelake.operators import attribute, entities, scrapes
from tracelake.operators import images as images_of
from tracelake.operators.asof import OPEN_END, asof_join
from tracelake.operators.histogram import DURATION_BOUNDS_US, GAP_BOUNDS_MS, cumulative, histogram
from tracelake.operators.images import resolve_images
from tracelake.operators.materialise import materialise, temporary_tables
from tracelake.operators.pairing import finalised_dpcs, pair_isr_dpc, switch_gaps
from tracelake.plans import disk, interrupts, memory, network, threads
from tracelake.plans.rollup import full_keys
from tracelake.sources.dimensions import disk_dim, running_services, service_dim

START = "seq bigint, ts_ns bigint, start_key bigint, pid bigint, process_name string, session_id bigint"
END = "seq bigint, ts_ns bigint, start_key bigint"
THREAD = "seq bigint, ts_ns bigint, pid bigint, tid bigint, sub_process_tag bigint"
THREAD_END = "seq bigint, ts_ns bigint, tid bigint"
STRATEGIES = ["broadcast", "scan"]


def procs(spark, starts, ends=()):
    ended = spark.createDataFrame([("h", *e) for e in ends], "host string, " + END)
    return entities.process_intervals(make(spark, START, *starts), ended)


def no_thread_ends(spark):
    return spark.createDataFrame([], "host string, " + THREAD_END)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_pid_reuse_and_grace(spark, strategy):
    p = procs(spark, [(1, 0, 100, 10, "a.exe", 1), (3, 6 * S, 200, 10, "b.exe", 1)], [(2, 5 * S, 100)])
    facts = make(spark, "seq bigint, ts_ns bigint, pid bigint", (10, 3 * S, 10), (11, int(5.5 * S), 10), (12, 7 * S, 10), (13, 7 * S, 11))
    got = attribute.attribute_by_pid(facts, p, strategy=strategy)
    assert rows(got, "seq", "start_key") == [(10, 100), (11, 100), (12, 200), (13, None)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_late_event_in_grace(spark, strategy):
    p = procs(spark, [(1, 0, 100, 10, "a.exe", 1)], [(2, 5 * S, 100)])
    facts = make(spark, "seq bigint, ts_ns bigint, pid bigint", (1, 34 * S, 10), (2, 36 * S, 10), (3, 35 * S, 10))
    assert rows(attribute.attribute_by_pid(facts, p, strategy=strategy), "seq", "start_key") == [(1, 100), (2, None), (3, None)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_epoch_precedes_fact_at_equal_time(spark, strategy):
    p = procs(spark, [(5, S, 100, 10, "a.exe", 1)])
    facts = make(spark, "seq bigint, ts_ns bigint, pid bigint", (1, S, 10), (2, S - 1, 10))
    assert rows(attribute.attribute_by_pid(facts, p, strategy=strategy), "seq", "start_key") == [(1, 100), (2, None)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_two_starts_at_one_time(spark, strategy):
    p = procs(spark, [(1, S, 100, 10, "a.exe", 1), (2, S, 200, 10, "b.exe", 1)])
    facts = make(spark, "seq bigint, ts_ns bigint, pid bigint", (9, 2 * S, 10))
    assert rows(attribute.attribute_by_pid(facts, p, strategy=strategy), "start_key") == [(200,)]


def test_end_by_pid_only_ends_the_current_instance(spark):
    starts = make(spark, START, (1, 0, 100, 10, "a", 1), (3, 9 * S, 200, 10, "b", 1))
    ends = make(spark, "seq bigint, ts_ns bigint, pid bigint", (2, 5 * S, 10), (4, 11 * S, 10), (5, 12 * S, 10))
    got = entities.process_intervals(starts, ends)
    assert rows(got, "start_key", "end_ns") == [(100, 5 * S), (200, 11 * S)]


def test_duplicate_snapshot_refreshes_last_seen(spark):
    p = procs(spark, [(1, S, 100, 10, "a.exe", 1), (2, 9 * S, 100, 10, "late.exe", 1)])
    assert rows(p, "start_key", "process_name", "create_ns", "last_seen_ns") == [(100, "a.exe", S, 9 * S)]


def test_session_normalisation(spark):
    p = procs(spark, [(1, 0, 1, 20, "a", 0xFFFFFFFF), (2, 0, 2, 4, "System", 7), (3, 0, 3, 21, "b", 7)])
    assert sorted(rows(p, "pid", "session_id")) == [(4, 0), (20, 0), (21, 7)]


def test_thread_older_than_its_process(spark):
    p = procs(spark, [(1, 10 * S, 100, 10, "a.exe", 1)])
    t = make(spark, THREAD, (2, 10 * S - 500_000, 10, 7, 0), (3, 10 * S - 2_000_000, 10, 8, 0), (4, 11 * S, 99, 9, 0), (5, 10 * S - 1_000_000, 10, 6, 0))
    got = entities.thread_intervals(t, no_thread_ends(spark), p)
    assert sorted(rows(got, "tid", "start_key")) == [(6, 1), (7, 100), (8, 1), (9, 1)]


def test_thread_belongs_to_the_owner_of_its_pid_at_its_start(spark):
    h = S // 2000
    p = procs(spark, [(1, S, 100, 10, "a", 1), (5, 10 * S, 101, 10, "b", 1), (2, S, 200, 11, "c", 1)], [(9, 5 * S, 200)])
    t = make(
        spark, THREAD, (11, 10 * S - h, 10, 7, 0),  # the pid starts again half a millisecond later
        (12, 35 * S - h, 11, 8, 0),  # its process expires half a millisecond later
        (13, 10 * S, 10, 9, 0), (14, S - h, 10, 6, 0), (15, S - 4 * h, 10, 5, 0),
    )
    got = entities.thread_intervals(t, no_thread_ends(spark), p)
    assert sorted(rows(got, "tid", "start_key")) == [(5, 1), (6, 100), (7, 100), (8, 200), (9, 101)]


def test_null_names_and_checksums_are_unset(spark):
    starts = make(
        spark, "seq bigint, ts_ns bigint, start_key bigint, pid bigint, process_name string, session_id bigint, service_name string, pe_checksum bigint",
        (1, 0, 100, 10, "a.exe", 1, None, None),
    )
    p = entities.process_intervals(starts, make(spark, "seq bigint, ts_ns bigint, pid bigint"))
    assert rows(p, "service_name", "pe_checksum") == [("", 0)]


def test_entities_without_a_time_match_no_epoch(spark):
    facts = make(spark, "seq bigint, ts_ns bigint", (1, None), (2, 5))
    epochs = make(spark, "seq bigint, valid_from bigint, valid_to bigint, name string", (1, 0, 10, "x"))
    for strategy in ("broadcast", "scan"):
        assert rows(asof_join(facts, epochs, ["host"], ["name"], strategy=strategy), "seq", "name") == [(1, None), (2, "x")]


def test_thread_ends_with_grace_reuse_and_process_expiry(spark):
    p = procs(spark, [(1, 0, 100, 10, "a", 1), (2, 0, 200, 11, "b", 1)], [(9, 50 * S, 200)])
    t = make(spark, THREAD, (3, S, 10, 7, 0), (5, 20 * S, 11, 7, 0), (6, S, 11, 8, 0), (7, S, 10, 9, 0))
    ends = make(spark, THREAD_END, (4, 5 * S, 7), (8, 6 * S, 9))
    got = entities.thread_intervals(t, ends, p)
    assert sorted(rows(got, "tid", "valid_from", "valid_to")) == [
        (7, S, 20 * S), (7, 20 * S, 80 * S), (8, S, 80 * S), (9, S, 36 * S),
    ]


def test_name_and_checksum_enrichment(spark):
    p = procs(spark, [(1, 0, 100, 10, "a.exe", 1), (2, 0, 200, 11, "C:\\already\\full.exe", 1), (3, 0, 300, 12, "c.exe", 1)])
    loads = make(
        spark, "seq bigint, ts_ns bigint, pid bigint, pe_checksum bigint, file_name string",
        (4, S, 10, 0, "C:\\x\\a.exe"), (5, 2 * S, 10, 7, "D:\\y\\b.EXE"), (6, S, 11, 9, "C:\\z\\f.exe"), (7, S, 12, 5, "C:\\q\\lib.dll"),
        (8, S, 99, 5, "C:\\q\\no.exe"),
    )
    got = entities.enrich_programs(p, loads)
    assert rows(got, "start_key", "process_name", "pe_checksum") == [
        (100, "C:\\x\\a.exe", 7), (200, "C:\\already\\full.exe", 9), (300, "c.exe", 0),
    ]


def test_service_names(spark):
    config = make(spark, "seq bigint, tag bigint, service_name string", (1, 5, "old"), (2, 5, "Spooler"), (3, 0, "zero"), (4, 6, ""), (5, 8, "Dns"))
    services = service_dim(config)
    assert rows(services, "tag", "service_name") == [(5, "Spooler"), (8, "Dns")]
    p = procs(spark, [(1, 0, 100, 10, "svc.exe", 1), (2, 0, 200, 4, "System", 0), (3, 0, 300, 12, "other.exe", 1)])
    t = make(spark, THREAD, (4, S, 10, 1, 9), (5, 2 * S, 10, 2, 8), (6, 3 * S, 10, 3, 5), (7, S, 4, 4, 5), (8, S, 12, 5, 0))
    th = entities.thread_intervals(t, no_thread_ends(spark), p)
    named = entities.resolve_services(p, th, services)
    assert rows(named, "start_key", "service_name") == [(100, "Dns"), (200, ""), (300, "")]
    snapshot = make(spark, "seq bigint, pid bigint, service_name string", (1, 12, "Spooler"), (2, 10, "Spooler"), (3, 4, "Dns"), (4, 0, "Dns"), (5, 12, "Dns"))
    running = running_services(snapshot)
    assert rows(running, "pid", "service_name") == [(10, "Spooler"), (12, "Dns"), (4, "Dns")]
    enriched = entities.enrich_running(named, running, services)
    assert rows(enriched, "start_key", "service_name") == [(100, "Dns"), (200, ""), (300, "Dns")]


DISK = "seq bigint, ts_ns bigint, disk bigint, operation string, size bigint, issuing_tid bigint, header_pid bigint"


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_disk_chain(spark, strategy):
    p = procs(spark, [(1, 0, 100, 10, "a", 1), (2, 0, 200, 11, "b", 1), (3, 0, 400, 4, "System", 0)])
    t = make(spark, THREAD, (4, S, 10, 7, 0), (5, S, 99, 8, 0))
    th = entities.thread_intervals(t, no_thread_ends(spark), p)
    facts = make(
        spark, DISK,
        (1, 2 * S, 0, "read", 1, 7, 11), (2, 2 * S, 0, "read", 1, 0, 11), (3, 2 * S, 0, "read", 1, 0xFFFFFFFF, 0xFFFFFFFF),
        (4, 2 * S, 0, "read", 1, 8, 11), (5, 2 * S, 0, "read", 1, 55, 77),
    )
    got = attribute.attribute_disk(facts, th, p, strategy=strategy)
    assert rows(got, "seq", "start_key", "attribution") == [
        (1, 100, "thread"), (2, 200, "process"), (3, 400, "system"), (4, 1, "thread"), (5, 400, "system"),
    ]
    without_system = attribute.attribute_disk(facts, th, p.filter("pid <> 4"), strategy=strategy)
    assert rows(without_system.filter("seq = 3"), "start_key", "attribution") == [(None, None)]
    no_thread = attribute.attribute_disk(facts.drop("issuing_tid"), th, p, strategy=strategy)
    assert rows(no_thread.filter("seq = 1"), "start_key", "attribution") == [(200, "process")]


def test_flush_only_disk_has_all_series(spark):
    events = make(spark, DISK, (1, S, 2, "flush", None, None, 4))
    assert rows(disk.disk_operations(events), "disk", "operation", "value") == [(2, "flush", 1), (2, "read", 0), (2, "write", 0)]
    assert rows(disk.disk_totals(events), "read_bytes", "written_bytes") == [(0, 0)]


NET = "seq bigint, ts_ns bigint, cls string, pid bigint, size bigint, proto bigint, failure_code bigint"


def test_unknown_network_pid_is_dropped_everywhere(spark):
    p = procs(spark, [(1, 0, 100, 10, "a", 1)])
    events = make(spark, NET, (1, S, "tcp_send", 99, 100, None, None), (2, S, "tcp_send", 10, 5, None, None))
    assert rows(network.network_totals(events, p), "protocol", "sent_bytes") == [("tcp", 5)]
    assert rows(network.network_bytes(events, p), "process_name", "sent_bytes") == [("a", 5)]


def test_failures_belong_to_system(spark):
    p = procs(spark, [(1, 0, 400, 4, "System", 0)])
    events = make(spark, NET, (1, S, "tcp_fail", None, None, 2, 1), (2, S, "tcp_fail", None, None, 23, 1), (3, S, "udp_fail", None, None, 99, 1))
    got = network.connections_failed(events, p)
    assert rows(got, "process_name", "protocol", "address_family", "failure_code", "value") == [
        ("System", "tcp", "ipv4", 1, 1), ("System", "tcp", "ipv6", 1, 1), ("System", "udp", "ipv4", 1, 1),
    ]
    assert network.connections_failed(events, p.filter("pid <> 4")).count() == 0


SWITCH = "seq bigint, ts_ns bigint, cpu int, new_tid bigint, old_wait_reason bigint"


def test_gap_buckets(spark):
    gaps_us = [1, 7, 8, 9, 16384, 99999]
    at, times = 0, [0, 0]
    for g in gaps_us:
        at += g * 1000
        times.append(at)
    at += 400
    times.append(at)
    switches = make(spark, SWITCH, *[(i, t, 0, 1, 0) for i, t in enumerate(times)])
    assert sorted(r[0] for r in rows(switch_gaps(switches), "gap_ns")) == sorted([g * 1000 for g in gaps_us] + [400])
    h = threads.cswitch_intervals(switches).first()
    expected = [0] * 15
    for bucket in [0, 2, 3, 3, 14, 14, 0]:
        expected[bucket] += 1
    assert list(h["buckets"]) == expected
    assert (h["n"], h["total"]) == (7, sum(gaps_us) * 1000 + 400)
    upper = threads.cswitch_intervals(switches, bounds="upper").first()
    assert sum(upper["buckets"]) == 6 and upper["buckets"][3] == 2 and upper["buckets"][4] == 1


def test_wait_reasons(spark):
    switches = make(spark, SWITCH, (1, 1, 0, 1, 37), (2, 2, 0, 1, 38), (3, 3, 0, 1, 255))
    none = spark.createDataFrame([], "host string, seq bigint, ts_ns bigint")
    got = threads.thread_states(switches, none, none, none)
    assert rows(got, "state", "wait_reason", "value") == [("running", "none", 3), ("waiting", "MaximumWaitReason", 1)]


POINT = "seq bigint, ts_ns bigint, cpu int, initial_ns bigint"


def pairs(spark, isr, dpc, switches=()):
    i = make(spark, POINT, *isr)
    d = make(spark, POINT, *dpc)
    c = make(spark, "seq bigint, ts_ns bigint, cpu int", *(switches or [(999, 10**17, 9)]))
    return pair_isr_dpc(i, finalised_dpcs(d, c))


def test_nested_interrupts(spark):
    got = pairs(spark, [(1, 10, 0, 10), (2, 20, 0, 20)], [(3, 30, 0, 30), (4, 40, 0, 40)], [(5, 50, 0)])
    assert rows(got, "dpc_seq", "isr_seq", "latency_ns") == [(3, 2, 10), (4, 1, 30)]


def test_pairing_limits(spark):
    hour = 3600 * S
    got = pairs(
        spark,
        [(1, 20, 0, 20), (2, 100, 1, 100), (3, 0, 2, 0), (4, 1, 3, 1)],
        [(11, 10, 0, 10), (12, 100, 1, 100), (13, hour, 2, hour), (14, hour, 3, hour)],
        [(21, 15, 0), (22, 200, 1), (23, hour + 5, 2), (24, hour + 5, 3)],
    )
    assert rows(got, "dpc_seq", "isr_seq", "latency_ns") == [(12, 2, 0), (14, 4, hour - 1)]


def test_last_call_on_a_cpu_is_not_executed(spark):
    d = make(spark, POINT, (1, 10, 0, 10), (2, 20, 0, 20))
    c = make(spark, "seq bigint, ts_ns bigint, cpu int", (3, 5, 0))
    assert rows(finalised_dpcs(d, c), "seq", "end_ns", "duration_ns") == [(1, 20, 10)]
    i = make(spark, POINT, (7, 15, 0, 15))
    assert pair_isr_dpc(i, finalised_dpcs(d, c)).count() == 0
    counts = interrupts.dpc_counts(i, d, c, per_cpu=True)
    assert rows(counts, "cpu", "queued", "executed") == [(0, 1, 1)]


def test_latency_histogram_exists_without_pairs(spark):
    i = make(spark, POINT, (7, 15, 0, 15))
    none = spark.createDataFrame([], "host string, " + POINT)
    c = spark.createDataFrame([], "host string, seq bigint, ts_ns bigint, cpu int")
    got = interrupts.isr_dpc_latency(i, none, c).first()
    assert (got["n"], got["total"], sum(got["buckets"])) == (0, 0, 0)


def test_bounded_buckets(spark):
    df = make(spark, "us bigint", (1,), (2,), (48828125,), (48828126,))
    h = histogram(df, F.col("us"), ["host"], DURATION_BOUNDS_US)
    row = h.first()
    assert (row["n"], row["buckets"][0], row["buckets"][1], row["buckets"][11]) == (4, 1, 1, 1)
    assert rows(cumulative(h, DURATION_BOUNDS_US).filter("le = 48828125.0"), "bucket_count") == [(3,)]
    assert cumulative(h, DURATION_BOUNDS_US).count() == 12 and len(GAP_BOUNDS_MS) == 15


IMAGE = "seq bigint, ts_ns bigint, base bigint, size bigint, file_name string"
UNLOAD = "seq bigint, ts_ns bigint, base bigint"


def test_image_reference_count_and_reload(spark):
    loads = make(spark, IMAGE, (1, 10, 4096, 100, "C:\\d\\foo.SYS"), (2, 20, 4096, 100, "foo.SYS"), (6, 60, 4096, 50, "/x/bar.sys"), (9, 5, 0, 10, "zero"))
    unloads = make(spark, UNLOAD, (3, 30, 4096), (4, 40, 4096), (5, 50, 4096), (7, 5, 8192))
    got = entities.image_intervals(loads, unloads)
    assert rows(got, "image_name", "valid_from", "unload_ns") == [("bar.sys", 60, None), ("foo.SYS", 10, 40)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_address_bounds_and_time(spark, strategy):
    loads = make(spark, IMAGE, (1, 10, 1 << 40, 300, "a.sys"), (2, 10, (1 << 40) + 5000, 1 << 21, "big.sys"), (3, 60, 1 << 40, 300, "b.sys"))
    unloads = make(spark, UNLOAD, (5, 50, 1 << 40))
    images = entities.image_intervals(loads, unloads)
    base = 1 << 40
    events = make(
        spark, "seq bigint, ts_ns bigint, address bigint",
        (1, 20, base), (2, 20, base + 299), (3, 20, base + 300), (4, 5, base), (5, 55, base), (6, 65, base + 1),
        (7, 20, base + 5000 + (1 << 21) - 1), (8, 20, None), (9, 20, base - 1),
    )
    got = resolve_images(events, images, strategy=strategy)
    assert rows(got, "seq", "image_name") == [
        (1, "a.sys"), (2, "a.sys"), (3, None), (4, None), (5, None), (6, "b.sys"), (7, "big.sys"), (8, None), (9, None),
    ]


def test_overlapping_images_latest_load_then_highest_base(spark):
    images = make(
        spark, "seq bigint, base bigint, size bigint, image_name string, valid_from bigint, valid_to bigint",
        (1, 1000, 500, "old", 10, OPEN_END), (2, 1100, 500, "new", 20, OPEN_END), (3, 1200, 500, "low", 30, OPEN_END), (4, 1250, 500, "high", 30, OPEN_END),
    )
    events = make(spark, "seq bigint, ts_ns bigint, address bigint", (1, 15, 1150), (2, 25, 1150), (3, 35, 1300), (4, 35, 1050))
    assert rows(resolve_images(events, images), "seq", "image_name") == [(1, "old"), (2, "new"), (3, "high"), (4, "old")]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_an_older_image_holds_the_address_again(spark, strategy):
    images = make(
        spark, "seq bigint, base bigint, size bigint, image_name string, valid_from bigint, valid_to bigint",
        (1, 1000, 500, "a", 0, OPEN_END), (2, 1100, 500, "b", 10, 20), (3, 1200, 500, "c", 15, 40), (4, 1100, 500, "d", 18, 18), (5, 1100, 500, "e", 50, 60),
        (6, 5000, 500, "x", 0, 10), (7, 5100, 500, "y", 10, 30),
    )
    times = [5, 10, 14, 15, 20, 39, 40, 49, 55, 60]
    events = make(spark, "seq bigint, ts_ns bigint, address bigint", *[(t, t, 1300) for t in times], (109, 9, 5200), (110, 10, 5200), (130, 30, 5200))
    got = rows(resolve_images(events, images, strategy=strategy), "seq", "image_name")
    assert sorted(got) == sorted([*zip(times, "abb" "ccca" "aea"), (109, "x"), (110, "y"), (130, None)])


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_of_overlapping_epochs_the_latest_counts(spark, strategy):
    epochs = make(spark, "seq bigint, valid_from bigint, valid_to bigint, name string", (1, 0, 100, "x"), (2, 10, 20, "y"), (3, 10, 30, "z"))
    facts = make(spark, "seq bigint, ts_ns bigint", (1, 5), (2, 10), (3, 25), (4, 30), (5, 99))
    got = asof_join(facts, epochs, ["host"], ["name"], strategy=strategy)
    assert rows(got, "seq", "name") == [(1, "x"), (2, "z"), (3, "z"), (4, None), (5, None)]


def test_driver_series_restart_after_unload(spark):
    loads = make(spark, IMAGE, (1, 0, 4096, 4096, "a.sys"), (3, 60, 4096, 4096, "a.sys"))
    images = entities.image_intervals(loads, make(spark, UNLOAD, (2, 50, 4096)))
    durations = make(spark, "cpu int, seq bigint, ts_ns bigint, end_ns bigint, routine bigint, duration_us bigint", (0, 1, 10, 20, 4096, 3), (0, 2, 70, 80, 4097, 9))
    kept = interrupts.dpc_duration_by_image(durations, images)
    assert rows(kept, "image_name", "n", "total") == [("a.sys", 1, 9)]
    assert rows(interrupts.dpc_duration_by_image(durations, images, prune_unloaded=False), "n", "total") == [(2, 12)]


def test_cleanup_thresholds(spark):
    times = [0, 10, 20, 30, 40, 110]
    got = scrapes.cleanup_thresholds(make(spark, "ts_ns bigint", *[(t * S,) for t in times]))
    assert rows(got.filter("scrape_id = 5"), "grace", "threshold") == [(3, 2)]
    assert rows(got.filter("scrape_id = 6"), "threshold") == [(6,)]
    assert rows(got.filter("scrape_id = 1"), "grace", "threshold") == [(1, 0)]
    assert scrapes.idle_cleanup_due(0, 3 * 3600 * S + 1) and not scrapes.idle_cleanup_due(0, 3 * 3600 * S)


def test_generation_expiry(spark):
    s = make(spark, "ts_ns bigint", *[(t * S,) for t in (10, 20, 30, 40, 50, 60)])
    e = make(spark, "id bigint, end_ns bigint", (1, 5 * S), (2, 25 * S), (3, 59 * S), (4, None))
    got = scrapes.cleaned_at(e, s)
    # Grace is 3 generations: scrape k cleans what ended before scrape k - 3 - 1 completed.
    assert rows(got, "id", "generation", "cleaned_scrape") == [(1, 0, 4), (2, 2, 6), (3, 5, None), (4, None, None)]


def test_counters_fall_when_instances_expire(spark):
    p = procs(spark, [(1, 0, 100, 10, "a", 1), (2, 0, 200, 11, "b", 1)], [(3, 5 * S, 100)])
    deltas = make(spark, "start_key bigint, ts_ns bigint, disk bigint, value bigint", (100, S, 0, 4), (200, 2 * S, 0, 1), (200, 45 * S, 0, 1))
    s = make(spark, "ts_ns bigint", (10 * S,), (20 * S,), (40 * S,), (50 * S,))
    kept = scrapes.snapshot_counters(deltas, s, ["disk"], every_scrape=True)
    assert rows(kept, "scrape_id", "value") == [(1, 5), (2, 5), (3, 5), (4, 6)]
    falling = scrapes.snapshot_counters(deltas, s, ["disk"], processes=p, retain_expired=False, every_scrape=True)
    assert rows(falling, "scrape_id", "value") == [(1, 5), (2, 5), (3, 1), (4, 2)]
    assert rows(scrapes.snapshot_counters(deltas, s, ["disk"]), "scrape_id", "value") == [(1, 5), (4, 6)]


def test_unowned_faults_go_to_the_unknown_process(spark):
    p = procs(spark, [(1, 0, 100, 10, "a", 1)])
    th = entities.thread_intervals(make(spark, THREAD, (2, S, 10, 7, 0)), no_thread_ends(spark), p)
    faults = make(spark, "seq bigint, ts_ns bigint, tid bigint", (1, 2 * S, 7), (2, 2 * S, 8), (3, 0, 7))
    got = memory.hard_faults_by_program(faults, th, p)
    assert rows(got, "process_name", "pe_checksum", "session_id", "value") == [("a", "0x0", 1, 1), ("unknown_process", "0x0", 0, 2)]


def test_program_filter_ignores_bad_patterns(spark):
    df = make(spark, "process_name string", ("svchost.exe",), ("notepad.exe",))
    assert rows(entities.filter_programs(df, ["svc.*", "("]), "process_name") == [("svchost.exe",)]
    assert entities.filter_programs(df, []).count() == 2
    assert entities.filter_programs(df, ["("]).count() == 0


def test_disk_dimension_defaults(spark):
    physical = make(spark, "seq bigint, disk bigint, manufacturer string", (1, 0, "A"), (2, 0, None))
    logical = make(spark, "seq bigint, disk bigint, drive_letter string, file_system string", (3, 0, "C:", "NTFS"), (4, 1, None, None))
    assert rows(disk_dim(physical, logical), "disk", "manufacturer", "drive_letter", "file_system") == [
        (0, "Unknown", "C:", "NTFS"), (1, None, "", "Unknown"),
    ]


def test_full_keys_fill_both_sides(spark):
    a, b = make(spark, "cpu int, x bigint", (0, 5)), make(spark, "cpu int, y bigint", (1, 6))
    assert rows(full_keys(a, b, ["host", "cpu"], ["x", "y"]), "cpu", "x", "y") == [(0, 5, 0), (1, 0, 6)]


def test_hosts_do_not_mix(spark):
    starts = spark.createDataFrame([("h1", 1, 0, 100, 10, "a", 1), ("h2", 1, 5 * S, 100, 10, "b", 1)], "host string, " + START)
    ends = spark.createDataFrame([], "host string, " + END)
    p = entities.process_intervals(starts, ends)
    facts = spark.createDataFrame([("h1", 1, 6 * S, 10), ("h2", 2, 6 * S, 10), ("h2", 3, S, 10)], "host string, seq bigint, ts_ns bigint, pid bigint")
    for strategy in STRATEGIES:
        got = attribute.attribute_by_pid(facts, p, strategy=strategy).join(p.select("host", "start_key", "process_name"), ["host", "start_key"], "left")
        assert rows(got, "host", "seq", "process_name") == [("h1", 1, "a"), ("h2", 2, "b"), ("h2", 3, None)]


def test_idle_failsafe_cleans_up_without_scrapes(spark):
    h = 3600 * S
    times = make(spark, "ts_ns bigint", (0,), (10 * h,), (13 * h,))
    every = scrapes.with_idle_cleanups(times, 3 * h, 20 * h)
    assert sorted(r[0] // h for r in rows(every, "ts_ns")) == [0, 3, 6, 9, 10, 13, 16, 19]
    gone = make(spark, "seq bigint, end_ns bigint", (1, h), (2, 10 * h + 1), (3, None), (4, 19 * h + 1))
    got = scrapes.cleaned_at(gone, times, idle_limit_ns=3 * h, until_ns=20 * h)
    assert sorted(rows(got, "seq", "cleaned_ns")) == [(1, 3 * h), (2, 13 * h), (3, None), (4, None)]
    plain = scrapes.cleaned_at(gone, times)
    assert sorted(rows(plain, "seq", "cleaned_ns"))[0] == (1, 10 * h)


def test_temporary_tables_are_deleted_by_their_owner(spark):
    import os

    kept = materialise(spark.range(3))
    with temporary_tables(spark):
        inner = materialise(spark.range(5))
        assert inner.count() == 5
        path = inner.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert not os.path.exists(os.path.dirname(path)) and kept.count() == 3


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_large_image_tables_are_not_sent_out(spark, strategy, monkeypatch):
    monkeypatch.setattr(images_of, "SMALL_BYTES", 0)
    loaded = make(
        spark, "seq bigint, base bigint, size bigint, image_name string, valid_from bigint, valid_to bigint",
        (1, 1000, 500, "a", 0, OPEN_END), (2, 1100, 500, "b", 10, 20),
    )
    loaded = materialise(loaded)
    calls = make(spark, "seq bigint, ts_ns bigint, address bigint", (5, 5, 1300), (15, 15, 1300), (20, 20, 1300))
    matched = images_of.match_addresses(materialise(calls.select("host", "address").distinct()), loaded)
    assert "Broadcast" not in matched._jdf.queryExecution().executedPlan().toString()
    got = resolve_images(calls, loaded, strategy=strategy)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "seq", "image_name") == [(15, "b"), (20, "a"), (5, "a")]
