"""Random traces: the batch plans against small event-by-event replays, and results that do not depend on the chunk length."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tests.util import make, rows
from tracelake.operators import attribute, carry, entities
from tracelake.operators.asof import asof_join
from tracelake.operators.images import holding_epochs, match_addresses
from tracelake.operators.pairing import finalised_dpcs, pair_isr_dpc, switch_gaps

CHUNKS = [7, 100, 10**12]
OPEN = (1 << 63) - 1
GRACE = 30


def lifecycle(seed, ids, n):
    """Starts and ends of ids in time order, as (seq, ts, id, key or None)."""
    rng = random.Random(seed)
    starts, ends, at, current = [], [], 0, {}
    for seq in range(n):
        at += rng.choice([0, 1, 1, 5, 20])
        i = rng.choice(ids)
        if rng.random() < 0.5 or i not in current:
            current[i] = 1000 + seq
            starts.append((seq, at, i, 1000 + seq))
        else:
            ends.append((seq, at, i, current[i]))
    return starts, ends, at


def replay_owner(starts, ends, facts):
    """Event by event: the mapping of an id is replaced by a start and dropped GRACE after the end of its owner."""
    events = [(ts, seq, 0, i, key) for seq, ts, i, key in starts] + [(ts, seq, 0, i, None) for seq, ts, i, _ in ends]
    events += [(ts, 10**9 + seq, 1, i, seq) for seq, ts, i in facts]
    owner, expires, out = {}, {}, {}
    for ts, _, kind, i, value in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        if kind == 0 and value is not None:
            owner[i], expires[i] = value, None
        elif kind == 0:
            if i in owner and expires[i] is None:
                expires[i] = ts + GRACE
        else:
            live = i in owner and (expires[i] is None or ts < expires[i])
            out[value] = owner[i] if live else None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_attribution_replay(spark, seed):
    rng = random.Random(seed + 100)
    starts, ends, last = lifecycle(seed, [10, 11, 12], 120)
    facts = [(seq, rng.randint(0, last + 50), rng.choice([10, 11, 12, 13])) for seq in range(300)]
    want = replay_owner(starts, ends, facts)
    s = make(spark, "seq bigint, ts_ns bigint, pid bigint, start_key bigint, process_name string, session_id bigint", *[(*r, "p", 0) for r in starts])
    e = make(spark, "seq bigint, ts_ns bigint, pid bigint", *[r[:3] for r in ends])
    f = make(spark, "seq bigint, ts_ns bigint, pid bigint", *facts)
    for chunk in CHUNKS:
        p = entities.process_intervals(s, e, GRACE, chunk)
        for strategy in ("broadcast", "scan"):
            got = dict(rows(attribute.attribute_by_pid(f, p, strategy=strategy, chunk_ns=chunk), "seq", "start_key"))
            assert got == want, (chunk, strategy)


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_ends_equal_pid_ends(spark, seed):
    starts, ends, _ = lifecycle(seed, [10, 11], 80)
    s = make(spark, "seq bigint, ts_ns bigint, pid bigint, start_key bigint, process_name string, session_id bigint", *[(*r, "p", 0) for r in starts])
    by_pid = make(spark, "seq bigint, ts_ns bigint, pid bigint", *[r[:3] for r in ends])
    by_key = make(spark, "seq bigint, ts_ns bigint, start_key bigint", *[(r[0], r[1], r[3]) for r in ends])
    columns = ["start_key", "end_ns", "valid_from", "valid_to"]
    assert rows(entities.process_intervals(s, by_pid, GRACE), *columns) == rows(entities.process_intervals(s, by_key, GRACE), *columns)


def replay_pairs(events):
    """Arrival order per CPU: a call is finalised by the next call or switch, then takes the closest earlier interrupt."""
    pending, waiting, out = {}, {}, []
    for ts, seq, cpu, kind in sorted(events):
        if kind == "isr":
            waiting.setdefault(cpu, []).append((ts, seq))
            continue
        if cpu in pending:
            at, dpc = pending.pop(cpu)
            earlier = [w for w in waiting.get(cpu, []) if 0 <= at - w[0] < 3600 * 10**9]
            if earlier:
                best = max(earlier)
                waiting[cpu].remove(best)
                out.append((dpc, best[1], at - best[0]))
        if kind == "dpc":
            pending[cpu] = (ts, seq)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_pairing_replay(spark, seed):
    """Calls are logged at their initial time here, so both orders agree and ties do not occur."""
    rng = random.Random(seed)
    at, events = 0, []
    for seq in range(600):
        at += rng.randint(1, 9)
        events.append((at, seq, rng.randint(0, 2), rng.choice(["isr", "isr", "dpc", "dpc", "switch"])))
    # In arrival order an interrupt may come between a call and its end; it is later than the call and cannot match it.
    want = sorted(replay_pairs(events))
    point = "seq bigint, ts_ns bigint, cpu int, initial_ns bigint"
    isr = make(spark, point, *[(s, t, c, t) for t, s, c, k in events if k == "isr"])
    dpc = make(spark, point, *[(s, t, c, t) for t, s, c, k in events if k == "dpc"])
    switch = make(spark, "seq bigint, ts_ns bigint, cpu int", *[(s, t, c) for t, s, c, k in events if k == "switch"])
    for chunk in CHUNKS:
        got = pair_isr_dpc(isr, finalised_dpcs(dpc, switch, chunk), chunk_ns=chunk)
        assert sorted(rows(got, "dpc_seq", "isr_seq", "latency_ns")) == want
    assert want


def test_order_by_initial_time_is_the_definition(spark):
    """Two calls finalised in the reverse order of their initial times: the batch rule serves the earlier one first.

    An arrival-order replay would let the call finalised first (initial time 40) take interrupt 2 and leave 1 for the other
    (initial time 30, logged later). Ordered by initial time, the call at 30 takes interrupt 2, and the one at 40 takes 1.
    """
    point = "seq bigint, ts_ns bigint, cpu int, initial_ns bigint"
    isr = make(spark, point, (1, 10, 0, 10), (2, 20, 0, 20))
    dpc = make(spark, point, (3, 50, 0, 40), (4, 60, 0, 30))
    switch = make(spark, "seq bigint, ts_ns bigint, cpu int", (5, 70, 0))
    got = pair_isr_dpc(isr, finalised_dpcs(dpc, switch))
    assert rows(got, "dpc_seq", "isr_seq", "latency_ns") == [(3, 1, 30), (4, 2, 10)]


@pytest.mark.parametrize("seed", [1, 2])
def test_depth_replay(spark, seed):
    rng = random.Random(seed)
    steps = [(seq, seq // 3, rng.randint(0, 1), rng.choice([1, -1, -1])) for seq in range(400)]
    height, want = {}, {}
    for seq, _, key, step in steps:
        height[key] = max(0, height.get(key, 0) + step)
        want[seq] = height[key]
    df = make(spark, "seq bigint, ts_ns bigint, k int, step int", *steps)
    for chunk in CHUNKS:
        got = carry.stack_depth(df, ["host", "k"], ["ts_ns", "seq"], F.col("step"), "depth", chunk_ns=chunk)
        assert dict(rows(got, "seq", "depth")) == want


def test_fill_and_neighbours_do_not_depend_on_chunks(spark):
    rng = random.Random(5)
    data = [(seq, rng.randint(0, 500), rng.randint(0, 1), rng.choice([None, seq])) for seq in range(300)]
    df = make(spark, "seq bigint, ts_ns bigint, k int, v bigint", *data)
    for backward in (False, True):
        for inclusive in (False, True):
            results = []
            for chunk in CHUNKS:
                got = carry.fill(df, ["host", "k"], ["ts_ns", "seq"], {"out": F.col("v")}, backward=backward, inclusive=inclusive, chunk_ns=chunk)
                results.append(rows(got, "seq", "out"))
            assert results[0] == results[1] == results[2]
            ordered = sorted(data, key=lambda r: (r[1], r[0]), reverse=backward)
            want, last = {}, {}
            for seq, _, k, v in ordered:
                if inclusive and v is not None:
                    last[k] = v
                want[seq] = last.get(k)
                if v is not None:
                    last[k] = v
            assert dict(results[0]) == want


@pytest.mark.parametrize("chunk", CHUNKS)
def test_gaps_on_one_hot_cpu(spark, chunk):
    rng = random.Random(9)
    times = sorted(rng.randint(0, 10_000) for _ in range(500))
    df = make(spark, "seq bigint, ts_ns bigint, cpu int", *[(i, t, 0) for i, t in enumerate(times)])
    want = sorted(b - a for a, b in zip(times, times[1:]) if b > a)
    assert sorted(r[0] for r in rows(switch_gaps(df, chunk), "gap_ns")) == want


def test_missing_keys_match_nothing_and_spread(spark):
    epochs = make(spark, "tid bigint, seq bigint, valid_from bigint, valid_to bigint, owner bigint", (1, 1, 0, 100, 7))
    facts = make(spark, "seq bigint, ts_ns bigint, tid bigint", *[(i, i, None if i % 2 else 1) for i in range(50)])
    for strategy in ("broadcast", "scan"):
        got = asof_join(facts, epochs, ["host", "tid"], ["owner"], strategy=strategy, chunk_ns=10)
        assert rows(got.groupBy("owner").count()) == [(7, 25), (None, 25)]


@pytest.mark.parametrize("seed", [1, 2])
def test_range_join_brute_force(spark, seed):
    """Images of very different size, overlapping or not, also above the middle of the address space."""
    rng = random.Random(seed)
    images = []
    for seq in range(60):
        base = rng.choice([0, 1 << 40, -(1 << 62), (1 << 62)]) + rng.randint(0, 1 << 22)
        images.append((seq, base, rng.choice([1, 100, 4096, 70_000, 1 << 21, 1 << 33])))
    addresses = sorted({b + d for _, b, s in images for d in (-1, 0, s // 2, s - 1, s)})
    want = sorted((a, seq) for a in addresses for seq, b, s in images if b <= a < b + s)
    im = make(spark, "seq bigint, base bigint, size bigint", *images)
    ad = make(spark, "address bigint", *[(a,) for a in addresses])
    got = rows(match_addresses(ad, im), "address", "seq")
    assert sorted(got) == want


def swept(epochs):
    """(from, to, seq) of the holder of every stretch, by a sweep with a heap: the latest load among those that live."""
    points = sorted({t for e in epochs for t in (e[0], e[1]) if e[0] < e[1]})
    starts = sorted(e for e in epochs if e[0] < e[1])
    heap, out, i = [], [], 0
    for now, after in zip(points, points[1:], strict=False):
        while i < len(starts) and starts[i][0] <= now:
            start, end, base, seq = starts[i]
            heapq.heappush(heap, (-start, -base, -seq, end))
            i += 1
        while heap and heap[0][3] <= now:
            heapq.heappop(heap)
        if heap:
            out.append((now, after, -heap[0][2]))
    return out


def pieces(df):
    """Stretches of one holder joined where they touch."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.address, r.valid_from)):
        mine = out.setdefault(r.address, [])
        if mine and mine[-1][1] == r.valid_from and mine[-1][2] == r.seq:
            mine[-1] = (mine[-1][0], r.valid_to, r.seq)
        else:
            mine.append((r.valid_from, r.valid_to, r.seq))
    return out


def joined(stretches):
    out = []
    for a, b, seq in stretches:
        if out and out[-1][1] == a and out[-1][2] == seq:
            out[-1] = (out[-1][0], b, seq)
        else:
            out.append((a, b, seq))
    return out


@pytest.mark.parametrize("chunk_ns", [7, 10**12])
def test_holders_of_overlapping_epochs(spark, chunk_ns):
    """Nested, chained, equal and empty epochs, open ends and times before zero, over several addresses."""
    rng = random.Random(9)
    every = {}
    for address in range(12):
        for i in range(rng.choice([1, 2, 5, 40])):
            start = rng.randrange(-20, 60)
            end = rng.choice([start, start + rng.randrange(1, 60), start + 1, OPEN])
            every.setdefault(address, []).append((start, end, rng.randrange(3), 100 * address + i))
    values = [(a, *e) for a, es in every.items() for e in es]
    df = make(spark, "address long, valid_from long, valid_to long, base long, seq long", *values)
    got = pieces(holding_epochs(df, chunk_ns))
    assert {a: joined(swept(es)) for a, es in every.items() if swept(es)} == got


def test_many_epochs_over_one_address(spark):
    """Twenty thousand images that all overlap, half of them nested: rows grow by the logarithm, not with the square."""
    rng, n = random.Random(10), 20_000
    nested = [(i, 4 * n - i, 1, i) for i in range(n // 2)]
    epochs = nested + [(rng.randrange(4 * n), 4 * n + rng.randrange(4 * n), 2, n + i) for i in range(n // 2)]
    df = make(spark, "address long, valid_from long, valid_to long, base long, seq long", *[(1, *e) for e in epochs])
    assert pieces(holding_epochs(df, 1000))[1] == joined(swept(epochs))
