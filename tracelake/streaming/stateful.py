"""Entity and interrupt state in the state store: the optional form of the stream operators, by ``transformWithState``.

Each processor keeps what one id needs: the rows that wait for the watermark, the present owner, the unpaired interrupts. Rows go on in time order
once the watermark has passed them, so that the order in which they arrive does not matter. Unlike the runner's micro-batches over
carried tables this runs Python code per row; it is for streams whose state is too large to write anew with every batch.
The session needs the RocksDB state store (``use_state_store``). The watermark is one for all hosts.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from tracelake.functions.names import UNKNOWN_START_KEY
from tracelake.functions.units import NS_PER_MS, NS_PER_S
from tracelake.operators.asof import OPEN_END
from tracelake.operators.entities import GRACE_NS, THREAD_SLACK_NS
from tracelake.operators.pairing import MAX_PAIR_NS
from tracelake.operators.scrapes import IDLE_LIMIT_NS
from tracelake.sources.schema import WIDE_EVENTS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The class of rows that carry time on and nothing else.
END_MARKER = "end_marker"


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of queries started from now on in RocksDB, which ``transformWithState`` asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def end_marker(spark: SparkSession, ts_ns: int) -> DataFrame:
    """A row of ``WIDE_EVENTS`` that moves the watermark on to ``ts_ns``, so that what waits is processed once a stream has ended."""
    row = spark.range(1).select(F.lit("").alias("host"), F.lit(0).cast("bigint").alias("seq"), F.lit(ts_ns).cast("bigint").alias("ts_ns"), F.lit(END_MARKER).alias("cls"))
    return row.select(*[(F.col(f.name) if f.name in row.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in WIDE_EVENTS.fields])


def _longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


class InOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, then hands them over by (time, lifecycle before facts, seq).

    A subclass names its ``row`` fields (``ts_ns``, ``phase`` and ``seq`` come first) and has ``open`` (its other states), ``step`` (one row) and
    ``settle`` (what follows once the watermark stands at a time; returns when it wants to be asked again, or None).
    """

    row: StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, row: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def settle(self, key: tuple, upto_ns: int) -> Iterator[Row]:
        return iter(())

    def wake_ns(self) -> int | None:
        return None

    def _wake_at(self, ts_ns: int) -> None:
        self.handle.registerTimer(ts_ns // NS_PER_MS + 2)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        new = [tuple(r[f.name] for f in self.row.fields) for r in rows if r["cls"] != END_MARKER]
        if new:
            self.waiting.appendList(new)
            self._wake_at(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # Rows at the watermark's own microsecond have all come: Spark drops later ones as late.
        upto_ns = (timerValues.getCurrentWatermarkInMs() * 1000 + 1) * 1000 - 1
        held = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in held if r[0] <= upto_ns]
        if due:
            rest = held[len(due):]
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.load()
            for r in due:
                yield from self.step(key, r)
        else:
            rest = held
            self.load()
        yield from self.settle(key, upto_ns)
        self.save()
        wakes = [rest[0][0]] if rest else []
        later = self.wake_ns()
        for at in [*wakes, *([later] if later is not None else [])]:
            self._wake_at(max(at, upto_ns))

    def load(self) -> None:
        """Read the states once per call; ``save`` writes them back."""

    def save(self) -> None:
        pass


# Interrupts -----------------------------------------------------------------------------------

PAIRS = StructType([StructField("host", StringType()), *_longs("cpu", "dpc_seq", "isr_seq", "isr_ns", "dpc_ns", "latency_ns")])


class InterruptPairs(InOrder):
    """Per (host, cpu): a call takes the latest unpaired interrupt before it, by initial time, less than the limit back.

    A call counts once the next call or switch on its CPU ends it. Interrupts and ended calls are ordered by initial time once nothing that precedes them
    can come: calls last ``call_limit_ns`` at most, and a call still open holds the later ones back, for the pairing limit at most. The
    stack of unpaired interrupts is cut at its old end as time goes on.
    """

    row = StructType(_longs("ts_ns", "phase", "seq", "kind", "initial_ns"))  # kind: 0 switch, 1 interrupt, 2 call

    def __init__(self, limit_ns: int = MAX_PAIR_NS, call_limit_ns: int = NS_PER_S):
        self.limit_ns, self.call_limit_ns = limit_ns, call_limit_ns

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.call = handle.getValueState("call", StructType(_longs("ts_ns", "initial_ns", "seq")))
        self.queued = handle.getListState("queued", StructType(_longs("initial_ns", "is_dpc", "seq")))
        self.unpaired = handle.getListState("unpaired", StructType(_longs("initial_ns", "seq")))

    def load(self) -> None:
        self.running = self.call.get() if self.call.exists() else None
        self.queue = [tuple(r) for r in self.queued.get()]

    def save(self) -> None:
        self.call.update(self.running) if self.running else self.call.clear()
        self.queued.put(self.queue) if self.queue else self.queued.clear()

    def step(self, key: tuple, row: tuple) -> Iterator[Row]:
        ts_ns, _, seq, kind, initial_ns = row
        if kind == 1:
            self.queue.append((initial_ns, 0, seq))
        else:
            if self.running:
                self.queue.append((self.running[1], 1, self.running[2]))
            self.running = (ts_ns, initial_ns, seq) if kind == 2 else None
        return iter(())

    def settle(self, key: tuple, upto_ns: int) -> Iterator[Row]:
        frontier = upto_ns - self.call_limit_ns
        if self.running and self.running[0] > upto_ns - self.limit_ns:
            frontier = min(frontier, self.running[1])
        ready = sorted(r for r in self.queue if r[0] < frontier)
        self.queue = [r for r in self.queue if r[0] >= frontier]
        if not ready:
            return
        stack = [tuple(r) for r in self.unpaired.get()]
        for initial_ns, is_dpc, seq in ready:
            if not is_dpc:
                stack.append((initial_ns, seq))
            elif stack:
                at, isr = stack.pop()
                if initial_ns - at < self.limit_ns:
                    yield Row(host=key[0], cpu=key[1], dpc_seq=seq, isr_seq=isr, isr_ns=at, dpc_ns=initial_ns, latency_ns=initial_ns - at)
        stack = [r for r in stack if r[0] > frontier - self.limit_ns]
        self.unpaired.put(stack) if stack else self.unpaired.clear()

    def wake_ns(self) -> int | None:
        times = [min(r[0] for r in self.queue) + self.call_limit_ns] if self.queue else []
        if self.running:
            times.append(self.running[0] + self.limit_ns)
        return min(times, default=None)


def interrupt_pairs(events: DataFrame, delay: str, limit_ns: int = MAX_PAIR_NS, call_limit_ns: int = NS_PER_S) -> DataFrame:
    """The streaming form of ``pair_isr_dpc`` over ``WIDE_EVENTS`` rows with an event time ``ts``: same columns, one row per pair."""
    rows = events.filter(F.col("cls").isin("isr", "dpc", "cswitch", END_MARKER)).withWatermark("ts", delay)
    kind = F.when(F.col("cls") == "isr", 1).when(F.col("cls") == "dpc", 2).otherwise(0)
    cpu = F.coalesce(F.col("cpu"), F.lit(-1)).cast("bigint").alias("cpu")
    shaped = rows.select("ts", "host", cpu, "cls", "ts_ns", F.lit(0).cast("bigint").alias("phase"), "seq", kind.cast("bigint").alias("kind"), "initial_ns")
    return shaped.groupBy("host", "cpu").transformWithState(InterruptPairs(limit_ns, call_limit_ns), PAIRS, "append", "eventTime")


# Owners ---------------------------------------------------------------------------------------

#: What both owner processors return: lifecycle rows and facts with the instance they belong to (null: nobody).
OWNED = StructType([
    StructField("host", StringType()), *_longs("pid", "tid", "seq", "ts_ns"), StructField("ts", TimestampType()), StructField("cls", StringType()),
    *_longs("start_key", "expires_ns", "size", "sub_process_tag"), StructField("process_name", StringType()), *_longs("session_id", "pe_checksum"),
])
EXPIRES = "owner_expires"
# What comes before facts of the same time: for a pid the life of its processes, for a tid that of its threads.
_OF_PID, _OF_TID = ("process_start", "process_end"), ("thread_start", "thread_end", EXPIRES)


_OWNED_ROW = Row(*OWNED.names)


def _owned(host: str, class_name: str, **values) -> Row:
    given = {"host": host, "cls": class_name, **values}
    return _OWNED_ROW(*[given.get(n) for n in OWNED.names])


class ProcessOwners(InOrder):
    """Per (host, pid): which instance owns the pid at each row.

    An instance owns its pid from its start until the pid starts again or ``grace_ns`` after its end. Thread starts are facts of their pid; one that
    nobody owns waits for a process that starts less than ``slack_ns`` later, else it belongs to the unknown process. When an instance ends, its threads
    learn when it expires. Repeated sightings of an instance change nothing.
    """

    row = StructType([*_longs("ts_ns", "phase", "seq"), StructField("class_name", StringType()), *_longs("start_key", "tid", "size", "sub_process_tag"), StructField("process_name", StringType()), *_longs("session_id", "pe_checksum")])

    def __init__(self, grace_ns: int = GRACE_NS, slack_ns: int = THREAD_SLACK_NS):
        self.grace_ns, self.slack_ns = grace_ns, slack_ns

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", StructType(_longs("start_key", "expires_ns")))
        self.threads = handle.getListState("threads", StructType(_longs("tid", "seq")))
        self.orphans = handle.getListState("orphans", self.row)
        # Instances whose pid has started again: their late sightings are no starts.
        self.replaced = handle.getMapState("replaced", StructType(_longs("start_key")), StructType(_longs("until_ns")))

    def load(self) -> None:
        self.now = self.owner.get() if self.owner.exists() else None
        self.alone = [tuple(r) for r in self.orphans.get()]
        self.mine = [tuple(r) for r in self.threads.get()]
        self.kept = {k[0]: until[0] for k, until in self.replaced.iterator()}
        self.past = dict(self.kept)

    def save(self) -> None:
        self.owner.update(self.now) if self.now else self.owner.clear()
        self.orphans.put(self.alone) if self.alone else self.orphans.clear()
        self.threads.put(self.mine) if self.mine else self.threads.clear()
        for k in self.kept.keys() - self.past.keys():
            self.replaced.removeKey((k,))
        for k, until in self.past.items():
            if self.kept.get(k) != until:
                self.replaced.updateValue((k,), (until,))

    def step(self, key: tuple, row: tuple) -> Iterator[Row]:
        host, pid = key
        ts_ns, _, seq, cls, start_key, tid, size, tag, name, session, checksum = row
        if cls == "process_start":
            if start_key is None or (self.now and self.now[0] == start_key) or start_key in self.past:
                return
            if self.now:
                self.past[self.now[0]] = ts_ns + self.grace_ns
            self.now = (start_key, OPEN_END)
            self.mine = []
            yield _owned(host, cls, pid=pid, seq=seq, ts_ns=ts_ns, start_key=start_key, process_name=name, session_id=session, pe_checksum=checksum)
            for o in [o for o in self.alone if ts_ns - o[0] < self.slack_ns]:
                yield self._thread(host, pid, o)
            self.alone = [o for o in self.alone if ts_ns - o[0] >= self.slack_ns]
        elif cls == "process_end":
            if not self.now or self.now[1] < OPEN_END or (start_key is not None and start_key != self.now[0]):
                return
            self.now = (self.now[0], ts_ns + self.grace_ns)
            for t in self.mine:
                yield _owned(host, EXPIRES, pid=pid, tid=t[0], seq=seq, ts_ns=ts_ns, start_key=self.now[0], expires_ns=self.now[1])
        elif cls == "thread_start":
            if self.now and ts_ns < self.now[1]:
                yield self._thread(host, pid, row)
            else:
                self.alone.append(row)
        else:
            owned = self.now[0] if self.now and ts_ns < self.now[1] else None
            yield _owned(host, cls, pid=pid, tid=tid, seq=seq, ts_ns=ts_ns, start_key=owned, size=size)

    def _thread(self, host: str, pid: int, row: tuple) -> Row:
        self.mine.append((row[5], row[2]))
        expires = None if self.now[1] == OPEN_END else self.now[1]
        return _owned(host, "thread_start", pid=pid, tid=row[5], seq=row[2], ts_ns=row[0], start_key=self.now[0], expires_ns=expires, sub_process_tag=row[7])

    def settle(self, key: tuple, upto_ns: int) -> Iterator[Row]:
        for o in [o for o in self.alone if o[0] + self.slack_ns <= upto_ns]:
            yield _owned(key[0], "thread_start", pid=key[1], tid=o[5], seq=o[2], ts_ns=o[0], start_key=UNKNOWN_START_KEY, sub_process_tag=o[7])
        self.alone = [o for o in self.alone if o[0] + self.slack_ns > upto_ns]
        if self.now and self.now[1] <= upto_ns:
            self.now = None
            self.mine = []
        self.past = {k: until for k, until in self.past.items() if until > upto_ns}

    def wake_ns(self) -> int | None:
        times = [o[0] + self.slack_ns for o in self.alone] + list(self.past.values())
        if self.now and self.now[1] < OPEN_END:
            times.append(self.now[1])
        return min(times, default=None)


class ThreadOwners(InOrder):
    """Per (host, tid): which instance the thread belongs to at each row.

    A tid stays mapped until it starts again, ``grace_ns`` after the thread ended, or when its process expires.
    """

    row = StructType([*_longs("ts_ns", "phase", "seq"), StructField("class_name", StringType()), *_longs("start_key", "expires_ns", "pid", "size")])

    def __init__(self, grace_ns: int = GRACE_NS):
        self.grace_ns = grace_ns

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", StructType(_longs("start_key", "ended_ns", "expires_ns")))

    def load(self) -> None:
        self.now = self.owner.get() if self.owner.exists() else None

    def save(self) -> None:
        self.owner.update(self.now) if self.now else self.owner.clear()

    def step(self, key: tuple, row: tuple) -> Iterator[Row]:
        ts_ns, _, seq, cls, start_key, expires_ns, pid, size = row
        if cls == "thread_start":
            self.now = (start_key, OPEN_END, OPEN_END if expires_ns is None else expires_ns)
        elif cls == EXPIRES:
            if self.now and self.now[0] == start_key:
                self.now = (start_key, self.now[1], expires_ns)
        elif cls == "thread_end":
            if self.now and self.now[1] == OPEN_END:
                self.now = (self.now[0], ts_ns + self.grace_ns, self.now[2])
        else:
            owned = self.now[0] if self.now and ts_ns < min(self.now[1], self.now[2]) else None
            yield _owned(key[0], cls, pid=pid, tid=key[1], seq=seq, ts_ns=ts_ns, start_key=owned, size=size)

    def settle(self, key: tuple, upto_ns: int) -> Iterator[Row]:
        if self.now and min(self.now[1], self.now[2]) <= upto_ns:
            self.now = None
        return iter(())

    def wake_ns(self) -> int | None:
        until = min(self.now[1], self.now[2]) if self.now else OPEN_END
        return until if until < OPEN_END else None


#: The id that says whose a fact is, by class: of a process, and of a thread.
PID_OF = {"registry_op": "header_pid"}
TID_OF = {"cswitch": "new_tid", "disk_read": "issuing_tid", "disk_write": "issuing_tid", "disk_flush": "issuing_tid"}


def _keyed(rows: DataFrame, key: str, of_class: dict[str, str], fields: StructType, lifecycle: tuple[str, ...]) -> DataFrame:
    ident = F.col(key)
    for cls, column in of_class.items():
        if column in rows.columns:
            ident = F.when(F.col("cls") == cls, F.col(column)).otherwise(ident)
    phase = F.when(F.col("cls").isin(*lifecycle), 0).otherwise(1).cast("bigint")
    # A state field cannot be called cls: rows of the state store are built by name, and that name is taken.
    given = {"phase": phase, "class_name": F.col("cls")}
    columns = [(given[f.name] if f.name in given else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields.fields if f.name != key]
    return rows.select("ts", "host", "cls", F.coalesce(ident, F.lit(-1)).cast("bigint").alias(key), *columns)


def process_owners(events: DataFrame, delay: str, facts: list[str], grace_ns: int = GRACE_NS, slack_ns: int = THREAD_SLACK_NS) -> DataFrame:
    """A stream of ``OWNED`` rows from one of ``WIDE_EVENTS``: process and thread starts, expiries, and the ``facts`` classes, which belong to a pid."""
    rows = events.filter(F.col("cls").isin("process_start", "process_end", "thread_start", END_MARKER, *facts)).withWatermark("ts", delay)
    shaped = _keyed(rows, "pid", PID_OF, ProcessOwners.row, _OF_PID)
    owned = shaped.groupBy("host", "pid").transformWithState(ProcessOwners(grace_ns, slack_ns), OWNED, "append", "eventTime")
    return owned.withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)))


def thread_owners(owned: DataFrame, events: DataFrame, delay: str, facts: list[str], grace_ns: int = GRACE_NS) -> DataFrame:
    """A stream of the ``facts`` classes, which belong to a tid, as ``OWNED`` rows.

    ``owned`` is what ``process_owners`` has written, read as a stream. Both inputs keep their own watermark, and the one further back counts. An end
    marker among the events ends both.
    """
    ends = events.filter(F.col("cls") == END_MARKER).select(*[(F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in OWNED.fields])
    starts = owned.filter(F.col("cls").isin("thread_start", EXPIRES)).unionByName(ends).withWatermark("ts", delay)
    rows = events.filter(F.col("cls").isin("thread_end", END_MARKER, *facts)).withWatermark("ts", delay)
    shaped = _keyed(starts, "tid", {}, ThreadOwners.row, _OF_TID).unionByName(_keyed(rows, "tid", TID_OF, ThreadOwners.row, _OF_TID))
    return shaped.groupBy("host", "tid").transformWithState(ThreadOwners(grace_ns), OWNED, "append", "eventTime")


def write_stream(rows: DataFrame, checkpoint: str, out: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a folder of Parquet files; a restart goes on where the checkpoint stands."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_stream(spark: SparkSession, out: str, schema: StructType = OWNED) -> DataFrame:
    return spark.readStream.schema(schema).parquet(out)


# Silent hosts ---------------------------------------------------------------------------------

#: The class of the rows that say: nothing has come from this host for the limit.
IDLE = "idle"
_SILENT = Row("host", "ts_ns", "cls")


class SilentHosts(StatefulProcessor):
    """Per host: a row whenever nothing has come for ``limit_ns`` of the clock on the wall, by timers that need no input to fire."""

    def __init__(self, limit_ns: int = IDLE_LIMIT_NS):
        self.limit_ns = limit_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType(_longs("ts_ns", "times")))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        latest = max(r["ts_ns"] for r in rows)
        before = self.last.get()[0] if self.last.exists() else latest
        self.last.update((max(latest, before), 0))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._wake(timerValues)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        ts_ns, times = self.last.get()
        self.last.update((ts_ns, times + 1))
        self._wake(timerValues)
        yield _SILENT(key[0], ts_ns + (times + 1) * self.limit_ns, IDLE)

    def _wake(self, timers) -> None:
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + max(1, self.limit_ns // NS_PER_MS))


def silent_hosts(events: DataFrame, limit_ns: int = IDLE_LIMIT_NS) -> DataFrame:
    """Rows (host, ts_ns, cls ``idle``) for the runner: one for every ``limit_ns`` without a row from a host, timed from its last row on."""
    rows = events.select("host", F.col("ts_ns").cast("bigint").alias("ts_ns"))
    return rows.groupBy("host").transformWithState(SilentHosts(limit_ns), "host string, ts_ns long, cls string", "append", "processingTime")
