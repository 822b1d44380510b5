"""SQL that computes the registered queries independently, with one-phase windows and interval joins."""

from workload.views import DAY_NS, EPOCH_US, GRACE_NS, HOST, IMAGE_SPACING

OPEN = (1 << 63) - 1
BOUNDS_GAP_MS = [0.001 * 2**i for i in range(15)]
BOUNDS_LATENCY = [5**i for i in range(11)]
BOUNDS_DURATION = [5**i for i in range(12)]

K = f"""k AS (
  SELECT event_id AS seq, ((epoch_us(ts) - {EPOCH_US}) // 1000000) * 1000 AS ts_ns, CAST(user_id % 8 AS INT) AS cpu,
         user_id AS tid, user_id % 40 + 4 AS pid, event_type,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS size
  FROM events)"""

PROC = f"""
ps AS (SELECT seq, ts_ns, pid, seq + 2 AS start_key, 'app' || (tid % 7) || '.exe' AS process_name,
              CASE WHEN pid = 4 THEN 0 ELSE tid % 3 END AS session_id, tid * 2654435761 % 4294967296 AS pe_checksum
       FROM k WHERE event_type = 'signup'),
pe AS (SELECT ts_ns, last_value(CASE WHEN event_type = 'signup' THEN seq + 2 END IGNORE NULLS)
                OVER (PARTITION BY pid ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS start_key, event_type
       FROM k WHERE event_type IN ('signup', 'error')),
pend AS (SELECT start_key, min(ts_ns) AS end_ns FROM pe WHERE event_type = 'error' AND start_key IS NOT NULL GROUP BY 1),
pn AS (SELECT *, coalesce(lead(ts_ns) OVER (PARTITION BY pid ORDER BY ts_ns, seq), {OPEN}) AS next_ns FROM ps),
proc AS (SELECT pn.*, end_ns, coalesce(end_ns + {GRACE_NS}, {OPEN}) AS expires_ns, ts_ns AS valid_from,
                least(next_ns, coalesce(end_ns + {GRACE_NS}, {OPEN})) AS valid_to,
                '0x' || lower(to_hex(pe_checksum)) AS checksum
         FROM pn LEFT JOIN pend USING (start_key))"""

THREAD = f"""
tr AS (SELECT seq, ts_ns, tid, pid, event_type, k % 30 AS tag,
              min(CASE WHEN event_type = 'signup' THEN ts_ns END)
                OVER (PARTITION BY tid ORDER BY ts_ns, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ns,
              min(CASE WHEN event_type = 'error' THEN ts_ns END)
                OVER (PARTITION BY tid ORDER BY ts_ns, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS first_end
       FROM k WHERE event_type IN ('signup', 'error')),
ts AS (SELECT *, CASE WHEN next_ns IS NULL OR first_end <= next_ns THEN first_end END AS end_ns
       FROM tr WHERE event_type = 'signup'),
owner AS (SELECT ts.seq, coalesce(arg_max(p.start_key, p.valid_from) FILTER (p.valid_from <= ts.ts_ns),
                                 arg_min(p.start_key, p.valid_from) FILTER (p.valid_from > ts.ts_ns)) AS start_key
          FROM ts JOIN proc p ON p.pid = ts.pid AND p.valid_from < ts.ts_ns + 1000000 AND ts.ts_ns < p.valid_to AND p.valid_from < p.valid_to
          GROUP BY ts.seq),
thread AS (SELECT ts.seq, ts.tid, ts.pid, ts.tag, ts.ts_ns AS valid_from, ts.end_ns,
                  coalesce(proc.start_key, 1) AS start_key, proc.start_key IS NOT NULL AS owner_known,
                  least(coalesce(ts.next_ns, {OPEN}), coalesce(ts.end_ns + {GRACE_NS}, {OPEN}),
                        coalesce(proc.expires_ns, {OPEN})) AS valid_to
           FROM ts LEFT JOIN owner ON owner.seq = ts.seq LEFT JOIN proc ON proc.start_key = owner.start_key)"""

PROGRAMS = """
programs AS (SELECT start_key, process_name, '' AS service_name, checksum AS pe_checksum, session_id FROM proc
             UNION ALL SELECT 1, 'unknown_process', '', '0x0', 0)"""

DISK = f"""
disk AS (SELECT seq, ts_ns, k % 4 AS disk, size, tid, pid,
                CASE WHEN k % 10 = 9 THEN 'flush' WHEN seq % 2 = 1 THEN 'write' ELSE 'read' END AS operation
         FROM k WHERE event_type = 'purchase'),
dt AS (SELECT d.seq, t.start_key FROM disk d JOIN thread t ON t.tid = d.tid AND d.tid <> 0
         AND t.valid_from <= d.ts_ns AND d.ts_ns < t.valid_to),
dp AS (SELECT d.seq, p.start_key FROM disk d JOIN proc p ON p.pid = d.pid AND p.valid_from <= d.ts_ns AND d.ts_ns < p.valid_to),
ds AS (SELECT d.seq, p.start_key FROM disk d JOIN proc p ON p.pid = 4 AND p.valid_from <= d.ts_ns AND d.ts_ns < p.valid_to),
owned AS (SELECT disk.*, coalesce(dt.start_key, dp.start_key, ds.start_key) AS start_key,
                 CASE WHEN dt.start_key IS NOT NULL THEN 'thread' WHEN dp.start_key IS NOT NULL THEN 'process'
                      WHEN ds.start_key IS NOT NULL THEN 'system' END AS attribution
          FROM disk LEFT JOIN dt USING (seq) LEFT JOIN dp USING (seq) LEFT JOIN ds USING (seq)
          WHERE operation <> 'flush')"""

NET = f"""
netk AS (SELECT *, ['send', 'recv', 'connect', 'accept', 'retransmit', 'fail'][1 + k % 6] AS kind FROM k WHERE event_type = 'view'),
net AS (SELECT seq, ts_ns, pid, size, kind, CASE WHEN seq % 3 = 0 AND kind IN ('send', 'recv', 'fail') THEN 'udp' ELSE 'tcp' END AS protocol,
               CASE WHEN seq % 4 = 1 THEN 'ipv6' ELSE 'ipv4' END AS address_family, k % 7 AS failure_code FROM netk),
netown AS (SELECT n.*, p.start_key FROM net n JOIN proc p ON p.pid = n.pid AND p.valid_from <= n.ts_ns AND n.ts_ns < p.valid_to)"""

REG = """
regown AS (SELECT r.k % 30 + 10 AS opcode, CASE WHEN r.k % 5 = 0 THEN 'success' ELSE 'failure' END AS result, p.start_key
           FROM k r JOIN proc p ON p.pid = r.pid AND p.valid_from <= r.ts_ns AND r.ts_ns < p.valid_to
           WHERE r.event_type = 'click'),
reg AS (SELECT ['create', 'open', 'delete', 'query', 'set_value', 'delete_value', 'query_value', 'enumerate_key',
                'enumerate_value_key', 'query_multiple_value', 'set_information', 'flush', 'kcb_create', 'kcb_delete',
                'kcb_rundown_begin', 'kcb_rundown_end', 'virtualize', 'close', 'set_security', 'query_security', 'commit',
                'prepare', 'rollback', 'mount_hive'][opcode - 9] AS operation, result, start_key
        FROM regown WHERE opcode BETWEEN 10 AND 33)"""

# Calls finalised by the next call or switch on the CPU, and the stack rule that pairs them with interrupts.
DPC = """
seqs AS (SELECT seq, ts_ns, cpu, event_type,
                lead(ts_ns) OVER (PARTITION BY cpu ORDER BY ts_ns, seq) AS end_ns
         FROM k WHERE event_type IN ('click', 'purchase')),
dpc AS (SELECT seq, ts_ns, cpu, end_ns, end_ns - ts_ns AS duration_ns FROM seqs WHERE event_type = 'purchase' AND end_ns IS NOT NULL)"""

PAIRS = DPC + """,
steps AS (SELECT seq, ts_ns, cpu, 0 AS is_dpc, 1 AS step FROM k WHERE event_type = 'view'
          UNION ALL SELECT seq, ts_ns, cpu, 1, -1 FROM dpc),
sums AS (SELECT *, sum(step) OVER (PARTITION BY cpu ORDER BY ts_ns, is_dpc, seq ROWS UNBOUNDED PRECEDING) AS total FROM steps),
depths AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY cpu ORDER BY ts_ns, is_dpc, seq ROWS UNBOUNDED PRECEDING)) + is_dpc AS level
           FROM sums),
partners AS (SELECT *, lag(is_dpc) OVER w AS below, lag(seq) OVER w AS isr_seq, lag(ts_ns) OVER w AS isr_ns
             FROM depths WINDOW w AS (PARTITION BY cpu, level ORDER BY ts_ns, is_dpc, seq)),
pairs AS (SELECT cpu, seq AS dpc_seq, isr_seq, isr_ns, ts_ns AS dpc_ns, ts_ns - isr_ns AS latency_ns
          FROM partners WHERE is_dpc = 1 AND below = 0 AND ts_ns - isr_ns < 3600000000000)"""

IMAGES = f"""
img AS (SELECT (p_partkey + 1) * {IMAGE_SPACING} AS base, p_size * 64 + 512 AS size, p_name AS image_name,
               CASE WHEN p_partkey % 10 = 0 THEN {15 * DAY_NS} END AS unload_ns FROM part)"""

SCRAPES = f"""
scrapes AS (SELECT ts_ns, row_number() OVER (ORDER BY ts_ns) AS scrape_id
            FROM (SELECT DISTINCT (ts_ns // {DAY_NS} + 1) * {DAY_NS} AS ts_ns FROM k))"""

PROGRAM_COLUMNS = "process_name, service_name, pe_checksum, session_id"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + select


def by_program(source: str, dims: str, values: str) -> str:
    groups = ", ".join(str(i + 2) for i in range(4 + (dims.count(",") + 1 if dims else 0)))
    dims = f", {dims}" if dims else ""
    return (
        f"SELECT '{HOST}' AS host, {PROGRAM_COLUMNS}{dims}, {values} FROM {source} JOIN programs USING (start_key) "
        f"GROUP BY {groups}"
    )


def le_rows(bounds: list, value: str, rule: str) -> str:
    """A bounds relation (le, threshold) and the test that puts a value at or below a bound."""
    rows = []
    for i, b in enumerate(bounds):
        limit = {"log2": 2 ** (i + 1), "first_ge": b}[rule]
        last = i == len(bounds) - 1
        rows.append(f"({float(b)!r}::DOUBLE, {limit}, {'true' if last and rule == 'log2' else 'false'})")
    return f"bounds(le, threshold, is_last) AS (VALUES {', '.join(rows)})"


def cumulative_sql(source: str, labels: list[str], bounds: list, value: str, rule: str, total: str) -> tuple[str, str]:
    """CTE and SELECT for cumulative histogram rows: labels, n, total, le, bucket_count."""
    cte = le_rows(bounds, value, rule)
    test = f"({value} < threshold OR is_last)" if rule == "log2" else f"{value} <= threshold"
    names = ", ".join(labels)
    prefix = f"{names}, " if names else ""
    group = f"GROUP BY {prefix}le" if names else "GROUP BY le"
    select = (
        f"SELECT '{HOST}' AS host, {prefix}count(*) AS n, CAST(sum({total}) AS BIGINT) AS total, le, "
        f"count(*) FILTER (WHERE {test}) AS bucket_count FROM {source} CROSS JOIN bounds {group}"
    )
    return cte, select
