"""The queries of :mod:`pitbars.plans.queries` as DuckDB SQL over the same tables."""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}

H = 3_600_000_000
D = 24 * H


def add(name: str, sql: str, doubles: str = "", digits: int = 6) -> None:
    """Register a query; listed double columns are rounded like the Spark side."""
    # ``at`` is reserved in newer grammars.
    sql = re.sub(r"(?<![\w\"'])at(?![\w\"'])", '"at"', sql)
    if doubles:
        scale = f"1e{digits}"
        rounds = ", ".join(
            f"round(CAST({c} AS DOUBLE) * {scale} + 0.0137) / {scale} + 0.0 AS {c}" for c in doubles.split()
        )
        sql = f"SELECT * REPLACE ({rounds}) FROM ({sql}) AS q"
    ORACLES[name] = sql


def bars_cte(size_us: int = H, label: str = "1h", by: str = "event_type", name: str = "bars") -> str:
    width = f"to_microseconds({size_us})"
    return f"""
ev_{name} AS (
  SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k,
         make_timestamp((epoch_us(ts) // {size_us}) * {size_us}) AS bar_start FROM events),
raw_{name} AS (
  SELECT CAST({by} AS VARCHAR) AS instrument_id, bar_start,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, CAST(sum(k) AS DOUBLE) AS volume,
         CASE WHEN sum(k) <> 0 THEN sum(value * k) / sum(k) END AS vwap,
         count(*) AS trade_count
  FROM ev_{name} GROUP BY 1, 2),
{name} AS (
  SELECT instrument_id, '{label}' AS bar_size, bar_start, bar_start + {width} AS bar_end,
         bar_start + {width} + INTERVAL 2 SECOND
           + CASE WHEN (epoch_us(bar_start) // {H}) % 17 = 0 THEN INTERVAL 90 MINUTE
                  ELSE INTERVAL 0 SECOND END AS available_at,
         open, high, low, close, volume, vwap, trade_count, 0 AS revision
  FROM raw_{name})"""


BARS = bars_cte()
REVISED = f"""{BARS},
revised AS (
  SELECT * FROM bars
  UNION ALL BY NAME
  SELECT * REPLACE (1 AS revision, round(close * 1.0001, 6) AS close,
                    available_at + INTERVAL 3 HOUR AS available_at)
  FROM bars WHERE (epoch_us(bar_start) // {H}) % 23 = 0)"""
KNOWN = f"""{REVISED},
known AS (
  SELECT * FROM revised
  QUALIFY row_number() OVER (PARTITION BY instrument_id, bar_start ORDER BY revision DESC) = 1)"""
FILLS = """
fills AS (
  SELECT CAST(l_partkey AS VARCHAR) AS instrument_id,
         CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
         l_quantity AS quantity, l_shipdate AS fill_at,
         l_extendedprice / l_quantity AS price,
         l_extendedprice / l_quantity * l_discount / 1000 AS half_spread,
         CASE WHEN l_linestatus = 'O'
              THEN l_extendedprice / l_quantity - l_extendedprice / l_quantity * l_discount / 1000
              ELSE l_extendedprice / l_quantity + l_extendedprice / l_quantity * l_discount / 1000
         END AS reference_price,
         0.0 AS slippage, l_extendedprice / l_quantity * l_quantity * l_tax / 100 AS fee,
         l_orderkey AS order_key, l_linenumber AS line, l_suppkey AS maker
  FROM lineitem)"""
HOUR_NO = f"(epoch_us(bar_start) // {H})"
AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
START = "TIMESTAMP '2024-01-05 00:00:00'"
END = "TIMESTAMP '2024-01-25 00:00:00'"

# -- sources and scans

add("build_bars_from_events", f"WITH {BARS} SELECT * FROM bars", "open high low close volume vwap")

FEATURE_BASE = f"""{BARS},
w AS (SELECT *, lag(close) OVER o AS c1, lag(bar_start) OVER o AS b1,
        lag(close, 2) OVER o AS c2, lag(bar_start, 2) OVER o AS b2,
        lag(close, 3) OVER o AS c3, lag(bar_start, 3) OVER o AS b3,
        lag(bar_start, 4) OVER o AS b4, lag(bar_start, 5) OVER o AS b5,
        row_number() OVER o AS rn
      FROM bars WINDOW o AS (PARTITION BY instrument_id ORDER BY bar_start)),
r AS (SELECT *, close / c1 - 1 AS step_ret FROM w)"""


def ready(*lookbacks: int, latency: str = "0 SECOND") -> str:
    parts = [
        f"""CASE WHEN rn > {k} THEN max(available_at) OVER (PARTITION BY instrument_id
            ORDER BY bar_start ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)
            + INTERVAL {latency} END"""
        for k in lookbacks
    ]
    return f"greatest(available_at, {', '.join(parts)})"


def frame(n: int, last: int = 0) -> str:
    end = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING"
    return (
        "(PARTITION BY instrument_id ORDER BY bar_start "
        f"ROWS BETWEEN {n - 1 - last} PRECEDING AND {end})"
    )


def gap(column: str, k: int) -> str:
    return f"epoch_us(bar_start) - epoch_us({column}) = {k * H}"


RET_1 = f"CASE WHEN {gap('b1', 1)} THEN close / c1 - 1 END"
RANGE_3 = (
    f"CASE WHEN {gap('b2', 2)} AND rn >= 3 THEN (max(high) OVER {frame(3)} "
    f"- min(low) OVER {frame(3)}) / close END"
)
Z4 = (
    f"CASE WHEN {gap('b3', 3)} AND rn >= 4 AND max(close) OVER {frame(4)} > min(close) OVER {frame(4)} "
    f"THEN (close - avg(close) OVER {frame(4)}) / stddev_samp(close) OVER {frame(4)} END"
)

add(
    "pit_lagged_return",
    f"""WITH {FEATURE_BASE}, f AS (
      SELECT instrument_id, bar_start, {RET_1} AS ret_1, {ready(1)} AS available_at FROM r)
    SELECT * FROM f WHERE available_at <= {AS_OF}""",
    "ret_1",
)
add(
    "scan_point_in_time",
    f"""WITH {BARS} SELECT instrument_id, bar_start, available_at, close, volume FROM bars
    WHERE available_at <= {AS_OF} AND bar_start >= {START} AND bar_start < {END}
      AND instrument_id IN ('click', 'view', 'signup')""",
    "close volume",
)
add(
    "scan_as_of_revisions",
    f"""WITH {REVISED} SELECT instrument_id, bar_start, available_at, close, revision
    FROM revised WHERE available_at <= {AS_OF}
    QUALIFY row_number() OVER (PARTITION BY instrument_id, bar_start ORDER BY revision DESC) = 1""",
    "close",
)
add(
    "scan_sql_asof_function",
    f"""WITH {REVISED} SELECT instrument_id, bar_start, revision, close FROM revised
    WHERE available_at <= {AS_OF} AND volume > 0""",
    "close",
)
add(
    "scan_head",
    f"""WITH {BARS} SELECT instrument_id, bar_start, revision, close FROM bars
    WHERE available_at <= {AS_OF} ORDER BY instrument_id, bar_start LIMIT 20""",
    "close",
)
add(
    "scan_recent_rows",
    f"""WITH {BARS} SELECT instrument_id, bar_start, available_at, close FROM bars
    WHERE available_at <= {AS_OF}
    QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY bar_start DESC) <= 5""",
    "close",
)
add(
    "catalog_partition_stats",
    f"""WITH {BARS} SELECT date_trunc('day', bar_start) AS date, count(*) AS row_count,
      min(bar_start) AS min_bar_start, max(bar_start) AS max_bar_start,
      min(available_at) AS min_available_at, max(available_at) AS max_available_at
    FROM bars GROUP BY 1""",
)
add(
    "catalog_pruned_partitions",
    f"""WITH {REVISED} SELECT CAST(bar_start AS DATE) AS date, count(*) AS row_count
    FROM revised GROUP BY 1
    HAVING min(available_at) <= {AS_OF} AND max(bar_start) >= {START} AND min(bar_start) < {END}""",
)
add(
    "catalog_stored_scan",
    f"""WITH {REVISED} SELECT instrument_id, bar_start, available_at, close, revision
    FROM revised WHERE available_at <= {AS_OF} AND bar_start >= {START} AND bar_start < {END}
    QUALIFY row_number() OVER (PARTITION BY instrument_id, bar_start ORDER BY revision DESC) = 1""",
    "close",
)
add(
    "catalog_stored_asof",
    f"""WITH {REVISED} SELECT instrument_id, bar_start, revision, close FROM revised
    WHERE available_at <= {AS_OF} AND volume > 0""",
    "close",
)
add(
    "catalog_unfiltered",
    f"""WITH {REVISED} SELECT instrument_id, count(*) AS rows, max(revision) AS revision, true AS identified
    FROM revised GROUP BY 1""",
)
add(
    "catalog_verify_altered",
    f"""WITH {BARS} SELECT 'after' AS moment, CAST(CAST(min(bar_start) AS DATE) AS VARCHAR) AS part FROM bars
    UNION ALL SELECT 'after', 'content'""",
)
add(
    "ledger_store_round_trip",
    f"""WITH {FILLS} SELECT instrument_id, count(*) AS fills, CAST(sum(CAST(quantity AS BIGINT)) AS BIGINT) AS quantity,
      true AS again, false AS changed FROM fills GROUP BY 1""",
)
add(
    "source_files_read",
    f"""WITH {BARS} SELECT instrument_id, bar_start, bar_end + INTERVAL 2 SECOND AS available_at, open, close, volume,
      vwap, trade_count, CAST((epoch_us(bar_start) // {H}) % 3 AS INTEGER) AS revision, CAST(0 AS BIGINT) AS unmapped
    FROM bars""",
    "open close volume vwap",
)
add(
    "split_fixed",
    f"""WITH {BARS}, f AS (SELECT * FROM (VALUES
      ('warmup', TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-03 00:00:00'),
      ('train', TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-15 00:00:00'),
      ('purge', TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-01-15 06:00:00'),
      ('validation', TIMESTAMP '2024-01-15 06:00:00', TIMESTAMP '2024-01-20 00:00:00'),
      ('purge', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-20 06:00:00'),
      ('test', TIMESTAMP '2024-01-20 06:00:00', TIMESTAMP '2024-01-27 00:00:00')) v(split_role, lo, hi))
    SELECT instrument_id, bar_start, split_role FROM bars JOIN f ON available_at >= lo AND available_at < hi""",
)


def digest_sql(rows: str, columns: list[str], key: str = "") -> str:
    text = " || chr(1) || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    by = f"{key}, " if key else ""
    group = f" GROUP BY {key}" if key else ""

    def slice_of(start: int) -> str:
        return f"CAST(CAST(sum(CAST('0x' || substr(h, {start}, 15) AS BIGINT)::HUGEINT) AS HUGEINT) AS VARCHAR)"

    return f"""SELECT {by}count(*) AS rows, {slice_of(1)} AS low, {slice_of(16)} AS high
    FROM (SELECT {by}sha256({text}) AS h FROM ({rows}) AS t) AS x{group}"""


add(
    "digest_bars",
    f"WITH {BARS} "
    + digest_sql(
        "SELECT instrument_id, epoch_us(bar_start) AS us, CAST(round(close * 100) AS BIGINT) AS cents, "
        "trade_count FROM bars",
        ["instrument_id", "us", "cents", "trade_count"],
    ),
)
add(
    "digest_economic",
    f"WITH {FILLS} "
    + digest_sql(
        "SELECT instrument_id, epoch_us(fill_at) AS us, side, CAST(quantity AS BIGINT) AS q, "
        "order_key, line FROM fills",
        ["instrument_id", "us", "side", "q", "order_key", "line"],
        "side",
    ),
)

# -- normalisation

add(
    "normalize_bar_bounds",
    """WITH l AS (SELECT event_id, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS t FROM events)
    SELECT event_id, t AS bar_start, t + INTERVAL 5 MINUTE AS bar_end,
           t + INTERVAL 5 MINUTE + INTERVAL 2 SECOND AS available_at, 'start' AS kind FROM l
    UNION ALL BY NAME
    SELECT event_id, t - INTERVAL 5 MINUTE AS bar_start, t AS bar_end,
           t + INTERVAL 2 SECOND AS available_at, 'end' AS kind FROM l""",
)
TURN = "TIMESTAMP '2024-01-15 12:00:00'"
add(
    "normalize_symbol_aliases",
    f"""SELECT CASE WHEN ts < {TURN} THEN 'A:' ELSE 'B:' END || event_type AS instrument_id,
      count(*) AS n, min(ts) AS first, max(ts) AS last
    FROM events WHERE ts < {TURN} OR event_type <> 'signup' GROUP BY 1""",
)
add(
    "normalize_unmapped_symbols",
    f"""SELECT event_type AS symbol, count(*) AS rows FROM events
    WHERE ts >= {TURN} AND event_type = 'signup' GROUP BY 1""",
)
add(
    "normalize_alias_overlaps",
    """WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS instrument_id, o_orderpriority AS source,
        lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS symbol, o_orderdate AS effective_from,
        o_orderdate + INTERVAL 30 DAY AS effective_to FROM orders),
    b AS (SELECT *, max(effective_to) OVER (PARTITION BY instrument_id, source
        ORDER BY effective_from, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end
      FROM a)
    SELECT instrument_id, source, symbol, effective_from, previous_end FROM b
    WHERE effective_from < previous_end""",
)
add(
    "normalize_duplicates",
    f"WITH {KNOWN} SELECT instrument_id, bar_start, revision, close, available_at FROM known",
    "close",
)
add(
    "normalize_keep_first",
    f"WITH {BARS} SELECT instrument_id, bar_start, revision, close, available_at FROM bars",
    "close",
)
add(
    "normalize_duplicate_keys",
    f"""WITH {REVISED} SELECT instrument_id, bar_size, bar_start, count(*) AS copies
    FROM revised GROUP BY ALL HAVING count(*) > 1""",
)
add(
    "parse_kline_json",
    f"""WITH {BARS} SELECT instrument_id, '1h' AS bar_size, bar_start, bar_end,
      bar_end + INTERVAL 2 SECOND AS available_at, open, high, low, close, volume, vwap, trade_count,
      instrument_id || ':' || CAST(epoch_ms(bar_start) AS VARCHAR) AS source_key, 0 AS revision
    FROM bars WHERE bar_end <= {END}""",
    "open high low close volume vwap",
)
add(
    "instruments_from_listing",
    """SELECT 'CRYPTO:P' || CAST(p_partkey AS VARCHAR) AS instrument_id, p_brand AS base_currency,
      CASE WHEN p_size % 2 = 0 THEN 'TRADING' ELSE 'HALT' END AS status,
      0.01 AS price_increment, p_size / 1000.0 AS quantity_increment, 1 AS alias_count FROM part""",
    "price_increment quantity_increment",
)

# -- data quality

FAULTY = f"""{BARS},
bad1 AS (
  SELECT * REPLACE (
    CASE WHEN {HOUR_NO} % 29 = 0 THEN bar_end - INTERVAL 1 SECOND ELSE available_at END AS available_at,
    CASE WHEN {HOUR_NO} % 31 = 0 THEN bar_start + INTERVAL 30 MINUTE ELSE bar_end END AS bar_end,
    CASE WHEN {HOUR_NO} % 37 = 0 THEN -low ELSE low END AS low,
    CASE WHEN {HOUR_NO} % 41 = 0 THEN low / 2 ELSE high END AS high,
    CASE WHEN {HOUR_NO} % 43 = 0 THEN -1.0 ELSE volume END AS volume) FROM bars),
bad AS (SELECT * FROM bad1 UNION ALL SELECT * FROM bad1 WHERE {HOUR_NO} % 47 = 0)"""
KEY_TEXT = (
    "instrument_id || ' ' || bar_size || ' ' || strftime(bar_start, '%Y-%m-%d %H:%M:%S') || ' ' "
    "|| CAST(revision AS VARCHAR)"
)


def finding(check: str, severity: str, rows: str, where: str, inst: str = "''", occ: str = "count(*)",
            key: str = KEY_TEXT) -> str:
    group = f" GROUP BY {inst}" if inst != "''" else ""
    return f"""SELECT '{check}' AS "check", '{severity}' AS severity, {inst} AS instrument_id,
      CAST({occ} AS BIGINT) AS occurrences, array_to_string(list_sort(list(k))[1:5], '; ') AS sample
    FROM (SELECT *, {key} AS k FROM {rows} WHERE {where}) AS f{group} HAVING count(*) > 0"""


LOWEST = "least(open, high, low, close)"
add(
    "quality_findings",
    f"""WITH {FAULTY},
    dup AS (SELECT instrument_id, bar_size, bar_start, revision, count(*) AS copies FROM bad
            GROUP BY ALL HAVING count(*) > 1),
    seq AS (SELECT *, lag(available_at) OVER (PARTITION BY instrument_id ORDER BY bar_start, revision) AS pa
            FROM bad)
    """
    + " UNION ALL ".join(
        [
            """SELECT 'row_count' AS "check", 'info' AS severity, '' AS instrument_id,
               count(*) AS occurrences,
               CAST(count(DISTINCT instrument_id) AS VARCHAR) || ' instruments' AS sample FROM bad""",
            finding("available_before_bar_end", "error", "bad", "available_at < bar_end"),
            finding("empty_bar_interval", "error", "bad", "bar_start >= bar_end"),
            finding("bar_size_mismatch", "error", "bad", f"epoch_us(bar_end) - epoch_us(bar_start) <> {H}"),
            finding("non_positive_price", "error", "bad", f"{LOWEST} <= 0"),
            finding(
                "ohlc_relationship", "error", "bad",
                "low > least(open, close) OR high < greatest(open, close) OR low > high",
            ),
            finding("negative_volume", "error", "bad", "volume < 0"),
            finding("zero_volume_bar", "warning", "bad", "volume = 0"),
            finding(
                "publication_latency_mismatch", "warning", "bad",
                "epoch_us(available_at) - epoch_us(bar_end) <> 2000000",
            ),
            finding("duplicate_natural_key", "error", "dup", "true", occ="sum(copies)"),
            finding("availability_out_of_order", "warning", "seq", "available_at < pa"),
        ]
    ),
)
MISSING = f"""{BARS},
span AS (SELECT instrument_id, min(bar_start) AS lo, max(bar_start) AS hi FROM bars GROUP BY 1),
grid AS (SELECT instrument_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS bar_start FROM span),
miss AS (SELECT g.* FROM grid g ANTI JOIN bars b USING (instrument_id, bar_start))"""
add(
    "quality_missing_grid",
    f"WITH {MISSING} "
    + finding("missing_bars", "warning", "miss", "true", inst="instrument_id",
              key="strftime(bar_start, '%Y-%m-%d %H:%M:%S')"),
)
add("quality_missing_intervals", f"WITH {MISSING} SELECT * FROM miss")
add(
    "quality_availability_order",
    f"""WITH {BARS}, s AS (SELECT instrument_id, bar_start, available_at,
      lag(available_at) OVER (PARTITION BY instrument_id ORDER BY bar_start) AS previous_available_at FROM bars)
    SELECT * FROM s WHERE available_at < previous_available_at""",
)
add(
    "quality_contract_violations",
    f"""WITH {FAULTY}, v AS (SELECT unnest([
      CASE WHEN NOT ({LOWEST} > 0) THEN 'positive_prices' END,
      CASE WHEN NOT (low <= least(open, close)) THEN 'low_bounds' END,
      CASE WHEN NOT (high >= greatest(open, close)) THEN 'high_bounds' END,
      CASE WHEN NOT (volume >= 0) THEN 'volume_not_negative' END,
      CASE WHEN NOT (vwap IS NULL OR vwap BETWEEN low * (1 - 1e-9) AND high * (1 + 1e-9))
           THEN 'vwap_in_range' END,
      CASE WHEN NOT (bar_start < bar_end) THEN 'interval_ordered' END,
      CASE WHEN NOT (available_at >= bar_end) THEN 'not_early' END]) AS rule FROM bad)
    SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1""",
)

# -- calendars. January 2024 is on standard time with two holidays; orders span older rules.

JAN = """
jan AS (SELECT CAST(d AS DATE) AS session_date, d + INTERVAL 870 MINUTE AS session_open,
          d + INTERVAL 1260 MINUTE AS session_close
        FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS d)
        WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15'))"""


def in_jan(at: str) -> str:
    return f"{at} >= session_open AND {at} < session_close"


add(
    "quality_outside_session",
    f"""WITH {BARS}, {JAN}, o AS (SELECT b.* FROM bars b WHERE NOT EXISTS (
      SELECT 1 FROM jan WHERE b.bar_start >= session_open AND b.bar_start < session_close)) """
    + finding("outside_session", "warning", "o", "true"),
)
SPINE = """
dates AS (SELECT unnest(generate_series(
   (SELECT date_trunc('day', min(o_orderdate)) - INTERVAL 1 DAY FROM orders),
   (SELECT date_trunc('day', max(o_orderdate)) + INTERVAL 1 DAY FROM orders), INTERVAL 1 DAY)) AS d)"""
add(
    "calendar_24x7",
    f"""WITH {SPINE} SELECT d AS session_date, d AS session_open, d + INTERVAL 1 DAY AS session_close FROM dates""",
)


def nth(month: int, dow: int, n: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"({first} + CAST(({dow} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER))"


def last_of(month: int, day: int, dow: int) -> str:
    end = f"make_date(y, {month}, {day})"
    return f"({end} - CAST((isodow({end}) - {dow} + 7) % 7 AS INTEGER))"


def observed(month: int, day: int, saturday: str) -> str:
    date = f"make_date(y, {month}, {day})"
    return f"(CASE isodow({date}) WHEN 7 THEN {date} + 1 WHEN 6 THEN {saturday} ELSE {date} END)"


add(
    "calendar_xnys",
    f"""WITH {SPINE},
    e0 AS (SELECT d, CAST(d AS DATE) AS day, CAST(year(d) AS BIGINT) AS y FROM dates),
    e1 AS (SELECT *, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM e0),
    e2 AS (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM e1),
    e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
    e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
    e5 AS (SELECT *, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM e4),
    hol AS (SELECT *, [{observed(1, 1, 'NULL')}, {nth(1, 1, 3)}, {nth(2, 1, 3)}, easter - 2,
        {last_of(5, 31, 1)}, {observed(7, 4, 'make_date(y, 7, 3)')}, {nth(9, 1, 1)}, {nth(11, 4, 4)},
        {observed(12, 25, 'make_date(y, 12, 24)')}] AS off,
        ((month(day) = 7 AND dayofmonth(day) = 3 AND isodow(day) < 5)
          OR (month(day) = 12 AND dayofmonth(day) = 24) OR day = {nth(11, 4, 4)} + 1) AS early,
        CASE WHEN day >= {nth(4, 7, 1)} AND day < {last_of(10, 31, 7)} THEN 4 ELSE 5 END AS hours
      FROM e5)
    SELECT d AS session_date, d + to_minutes(CAST(570 + 60 * hours AS BIGINT)) AS session_open,
      d + to_minutes(CAST(CASE WHEN early THEN 780 ELSE 960 END + 60 * hours AS BIGINT)) AS session_close,
      CAST(early AS INTEGER) AS early_close
    FROM hol WHERE isodow(day) < 6 AND NOT list_contains(off, day)
      AND day NOT IN (DATE '2001-09-11', DATE '2001-09-12', DATE '2001-09-13', DATE '2001-09-14')""",
)
Q15 = bars_cte(H // 4, "15m", name="bars")
add(
    "calendar_attach_sessions",
    f"""WITH {Q15}, {JAN} SELECT instrument_id, bar_start, CAST(session_date AS TIMESTAMP) AS session_date,
      session_open, session_close FROM bars LEFT JOIN jan ON {in_jan('bar_start')}""",
)
add(
    "calendar_session_at",
    f"""WITH {BARS}, {JAN} SELECT instrument_id, count(session_open) AS open_rows
    FROM bars LEFT JOIN jan ON {in_jan('available_at')} GROUP BY 1""",
)
add(
    "window_session_features",
    f"""WITH {Q15}, {JAN} SELECT instrument_id, bar_start,
      CAST((epoch_us(bar_start) - epoch_us(session_open)) // 60000000 AS INTEGER) AS minutes_since_open,
      CAST((epoch_us(session_close) - epoch_us(bar_end)) // 60000000 AS INTEGER) AS minutes_to_close,
      (epoch_us(bar_start) - epoch_us(session_open)) / (epoch_us(session_close) - epoch_us(session_open))
        AS session_fraction,
      CASE WHEN session_open IS NOT NULL THEN 0 END AS is_early_close, available_at
    FROM bars LEFT JOIN jan ON {in_jan('bar_start')}""",
    "session_fraction",
)

# -- joins

ASOF = f"""{BARS},
l AS (SELECT event_type AS instrument_id, event_id, ts AS cutoff, user_id FROM events),
j AS (SELECT l.*, b.bar_start AS bar_bar_start, b.available_at AS bar_available_at, b.close AS bar_close
      FROM l ASOF LEFT JOIN (SELECT * FROM bars
        QUALIFY row_number() OVER (PARTITION BY instrument_id, available_at ORDER BY bar_start DESC) = 1) b
      ON l.instrument_id = b.instrument_id AND l.cutoff >= b.available_at)"""
add("join_asof", f"WITH {ASOF} SELECT * FROM j", "bar_close")
add(
    "join_asof_staleness",
    f"""WITH {ASOF} SELECT instrument_id, event_id, cutoff, user_id,
      CASE WHEN ok THEN bar_bar_start END AS bar_bar_start,
      CASE WHEN ok THEN bar_available_at END AS bar_available_at,
      CASE WHEN ok THEN bar_close END AS bar_close
    FROM (SELECT *, cutoff - bar_available_at <= INTERVAL 45 MINUTE AS ok FROM j)""",
    "bar_close",
)
add(
    "join_next_open",
    f"""WITH {BARS} SELECT event_id, b.bar_start AS open_at, b.open AS open
    FROM events e ASOF LEFT JOIN bars b ON e.event_type = b.instrument_id AND e.ts <= b.bar_start""",
    "open",
)
add(
    "join_containing_bar",
    f"""WITH {Q15}, e AS (SELECT event_id, event_type, ts + INTERVAL 7 MINUTE AS t FROM events)
    SELECT event_id, b.bar_start AS open_at, b.open AS open FROM e LEFT JOIN bars b
    ON e.event_type = b.instrument_id AND e.t >= b.bar_start AND e.t < b.bar_end""",
    "open",
)

# -- resampling

for name, size, label in (("resample_4h", 4 * H, "4h"), ("resample_1d", D, "1d")):
    add(
        name,
        f"""WITH {KNOWN}, g AS (SELECT *, make_timestamp((epoch_us(bar_start) // {size}) * {size}) AS s FROM known)
        SELECT instrument_id, '{label}' AS bar_size, s AS bar_start, s + to_microseconds({size}) AS bar_end,
          greatest(max(available_at), s + to_microseconds({size})) AS available_at,
          arg_min(open, bar_start) AS open, max(high) AS high, min(low) AS low,
          arg_max(close, bar_start) AS close, sum(volume) AS volume,
          CASE WHEN sum(volume) FILTER (vwap IS NOT NULL) <> 0
               THEN sum(vwap * volume) / sum(volume) FILTER (vwap IS NOT NULL) END AS vwap,
          CAST(sum(trade_count) AS BIGINT) AS trade_count, max(revision) AS revision
        FROM g GROUP BY instrument_id, s""",
        "open high low close volume vwap",
    )
ORACLES["catalog_derived_daily"] = ORACLES["resample_1d"]
add(
    "resample_periodic_equity",
    f"""WITH c AS (SELECT o_orderpriority, o_orderdate + to_microseconds(o_orderkey) AS at,
        o_totalprice AS equity FROM orders)
    SELECT o_orderpriority, make_timestamp((epoch_us(at) // {7 * D}) * {7 * D}) AS period,
      arg_max(equity, at) AS equity FROM c GROUP BY 1, 2""",
    "equity",
)

# -- window features


def feature(name: str, columns: dict[str, str], lookbacks: list[int], integers: str = "") -> None:
    listed = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    doubles = " ".join(n for n in columns if n not in integers.split())
    add(
        name,
        f"""WITH {FEATURE_BASE} SELECT instrument_id, bar_start, {listed},
          {ready(*lookbacks)} AS available_at FROM r""",
        doubles,
    )


feature(
    "window_log_return",
    {"ret_log_3": f"CASE WHEN {gap('b3', 3)} THEN ln(close / c3) END", "ret_2": "close / c2 - 1"},
    [3, 2],
)
feature(
    "window_volatility",
    {
        "vol_5": f"CASE WHEN {gap('b5', 5)} AND count(step_ret) OVER {frame(5)} = 5 "
        f"THEN stddev_samp(step_ret) OVER {frame(5)} END"
    },
    [5],
)
feature(
    "window_relative_volume",
    {
        "rvol_5": f"CASE WHEN {gap('b5', 5)} AND avg(volume) OVER {frame(5, -1)} > 0 "
        f"THEN volume / avg(volume) OVER {frame(5, -1)} END"
    },
    [5],
)


def zscore(column: str, n: int) -> str:
    f = frame(n)
    return (
        f"CASE WHEN {gap(f'b{n - 1}', n - 1)} AND rn >= {n} AND max({column}) OVER {f} > min({column}) OVER {f} "
        f"THEN ({column} - avg({column}) OVER {f}) / stddev_samp({column}) OVER {f} END"
    )


feature("window_zscore", {"zscore_6": zscore("close", 6), "zscore_volume_4": zscore("volume", 4)}, [5, 3])
feature(
    "window_range",
    {
        "range_4": f"CASE WHEN {gap('b3', 3)} AND rn >= 4 THEN (max(high) OVER {frame(4)} "
        f"- min(low) OVER {frame(4)}) / close END",
        "bar_range": "(high - low) / close",
    },
    [3, 0],
)
MINUTE_OF_DAY = "CAST(hour(bar_start) * 60 + minute(bar_start) AS INTEGER)"
feature(
    "window_time_features",
    {
        "minute_of_day_utc": MINUTE_OF_DAY,
        "minute_of_day_utc_sin": f"sin({MINUTE_OF_DAY} * 2 * pi() / 1440)",
        "minute_of_day_utc_cos": f"cos({MINUTE_OF_DAY} * 2 * pi() / 1440)",
        "day_of_week_utc": "CAST(isodow(bar_start) - 1 AS INTEGER)",
    },
    [0],
    integers="minute_of_day_utc day_of_week_utc",
)
add(
    "window_availability",
    f"""WITH {FEATURE_BASE} SELECT instrument_id, bar_start,
      {ready(2, latency='5 SECOND')} AS available_at FROM r""",
)
EST = f"""{BARS},
pub AS (SELECT instrument_id, available_at, bar_start, open, close, volume, trade_count,
    CASE WHEN lag(close) OVER p > 0 THEN close / lag(close) OVER p - 1 END AS pr,
    row_number() OVER p AS pn
  FROM bars WINDOW p AS (PARTITION BY instrument_id ORDER BY available_at, bar_start)),
est AS (SELECT *,
    CASE WHEN pn >= 5 AND avg(volume) OVER w5 > 0 THEN avg(volume) OVER w5 END AS liquidity_estimate,
    CASE WHEN pn >= 5 AND count(pr) OVER w4 >= 2 THEN stddev_samp(pr) OVER w4 END AS volatility_estimate
  FROM pub WINDOW w5 AS (PARTITION BY instrument_id ORDER BY available_at, bar_start
                         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
                  w4 AS (PARTITION BY instrument_id ORDER BY available_at, bar_start
                         ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""
add(
    "window_liquidity_estimates",
    f"""WITH {EST} SELECT instrument_id, available_at, bar_start, liquidity_estimate, volatility_estimate
    FROM est""",
    "liquidity_estimate volatility_estimate",
)

# -- cross-section

USERS = bars_cte(D, "1d", by="user_id", name="bars")
LIFT = "max(available_at) OVER (PARTITION BY bar_start) AS available_at"
add(
    "cross_rank",
    f"""WITH {USERS} SELECT instrument_id, bar_start, trade_count, close,
      CASE WHEN count(*) OVER m >= 2 THEN (rank() OVER (PARTITION BY bar_start ORDER BY close)
        + (count(*) OVER (PARTITION BY bar_start, close) - 1) / 2.0) / count(*) OVER m END AS close_xrank,
      {LIFT} FROM bars WINDOW m AS (PARTITION BY bar_start)""",
    "close close_xrank",
)
CROWD = """crowd AS (SELECT CAST(l_partkey AS VARCHAR) || '|' || CAST(l_orderkey AS VARCHAR) || '|'
    || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || '|'
    || CAST(epoch_us(l_shipdate) AS VARCHAR) AS instrument_id, date_trunc('year', l_shipdate)::TIMESTAMP AS bar_start,
    date_trunc('year', l_shipdate)::TIMESTAMP + INTERVAL 1 DAY AS available_at,
    100 + (l_partkey % 500) / 100 AS narrow, 7.0::DOUBLE AS same FROM lineitem)"""
add(
    "cross_rank_close_values",
    f"""WITH {CROWD} SELECT *, rank() OVER u + (count(*) OVER (PARTITION BY bar_start, narrow) - 1) / 2.0 AS rank_average,
      CAST(dense_rank() OVER u AS DOUBLE) AS rank_dense,
      CAST(row_number() OVER (PARTITION BY bar_start ORDER BY narrow, instrument_id) AS DOUBLE) AS rank_ordinal
    FROM crowd WINDOW u AS (PARTITION BY bar_start ORDER BY narrow)""",
    "narrow same rank_average rank_dense rank_ordinal",
)
add(
    "cross_rank_repeated_value",
    f"""WITH {CROWD} SELECT instrument_id, bar_start, available_at, same, (1 + count(*) OVER m) / 2.0 AS rank_average,
      CAST(count(*) OVER m AS DOUBLE) AS rank_max,
      CAST(row_number() OVER (PARTITION BY bar_start ORDER BY instrument_id) AS DOUBLE) AS rank_ordinal
    FROM crowd WINDOW m AS (PARTITION BY bar_start)""",
    "same rank_average rank_max rank_ordinal",
)
add(
    "quantiles_of_close_values",
    f"""WITH {CROWD}, v AS (SELECT CAST(year(bar_start) AS INTEGER) AS fold, 'narrow' AS "column", narrow AS v FROM crowd
      UNION ALL SELECT CAST(year(bar_start) AS INTEGER), 'same', same FROM crowd)
    SELECT fold, "column", quantile_cont(v, 0.013) AS lower, quantile_cont(v, 0.77) AS upper FROM v GROUP BY 1, 2""",
    "lower upper",
)
add(
    "cross_rank_methods",
    f"""WITH {USERS}, t AS (SELECT *, count(*) OVER (PARTITION BY bar_start, trade_count) AS ties,
        count(*) OVER (PARTITION BY bar_start) AS members,
        rank() OVER u AS r, dense_rank() OVER u AS dr,
        rank() OVER (PARTITION BY bar_start ORDER BY trade_count DESC) AS rd,
        row_number() OVER (PARTITION BY bar_start ORDER BY trade_count, instrument_id) AS ro
      FROM bars WINDOW u AS (PARTITION BY bar_start ORDER BY trade_count))
    SELECT instrument_id, bar_start, trade_count, close,
      CASE WHEN members >= 2 THEN r + (ties - 1) / 2.0 END AS rank_average,
      CASE WHEN members >= 2 THEN CAST(rd AS DOUBLE) END AS rank_min,
      CASE WHEN members >= 2 THEN CAST(r + ties - 1 AS DOUBLE) END AS rank_max,
      CASE WHEN members >= 2 THEN CAST(dr AS DOUBLE) END AS rank_dense,
      CASE WHEN members >= 2 THEN CAST(ro AS DOUBLE) END AS rank_ordinal,
      {LIFT} FROM t""",
    "close rank_average rank_min rank_max rank_dense rank_ordinal",
)
add(
    "cross_mean",
    f"""WITH {USERS} SELECT instrument_id, bar_start, trade_count, close,
      CASE WHEN count(*) OVER m >= 3 THEN avg(close) OVER m END AS close_xmean, {LIFT}
    FROM bars WINDOW m AS (PARTITION BY bar_start)""",
    "close close_xmean",
)
add(
    "cross_batch_availability",
    f"""WITH {USERS} SELECT bar_start, max(available_at) AS ready_from, max(available_at) AS ready_to,
      count(*) AS members FROM bars GROUP BY 1""",
)

# -- folds and transforms


def folds_sql(train: int, parts: list[tuple[str, int, int]], step: int, warm: int = 0,
              expanding: bool = False, banned: str = "") -> str:
    """Fold rows; lengths in hours."""
    test_end = next(e for r, _, e in parts if r == "test")
    start = "t0" if expanding else f"train_end - INTERVAL {train} HOUR"
    pieces = [f"SELECT fold, 'train' AS role, train_start AS \"start\", train_end AS \"end\" FROM num"]
    if warm:
        pieces.append(
            f"SELECT fold, 'warmup', train_start - INTERVAL {warm} HOUR, train_start FROM num"
        )
    pieces += [
        f"SELECT fold, '{r}', train_end + INTERVAL {a} HOUR, train_end + INTERVAL {b} HOUR FROM num"
        for r, a, b in parts
    ]
    return f"""span AS (SELECT date_trunc('day', min(bar_start)) AS lo,
        date_trunc('day', max(bar_start)) + INTERVAL 1 DAY AS hi FROM bars),
    k AS (SELECT lo + INTERVAL {warm} HOUR AS t0,
        lo + INTERVAL {warm + train} HOUR + to_hours(CAST(i * {step} AS INTEGER)) AS train_end, hi, i
      FROM span, range(0, 200) AS r(i)),
    fit AS (SELECT *, {start} AS train_start FROM k WHERE train_end + INTERVAL {test_end} HOUR <= hi),
    num AS (SELECT *, CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS fold FROM fit
      WHERE true {banned}),
    folds AS ({' UNION ALL '.join(pieces)})"""


ROLLING_PARTS = [
    ("purge", 0, 1), ("validation", 1, 49), ("purge", 49, 50), ("test", 50, 98), ("embargo", 98, 104)
]
FOLDS = f"{BARS}, " + folds_sql(168, ROLLING_PARTS, 96, warm=24)
add("folds_rolling", f"WITH {FOLDS} SELECT * FROM folds")
add(
    "folds_expanding",
    f"WITH {BARS}, "
    + folds_sql(120, [("purge", 0, 2), ("test", 2, 74)], 48, warm=12, expanding=True)
    + " SELECT * FROM folds",
)
SEAL = "TIMESTAMP '2024-01-08 18:00:00'", "TIMESTAMP '2024-01-10 06:00:00'"
SHORT_PARTS = [("purge", 0, 1), ("test", 1, 49)]
BAN = f"AND NOT (train_start < {SEAL[1]} AND {SEAL[0]} < train_end + INTERVAL 49 HOUR)"
add(
    "folds_excluding_sealed",
    f"WITH {BARS}, " + folds_sql(96, SHORT_PARTS, 24, banned=BAN) + " SELECT * FROM folds",
)
add(
    "folds_touching_sealed",
    f"WITH {BARS}, "
    + folds_sql(96, SHORT_PARTS, 24)
    + f""" SELECT fold, 'holdout' AS name FROM folds GROUP BY fold
    HAVING min("start") < {SEAL[1]} AND {SEAL[0]} < max("end")""",
)
add(
    "sealed_exclusion",
    f"""WITH {BARS} SELECT instrument_id, count(*) AS n, CAST(sum(trade_count) AS BIGINT) AS trades
    FROM bars WHERE NOT (bar_start >= {SEAL[0]} AND bar_start < {SEAL[1]}) GROUP BY 1""",
)
add(
    "sealed_exclusion_by_table",
    f"""WITH {BARS}, w AS (SELECT {START} + to_microseconds(n_nationkey * {14 * H} - n_regionkey * {H}) AS lo,
      {START} + to_microseconds(n_nationkey * {14 * H} + {3 * H} + n_regionkey * {H}) AS hi FROM nation)
    SELECT instrument_id, bar_start, trade_count FROM bars b
    WHERE NOT EXISTS (SELECT 1 FROM w WHERE b.bar_start >= lo AND b.bar_start < hi)""",
)
EXCL = """excl AS (SELECT t.fold, e.fold AS from_fold, e."start", e."end" FROM folds t JOIN folds e
  ON t.role = 'train' AND e.role = 'embargo' AND e.fold < t.fold
  AND t."start" < e."end" AND e."start" < t."end")"""
add("folds_train_exclusions", f"WITH {FOLDS}, {EXCL} SELECT * FROM excl")
add(
    "join_interval_roles",
    f"""WITH {FOLDS} SELECT instrument_id, bar_start, fold, role AS split_role FROM bars b
    JOIN folds f ON b.available_at >= f."start" AND b.available_at < f."end\"""",
)
SCORED = f"""{FEATURE_BASE}, scored AS (SELECT instrument_id, bar_start, {RET_1} AS ret_1,
  {RANGE_3} AS range_3, {ready(1, 2)} AS available_at FROM r), """ + folds_sql(
    168, ROLLING_PARTS, 96, warm=24
) + f""", {EXCL},
train AS (SELECT s.*, f.fold FROM scored s JOIN folds f ON f.role = 'train'
    AND s.available_at >= f."start" AND s.available_at < f."end"
  WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.fold = f.fold
    AND s.available_at >= e."start" AND s.available_at < e."end"))"""
add(
    "transform_zscore",
    f"""WITH {SCORED}, st AS (SELECT fold, avg(ret_1) AS m1, stddev_samp(ret_1) AS s1,
      avg(range_3) AS m2, stddev_samp(range_3) AS s2 FROM train GROUP BY 1)
    SELECT f.fold, f.role AS split_role, instrument_id, bar_start, (ret_1 - m1) / s1 AS ret_1,
      (range_3 - m2) / s2 AS range_3
    FROM scored s JOIN folds f ON f.role IN ('validation', 'test')
      AND s.available_at >= f."start" AND s.available_at < f."end" JOIN st USING (fold)""",
    "ret_1 range_3",
)
add(
    "transform_fit_winsor",
    f"""WITH {SCORED} SELECT fold, 'ret_1' AS "column", quantile_cont(ret_1, 0.05) AS lower,
      quantile_cont(ret_1, 0.9) AS upper FROM train GROUP BY 1
    UNION ALL SELECT fold, 'range_3', quantile_cont(range_3, 0.05), quantile_cont(range_3, 0.9)
    FROM train GROUP BY 1""",
    "lower upper",
)
add(
    "transform_winsor",
    f"""WITH {SCORED}, st AS (SELECT fold, quantile_cont(ret_1, 0.05) AS lo, quantile_cont(ret_1, 0.9) AS hi
      FROM train GROUP BY 1)
    SELECT f.fold, f.role AS split_role, instrument_id, bar_start,
      CASE WHEN ret_1 IS NOT NULL THEN greatest(least(ret_1, hi), lo) END AS ret_1
    FROM scored s JOIN folds f ON s.available_at >= f."start" AND s.available_at < f."end" JOIN st USING (fold)""",
    "ret_1",
)
add(
    "stitch_curves",
    """WITH c AS (SELECT o_orderpriority AS role, CAST(year(o_orderdate) AS INTEGER) AS fold,
        o_orderdate + to_microseconds(o_orderkey) AS at, o_totalprice / 1000 + 1000 AS equity,
        o_totalprice / 2000 AS gross FROM orders),
    e AS (SELECT role, fold, arg_min(equity, at) AS s, arg_max(equity, at) AS e, avg(gross) AS g
      FROM c GROUP BY 1, 2),
    x AS (SELECT *, coalesce(product(e / s) OVER (PARTITION BY role ORDER BY fold
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0)
        * first_value(s) OVER (PARTITION BY role ORDER BY fold) / s AS f FROM e)
    SELECT role, fold, s * f AS first_equity, e * f AS last_equity, g * f AS mean_gross FROM x""",
    "first_equity last_equity mean_gross",
    4,
)

# -- leakage

CUTS = f"""{BARS}, sorted AS (SELECT available_at, row_number() OVER (ORDER BY available_at) - 1 AS i,
    count(*) OVER () AS n FROM bars),
cuts AS (SELECT DISTINCT available_at AS cut FROM sorted
  WHERE i IN (n * 1 // 6, n * 2 // 6, n * 3 // 6, n * 4 // 6, n * 5 // 6))"""
add("leak_cut_points", f"WITH {CUTS} SELECT * FROM cuts")
for name in ("leak_prefix_invariance", "leak_future_insensitive"):
    add(
        name,
        f"""WITH {CUTS}, {FEATURE_BASE.removeprefix(BARS + ",")},
        f AS (SELECT instrument_id, bar_start, {ready(1, 2)} AS available_at FROM r)
        SELECT cut, count(*) AS checked, CAST(0 AS BIGINT) AS violations
        FROM f JOIN cuts ON f.available_at <= cut GROUP BY 1""",
    )
add(
    "leak_prefix_caught",
    f"""WITH {CUTS},
    full_ AS (SELECT instrument_id, bar_start, available_at,
      lead(close) OVER (PARTITION BY instrument_id ORDER BY bar_start) AS peek FROM bars),
    pre AS (SELECT cut, instrument_id, bar_start,
      lead(close) OVER (PARTITION BY cut, instrument_id ORDER BY bar_start) AS peek
      FROM bars JOIN cuts ON available_at <= cut)
    SELECT p.cut, f.instrument_id, f.bar_start, 'peek' AS feature FROM full_ f JOIN pre p
      USING (instrument_id, bar_start) WHERE p.peek IS DISTINCT FROM f.peek""",
)

# -- targets

BAR_RANGE = "(high - low) / close"
RULED = f"""{FEATURE_BASE}, ruled AS (SELECT instrument_id, bar_start, {RET_1} AS ret_1, {RANGE_3} AS range_3,
  {BAR_RANGE} AS bar_range, {ready(1, 2)} AS available_at FROM r),
aimed AS (SELECT *, CASE
   WHEN coalesce(ret_1 > 0.1, false) AND NOT coalesce(range_3 >= 5.0, false) THEN 0.25
   WHEN coalesce(ret_1 < -0.8, false) OR coalesce(bar_range > range_3, false) THEN -0.25
   ELSE 0.0 END AS target FROM ruled)"""
add(
    "rule_targets",
    f"WITH {RULED} SELECT instrument_id, bar_start, available_at, target FROM aimed",
    "target",
)
add(
    "rule_target_changes",
    f"""WITH {RULED}, pick AS (SELECT instrument_id, bar_start, target FROM aimed WHERE target <> 0
      QUALIFY row_number() OVER (PARTITION BY bar_start
        ORDER BY ret_1 DESC NULLS LAST, instrument_id DESC) <= 2),
    g AS (SELECT i.instrument_id, c.bar_start, coalesce(p.target, 0.0) AS target
      FROM (SELECT DISTINCT instrument_id FROM bars) i, (SELECT DISTINCT bar_start FROM bars) c
      LEFT JOIN pick p ON p.instrument_id = i.instrument_id AND p.bar_start = c.bar_start),
    l AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY instrument_id ORDER BY bar_start), 0.0)
      AS previous_target FROM g)
    SELECT instrument_id, bar_start, target, previous_target FROM l WHERE target <> previous_target""",
    "target previous_target",
)
add(
    "rule_topk",
    f"""WITH {RULED}, pick AS (SELECT instrument_id, bar_start FROM aimed WHERE target <> 0
      QUALIFY row_number() OVER (PARTITION BY bar_start
        ORDER BY ret_1 DESC NULLS LAST, instrument_id DESC) <= 2)
    SELECT a.instrument_id, a.bar_start, CASE WHEN p.bar_start IS NOT NULL THEN target ELSE 0.0 END AS target
    FROM aimed a LEFT JOIN pick p USING (instrument_id, bar_start)""",
    "target",
)
add(
    "lagged_signal_targets",
    f"""WITH {FEATURE_BASE}, f AS (SELECT instrument_id, bar_start, {RET_1} AS ret_1, {ready(1)} AS at FROM r),
    t AS (SELECT instrument_id, at AS decision_at, bar_start, CASE WHEN ret_1 > 0 THEN 0.2 ELSE 0.0 END AS target
      FROM f WHERE ret_1 IS NOT NULL),
    c AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY instrument_id ORDER BY decision_at, bar_start), 0)
      AS before FROM t)
    SELECT instrument_id, decision_at, bar_start, target FROM c WHERE target <> before""",
    "target",
)
STRETCH = f"""{FEATURE_BASE}, stretch AS (SELECT instrument_id, bar_start, {Z4} AS z, {RANGE_3} AS range_3, rn
  FROM r)"""
add(
    "hysteresis_one_sided",
    f"""WITH {STRETCH}, e AS (SELECT *, CASE WHEN z <= -1.0 AND coalesce(range_3 > 1.0, false) THEN 1
        WHEN z >= -0.2 THEN 0 END AS ev FROM stretch)
    SELECT instrument_id, bar_start, coalesce(last_value(ev IGNORE NULLS) OVER (
      PARTITION BY instrument_id ORDER BY bar_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state
    FROM e""",
)
add(
    "hysteresis_episodes",
    f"""WITH RECURSIVE {STRETCH}, st AS MATERIALIZED (SELECT * FROM stretch),
    walk AS (
      SELECT instrument_id, CAST(0 AS BIGINT) AS rn, 0 AS state, CAST(NULL AS TIMESTAMP) AS bar_start
      FROM (SELECT DISTINCT instrument_id FROM st)
      UNION ALL
      SELECT s.instrument_id, s.rn,
        CASE WHEN w.state = 1 THEN CASE WHEN s.z >= -0.2 THEN 0 ELSE 1 END
             WHEN w.state = -1 THEN CASE WHEN s.z <= 0.2 THEN 0 ELSE -1 END
             WHEN coalesce(s.range_3 >= 0.5, false) AND s.z <= -1.0 THEN 1
             WHEN coalesce(s.range_3 >= 0.5, false) AND s.z >= 1.0 THEN -1
             ELSE 0 END,
        s.bar_start
      FROM walk w JOIN st s ON s.instrument_id = w.instrument_id AND s.rn = w.rn + 1)
    SELECT instrument_id, bar_start, state FROM walk WHERE rn > 0""",
)
FIRSTS = """firsts AS (SELECT instrument_id, min(available_at) AS first_at,
  CASE instrument_id WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.2 ELSE 0.1 END AS target
  FROM bars WHERE instrument_id IN ('click', 'view', 'error') GROUP BY 1)"""
add(
    "scheduled_targets",
    f"""WITH RECURSIVE {BARS}, t AS MATERIALIZED (SELECT DISTINCT available_at AS at FROM bars),
    walk AS (SELECT min(at) AS at FROM t UNION ALL
      SELECT (SELECT min(t.at) FROM t WHERE t.at >= w.at + INTERVAL 7 HOUR) AS at FROM walk w
      WHERE w.at IS NOT NULL),
    {FIRSTS}
    SELECT w.at AS decision_at, instrument_id, target FROM walk w JOIN firsts f ON w.at >= f.first_at
    WHERE instrument_id <> 'error'""",
    "target",
)
add(
    "initial_allocation",
    f"""WITH {BARS}, {FIRSTS}, t AS (SELECT DISTINCT available_at AS at FROM bars),
    stop AS (SELECT min(at) AS done FROM t WHERE at >= (SELECT max(first_at) FROM firsts))
    SELECT at AS decision_at, instrument_id, target FROM t, stop, firsts
    WHERE at <= done AND at >= first_at""",
    "target",
)
add(
    "decision_batches",
    f"""WITH {BARS}, t AS (SELECT DISTINCT available_at AS decision_at FROM bars
      WHERE available_at >= {START} AND available_at < {AS_OF}),
    g AS (SELECT * FROM t, (SELECT DISTINCT instrument_id FROM bars)),
    b AS (SELECT * FROM bars QUALIFY row_number() OVER (
      PARTITION BY instrument_id, available_at ORDER BY bar_start DESC) = 1)
    SELECT g.decision_at, g.instrument_id, b.bar_start, b.available_at, b.close
    FROM g ASOF JOIN b ON g.instrument_id = b.instrument_id AND g.decision_at >= b.available_at""",
    "close",
)

# -- execution

ORDERS = f"""{EST},
ask AS (SELECT instrument_id, available_at AS signal_at,
    CASE WHEN close > open THEN 'buy' ELSE 'sell' END AS side, CAST(trade_count * 5 AS DOUBLE) AS quantity,
    instrument_id || '|' || CAST(epoch_us(bar_start) AS VARCHAR) AS order_id
  FROM bars),
uniq AS (SELECT * FROM est QUALIFY row_number() OVER (
    PARTITION BY instrument_id, available_at ORDER BY bar_start DESC) = 1),
ords AS (SELECT a.*, a.signal_at AS order_at, a.signal_at + INTERVAL 1 SECOND AS eligible_at,
    a.signal_at + INTERVAL 6 HOUR AS expires_at, e.liquidity_estimate, e.volatility_estimate,
    floor(0.1 * e.liquidity_estimate / 0.01 + 1e-12) * 0.01 AS cap
  FROM ask a ASOF LEFT JOIN uniq e ON a.instrument_id = e.instrument_id AND a.signal_at >= e.available_at)"""
NEXT_OPEN = f"""{ORDERS},
cand AS (SELECT o.*, b.bar_start AS fill_at, b.open AS reference_price,
    row_number() OVER (PARTITION BY o.order_id ORDER BY b.bar_start) AS n
  FROM ords o JOIN bars b ON o.instrument_id = b.instrument_id AND b.bar_start >= o.eligible_at
    AND b.bar_start > o.signal_at AND b.bar_start < o.expires_at),
matched AS (SELECT * REPLACE (CASE WHEN cap IS NULL THEN quantity
      ELSE least(cap, quantity - (n - 1) * cap) END AS quantity)
  FROM cand WHERE (cap IS NULL AND n = 1) OR (cap > 0 AND n - 1 < quantity / cap - 1e-9))"""
add(
    "match_orders_next_open",
    f"WITH {NEXT_OPEN} SELECT order_id, fill_at, reference_price, quantity FROM matched",
    "reference_price quantity",
)
add(
    "match_orders_current_bar",
    f"""WITH {ORDERS},
    now_ AS (SELECT o.*, b.open AS now_price,
        CASE WHEN b.open IS NULL THEN 0.0 WHEN cap IS NULL THEN quantity ELSE least(cap, quantity) END AS took
      FROM ords o LEFT JOIN bars b ON o.instrument_id = b.instrument_id
        AND o.eligible_at >= b.bar_start AND o.eligible_at < b.bar_end),
    cand AS (SELECT o.*, quantity - took AS rest, b.bar_start AS fill_at, b.open AS reference_price,
        row_number() OVER (PARTITION BY o.order_id ORDER BY b.bar_start) AS n
      FROM now_ o JOIN bars b ON o.instrument_id = b.instrument_id AND b.bar_start >= o.eligible_at
        AND b.bar_start > o.signal_at AND b.bar_start < o.expires_at)
    SELECT order_id, eligible_at AS fill_at, now_price AS reference_price, took AS quantity
    FROM now_ WHERE took > 0
    UNION ALL
    SELECT order_id, fill_at, reference_price,
      CASE WHEN cap IS NULL THEN rest ELSE least(cap, rest - (n - 1) * cap) END
    FROM cand WHERE rest > 1e-12 AND ((cap IS NULL AND n = 1) OR (cap > 0 AND n - 1 < rest / cap - 1e-9))""",
    "reference_price quantity",
)
add(
    "match_orders_unfilled",
    f"""WITH {NEXT_OPEN}, done AS (SELECT order_id, sum(quantity) AS filled FROM matched GROUP BY 1)
    SELECT order_id, instrument_id, quantity - coalesce(filled, 0) AS remaining, 'expired' AS status
    FROM ords LEFT JOIN done USING (order_id) WHERE quantity - coalesce(filled, 0) > 1e-12""",
    "remaining",
)
# Half-spread, commission, coefficient, fallback per scenario.
SCENARIOS = """scen AS (SELECT * FROM (VALUES
  ('base', 2.5, 1.0, 25.0, 10.0, 'participation'), ('free', 0.0, 0.0, 0.0, 0.0, 'fixed_bps'),
  ('low', 1.0, 0.5, 10.0, 10.0, 'participation'), ('measured_retail', 0.72, 10.0, 25.0, 10.0, 'participation'),
  ('measured_vip', 0.72, 2.0, 25.0, 10.0, 'participation'),
  ('measured_maker', 0.72, 0.0, 25.0, 10.0, 'participation'),
  ('measured_perp', 0.43, 5.0, 25.0, 10.0, 'participation'),
  ('stressed', 10.0, 3.0, 100.0, 10.0, 'participation'))
  AS v(scenario, hs, com, coef, fall, kind))"""
COSTED = f"""{NEXT_OPEN}, {SCENARIOS},
c1 AS (SELECT m.*, s.*, reference_price * hs / 1e4 AS half_spread, quantity / liquidity_estimate AS participation,
    CASE WHEN kind = 'fixed_bps' THEN reference_price * coef / 1e4
         ELSE coalesce(reference_price * coef / 1e4 * (quantity / liquidity_estimate),
                       reference_price * fall / 1e4) END AS slippage
  FROM matched m, scen s),
c2 AS (SELECT *, reference_price + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (half_spread + slippage) AS price
  FROM c1),
costed AS (SELECT *, greatest(quantity * price * com / 1e4, 0.0) AS fee FROM c2)"""
add(
    "execution_costs",
    f"""WITH {COSTED} SELECT order_id, fill_at, half_spread, slippage, price, fee, participation
    FROM costed WHERE scenario = 'base'""",
    "half_spread slippage price fee participation",
)
add(
    "execution_sqrt_impact",
    f"""WITH {NEXT_OPEN}, s AS (SELECT *, reference_price * 1.0 / 1e4 AS hs,
      coalesce(reference_price * 0.05 * volatility_estimate * sqrt(quantity / liquidity_estimate),
               reference_price * 7.0 / 1e4) AS slippage FROM matched),
    p AS (SELECT *, reference_price + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (hs + slippage) AS price FROM s)
    SELECT order_id, fill_at, slippage, price,
      greatest(quantity * price * 2.0 / 1e4 + quantity * 0.001, 0.02) AS fee FROM p""",
    "slippage price fee",
)
SPLIT = """sum(quantity * half_spread) AS spread_cost, sum(quantity * slippage) AS slippage_cost,
  sum(fee) AS fee_cost, sum(quantity * (half_spread + slippage) + fee) AS total_costs,
  sum(quantity * price) AS notional, count(*) AS fill_count"""
SPLIT_DOUBLES = "spread_cost slippage_cost fee_cost total_costs notional mean_participation"
add(
    "cost_scenarios",
    f"""WITH {COSTED} SELECT scenario, side, {SPLIT}, avg(participation) AS mean_participation
    FROM costed GROUP BY 1, 2""",
    SPLIT_DOUBLES,
    4,
)
add(
    "execution_chain_violations",
    f"""WITH {NEXT_OPEN} SELECT instrument_id, count(*) AS n FROM matched
    WHERE epoch_us(signal_at) % 5 = 0 GROUP BY 1""",
)

def toward(q: str, inc: str = "increment") -> str:
    return f"(sign({q}) * floor(abs({q}) / {inc} + 1e-9) * {inc})"


add(
    "size_targets",
    f"""WITH b AS (SELECT o_orderdate AS decision_at, CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)
        AS instrument_id, o_orderkey AS ok, o_custkey AS ck, o_totalprice FROM orders),
    i AS (SELECT decision_at, instrument_id, CASE WHEN ok % 5 = 4 THEN 0 ELSE ok % 3 END AS kind,
        CASE WHEN ok % 5 = 4 THEN 0.0 WHEN ok % 3 = 0 THEN (ck % 41 - 20) * 2.5 WHEN ok % 3 = 1 THEN (ck % 23 - 4) / 20
        ELSE (ck % 31 - 5) * 3.0 END AS value, ok % 97 = 0 AS stale FROM b),
    h AS (SELECT decision_at, instrument_id || CASE WHEN ok % 89 = 0 THEN '?' ELSE '' END AS instrument_id, CASE WHEN ok % 83 <> 0 THEN floor(o_totalprice / 10 + 0.5) / 100 END AS mark,
        CAST(ck % 7 * 10 AS DOUBLE) AS position, CAST(ck % 3 * 5 AS DOUBLE) AS pending,
        CASE WHEN ck % 2 = 0 THEN 1.0 ELSE 0.5 END AS increment FROM b),
    d AS (SELECT decision_at, count(*) * 9000.0 AS equity, count(*) * 2500.0 AS cash FROM b GROUP BY 1),
    s0 AS (SELECT i.*, mark, increment, equity, cash, coalesce(position, 0) + coalesce(pending, 0) AS base
      FROM i JOIN d USING (decision_at) LEFT JOIN h USING (decision_at, instrument_id)),
    s1 AS (SELECT *, CASE WHEN stale THEN 'stale_intent' WHEN increment IS NULL THEN 'unknown_instrument'
        WHEN kind = 1 AND coalesce(mark <= 0, true) THEN 'no_mark' END AS rej,
        CASE kind WHEN 0 THEN value WHEN 1 THEN value * equity / mark - base ELSE value - base END AS req FROM s0),
    s2 AS (SELECT *, CASE WHEN base + req < 0 THEN -base ELSE req END AS asked FROM s1),
    s3 AS (SELECT * EXCLUDE (rej), CASE WHEN rej IS NULL THEN {toward('asked')} ELSE 0.0 END AS q3, rej AS rej3 FROM s2),
    s4 AS (SELECT *, coalesce(rej3, CASE WHEN q3 = 0 AND req <> 0 THEN
        CASE WHEN asked = 0 AND req < 0 THEN 'short_not_allowed' ELSE 'below_increment' END END) AS rej4 FROM s3),
    s5 AS (SELECT *, CASE WHEN rej4 IS NULL AND q3 <> 0 AND abs(base + q3) > abs(base)
        AND abs(base + q3) * mark > 0.4 * equity + 1e-9
        THEN {toward('(sign(base + q3) * 0.4 * equity / mark - base)')} END AS n5 FROM s4),
    s6 AS (SELECT *, CASE WHEN n5 IS NULL THEN q3 WHEN n5 = 0 OR (n5 > 0) <> (q3 > 0) THEN 0.0 ELSE n5 END AS q6,
        coalesce(rej4, CASE WHEN n5 = 0 OR (n5 > 0) <> (q3 > 0) THEN 'position_limit' END) AS rej6 FROM s5),
    act AS (SELECT * FROM s6 WHERE rej6 IS NULL AND q6 <> 0),
    idle AS (SELECT decision_at, sum(abs(CASE WHEN position <> 0 THEN position ELSE pending END * mark)) AS fx
      FROM h ANTI JOIN act USING (decision_at, instrument_id) GROUP BY 1),
    tot AS (SELECT decision_at, sum(least(abs(base + q6), abs(base)) * mark) AS fx,
        sum(greatest(abs(base + q6) - abs(base), 0) * mark) AS dl FROM act GROUP BY 1),
    s7 AS (SELECT s6.*, coalesce(idle.fx, 0) + coalesce(tot.fx, 0) AS fx, coalesce(tot.dl, 0) AS dl
      FROM s6 LEFT JOIN idle USING (decision_at) LEFT JOIN tot USING (decision_at)),
    s8 AS (SELECT *, CASE WHEN rej6 IS NULL AND q6 <> 0 AND mark IS NOT NULL AND abs(base + q6) > abs(base)
        AND fx + dl > equity + 1e-9 THEN {toward('''(sign(base + q6) * (abs(base) + greatest(0.0, (equity - fx) / dl)
          * (abs(base + q6) - abs(base))) - base)''')} END AS n8 FROM s7),
    s9 AS (SELECT *, CASE WHEN n8 IS NULL THEN q6 WHEN n8 = 0 OR (n8 > 0) <> (q6 > 0) THEN 0.0 ELSE n8 END AS q9,
        coalesce(rej6, CASE WHEN n8 = 0 OR (n8 > 0) <> (q6 > 0) THEN 'gross_exposure' END) AS rej9 FROM s8),
    cash_ AS (SELECT decision_at, coalesce(sum(q9 * mark * 1.001) FILTER (q9 > 0), 0) AS cost,
        coalesce(sum(-q9 * mark) FILTER (q9 < 0), 0) AS got FROM s9 WHERE rej9 IS NULL GROUP BY 1),
    s10 AS (SELECT s9.*, CASE WHEN rej9 IS NULL AND q9 > 0 AND cost > cash + got + 1e-9
        THEN {toward('(q9 * greatest(0.0, (cash + got) / cost))')} END AS n10
      FROM s9 LEFT JOIN cash_ USING (decision_at))
    SELECT decision_at, instrument_id,
      CASE WHEN n10 IS NULL THEN q9 WHEN n10 <= 0 THEN 0.0 ELSE n10 END AS final_quantity,
      coalesce(rej9, CASE WHEN n10 <= 0 THEN 'insufficient_cash' END, '') AS rejection FROM s10""",
    "final_quantity",
)

# -- ledgers

ORDER = "fill_at, order_key, line, maker"
HELD = f"""{FILLS},
sg AS (SELECT *, CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS signed FROM fills),
held AS (SELECT *, sum(signed) OVER w AS position, sum(signed) OVER w - signed AS position_before,
    row_number() OVER w AS rn
  FROM sg WINDOW w AS (PARTITION BY instrument_id ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING))"""
add(
    "ledger_positions",
    f"WITH {HELD} SELECT instrument_id, {ORDER}, position_before, position FROM held",
    "position_before position",
)
add(
    "ledger_average_cost",
    f"""WITH RECURSIVE {HELD}, hm AS MATERIALIZED (SELECT * FROM held),
    walk AS (SELECT instrument_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS pnl
      FROM (SELECT DISTINCT instrument_id FROM hm)
      UNION ALL
      SELECT h.instrument_id, h.rn,
        CASE WHEN h.position = 0 THEN 0.0
             WHEN h.position_before = 0 OR (h.position_before > 0) = (h.signed > 0)
               THEN (h.position_before * w.cost + h.signed * h.price) / h.position
             WHEN (h.position > 0) <> (h.position_before > 0) THEN h.price ELSE w.cost END,
        CASE WHEN h.position_before = 0 OR (h.position_before > 0) = (h.signed > 0) THEN 0.0
             ELSE (h.price - w.cost) * sign(h.position_before)
                  * least(abs(h.signed), abs(h.position_before)) END
      FROM walk w JOIN hm h ON h.instrument_id = w.instrument_id AND h.rn = w.rn + 1)
    SELECT instrument_id, {ORDER}, position, cost AS avg_cost, pnl AS realized_pnl
    FROM walk JOIN hm USING (instrument_id, rn)""",
    "position avg_cost realized_pnl",
    4,
)


def curve_sql(key: str, cash: float) -> str:
    """Needs ``bk`` (costed fills, signed) and ``mk`` (marks), both with the key; defines ``curve``."""
    return f"""
clock AS (SELECT DISTINCT {key}, at FROM (SELECT {key}, fill_at AS at FROM bk
  UNION ALL SELECT {key}, at FROM mk)),
names AS (SELECT {key}, instrument_id, arg_min(reference_price, (fill_at, order_id, n)) AS ref1
  FROM bk GROUP BY 1, 2),
grid AS (SELECT c.{key}, c.at, n.instrument_id, n.ref1 FROM clock c JOIN names n USING ({key})),
pos AS (SELECT {key}, instrument_id, fill_at, sum(sum(signed)) OVER (PARTITION BY {key}, instrument_id
  ORDER BY fill_at) AS qty FROM bk GROUP BY 1, 2, 3),
lastbar AS (SELECT {key}, instrument_id, at, arg_max(close, bar_start) AS close FROM mk GROUP BY 1, 2, 3),
g1 AS (SELECT g.*, p.qty FROM grid g ASOF LEFT JOIN pos p ON g.{key} = p.{key}
  AND g.instrument_id = p.instrument_id AND g.at >= p.fill_at),
g2 AS (SELECT g.*, coalesce(m.close, ref1) AS mark FROM g1 g ASOF LEFT JOIN lastbar m
  ON g.{key} = m.{key} AND g.instrument_id = m.instrument_id AND g.at >= m.at),
val AS (SELECT {key}, at, sum(CASE WHEN abs(qty) > 1e-9 THEN qty * mark ELSE 0 END) AS net,
    sum(CASE WHEN abs(qty) > 1e-9 THEN abs(qty * mark) ELSE 0 END) AS gross,
    CAST(count(*) FILTER (abs(qty) > 1e-9) AS INTEGER) AS position_count FROM g2 GROUP BY 1, 2),
flow AS (SELECT {key}, fill_at AS at, sum(-signed * price - fee) AS c, sum(fee) AS f FROM bk GROUP BY 1, 2),
curve AS (SELECT v.{key}, v.at, {cash} + coalesce(sum(c) OVER w, 0) AS cash,
    {cash} + coalesce(sum(c) OVER w, 0) + net AS equity, gross AS gross_exposure, net AS net_exposure,
    coalesce(sum(f) OVER w, 0) AS fees_paid, position_count
  FROM val v LEFT JOIN flow USING ({key}, at)
  WINDOW w AS (PARTITION BY v.{key} ORDER BY v.at))"""


SIGNED = "CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS signed"
CURVE = f"""{COSTED},
bk AS (SELECT *, {SIGNED} FROM costed WHERE scenario IN ('base', 'stressed')),
mk AS (SELECT scenario, instrument_id, available_at AS at, close, bar_start
  FROM bars, (SELECT DISTINCT scenario FROM bk)),
{curve_sql('scenario', 5000000.0)}"""
add(
    "ledger_equity_curve",
    f"WITH {CURVE} SELECT * FROM curve",
    "cash equity gross_exposure net_exposure fees_paid",
    3,
)
add(
    "ledger_pnl_curve",
    f"""WITH RECURSIVE {CURVE},
    hm AS MATERIALIZED (SELECT scenario, instrument_id, fill_at, price, signed, row_number() OVER w AS rn,
        sum(signed) OVER w AS position, sum(signed) OVER w - signed AS position_before
      FROM bk WINDOW w AS (PARTITION BY scenario, instrument_id ORDER BY fill_at, order_id, n ROWS UNBOUNDED PRECEDING)),
    hs AS MATERIALIZED (SELECT * REPLACE (CASE WHEN abs(position) <= 1e-9 THEN 0 ELSE position END AS position,
        CASE WHEN abs(position_before) <= 1e-9 THEN 0 ELSE position_before END AS position_before) FROM hm),
    walk AS (SELECT scenario, instrument_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS pnl
      FROM (SELECT DISTINCT scenario, instrument_id FROM hs)
      UNION ALL
      SELECT h.scenario, h.instrument_id, h.rn,
        CASE WHEN h.position = 0 THEN 0.0
             WHEN h.position_before = 0 OR (h.position_before > 0) = (h.signed > 0)
               THEN (h.position_before * w.cost + h.signed * h.price) / h.position
             WHEN (h.position > 0) <> (h.position_before > 0) THEN h.price ELSE w.cost END,
        CASE WHEN h.position_before = 0 OR (h.position_before > 0) = (h.signed > 0) THEN 0.0
             ELSE (h.price - w.cost) * sign(h.position_before)
                  * least(abs(h.signed), abs(h.position_before)) END
      FROM walk w JOIN hs h ON h.scenario = w.scenario AND h.instrument_id = w.instrument_id AND h.rn = w.rn + 1),
    step AS (SELECT scenario, fill_at, pnl, position * cost - lag(position * cost, 1, 0.0) OVER (
        PARTITION BY scenario, instrument_id ORDER BY rn) AS db
      FROM walk JOIN hs USING (scenario, instrument_id, rn)),
    per AS (SELECT scenario, fill_at AS at, sum(pnl) AS dr, sum(db) AS db FROM step GROUP BY 1, 2)
    SELECT scenario, at, equity, coalesce(sum(dr) OVER w, 0) AS realized_pnl,
      net_exposure - coalesce(sum(db) OVER w, 0) AS unrealized_pnl
    FROM curve LEFT JOIN per USING (scenario, at) WINDOW w AS (PARTITION BY scenario ORDER BY at)""",
    "equity realized_pnl unrealized_pnl",
    3,
)
add(
    "ledger_stale_spans",
    f"""WITH {HELD}, m AS (SELECT DISTINCT instrument_id,
      make_timestamp((epoch_us(fill_at) // {90 * D}) * {90 * D}) AS at FROM fills),
    clk AS (SELECT fill_at AS at, row_number() OVER (ORDER BY fill_at) AS no FROM (SELECT DISTINCT fill_at FROM fills)),
    p AS (SELECT instrument_id, fill_at, arg_max(position, rn) AS position FROM held GROUP BY 1, 2),
    g AS (SELECT i.instrument_id, c.at, c.no FROM (SELECT DISTINCT instrument_id FROM fills) i, clk c),
    g1 AS (SELECT g.*, p.position FROM g ASOF JOIN p ON g.instrument_id = p.instrument_id AND g.at >= p.fill_at),
    g2 AS (SELECT g1.*, m.at AS mark_at FROM g1 ASOF JOIN m ON g1.instrument_id = m.instrument_id AND g1.at >= m.at),
    s AS (SELECT *, no - row_number() OVER (PARTITION BY instrument_id, mark_at ORDER BY no) AS island FROM g2
      WHERE position <> 0 AND epoch_us(at) - epoch_us(mark_at) > {60 * D})
    SELECT instrument_id, mark_at, min(at) AS first_at, count(*) AS occurrences FROM s GROUP BY instrument_id, mark_at, island""",
)
add(
    "ledger_reconcile",
    f"""WITH {CURVE} SELECT scenario, count(*) AS instants, CAST(0 AS BIGINT) AS violations
    FROM clock GROUP BY 1""",
)
add(
    "ledger_stale_marks",
    f"""WITH {HELD}, m AS (SELECT DISTINCT instrument_id,
      make_timestamp((epoch_us(fill_at) // {90 * D}) * {90 * D}) AS at FROM fills)
    SELECT h.instrument_id, {ORDER}, m.at AS mark_at, epoch_us(fill_at) - epoch_us(m.at) AS age_us
    FROM held h ASOF JOIN m ON h.instrument_id = m.instrument_id AND h.fill_at >= m.at
    WHERE position <> 0 AND epoch_us(fill_at) - epoch_us(m.at) > {60 * D}""",
)
add(
    "ledger_short_positions",
    f"""WITH {HELD} SELECT 'short_position' AS code, instrument_id, count(*) AS occurrences, min(fill_at) AS at
    FROM held WHERE side = 'sell' AND position < 0 GROUP BY instrument_id""",
)
TRADES = f"""{HELD},
legs AS (
  SELECT *, 0 AS leg, CASE WHEN position_before * position < 0 THEN -position_before ELSE signed END AS applied,
    position_before AS p0, CASE WHEN position_before * position < 0 THEN 0.0 ELSE position END AS p1 FROM held
  UNION ALL
  SELECT *, 1, position, 0.0, position FROM held WHERE position_before * position < 0),
num AS (SELECT *, sum(CASE WHEN p0 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id
    ORDER BY {ORDER}, leg ROWS UNBOUNDED PRECEDING) AS trade_no,
    abs(p1) > abs(p0) AS ent, (fee + quantity * half_spread) * abs(applied) / quantity AS fric FROM legs),
agg AS (SELECT instrument_id, CAST(trade_no AS BIGINT) AS trade_no, arg_min(applied, (rn, leg)) AS d0,
    min(fill_at) AS opened_at, max(fill_at) AS last_at, arg_max(p1, (rn, leg)) AS pe,
    max(abs(p1)) AS peak_quantity,
    coalesce(sum(abs(applied) * price) FILTER (ent), 0) AS en, coalesce(sum(abs(applied)) FILTER (ent), 0) AS eq,
    coalesce(sum(abs(applied) * price) FILTER (NOT ent), 0) AS xn,
    coalesce(sum(abs(applied)) FILTER (NOT ent), 0) AS xq,
    sum(-applied * reference_price) AS flow, sum(fric) AS costs, count(*) AS fill_count FROM num GROUP BY 1, 2),
tr AS (SELECT instrument_id, trade_no, CASE WHEN d0 > 0 THEN 'long' ELSE 'short' END AS direction, opened_at,
    CASE WHEN pe = 0 THEN last_at END AS closed_at,
    (epoch_us(last_at) - epoch_us(opened_at)) / 1e6 AS duration_s, peak_quantity, en / eq AS entry_price,
    (xn + abs(pe) * 1000.0) / (xq + abs(pe)) AS exit_price, fill_count,
    flow + pe * 1000.0 AS gross_pnl, costs, flow + pe * 1000.0 - costs AS net_pnl,
    (flow + pe * 1000.0 - costs) / (en / eq * peak_quantity) AS return_on_notional,
    CAST(pe <> 0 AS INTEGER) AS is_open FROM agg)"""
TRADE_DOUBLES = (
    "duration_s peak_quantity entry_price exit_price gross_pnl costs net_pnl return_on_notional"
)
add("ledger_flat_to_flat_trades", f"WITH {TRADES} SELECT * FROM tr", TRADE_DOUBLES, 4)
add(
    "trade_statistics",
    f"""WITH {TRADES}, t AS (SELECT *, CAST(instrument_id AS BIGINT) % 8 AS book FROM tr)
    SELECT book, count(*) FILTER (is_open = 0) AS trade_count, count(*) FILTER (is_open = 1) AS open_at_end,
      count(*) FILTER (is_open = 0 AND net_pnl > 0) / count(*) FILTER (is_open = 0) AS win_rate,
      avg(net_pnl) FILTER (is_open = 0 AND net_pnl > 0) AS average_win,
      avg(net_pnl) FILTER (is_open = 0 AND net_pnl < 0) AS average_loss,
      sum(net_pnl) FILTER (is_open = 0 AND net_pnl > 0) / abs(sum(net_pnl) FILTER (is_open = 0 AND net_pnl < 0))
        AS profit_factor,
      avg(net_pnl) FILTER (is_open = 0) AS expectancy,
      quantile_cont(duration_s, 0.5) FILTER (is_open = 0) AS median_duration_s,
      max(net_pnl) FILTER (is_open = 0) AS largest_win, min(net_pnl) FILTER (is_open = 0) AS largest_loss,
      sum(gross_pnl) FILTER (is_open = 0) AS gross_pnl, sum(costs) FILTER (is_open = 0) AS costs,
      sum(net_pnl) FILTER (is_open = 0) AS net_pnl,
      count(*) FILTER (is_open = 0 AND direction = 'long') AS long_count,
      count(*) FILTER (is_open = 0 AND direction = 'short') AS short_count
    FROM t GROUP BY 1""",
    "win_rate average_win average_loss profit_factor expectancy median_duration_s largest_win "
    "largest_loss gross_pnl costs net_pnl",
    2,
)

# -- metrics and runs


def performance_sql(keys: str, size: int, ppy: float, solvent: bool = True) -> str:
    """Needs ``curve(keys, at, equity, gross_exposure, net_exposure)``; defines ``perf``.

    Without ``solvent`` an account may begin or end in debt, and its rows follow the rules of
    ``metrics.performance`` for that.
    """
    sql = _PERFORMANCE.format(keys=keys, size=size, ppy=ppy)
    if not solvent:
        for plain, whole in _IN_DEBT.items():
            plain, whole = plain.format(ppy=ppy), whole.format(ppy=ppy)
            assert plain in sql
            sql = sql.replace(plain, whole)
    return sql


_PERFORMANCE = """
per AS (SELECT {keys}, make_timestamp((epoch_us(at) // {size}) * {size}) AS period,
    arg_max(equity, at) AS equity, arg_max(gross_exposure, at) AS g, arg_max(net_exposure, at) AS nx
  FROM curve GROUP BY ALL),
pk AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, lag(g) OVER w AS g0,
    max(equity) OVER w AS peak FROM per WINDOW w AS (PARTITION BY {keys} ORDER BY period)),
dd AS (SELECT *, max(CASE WHEN equity = peak THEN period END) OVER (PARTITION BY {keys} ORDER BY period) AS peak_at
  FROM pk),
perf AS (SELECT {keys}, count(*) - 1 AS periods, arg_min(equity, period) AS start_equity,
    arg_max(equity, period) AS end_equity,
    arg_max(equity, period) / arg_min(equity, period) - 1 AS total_return,
    pow(arg_max(equity, period) / arg_min(equity, period), {ppy} / (count(*) - 1)) - 1 AS annualized_return,
    stddev_samp(ret) * sqrt({ppy}) AS annualized_volatility,
    avg(ret) / stddev_samp(ret) * sqrt({ppy}) AS sharpe,
    max(CASE WHEN equity < peak THEN 1 - equity / peak ELSE 0.0 END) AS max_drawdown,
    max(CASE WHEN equity < peak THEN epoch_us(period) - epoch_us(peak_at) ELSE 0 END) AS max_drawdown_us,
    avg(equity) AS mean_equity, avg(g / equity) AS avg_gross_exposure, avg(nx / equity) AS avg_net_exposure,
    avg(CASE WHEN g0 > 0 THEN CAST(ret > 0 AS DOUBLE) END) AS period_hit_rate
  FROM dd GROUP BY ALL)"""
_START, _END = "arg_min(equity, period)", "arg_max(equity, period)"
_IN_DEBT = {
    "equity / lag(equity) OVER w - 1 AS ret": "equity / nullif(lag(equity) OVER w, 0) - 1 AS ret",
    f"{_END} / {_START} - 1 AS total_return":
        f"CASE WHEN {_START} > 0 THEN {_END} / {_START} - 1 ELSE 0.0 END AS total_return",
    f"pow({_END} / {_START}, {{ppy}} / (count(*) - 1)) - 1 AS annualized_return":
        f"CASE WHEN {_START} > 0 AND count(*) > 1 THEN pow({_END} / {_START}, {{ppy}} / (count(*) - 1)) - 1 END"
        " AS annualized_return",
    "avg(ret) / stddev_samp(ret) * sqrt({ppy}) AS sharpe":
        "CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt({ppy}) END AS sharpe",
    "avg(equity) AS mean_equity": "CASE WHEN avg(equity) > 0 AND count(*) > 1 THEN avg(equity) END AS mean_equity",
    "avg(g / equity) AS avg_gross_exposure, avg(nx / equity)":
        "avg(g / nullif(equity, 0)) AS avg_gross_exposure, avg(nx / nullif(equity, 0))",
    "CAST(ret > 0 AS DOUBLE)": "CAST(ret > 1e-9 AS DOUBLE)",
}


def cents(column: str) -> str:
    return f"round({column} * 1e2 + 0.0137) / 1e2 + 0.0 AS {column}"


HOURLY = performance_sql("scenario", H, 8766.0)
add(
    "metrics_performance",
    f"""WITH {CURVE}, {performance_sql("scenario", H, 8766.0, solvent=False)},
    ft AS (SELECT scenario, sum(quantity * (half_spread + slippage) + fee) AS total_costs,
      sum(quantity * price) AS notional, count(*) AS fill_count, avg(participation) AS mean_participation
      FROM bk GROUP BY 1)
    SELECT scenario, periods, {cents("start_equity")}, {cents("end_equity")}, total_return, annualized_return, annualized_volatility,
      sharpe, max_drawdown, max_drawdown_us, notional / mean_equity * 8766.0 / periods AS turnover_annualized,
      avg_gross_exposure, avg_net_exposure, (SELECT count(*) FROM ords) AS order_count, fill_count,
      period_hit_rate, {cents("total_costs")}, CASE WHEN start_equity > 0 THEN total_costs / start_equity ELSE 0.0 END AS cost_fraction,
      mean_participation, CAST(0 AS BIGINT) AS warning_count, 8766.0 AS periods_per_year
    FROM perf JOIN ft USING (scenario)""",
    "start_equity end_equity total_return annualized_return annualized_volatility sharpe max_drawdown "
    "turnover_annualized avg_gross_exposure avg_net_exposure period_hit_rate total_costs cost_fraction "
    "mean_participation periods_per_year",
)
BOOK_TRADES = (
    TRADES.replace(FILLS, """
fills AS (SELECT scenario || '|' || instrument_id AS instrument_id, side, quantity, fill_at, reference_price, half_spread,
  slippage, price, fee, order_id AS order_key, n AS line, 0 AS maker FROM bk)""")
    .replace("sum(signed) OVER w", "round(sum(signed) OVER w, 6)")
    .replace("(fee + quantity * half_spread)", "(fee + quantity * (half_spread + slippage))")
    .replace("1000.0", "mark")
    .replace("- signed AS position_before", "- signed AS pb0")
    .replace("FROM agg)", """FROM agg JOIN (SELECT instrument_id AS name, arg_max(close, available_at) AS mark FROM bars
      GROUP BY 1) ON split_part(instrument_id, '|', 2) = name)""")
    .replace("AS pb0", "AS position_before")
    .replace("round(sum(signed) OVER w, 6) - signed AS position_before", "round(sum(signed) OVER w - signed, 6) AS position_before")
)
STATISTICS = ORACLES["trade_statistics"]
_STATS = re.search(r"count\(\*\) FILTER \(is_open = 0\) AS trade_count.*?AS short_count", STATISTICS, re.S)[0]
add(
    "metrics_with_trades",
    f"""WITH {CURVE}, {HOURLY}, {BOOK_TRADES},
    st AS (SELECT split_part(instrument_id, '|', 1) AS scenario, {re.sub(r" AS (?=[a-z])", " AS trades_", _STATS)} FROM tr GROUP BY 1),
    ft AS (SELECT scenario, count(*) AS fill_count FROM bk GROUP BY 1)
    SELECT scenario, total_return, fill_count, st.* EXCLUDE (scenario) FROM perf JOIN ft USING (scenario) JOIN st USING (scenario)""",
    "total_return trades_win_rate trades_average_win trades_average_loss trades_profit_factor trades_expectancy "
    "trades_median_duration_s trades_largest_win trades_largest_loss trades_gross_pnl trades_costs trades_net_pnl",
    3,
)
add(
    "metrics_drawdown",
    f"""WITH {CURVE}, {HOURLY} SELECT scenario, period, peak_at,
      CASE WHEN equity < peak THEN 1 - equity / peak ELSE 0.0 END AS drawdown,
      CASE WHEN equity < peak THEN epoch_us(period) - epoch_us(peak_at) ELSE 0 END AS under_water_us FROM dd""",
    "drawdown",
)
add(
    "report_series",
    f"""WITH {CURVE}, {HOURLY} SELECT scenario, period,
      equity / first_value(equity) OVER (PARTITION BY scenario ORDER BY period) AS equity_index,
      CASE WHEN equity < peak THEN equity / peak - 1 ELSE 0.0 END AS drawdown, g / equity AS exposure FROM dd""",
    "equity_index drawdown exposure",
)
add(
    "metrics_cost_split",
    f"""WITH {FILLS} SELECT CAST(year(fill_at) AS INTEGER) AS year, side, {SPLIT},
      CAST(NULL AS DOUBLE) AS mean_participation FROM fills GROUP BY 1, 2""",
    SPLIT_DOUBLES,
    2,
)
ROLE = f"""curve AS (SELECT o_orderpriority AS run_id,
    CASE WHEN year(o_orderdate) % 2 = 0 THEN 'validation' ELSE 'test' END AS role,
    o_orderdate + to_microseconds(o_orderkey) AS at, o_totalprice / 1000 + 1000 AS equity,
    o_totalprice / 2000 AS gross_exposure, o_totalprice / 4000 AS net_exposure FROM orders),
{performance_sql('run_id, role', D, 252 * 390 / 1440)}"""
add(
    "metrics_by_role",
    f"""WITH {ROLE} SELECT run_id, role, periods, start_equity, end_equity, total_return, annualized_volatility,
      sharpe, max_drawdown, avg_gross_exposure, period_hit_rate FROM perf""",
    "start_equity end_equity total_return annualized_volatility sharpe max_drawdown avg_gross_exposure "
    "period_hit_rate",
)
IDENT = """ident AS (SELECT o_orderpriority AS run_id, count(DISTINCT o_custkey) AS instrument_count,
  min(o_orderdate) AS started_at FROM orders GROUP BY 1)"""


def role_pick(role: str, column: str) -> str:
    return f"max(CASE WHEN role = '{role}' THEN {column} END) AS {role}_{column}"


add(
    "run_table_pivot",
    f"""WITH {ROLE}, {IDENT} SELECT run_id, any_value(instrument_count) AS instrument_count,
      any_value(started_at) AS started_at, """
    + ", ".join(
        role_pick(r, c) for r in ("validation", "test") for c in ("total_return", "sharpe", "periods")
    )
    + " FROM ident LEFT JOIN perf USING (run_id) GROUP BY 1",
    "validation_total_return validation_sharpe test_total_return test_sharpe",
)
add(
    "run_compare",
    f"""WITH {ROLE}, {IDENT} SELECT run_id, instrument_count, started_at, 'test' AS role, total_return, max_drawdown
    FROM ident JOIN perf USING (run_id) WHERE perf.role = 'test'""",
    "total_return max_drawdown",
)
METRIC_LIST = """SELECT run_id, role, unnest([
  {'metric': 'total_return', 'v': total_return}, {'metric': 'sharpe', 'v': sharpe},
  {'metric': 'periods', 'v': CAST(periods AS DOUBLE)}], recursive := true) FROM perf"""
add(
    "run_agreement",
    f"""WITH {ROLE}, lg AS ({METRIC_LIST}),
    p AS (SELECT a.run_id, a.metric, a.v AS va, b.v AS vb FROM lg a JOIN lg b USING (run_id, metric)
      WHERE a.role = 'validation' AND b.role = 'test'),
    s AS (SELECT run_id, metric, v, CASE metric WHEN 'total_return' THEN v * (1 + 1e-12) WHEN 'sharpe' THEN v END
      AS w FROM lg WHERE role = 'validation'),
    u AS (SELECT run_id, metric, va, vb, 'roles' AS pair FROM p UNION ALL
          SELECT run_id, metric, v, w, 'copy' FROM s)
    SELECT run_id, metric, CASE WHEN va IS NOT DISTINCT FROM vb THEN 'exact'
      WHEN va IS NULL OR vb IS NULL THEN 'missing'
      WHEN abs(va - vb) <= 1e-9 * greatest(abs(va), abs(vb)) THEN 'within_tolerance'
      ELSE 'different' END AS agreement, pair FROM u""",
)
add(
    "report_top_bottom_trades",
    f"""WITH {TRADES}, c AS (SELECT *,
        row_number() OVER (ORDER BY net_pnl DESC, instrument_id, trade_no) AS t,
        row_number() OVER (ORDER BY net_pnl, instrument_id, trade_no) AS b FROM tr WHERE is_open = 0)
    SELECT instrument_id, trade_no, direction, opened_at, net_pnl FROM c WHERE t <= 5 OR b <= 5""",
    "net_pnl",
    4,
)
add(
    "series_downsample",
    """WITH s AS (SELECT o_orderpriority, o_orderdate + to_microseconds(o_orderkey) AS at, o_totalprice AS value
      FROM orders),
    p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY at) - 1 AS i,
        count(*) OVER (PARTITION BY o_orderpriority) AS n FROM s),
    b AS (SELECT *, ((i + 1) * 100 - 1) // n AS bk FROM p WHERE n > 200),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, bk ORDER BY value, i) AS lo,
        row_number() OVER (PARTITION BY o_orderpriority, bk ORDER BY value DESC, i) AS hi FROM b)
    SELECT o_orderpriority, at, value FROM r WHERE lo = 1 OR hi = 1 OR i = 0 OR i = n - 1
    UNION ALL SELECT o_orderpriority, at, value FROM p WHERE n <= 200""",
    "value",
    4,
)
add(
    "histogram_pnl",
    f"""WITH {TRADES}, c AS (SELECT net_pnl AS v, min(net_pnl) OVER () AS lo, max(net_pnl) OVER () AS hi
      FROM tr WHERE is_open = 0),
    x AS (SELECT lo, (hi - lo) / 31 AS st, CAST(least(floor((v - lo) / ((hi - lo) / 31)), 30) AS INTEGER) AS bin
      FROM c)
    SELECT k.bin, (SELECT min(lo) FROM x) + (SELECT min(st) FROM x) * k.bin AS bin_low, count(x.bin) AS n
    FROM (SELECT unnest(range(31))::INTEGER AS bin) k LEFT JOIN x ON k.bin = x.bin GROUP BY k.bin""",
    "bin_low",
    4,
)
add(
    "fold_preview",
    f"""WITH {FOLDS} SELECT count(DISTINCT fold) AS folds,
      count(*) FILTER (role IN ('validation', 'test')) AS evaluated,
      count(*) FILTER (role IN ('validation', 'test')) * 48 AS passes FROM folds""",
)

# -- the open-loop backtest for one parameter point

BT = f"""{FEATURE_BASE},{EST.removeprefix(BARS + ",")}, {folds_sql(168, ROLLING_PARTS, 96, warm=24)},
sig AS (SELECT instrument_id, bar_start, {RET_1} AS ret_1, {ready(1, 5)} AS decision_at, close FROM r),
plc AS (SELECT s.*, CAST(fold AS VARCHAR) || '|' || role AS acct FROM sig s JOIN folds f
  ON role IN ('validation', 'test') AND decision_at >= f."start" AND decision_at < f."end"
  WHERE ret_1 IS NOT NULL),
want AS (SELECT *, CASE WHEN ret_1 > 0 THEN floor(0.2 * 100000.0 / close / 1e-6 + 1e-9) * 1e-6 ELSE 0.0 END AS w
  FROM plc),
chg AS (SELECT *, w - coalesce(lag(w) OVER (PARTITION BY acct, instrument_id
  ORDER BY decision_at, bar_start), 0) AS c FROM want),
ords AS (SELECT acct, instrument_id, decision_at AS signal_at, CASE WHEN c > 0 THEN 'buy' ELSE 'sell' END AS side,
    abs(c) AS quantity, decision_at + INTERVAL 1 SECOND AS eligible_at,
    decision_at + INTERVAL 6 HOUR AS expires_at, liquidity_estimate,
    floor(0.1 * liquidity_estimate / 1e-6 + 1e-12) * 1e-6 AS cap,
    acct || '|' || instrument_id || '|' || CAST(epoch_us(decision_at) AS VARCHAR) || '|'
      || CAST(epoch_us(bar_start) AS VARCHAR) AS order_id
  FROM chg JOIN est USING (instrument_id, bar_start) WHERE abs(c) > 5e-7),
{NEXT_OPEN.removeprefix(ORDERS + ",")},
c1 AS (SELECT *, reference_price * 2.5 / 1e4 AS half_spread, quantity / liquidity_estimate AS participation,
    coalesce(reference_price * 25.0 / 1e4 * (quantity / liquidity_estimate), reference_price * 10.0 / 1e4)
      AS slippage FROM matched),
c2 AS (SELECT *, reference_price + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (half_spread + slippage) AS price
  FROM c1),
bk AS (SELECT *, greatest(quantity * price * 1.0 / 1e4, 0.0) AS fee, {SIGNED} FROM c2),
mk AS (SELECT CAST(fold AS VARCHAR) || '|' || role AS acct, instrument_id, available_at AS at, close, bar_start
  FROM bars JOIN folds f ON role IN ('validation', 'test') AND available_at >= f."start" AND available_at < f."end"),
{curve_sql('acct', 100000.0).replace('curve AS (', 'whole AS (')},
curve AS (SELECT w.* FROM whole w JOIN folds f ON w.acct = CAST(f.fold AS VARCHAR) || '|' || f.role
  AND w.at >= f."start" AND w.at < f."end"),
{performance_sql('acct', H, 8766.0, solvent=False)},
ft AS (SELECT acct, sum(quantity * (half_spread + slippage) + fee) AS total_costs,
    sum(quantity * price) AS notional, count(*) AS fill_count, avg(participation) AS mean_participation
  FROM bk GROUP BY 1),
oc AS (SELECT acct, count(*) AS order_count FROM ords GROUP BY 1)"""
add(
    "backtest_open_loop",
    f"""WITH {BT} SELECT 0 AS trial, CAST(split_part(acct, '|', 1) AS INTEGER) AS fold,
      split_part(acct, '|', 2) AS role, 'next_open_after_eligibility' AS fill_rule, 'base' AS scenario,
      periods, start_equity, end_equity, total_return, CASE WHEN end_equity / nullif(start_equity, 0) > 0
        THEN ln(end_equity / start_equity) * 8766.0 / nullif(periods, 0) END AS annualized_log_growth, annualized_volatility, sharpe,
      max_drawdown, max_drawdown_us, notional / mean_equity * 8766.0 / periods AS turnover_annualized,
      avg_gross_exposure, avg_net_exposure, order_count, fill_count, period_hit_rate, total_costs,
      CASE WHEN start_equity > 0 THEN total_costs / start_equity ELSE 0.0 END AS cost_fraction, mean_participation, CAST(0 AS BIGINT) AS warning_count,
      8766.0 AS periods_per_year, 'initial_capital' AS sizing
    FROM perf JOIN ft USING (acct) JOIN oc USING (acct)""",
    "start_equity end_equity total_return annualized_log_growth annualized_volatility sharpe max_drawdown "
    "turnover_annualized avg_gross_exposure avg_net_exposure period_hit_rate total_costs cost_fraction "
    "mean_participation periods_per_year",
    4,
)

END_REPORT = """
canc AS (SELECT o.acct, count(*) AS cancelled FROM ords o JOIN ends e USING (acct) LEFT JOIN (
    SELECT order_id, sum(quantity) AS filled FROM kept GROUP BY 1) d USING (order_id)
  WHERE o.quantity - coalesce(filled, 0) > 1e-12 AND o.expires_at > ends_at GROUP BY 1),
lastmark AS (SELECT instrument_id, arg_max(close, (available_at, bar_start)) AS mark FROM bars GROUP BY 1),
posn AS (SELECT acct, instrument_id, sum(signed) AS q FROM book GROUP BY 1, 2 HAVING abs(sum(signed)) > 1e-9),
held AS (SELECT acct, count(*) AS open_positions, sum(q * mark) AS value FROM posn JOIN lastmark USING (instrument_id) GROUP BY 1),
money AS (SELECT acct, count(*) AS fills, count(*) FILTER (liquidation) AS liquidation_fills,
    100000.0 + sum(-signed * price - fee) AS cash FROM book GROUP BY 1)
SELECT CAST(split_part(acct, '|', 1) AS INTEGER) AS fold, split_part(acct, '|', 2) AS role, fills, liquidation_fills, cash,
  coalesce(cancelled, 0) AS cancelled, coalesce(open_positions, 0) AS open_positions, coalesce(value, 0) AS value,
  coalesce(findings, 0) AS findings
FROM money LEFT JOIN canc USING (acct) LEFT JOIN held USING (acct) LEFT JOIN found USING (acct)"""
add(
    "backtest_end_mark",
    f"""WITH {BT.split("mk AS (")[0].rstrip().rstrip(",")},
    ends AS (SELECT DISTINCT acct, (SELECT greatest(max(bar_start), max(available_at)) FROM bars) AS ends_at FROM bk),
    kept AS (SELECT * FROM matched), book AS (SELECT *, false AS liquidation FROM bk),
    found AS (SELECT acct, 0 AS findings FROM ends WHERE false), {END_REPORT}""",
    "cash value",
    4,
)
add(
    "backtest_end_liquidate",
    f"""WITH {BT.split("c1 AS (")[0].rstrip().rstrip(",")},
    inst AS (SELECT bar_start AS t FROM bars UNION SELECT available_at FROM bars),
    ends AS (SELECT CAST(fold AS VARCHAR) || '|' || role AS acct, any_value("end") AS e,
        min(t) AS ends_at FROM folds LEFT JOIN inst ON t >= "end" WHERE role IN ('validation', 'test') GROUP BY 1),
    kept AS (SELECT m.*, {SIGNED} FROM matched m JOIN ends USING (acct) WHERE ends_at IS NULL OR fill_at <= ends_at),
    flat AS (SELECT acct, instrument_id, sum(signed) AS q FROM kept GROUP BY 1, 2 HAVING abs(sum(signed)) > 1e-9),
    uniq AS (SELECT * FROM est QUALIFY row_number() OVER (
      PARTITION BY instrument_id, available_at ORDER BY bar_start DESC) = 1),
    lords AS (SELECT f.acct, f.instrument_id, ends_at AS signal_at, CASE WHEN q > 0 THEN 'sell' ELSE 'buy' END AS side,
        abs(q) AS quantity, ends_at + INTERVAL 1 SECOND AS eligible_at, ends_at + INTERVAL 6 HOUR AS expires_at,
        u.liquidity_estimate, floor(0.1 * u.liquidity_estimate / 1e-6 + 1e-12) * 1e-6 AS cap
      FROM (SELECT * FROM flat JOIN ends USING (acct) WHERE ends_at IS NOT NULL) f
      ASOF LEFT JOIN uniq u ON f.instrument_id = u.instrument_id AND f.ends_at >= u.available_at),
    lcand AS (SELECT o.*, b.bar_start AS fill_at, b.open AS reference_price,
        row_number() OVER (PARTITION BY acct, o.instrument_id ORDER BY b.bar_start) AS n
      FROM lords o JOIN bars b ON o.instrument_id = b.instrument_id AND b.bar_start >= o.eligible_at
        AND b.bar_start > o.signal_at AND b.bar_start < o.expires_at),
    lfill AS (SELECT * REPLACE (CASE WHEN cap IS NULL THEN quantity ELSE least(cap, quantity - (n - 1) * cap) END AS quantity),
        {SIGNED.replace("quantity", "(CASE WHEN cap IS NULL THEN quantity ELSE least(cap, quantity - (n - 1) * cap) END)")}
      FROM lcand WHERE (cap IS NULL AND n = 1) OR (cap > 0 AND n - 1 < quantity / cap - 1e-9)),
    every AS (SELECT acct, instrument_id, side, quantity, signed, liquidity_estimate, reference_price, false AS liquidation FROM kept
      UNION ALL SELECT acct, instrument_id, side, quantity, signed, liquidity_estimate, reference_price, true FROM lfill),
    x1 AS (SELECT *, reference_price * 2.5 / 1e4 AS half_spread, coalesce(
        reference_price * 25.0 / 1e4 * (quantity / liquidity_estimate), reference_price * 10.0 / 1e4) AS slippage FROM every),
    x2 AS (SELECT *, reference_price + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (half_spread + slippage) AS price FROM x1),
    book AS (SELECT *, greatest(quantity * price * 1.0 / 1e4, 0.0) AS fee FROM x2),
    missed AS (SELECT l.acct, l.instrument_id FROM lords l LEFT JOIN (
        SELECT acct, instrument_id, sum(quantity) AS filled FROM lfill GROUP BY 1, 2) d USING (acct, instrument_id)
      WHERE l.quantity - coalesce(filled, 0) > 1e-12
      UNION ALL SELECT acct, instrument_id FROM flat JOIN ends USING (acct) WHERE ends_at IS NULL),
    found AS (SELECT acct, count(*) AS findings FROM missed GROUP BY 1), {END_REPORT}""",
    "cash value",
    4,
)

# -- the whole sweep: six parameter points, two fill rules, eight cost scenarios

SWEEP = f"""{FEATURE_BASE},{EST.removeprefix(BARS + ",")}, {folds_sql(168, ROLLING_PARTS, 96, warm=24)}, {SCENARIOS},
trial AS (SELECT i * 2 + j AS trial, threshold, weight
  FROM (VALUES (0, 0.0), (1, 0.5), (2, 1.0)) t(i, threshold), (VALUES (0, 0.1), (1, 0.2)) w(j, weight)),
sig AS (SELECT instrument_id, bar_start, {RET_1} AS ret_1, {ready(1, 5)} AS decision_at, close FROM r),
plc AS (SELECT s.*, trial, threshold, weight,
    CAST(trial AS VARCHAR) || '|' || CAST(fold AS VARCHAR) || '|' || role AS book
  FROM sig s JOIN folds f ON role IN ('validation', 'test')
    AND decision_at >= f."start" AND decision_at < f."end", trial
  WHERE ret_1 IS NOT NULL),
want AS (SELECT *, CASE WHEN ret_1 > threshold THEN floor(weight * 100000.0 / close / 1e-6 + 1e-9) * 1e-6
  ELSE 0.0 END AS w FROM plc),
chg AS (SELECT *, w - coalesce(lag(w) OVER (PARTITION BY book, instrument_id
  ORDER BY decision_at, bar_start), 0) AS c FROM want),
ords AS (SELECT book, instrument_id, decision_at AS signal_at, CASE WHEN c > 0 THEN 'buy' ELSE 'sell' END AS side,
    abs(c) AS quantity, decision_at + INTERVAL 1 SECOND AS eligible_at,
    decision_at + INTERVAL 6 HOUR AS expires_at, liquidity_estimate,
    floor(0.1 * liquidity_estimate / 1e-6 + 1e-12) * 1e-6 AS cap,
    book || '|' || instrument_id || '|' || CAST(epoch_us(decision_at) AS VARCHAR) || '|'
      || CAST(epoch_us(bar_start) AS VARCHAR) AS order_id
  FROM chg JOIN est USING (instrument_id, bar_start) WHERE abs(c) > 5e-7),
ruled AS (SELECT o.*, 'next_open_after_eligibility' AS fill_rule, 0.0 AS took, CAST(NULL AS DOUBLE) AS now_price
  FROM ords o
  UNION ALL
  SELECT o.*, 'open_of_current_bar', CASE WHEN b.open IS NULL THEN 0.0 WHEN cap IS NULL THEN quantity
    ELSE least(cap, quantity) END, b.open
  FROM ords o LEFT JOIN bars b ON o.instrument_id = b.instrument_id
    AND o.eligible_at >= b.bar_start AND o.eligible_at < b.bar_end),
cand AS (SELECT o.*, quantity - took AS rest, b.bar_start AS fill_at, b.open AS reference_price,
    row_number() OVER (PARTITION BY o.order_id, fill_rule ORDER BY b.bar_start) AS n
  FROM ruled o JOIN bars b ON o.instrument_id = b.instrument_id AND b.bar_start >= o.eligible_at
    AND b.bar_start > o.signal_at AND b.bar_start < o.expires_at),
matched AS (
  SELECT book, fill_rule, instrument_id, side, order_id, liquidity_estimate, 0 AS n, eligible_at AS fill_at,
    now_price AS reference_price, took AS quantity FROM ruled WHERE took > 0
  UNION ALL
  SELECT book, fill_rule, instrument_id, side, order_id, liquidity_estimate, n, fill_at, reference_price,
    CASE WHEN cap IS NULL THEN rest ELSE least(cap, rest - (n - 1) * cap) END
  FROM cand WHERE rest > 1e-12 AND ((cap IS NULL AND n = 1) OR (cap > 0 AND n - 1 < rest / cap - 1e-9))),
c1 AS (SELECT m.*, s.*, reference_price * hs / 1e4 AS half_spread,
    CASE WHEN kind = 'fixed_bps' THEN reference_price * coef / 1e4
         ELSE coalesce(reference_price * coef / 1e4 * (quantity / liquidity_estimate),
                       reference_price * fall / 1e4) END AS slippage
  FROM matched m, scen s),
c2 AS (SELECT *, reference_price + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (half_spread + slippage) AS price
  FROM c1),
account AS (SELECT trial, fill_rule, scenario, fold, role, "start", "end",
    CAST(trial AS VARCHAR) || '|' || CAST(fold AS VARCHAR) || '|' || role AS book,
    CAST(trial AS VARCHAR) || '|' || CAST(fold AS VARCHAR) || '|' || role || '|' || fill_rule || '|' || scenario AS acct
  FROM trial, folds, scen, (VALUES ('next_open_after_eligibility'), ('open_of_current_bar')) v(fill_rule)
  WHERE role IN ('validation', 'test')),
bk AS (SELECT *, book || '|' || fill_rule || '|' || scenario AS acct,
    greatest(quantity * price * com / 1e4, 0.0) AS fee, {SIGNED} FROM c2),
mk AS (SELECT acct, instrument_id, available_at AS at, close, bar_start
  FROM bars JOIN account f ON available_at >= f."start" AND available_at < f."end"),
{curve_sql('acct', 100000.0).replace('curve AS (', 'whole AS (')},
curve AS (SELECT w.* FROM whole w JOIN account f USING (acct) WHERE w.at >= f."start" AND w.at < f."end"),
{performance_sql('acct', H, 8766.0, solvent=False)},
ft AS (SELECT acct, count(*) AS fill_count FROM bk GROUP BY 1),
mean AS (SELECT trial, fill_rule, scenario, role, avg(coalesce(total_return, 0.0)) AS total_return,
    CAST(sum(coalesce(fill_count, 0)) AS BIGINT) AS fill_count
  FROM account LEFT JOIN perf USING (acct) LEFT JOIN ft USING (acct) GROUP BY 1, 2, 3, 4)"""
add(
    "sweep_parameter_grid",
    f"""WITH {SWEEP} SELECT trial, fill_rule, scenario,
      max(total_return) FILTER (role = 'validation') AS validation_total_return,
      max(fill_count) FILTER (role = 'validation') AS validation_fill_count,
      max(total_return) FILTER (role = 'test') AS test_total_return,
      max(fill_count) FILTER (role = 'test') AS test_fill_count,
      (SELECT count(*) FROM trial) AS trials
    FROM mean GROUP BY 1, 2, 3""",
    "validation_total_return test_total_return",
    4,
)

# -- streaming: only windows that closed before the watermark of the last event

CLOSED = f"""{BARS},
closed AS (SELECT * FROM bars
  WHERE bar_end <= (SELECT max(ts) FROM events) - INTERVAL 2 SECOND)"""
add(
    "stream_closed_bars",
    f"""WITH {CLOSED} SELECT instrument_id, bar_size, bar_start, bar_end,
      bar_end + INTERVAL 2 SECOND AS available_at, open, high, low, close, volume, vwap, trade_count, revision
    FROM closed""",
    "open high low close volume vwap",
)
add(
    "stream_deduplicated_users",
    f"WITH {BARS} SELECT instrument_id, count(*) AS n FROM bars GROUP BY 1",
)
add(
    "stream_findings",
    f"""WITH {CLOSED}, made AS (SELECT * REPLACE (bar_end + INTERVAL 2 SECOND AS available_at) FROM closed)
    """
    + " UNION ALL ".join(
        f"""SELECT '{check}' AS "check", '{severity}' AS severity, count(*) AS occurrences FROM made
      WHERE {where} HAVING count(*) > 0"""
        for check, severity, where in [
            ("available_before_bar_end", "error", "available_at < bar_end"),
            ("empty_bar_interval", "error", "bar_start >= bar_end"),
            ("bar_size_mismatch", "error", f"epoch_us(bar_end) - epoch_us(bar_start) <> {H}"),
            ("non_positive_price", "error", f"{LOWEST} <= 0"),
            ("ohlc_relationship", "error", "low > least(open, close) OR high < greatest(open, close) OR low > high"),
            ("negative_volume", "error", "volume < 0"),
            ("zero_volume_bar", "warning", "volume = 0"),
            ("publication_latency_mismatch", "warning", "epoch_us(available_at) - epoch_us(bar_end) <> 1000000"),
        ]
    ),
)
add(
    "feature_store_round_trip",
    f"""WITH {FEATURE_BASE} SELECT instrument_id, bar_start, {RET_1} AS ret_1, {RANGE_3} AS range_3,
      CAST(2 AS BIGINT) AS specs FROM r""",
    "ret_1 range_3",
)
add(
    "feature_user_staged",
    f"""WITH {FEATURE_BASE}, t AS (SELECT *, greatest(high, c1) - least(low, c1) AS tr FROM r)
    SELECT instrument_id, bar_start,
      CASE WHEN {gap('b3', 3)} THEN avg(tr) OVER {frame(3)} END AS atr_3,
      CASE WHEN {gap('b1', 1)} THEN open / c1 - 1 END AS gap_1,
      CASE WHEN {gap('b5', 5)} THEN stddev_samp(step_ret) OVER {frame(5)} END AS vol_5,
      {ready(3, 1, 5)} AS available_at FROM t""",
    "atr_3 gap_1 vol_5",
)
add(
    "stream_late_rows",
    f"""WITH a AS (SELECT event_type, epoch_us(ts) AS us, (epoch_us(ts) + (event_id % 7) * {6 * H}) // {5 * D} AS chunk
      FROM events),
    m AS (SELECT chunk, max(max(us)) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM a GROUP BY chunk),
    j AS (SELECT event_type, coalesce((us // {H} + 1) * {H} <= seen - {12 * H}, false) AS late FROM a JOIN m USING (chunk))
    SELECT event_type, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS late FROM j GROUP BY 1""",
)
add(
    "stream_availability_order",
    f"""WITH {BARS}, o AS (SELECT instrument_id, bar_start, revision, available_at,
      lag(available_at) OVER (PARTITION BY instrument_id ORDER BY bar_start) AS previous_available_at FROM bars)
    SELECT * FROM o WHERE available_at < previous_available_at
      AND bar_start <= (SELECT max(bar_start) FROM bars) - INTERVAL 2 DAY""",
)
add(
    "quality_empty_and_unmapped",
    f"""SELECT 'empty_dataset' AS "check", 'error' AS severity, CAST(0 AS BIGINT) AS occurrences, true AS refused
    UNION ALL SELECT 'unmapped_symbols', 'warning', count(DISTINCT event_type), true FROM events
    WHERE ts >= {TURN} AND event_type = 'signup'""",
)
add(
    "run_fold_table",
    f"""WITH curve AS (SELECT o_orderpriority AS run_id, CAST(year(o_orderdate) - 1992 AS INTEGER) AS fold,
        CASE WHEN year(o_orderdate) % 2 = 0 THEN 'validation' ELSE 'test' END AS role,
        o_orderdate + to_microseconds(o_orderkey) AS at, o_totalprice / 1000 + 1000 AS equity,
        o_totalprice / 2000 AS gross_exposure, o_totalprice / 4000 AS net_exposure FROM orders),
    {performance_sql("run_id, fold, role", D, 252.0)}
    SELECT run_id, fold, role, make_timestamp((fold + 1992)::BIGINT, 1, 1, 0, 0, 0.0) AS "start",
      make_timestamp((fold + 1993)::BIGINT, 1, 1, 0, 0, 0.0) AS "end", periods, total_return, max_drawdown FROM perf""",
    "total_return max_drawdown",
)
