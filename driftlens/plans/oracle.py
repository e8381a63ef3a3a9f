"""The same queries as plain SQL over the same tables, written independently of the DataFrame code.

The drift queries share one chain of CTEs over a long table of cells (dataset, table, load, column, value); the naive
forms (self-joins, full outer joins, recursive closure) are used on purpose.
"""

from __future__ import annotations

from . import roles as R

ORACLE: dict[str, str] = {}

# --- cells: one row per load, row and column ----------------------------------------------------------------------

_DAY = "CAST(CAST(ts AS DATE) AS TIMESTAMP)"


def _cells(dataset, table, sync, source, columns) -> str:
    parts = []
    for position, (name, kind) in enumerate(columns):
        text = f"CAST({name} AS VARCHAR)" if kind == "c" else "CAST(NULL AS VARCHAR)"
        number = f"CAST({name} AS DOUBLE)" if kind == "n" else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{dataset}' AS ds, '{table}' AS tbl, {sync} AS sync, {position} AS pos, '{name}' AS col, "
            f"'{kind}' AS kind, {text} AS sval, {number} AS nval, ({name}) IS NULL AS missing FROM {source}"
        )
    return " UNION ALL ".join(parts)


_EVENTS = _cells(
    "app", "events", _DAY, "events", [("event_type", "c"), ("props", "c"), ("user_id", "n"), ("value", "n")]
)
_ORDERS = _cells(
    "sales", "orders", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)", "orders",
    [("o_orderstatus", "c"), ("o_orderpriority", "c"), ("o_totalprice", "n")],
)
_LINEITEM = _cells(
    "sales", "lineitem", "CAST(date_trunc('month', l_shipdate) AS TIMESTAMP)", "lineitem",
    [("l_returnflag", "c"), ("l_linestatus", "c"), ("l_quantity", "n"), ("l_extendedprice", "n"),
     ("l_discount", "n"), ("l_tax", "n")],
)
_DOCUMENTS = _cells(
    "corpus", "documents",
    "CAST(DATE '2024-01-01' + CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS TIMESTAMP)",
    "(SELECT documents.*, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)",
    [("lang", "c"), ("n_chars", "n"), ("quality", "n"), ("toxic", "n")],
)


def _scenario() -> str:
    """Five earlier loads of the unchanged tables and one load with the renames."""
    offsets = ", ".join(f"({o})" for o in R.BASELINE_OFFSETS)
    at = f"TIMESTAMP '{R.AS_OF}'"
    old_region, new_region = R.RENAMED_REGION
    old_segment, new_segment = R.RENAMED_SEGMENT
    loads = f"(VALUES {offsets}, (0)) AS loads(days)"
    region = (
        f"(SELECT days, CASE WHEN days = 0 AND r_name = '{old_region}' THEN '{new_region}' ELSE r_name END AS r_name "
        f"FROM region, {loads})"
    )
    customer = (
        f"(SELECT days, CASE WHEN days = 0 AND c_mktsegment = '{old_segment}' THEN '{new_segment}' "
        f"ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer, {loads})"
    )
    regions_used = (
        f"(SELECT days, CAST(n_regionkey AS VARCHAR) AS region_id, c_acctbal "
        f"FROM customer JOIN nation ON c_nationkey = n_nationkey, {loads})"
    )
    supplier = f"(SELECT days, s_acctbal FROM supplier, {loads})"
    merged, into = R.MERGED_PRIORITY
    old_priority, new_priority = R.RENAMED_PRIORITY
    priorities = (
        f"(SELECT days, CASE WHEN days > 0 THEN o_orderpriority WHEN o_orderpriority = '{merged}' THEN '{into}' "
        f"WHEN o_orderpriority = '{old_priority}' THEN '{new_priority}' ELSE o_orderpriority END AS o_orderpriority "
        f"FROM orders, {loads})"
    )
    sync = f"({at} - INTERVAL 1 DAY * days)"
    return " UNION ALL ".join(
        [
            _cells("crm", "region", sync, region, [("r_name", "c")]),
            _cells("crm", "customer_region", sync, regions_used, [("region_id", "c"), ("c_acctbal", "n")]),
            _cells("market", "customer", sync, customer, [("c_mktsegment", "c"), ("c_acctbal", "n")]),
            _cells("market", "supplier", sync, supplier, [("s_acctbal", "n")]),
            _cells("shop", "orders", sync, priorities, [("o_orderpriority", "c")]),
        ]
    )


_SCENARIO = _scenario()
_HISTORIES = " UNION ALL ".join([_EVENTS, _ORDERS, _LINEITEM, _DOCUMENTS])

_TERM = (
    "(greatest(coalesce({a}, 0), 0.001::DOUBLE) - greatest(coalesce({e}, 0), 0.001::DOUBLE)) "
    "* ln(greatest(coalesce({a}, 0), 0.001::DOUBLE) / greatest(coalesce({e}, 0), 0.001::DOUBLE))"
)


def _chain(cells: str, upto: str = "report", scenario: str | None = None) -> str:
    """CTEs from cells to reports. With ``scenario`` only its newest load is compared, as in a live check."""
    only_newest = ""
    if scenario:
        only_newest = (
            "WHERE c.ds NOT IN ('crm', 'market', 'shop') OR c.sync = (SELECT max(sync) FROM fp f WHERE f.ds = c.ds AND f.tbl = c.tbl)"
        )
        cells = f"{cells} UNION ALL {scenario}" if cells else scenario
    return f"""
WITH RECURSIVE cells AS ({cells}),
fp AS (SELECT ds, tbl, sync, count(*) AS rc FROM cells WHERE pos = 0 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ds, tbl ORDER BY sync) AS no,
             row_number() OVER (PARTITION BY ds, tbl ORDER BY sync DESC) AS recency FROM fp),
stats AS (SELECT ds, tbl, sync, pos, col, kind, count(*) AS n,
          round(count(*) FILTER (WHERE missing) / count(*)::DOUBLE, 6) AS null_pct,
          avg(nval) AS mean, stddev_samp(nval) AS sd FROM cells GROUP BY ALL),
counted AS (SELECT ds, tbl, sync, col, coalesce(sval, '__null__') AS value, count(*) AS cnt
            FROM cells WHERE kind = 'c' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ds, tbl, sync, col ORDER BY cnt DESC, value) AS rk FROM counted),
dist AS (SELECT r.ds, r.tbl, r.sync, r.col, r.value, r.cnt, r.rk, r.cnt / f.rc::DOUBLE AS share
         FROM ranked r JOIN fp f USING (ds, tbl, sync) WHERE rk <= 20),
currents AS (SELECT c.* FROM numbered c {only_newest}),
pairs AS (SELECT c.ds, c.tbl, c.sync, b.sync AS bsync FROM currents c JOIN numbered b
          ON c.ds = b.ds AND c.tbl = b.tbl AND b.no BETWEEN c.no - 7 AND c.no - 1),
old_rows AS (SELECT p.ds, p.tbl, p.sync, count(*) AS nb, avg(f.rc) AS mu, stddev_samp(f.rc) AS sigma
             FROM pairs p JOIN fp f ON f.ds = p.ds AND f.tbl = p.tbl AND f.sync = p.bsync GROUP BY ALL),
old_cols AS (SELECT p.ds, p.tbl, p.sync, s.col, count(*) AS nb, avg(s.null_pct) AS null_pct, avg(s.mean) AS mean,
             avg(s.sd) AS sd FROM pairs p JOIN stats s ON s.ds = p.ds AND s.tbl = p.tbl AND s.sync = p.bsync GROUP BY ALL),
old_dist AS (SELECT p.ds, p.tbl, p.sync, d.col, d.value, sum(d.share) / any_value(o.nb) AS share
             FROM pairs p JOIN dist d ON d.ds = p.ds AND d.tbl = p.tbl AND d.sync = p.bsync
             JOIN old_cols o ON o.ds = p.ds AND o.tbl = p.tbl AND o.sync = p.sync AND o.col = d.col
             GROUP BY p.ds, p.tbl, p.sync, d.col, d.value),
now_dist AS (SELECT d.* FROM dist d JOIN old_rows USING (ds, tbl, sync)),
aligned AS (SELECT ds, tbl, sync, col, value, coalesce(a.share, 0) AS cur, coalesce(e.share, 0) AS base
            FROM now_dist a FULL OUTER JOIN old_dist e USING (ds, tbl, sync, col, value)),
psi AS (SELECT ds, tbl, sync, col, round(sum({_TERM.format(a='cur', e='base')}), 6) AS psi FROM aligned GROUP BY ALL),
shift AS (SELECT s.ds, s.tbl, s.sync, s.col, s.pos, s.mean, o.mean AS old_mean,
          CASE WHEN o.sd > 0 THEN abs((s.mean - o.mean) / o.sd) ELSE 0 END AS z
          FROM stats s JOIN old_cols o USING (ds, tbl, sync, col)
          WHERE s.kind = 'n' AND s.mean IS NOT NULL AND o.mean IS NOT NULL),
nulls AS (SELECT s.ds, s.tbl, s.sync, s.col, abs(s.null_pct - o.null_pct) AS moved
          FROM stats s JOIN old_cols o USING (ds, tbl, sync, col)),
scores AS (SELECT p.ds, p.tbl, p.sync, p.col, s.pos, p.psi AS score FROM psi p JOIN stats s USING (ds, tbl, sync, col)
           UNION ALL SELECT ds, tbl, sync, col, pos, least(z / 3, 2) FROM shift),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY ds, tbl, sync ORDER BY round(score, 6) DESC, pos) = 1),
report AS (SELECT c.ds, c.tbl, c.sync, c.rc, coalesce(o.nb, 0) AS nb, b.col AS max_col, coalesce(b.score, 0) AS score,
           CASE WHEN o.nb >= 2 AND o.sigma > 0 THEN (c.rc - o.mu) / o.sigma ELSE 0 END AS rcz
           FROM currents c LEFT JOIN old_rows o USING (ds, tbl, sync) LEFT JOIN best b USING (ds, tbl, sync))
"""


_NAMES = "ds AS dataset_id, tbl AS table_name, strftime(sync, '%Y-%m-%d') AS sync_day"


def _sql(name: str, text: str) -> None:
    ORACLE[name] = text


# --- scans and profiles ---------------------------------------------------------------------------------------------

_ALL = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_sql(
    "table_catalog",
    f"""
WITH sizes AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _ALL)}),
cols AS (SELECT DISTINCT table_name, ordinal_position, column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
       WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS data_type
  FROM information_schema.columns WHERE table_name IN (SELECT table_name FROM sizes))
SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, data_type,
  CASE WHEN data_type IN ('bigint', 'int', 'double') THEN 'numeric' WHEN data_type = 'string' THEN 'categorical'
       ELSE 'skipped' END AS kind, row_count
FROM cols JOIN sizes USING (table_name)
""",
)


_STALE_AFTER = 21600
_TIMES = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, max({c}) AS last_modified_at, count(*) AS row_count FROM {t}" for t, c in R.TIME_COLUMNS.items()
)
_sql(
    "freshness",
    f"""WITH loaded AS ({_TIMES}), wanted AS (SELECT unnest({[*_ALL, "not_loaded"]}) AS table_name),
ages AS (SELECT table_name, last_modified_at,
  CAST(round((epoch_us(TIMESTAMP '{R.AS_OF}') - epoch_us(last_modified_at)) / 1e6) AS BIGINT) AS age_seconds, row_count
  FROM wanted LEFT JOIN loaded USING (table_name))
SELECT *, coalesce(age_seconds > {_STALE_AFTER}, false) AS is_stale, {_STALE_AFTER} AS threshold_seconds,
  CASE WHEN age_seconds IS NOT NULL THEN least(age_seconds / {_STALE_AFTER}.0::DOUBLE * 100, 100) END AS used_pct,
  CASE WHEN age_seconds >= {_STALE_AFTER} THEN 'red' WHEN age_seconds >= 0.75 * {_STALE_AFTER} THEN 'amber'
    WHEN age_seconds IS NOT NULL THEN 'green' END AS band,
  (SELECT bool_or(coalesce(age_seconds > {_STALE_AFTER}, false)) FROM ages) AS any_stale FROM ages""",
)


_sql(
    "watched_columns",
    f"""WITH cols AS (SELECT DISTINCT table_name, column_name, data_type FROM information_schema.columns WHERE table_name IN {tuple(_ALL)})
SELECT table_name, column_name, 'categorical' AS status FROM cols WHERE data_type = 'VARCHAR'
UNION ALL SELECT table_name, 'region_code', CASE WHEN bool_or(data_type = 'VARCHAR') THEN 'warning' ELSE 'error' END FROM cols GROUP BY 1""",
)


def _numeric_profile(table: str, columns: list[str]) -> list[str]:
    quantiles = ", ".join(f"CAST(quantile_disc({{c}}, {p / 100}) AS DOUBLE) AS p{p}" for p in (1, 25, 50, 75, 99))
    return [
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count, "
        f"round(1 - count({c}) / count(*)::DOUBLE, 6) AS null_pct, count(DISTINCT {c}) AS distinct_count, "
        f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
        f"round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS stddev, "
        f"{quantiles.format(c=c)} FROM {table}"
        for c in columns
    ]


_sql(
    "profile_numeric",
    " UNION ALL ".join(
        _numeric_profile("orders", ["o_orderkey", "o_custkey", "o_totalprice"])
        + _numeric_profile(
            "lineitem",
            ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        )
    ),
)


def _text_counts(columns: list[tuple[str, str]]) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, coalesce({c}, '__null__') AS value, count(*) AS cnt, "
        f"count(DISTINCT {c}) AS present FROM {t} GROUP BY {c}"
        for t, c in columns
    )
    return f"""
WITH counted AS ({counts}),
sized AS (SELECT *, sum(cnt) OVER (PARTITION BY table_name, column_name) AS rc,
          sum(present) OVER (PARTITION BY table_name, column_name) AS distinct_count,
          row_number() OVER (PARTITION BY table_name, column_name ORDER BY cnt DESC, value) AS rnk FROM counted),
kept AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY table_name, column_name)::DOUBLE AS p FROM sized WHERE rnk <= 20)
"""


_TEXT = [
    ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("customer", "c_name"), ("customer", "c_mktsegment"),
    ("events", "event_type"), ("events", "props"), ("conversations", "role"), ("conversations", "text"),
    ("documents", "text"), ("documents", "lang"), ("documents", "source"), ("pages", "url"), ("pages", "html"),
    ("benchmark", "text"),
]
_sql(
    "profile_categorical",
    _text_counts([("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus")])
    + """SELECT table_name, column_name, CAST(any_value(rc) AS BIGINT) AS row_count,
  CAST(coalesce(sum(cnt) FILTER (WHERE value = '__null__'), 0) / any_value(rc) AS DOUBLE) AS null_pct,
  CAST(any_value(distinct_count) AS BIGINT) AS distinct_count, max(value) FILTER (WHERE rnk = 1) AS top_value,
  round(CAST(max(cnt) AS DOUBLE) / CAST(any_value(rc) AS DOUBLE), 6) AS top_pct, round(-sum(p * log2(p)), 6) AS entropy
FROM kept GROUP BY table_name, column_name""",
)
_sql(
    "topk_values",
    _text_counts(_TEXT)
    + "SELECT table_name, column_name, CAST(rnk AS INTEGER) AS rank, value, cnt, round(cnt / CAST(rc AS DOUBLE), 6) AS pct FROM kept",
)
_sql(
    "entropy_by_column",
    _text_counts(_TEXT)
    + """SELECT table_name, column_name, round(abs(sum(p * log2(p))), 6) AS entropy, CAST(count(*) AS INTEGER) AS kept_values
FROM kept GROUP BY table_name, column_name""",
)
_sql(
    "approximate_profile",
    f"""WITH cells AS ({_LINEITEM})
SELECT strftime(sync, '%Y-%m-%d') AS sync_day, col AS column_name, count(*) AS row_count,
  round(count(*) FILTER (WHERE missing) / count(*)::DOUBLE, 6) AS null_pct, round(avg(nval), 4) AS mean,
  CAST(count(DISTINCT sval) AS INTEGER) AS kept_values FROM cells GROUP BY sync, col""",
)
_sql(
    "weekly_profile",
    f"""WITH cells AS ({_cells("app", "events", "CAST(date_trunc('week', ts) AS TIMESTAMP)", "events",
        [("event_type", "c"), ("props", "c"), ("user_id", "n"), ("value", "n")])})
SELECT strftime(sync, '%Y-%m-%d') AS sync_day, col AS column_name, count(*) AS row_count,
  round(count(*) FILTER (WHERE missing) / count(*)::DOUBLE, 6) AS null_pct, min(nval) AS min_value, max(nval) AS max_value,
  round(avg(nval), 4) AS mean, round(stddev_samp(nval), 4) AS stddev,
  count(DISTINCT coalesce(sval, CAST(nval AS VARCHAR))) AS distinct_count, true AS distinct_within, true AS quantiles_within, true AS top_within
FROM cells GROUP BY sync, col""",
)
_sql(
    "fingerprint_daily",
    _chain(_EVENTS)
    + """, ent AS (SELECT ds, tbl, sync, col, round(-sum(p * log2(p)), 6) AS entropy FROM
  (SELECT *, share / sum(share) OVER (PARTITION BY ds, tbl, sync, col) AS p FROM dist) GROUP BY ALL),
more AS (SELECT sync, col, count(DISTINCT coalesce(sval, CAST(nval AS VARCHAR))) AS distinct_count, min(nval) AS lo, max(nval) AS hi
  FROM cells GROUP BY ALL)
SELECT strftime(s.sync, '%Y-%m-%d') AS sync_day,
  left(sha256('event_id:bigint,event_type:string,props:string,ts:timestamp_ntz,user_id:bigint,value:double'), 16) AS schema_hash,
  f.rc AS row_count, s.pos AS position, s.col AS column_name,
  CASE s.col WHEN 'value' THEN 'double' WHEN 'user_id' THEN 'bigint' ELSE 'string' END AS data_type,
  s.null_pct, m.distinct_count, m.lo AS min_value, m.hi AS max_value, round(s.mean, 4) AS mean, round(s.sd, 4) AS stddev, e.entropy
FROM stats s JOIN fp f USING (ds, tbl, sync) JOIN more m USING (sync, col) LEFT JOIN ent e USING (ds, tbl, sync, col)""",
)

_sql(
    "live_profile",
    """WITH live AS (SELECT * FROM orders WHERE o_orderstatus <> 'F')
SELECT 'o_orderstatus' AS column_name, count(*) AS row_count, 0::DOUBLE AS null_pct, NULL::DOUBLE AS mean,
  CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS kept_values FROM live
UNION ALL SELECT 'o_orderpriority', count(*), 0, NULL, CAST(count(DISTINCT o_orderpriority) AS INTEGER) FROM live
UNION ALL SELECT 'o_totalprice', count(*), 0, round(avg(o_totalprice), 4), 0 FROM live""",
)

# --- history --------------------------------------------------------------------------------------------------------

_sql(
    "recent_fingerprints",
    _chain(f"{_EVENTS} UNION ALL {_LINEITEM}")
    + f"SELECT {_NAMES}, CAST(recency AS INTEGER) AS recency, rc AS row_count FROM numbered WHERE recency <= 7",
)
_sql(
    "fingerprint_listing",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS sync_day, count(*) AS row_count FROM events "
    "GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
)
_sql(
    "history_store",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS sync_day, CAST(1 AS BIGINT) AS fingerprints, count(*) AS row_count "
    "FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1",
)
_sql(
    "history_delete",
    "SELECT 'app' AS dataset_id, 'events' AS table_name, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS sync_day, "
    "count(*) AS row_count FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 3 UNION ALL "
    "SELECT 'sales', 'orders', strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), count(*) FROM orders GROUP BY 3",
)
ORACLE["history_delete_in_place"] = ORACLE["history_delete"]
_sql(
    "baseline_capture",
    f"""SELECT 'orders' AS table_name, strftime(TIMESTAMP '{R.AS_OF}' - INTERVAL 1 DAY * days, '%Y-%m-%d') AS sync_day,
  row_count, false AS is_synthetic, CAST(5 AS INTEGER) AS columns, CAST(5 AS BIGINT) AS ids
FROM (SELECT count(*) AS row_count FROM orders), (VALUES (12), (9), (6), (3), (0)) AS v(days)""",
)
_COVERED = (
    "(SELECT DISTINCT o_orderstatus AS dataset_id, o_orderpriority AS table_name FROM orders "
    f"WHERE (o_orderstatus, o_orderpriority) IN ({', '.join(map(str, R.COVERED))}))"
)
_sql(
    "covered_tables",
    f"SELECT dataset_id, table_name, dataset_id || '.' || table_name AS table_key FROM {_COVERED}",
)

# --- drift ----------------------------------------------------------------------------------------------------------

_sql(
    "psi_daily",
    _chain(_HISTORIES)
    + f"SELECT {_NAMES}, col AS column_name, psi AS psi_score, psi > 0.25 AS is_anomalous FROM psi",
)
_sql(
    "numeric_shift_daily",
    _chain(_HISTORIES)
    + f"""SELECT {_NAMES}, col AS column_name, round(least(z / 3, 2), 6) AS score, round(mean, 4) AS current_mean,
  round(old_mean, 4) AS baseline_mean, z > 3 AS is_anomalous FROM shift""",
)
_sql(
    "null_shift",
    _chain(_DOCUMENTS)
    + """SELECT strftime(sync, '%Y-%m-%d') AS sync_day, col AS column_name, round(moved, 6) AS null_shift,
  moved > 0.10 AS is_anomalous FROM nulls WHERE moved > 0.05""",
)
_sql(
    "row_count_z",
    _chain(_HISTORIES)
    + f"SELECT {_NAMES}, rc AS row_count, nb AS baseline_count, round(rcz, 4) AS row_count_z_score FROM report WHERE nb > 0",
)
_sql(
    "schema_delta",
    """
WITH days AS (SELECT d, row_number() OVER (ORDER BY d) AS no FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)),
cols AS (SELECT d, no, col, typ FROM days, (VALUES ('event_type', 'string', 'string'), ('value', 'double', NULL),
  ('user_id', 'bigint', 'string'), ('props', NULL, 'string')) AS v(col, old_type, new_type),
  LATERAL (SELECT CASE WHEN d < DATE '2024-01-15' THEN old_type ELSE new_type END AS typ) WHERE typ IS NOT NULL),
cur AS (SELECT c.d, c.no, c.col, c.typ, count(b.col) AS nb, count(b.col) FILTER (WHERE b.typ <> c.typ) AS other
  FROM cols c LEFT JOIN cols b ON b.col = c.col AND b.no BETWEEN c.no - 7 AND c.no - 1 GROUP BY ALL),
gone AS (SELECT DISTINCT d.d, b.col FROM days d JOIN cols b ON b.no BETWEEN d.no - 7 AND d.no - 1
  WHERE NOT EXISTS (SELECT 1 FROM cols c WHERE c.d = d.d AND c.col = b.col)),
lists AS (SELECT d.d, coalesce((SELECT string_agg(col, ',' ORDER BY col) FROM cur WHERE cur.d = d.d AND nb = 0), '') AS columns_added,
  coalesce((SELECT string_agg(col, ',' ORDER BY col) FROM gone WHERE gone.d = d.d), '') AS columns_removed,
  coalesce((SELECT string_agg(col, ',' ORDER BY col) FROM cur WHERE cur.d = d.d AND other > 0), '') AS columns_type_changed
  FROM days d WHERE no > 1),
"""
    + _chain(
        " UNION ALL ".join(
            [
                _cells("app", "events", _DAY, "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15')",
                       [("event_type", "c"), ("value", "n"), ("user_id", "n")]),
                _cells("app", "events", _DAY, "(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15')",
                       [("event_type", "c"), ("user_id", "c"), ("props", "c")]),
            ]
        )
    ).replace("WITH RECURSIVE cells", "cells", 1)
    # a column that was numeric before has no old distribution: every old share is 0
    .replace("sum(d.share) / any_value(o.nb)", "sum(d.share) / any_value(o.nd)", 1)
    .replace("avg(s.sd) AS sd FROM pairs p", "avg(s.sd) AS sd, count(*) FILTER (WHERE s.kind = 'c') AS nd FROM pairs p", 1)
    .replace("AS cur, coalesce(e.share, 0) AS base", "AS cur, coalesce(e.share, 0) AS base, a.share AS has", 1)
    + """, judged AS (SELECT r.*, (SELECT max(p.psi) FROM psi p JOIN old_cols o USING (ds, tbl, sync, col)
  JOIN stats s USING (ds, tbl, sync, col) WHERE p.sync = r.sync) AS psi, (SELECT max(least(z / 3, 2)) FROM shift s WHERE s.sync = r.sync) AS num FROM report r)
SELECT strftime(l.d, '%Y-%m-%d') AS sync_day, columns_added, columns_removed, columns_type_changed,
  concat_ws('; ', CASE WHEN columns_added <> '' THEN 'columns added: [''' || replace(columns_added, ',', ''', ''') || ''']' END,
    CASE WHEN columns_removed <> '' THEN 'columns removed: [''' || replace(columns_removed, ',', ''', ''') || ''']' END) AS columns_reason,
  (coalesce(greatest(psi, num), psi, num, 0) > 0.25 OR abs(rcz) > 3 OR columns_added <> '' OR columns_removed <> '') AS is_anomalous
FROM lists l JOIN judged j ON CAST(j.sync AS DATE) = l.d""",
)
_REASON = """concat_ws('; ', CASE WHEN score > 0.25 THEN printf('column ''%s'' PSI=%.3f (threshold 0.25)', max_col, score) END,
  CASE WHEN abs(rcz) > 3 THEN printf('row count Z-score=%.2f', rcz) END)"""
_ANOMALOUS = "(score > 0.25 OR abs(rcz) > 3)"
_sql(
    "drift_report",
    _chain(_HISTORIES)
    + f"""SELECT {_NAMES}, CASE WHEN nb > 0 THEN 'compared' ELSE 'no_baseline' END AS status, rc AS row_count, nb AS baseline_count,
  max_col AS max_psi_column, CASE WHEN nb > 0 THEN round(score, 6) END AS max_psi_score,
  CASE WHEN nb = 0 THEN NULL WHEN score < 0.1 THEN 'stable' WHEN score <= 0.25 THEN 'watch' ELSE 'anomalous' END AS psi_band,
  CASE WHEN nb > 0 THEN round(rcz, 4) END AS row_count_z_score, CASE WHEN nb > 0 THEN {_ANOMALOUS} END AS is_anomalous,
  CASE WHEN nb > 0 AND {_ANOMALOUS} THEN {_REASON} END AS anomaly_reason FROM report""",
)
_sql(
    "latest_check",
    _chain(_HISTORIES)
    + f"""SELECT {_NAMES}, nb AS baseline_count, max_col AS max_psi_column, round(score, 6) AS max_psi_score,
  round(score / 0.25, 1) AS threshold_multiple, round(rcz, 4) AS row_count_z_score, {_ANOMALOUS} AS is_anomalous
FROM report JOIN numbered USING (ds, tbl, sync) WHERE recency = 1""",
)
_SHIFTS = """, shifts AS (SELECT *, 'DISAPPEARED' AS shift FROM aligned WHERE base > 0 AND cur < 0.001
  UNION ALL SELECT *, 'APPEARED' FROM aligned WHERE cur > 0 AND base < 0.001)"""
_sql(
    "value_shifts",
    _chain(_EVENTS, scenario=_SCENARIO)
    + _SHIFTS
    + f"""SELECT {_NAMES}, col AS column_name, value, shift, round(cur, 6) AS current_share, round(base, 6) AS baseline_share
FROM shifts""",
)
_sql(
    "leading_values",
    _chain(_ORDERS)
    + """, sides AS (SELECT *, 'current' AS side, cur AS share FROM aligned WHERE cur > 0
  UNION ALL SELECT *, 'baseline', base FROM aligned WHERE base > 0)
SELECT strftime(sync, '%Y-%m-%d') AS sync_day, col AS column_name, side, value, round(share, 6) AS share FROM sides
QUALIFY row_number() OVER (PARTITION BY sync, col, side ORDER BY share DESC, value) <= 10""",
)
_sql(
    "top_movers",
    _chain("", scenario=_SCENARIO)
    + """SELECT a.ds AS dataset_id, a.tbl AS table_name, col AS column_name, value, round(cur * 100, 1) AS current_pct,
  round(base * 100, 1) AS baseline_pct, round(cur - base, 6) AS delta
FROM aligned a JOIN report r ON a.ds = r.ds AND a.tbl = r.tbl AND a.sync = r.sync AND a.col = r.max_col
QUALIFY row_number() OVER (PARTITION BY a.ds, a.tbl, a.sync ORDER BY abs(round(cur - base, 12)) DESC, value) <= 7""",
)

# --- triage ---------------------------------------------------------------------------------------------------------

# the closest pair of every column is taken again and again, until no two unused values are close enough
_PAIRS = """, near AS (SELECT o.ds, o.tbl, o.sync, o.col, o.value AS old_value, n.value AS new_value, o.base AS old_share, n.cur AS new_share,
    row_number() OVER (PARTITION BY o.ds, o.tbl, o.sync, o.col ORDER BY round(abs(o.base - n.cur), 9), o.value, n.value) AS rk
  FROM shifts o JOIN shifts n ON o.ds = n.ds AND o.tbl = n.tbl AND o.sync = n.sync AND o.col = n.col
  WHERE o.shift = 'DISAPPEARED' AND n.shift = 'APPEARED' AND round(abs(o.base - n.cur), 9) <= 0.01),
picks AS (SELECT ds, tbl, sync, col, rk, [old_value] AS old_used, [new_value] AS new_used FROM near WHERE rk = 1
  UNION ALL SELECT p.ds, p.tbl, p.sync, p.col, n.rk, list_append(old_used, n.old_value), list_append(new_used, n.new_value)
  FROM picks p JOIN near n USING (ds, tbl, sync, col)
  WHERE NOT list_contains(old_used, n.old_value) AND NOT list_contains(new_used, n.new_value)
  QUALIFY row_number() OVER (PARTITION BY p.ds, p.tbl, p.sync, p.col ORDER BY n.rk) = 1),
renames AS (SELECT n.* FROM near n JOIN picks USING (ds, tbl, sync, col, rk))"""
_sql(
    "rename_pairs",
    _chain("", scenario=_SCENARIO)
    + _SHIFTS
    + _PAIRS
    + """SELECT ds AS dataset_id, tbl AS table_name, col AS column_name, old_value, new_value, round(old_share, 6) AS old_share,
  round(new_share, 6) AS new_share FROM renames""",
)
_CLASSES = f""", counts AS (SELECT r.*, {_ANOMALOUS} AS bad,
  (SELECT count(*) FROM renames x WHERE x.ds = r.ds AND x.tbl = r.tbl AND x.sync = r.sync) AS renamed_values,
  (SELECT count(*) FROM shifts x WHERE x.ds = r.ds AND x.tbl = r.tbl AND x.sync = r.sync AND shift = 'DISAPPEARED') AS vanished_values,
  (SELECT count(*) FROM shifts x WHERE x.ds = r.ds AND x.tbl = r.tbl AND x.sync = r.sync AND shift = 'APPEARED') AS new_values,
  (SELECT count(*) FROM nulls x WHERE x.ds = r.ds AND x.tbl = r.tbl AND x.sync = r.sync AND moved > 0.10) > 0 AS null_flag,
  (SELECT coalesce(string_agg(col, ',' ORDER BY pos), '') FROM
    (SELECT p.col, st.pos FROM psi p JOIN stats st USING (ds, tbl, sync, col) WHERE p.ds = r.ds AND p.tbl = r.tbl AND p.sync = r.sync AND p.psi > 0.25
     UNION SELECT s.col, s.pos FROM shift s WHERE s.ds = r.ds AND s.tbl = r.tbl AND s.sync = r.sync AND s.z > 3
     UNION SELECT n.col, st.pos FROM nulls n JOIN stats st USING (ds, tbl, sync, col) WHERE n.ds = r.ds AND n.tbl = r.tbl AND n.sync = r.sync AND n.moved > 0.10)) AS affected_columns
  FROM report r WHERE nb > 0),
classes AS (SELECT *, CASE WHEN bad THEN CASE WHEN renamed_values > 0 AND abs(round(rcz, 4)) <= 3 THEN 'SILENT_SEMANTIC_FAILURE'
    WHEN null_flag OR round(rcz, 4) < -3 OR vanished_values > renamed_values THEN 'UPSTREAM_DATA_QUALITY'
    WHEN (new_values > 0 OR round(rcz, 4) > 3) AND vanished_values = 0 THEN 'BENIGN_GROWTH' ELSE 'NORMAL_SEASONAL' END END AS classification,
  sum(CAST(bad AS INTEGER)) OVER (PARTITION BY ds, sync) - CAST(bad AS INTEGER) = 0 AS others_clean FROM counts)"""
_STEP = """CASE WHEN NOT bad THEN 'clean' WHEN classification = 'SILENT_SEMANTIC_FAILURE' THEN 'pending_approval'
  ELSE 'no_action_needed' END"""
_sql(
    "drift_class",
    _chain(_EVENTS, scenario=_SCENARIO)
    + _SHIFTS
    + _PAIRS
    + _CLASSES
    + f"""SELECT {_NAMES}, classification, {_STEP} AS next_step, affected_columns, renamed_values, vanished_values, new_values,
  null_flag, others_clean FROM classes""",
)
_sql(
    "verdict_rows",
    _chain("", scenario=_SCENARIO)
    + _SHIFTS
    + _PAIRS
    + _CLASSES
    + f"""SELECT c.ds AS dataset_id, c.tbl AS table_name, classification, affected_columns, max_col AS max_psi_column,
  round(score, 6) AS max_psi_score, CAST(0.25 AS DOUBLE) AS psi_threshold, 'pending' AS state,
  (SELECT CAST(count(*) AS INTEGER) FROM aligned a WHERE a.ds = c.ds AND a.tbl = c.tbl AND a.col = c.max_col AND base > 0) AS baseline_values,
  (SELECT CAST(count(*) AS INTEGER) FROM aligned a WHERE a.ds = c.ds AND a.tbl = c.tbl AND a.col = c.max_col AND cur > 0) AS current_values,
  {R.DETECTION_SECONDS}.0::DOUBLE AS time_to_detect_seconds, round((11520 - {R.DETECTION_SECONDS}) / 3600.0::DOUBLE, 2) AS hours_saved_this_incident
FROM classes c WHERE {_STEP} = 'pending_approval' AND c.ds <> 'market'""",
)
_MODEL_SQL = (
    "'select c.c_custkey from customer c join region r on r.r_regionkey = c.region where r.r_name = ''' || r_name || "
    "''' and c.c_mktsegment = ''' || c_mktsegment || ''''"
)
_MODELS = (
    f"(SELECT c_custkey, c_name, r_name, c_mktsegment, {_MODEL_SQL} AS sql FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)


def _stale(table: str, column: str, alias: str, old: str, new: str) -> str:
    before, after = f"{alias}.{column} = ''{old}''", f"{alias}.{column} = ''{new}''"
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, 'active_' || c_custkey AS model_name, "
        f"'models/active_' || c_custkey || '.sql' AS file_path, '{before}' AS original_snippet, '{after}' AS fixed_snippet, "
        f"replace(sql, '{before}', '{after}') AS fixed_sql FROM {_MODELS} WHERE {column} = '{old}'"
    )


_sql(
    "stale_literals",
    _stale("region", "r_name", "r", *R.RENAMED_REGION)
    + " UNION ALL "
    + _stale("customer", "c_mktsegment", "c", *R.RENAMED_SEGMENT),
)
_RENAMING = (
    "(SELECT c_custkey, r_name, 'select count(*) n from {{ ref(''middle_' || c_custkey || ''') }} v where v.zone in (''none'', ''' "
    "AS opening FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
_sql(
    "column_trace",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS graph, replace(uid, '#', CAST(c_custkey AS VARCHAR)) AS uid, "column", exact
FROM {_RENAMING}, (VALUES ('source.crm.region', 'r_name', true), ('model.crm.base_#', 'area', true),
  ('model.crm.middle_#', 'zone', true), ('model.crm.middle_#', 'loud', false)) AS t(uid, "column", exact)""",
)
_sql(
    "traced_blast",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS graph, 'model.crm.' || name || '_' || c_custkey AS uid, hop,
  name = 'base' AS references_column, true AS traces_column
FROM {_RENAMING}, (VALUES ('base', 1::INTEGER), ('middle', 2), ('last', 3)) AS t(name, hop)""",
)
_OLD, _NEW = R.RENAMED_REGION
_LAST = "opening || '{0}'') or ''{1}'' = ZONE or loud = ''" + _OLD + "'''"
_BROKEN = (
    "SELECT 'region' AS table_name, 'r_name' AS column_name, 'last_' || c_custkey AS model_name, "
    "'models/last_' || c_custkey || '.sql' AS file_path, 'zone' AS column_there, true AS certain, "
    f"'{_OLD}' AS old_value, '{_NEW}' AS new_value, "
)
_WITH_OLD = f"FROM {_RENAMING} WHERE r_name = '{_OLD}'"
_sql(
    "broken_literals",
    " UNION ALL ".join(
        f"{_BROKEN}'{form}' AS form, '{before}' AS original_snippet, '{after}' AS fixed_snippet, "
        f"{_LAST.format(*literals)} AS fixed_sql {_WITH_OLD}"
        for form, before, after, literals in (
            ("in", f"v.zone in (''none'', ''{_OLD}'')", f"v.zone in (''none'', ''{_NEW}'')", (_NEW, _OLD)),
            ("reversed", f"''{_OLD}'' = ZONE", f"''{_NEW}'' = ZONE", (_OLD, _NEW)),
        )
    ),
)
_sql(
    "repaired_models",
    "SELECT 'model.crm.last_' || c_custkey AS model_uid, 'last_' || c_custkey AS model_name, 2::INTEGER AS fixed_literals, "
    f"0::BIGINT AS uncertain_literals, {_LAST.format(_NEW, _NEW)} AS fixed_sql {_WITH_OLD}",
)
_sql(
    "sync_check",
    _chain("", scenario=_SCENARIO)
    + _SHIFTS
    + _PAIRS
    + _CLASSES
    + f"""SELECT ds AS dataset_id, tbl AS table_name, classification, {_STEP} AS next_step, max_col AS max_psi_column,
  round(score, 6) AS max_psi_score,
  CASE WHEN bad AND tbl IN ('region', 'customer') THEN 2 * (SELECT count(*) FROM customer) ELSE 0 END AS downstream,
  CASE tbl WHEN 'region' THEN (SELECT count(*) FROM {_MODELS} WHERE r_name = '{R.RENAMED_REGION[0]}')
    WHEN 'customer' THEN (SELECT count(*) FROM {_MODELS} WHERE c_mktsegment = '{R.RENAMED_SEGMENT[0]}') ELSE 0 END AS fixes
FROM classes""",
)
_sql(
    "impact_running",
    """
WITH spans AS (SELECT 'r' || (event_id // 3) AS report_id, min(ts) AS received_at, max(ts) AS detected_at FROM events GROUP BY 1),
timed AS (SELECT *, epoch_us(detected_at) / 1e6 - epoch_us(received_at) / 1e6 AS s0,
  (epoch_us(detected_at) - epoch_us(received_at)) / 1e6 AS seconds FROM spans),
hours AS (SELECT *, greatest((11520 - seconds) / 3600, 0) AS h FROM timed)
SELECT report_id, round(seconds, 1) AS time_to_detect_seconds, round(h, 2) AS hours_saved_this_incident,
  count(*) OVER w AS incidents_caught_total, round(sum(h) OVER w, 2) AS total_hours_saved
FROM hours WINDOW w AS (ORDER BY detected_at, report_id ROWS UNBOUNDED PRECEDING)
""",
)

# --- risk -----------------------------------------------------------------------------------------------------------

_RISK = (
    f""", win AS (SELECT * FROM numbered WHERE recency <= 15),
newest AS (SELECT * FROM win WHERE recency = 1), past AS (SELECT * FROM win WHERE recency > 1),
others AS (SELECT a.ds, a.tbl, a.sync, b.sync AS bsync FROM win a JOIN past b ON a.ds = b.ds AND a.tbl = b.tbl AND a.sync <> b.sync),
holders AS (SELECT o.ds, o.tbl, o.sync, s.col, count(*) AS n FROM others o JOIN stats s
  ON s.ds = o.ds AND s.tbl = o.tbl AND s.sync = o.bsync AND s.kind = 'c' GROUP BY ALL),
means AS (SELECT o.ds, o.tbl, o.sync, d.col, d.value, sum(d.share) / any_value(h.n) AS share FROM others o
  JOIN dist d ON d.ds = o.ds AND d.tbl = o.tbl AND d.sync = o.bsync
  JOIN holders h ON h.ds = o.ds AND h.tbl = o.tbl AND h.sync = o.sync AND h.col = d.col
  GROUP BY o.ds, o.tbl, o.sync, d.col, d.value),
own AS (SELECT d.* FROM dist d JOIN win USING (ds, tbl, sync)),
both_sides AS (SELECT ds, tbl, sync, col, value, a.share AS cur, e.share AS base FROM own a FULL OUTER JOIN means e USING (ds, tbl, sync, col, value)),
loo AS (SELECT ds, tbl, sync, col, round(sum({_TERM.format(a='cur', e='base')}), 6) AS psi FROM both_sides GROUP BY ALL),
bad AS (SELECT l.ds, l.tbl, l.sync, max(psi) AS psi FROM loo l JOIN past USING (ds, tbl, sync) WHERE psi > 0.25 GROUP BY ALL),
lead AS (SELECT l.ds, l.tbl, max(psi) AS max_psi, avg(psi) AS avg_psi, arg_min(l.col, (-psi, s.pos)) AS volatile
  FROM loo l JOIN newest USING (ds, tbl, sync) JOIN stats s USING (ds, tbl, sync, col) GROUP BY ALL),
profiles AS (SELECT w.ds, w.tbl, count(*) AS fingerprint_count,
  coalesce((SELECT count(*) FROM bad b WHERE b.ds = w.ds AND b.tbl = w.tbl), 0) AS anomaly_count,
  round(epoch(TIMESTAMP '{R.AS_OF}' - (SELECT max(sync) FROM bad b WHERE b.ds = w.ds AND b.tbl = w.tbl)) / 86400, 1) AS recent_anomaly_days,
  round(any_value(l.max_psi), 4) AS max_psi, any_value(l.volatile) AS volatile_column, round(any_value(l.avg_psi), 4) AS avg_max_psi
  FROM win w LEFT JOIN lead l USING (ds, tbl) GROUP BY w.ds, w.tbl)"""
)
_sql(
    "past_anomalies",
    _chain(_HISTORIES) + _RISK + f"SELECT {_NAMES}, round(psi, 5) AS psi FROM bad",
)
_sql(
    "risk_profile",
    _chain(_HISTORIES)
    + _RISK
    + """SELECT ds AS dataset_id, tbl AS table_name, fingerprint_count, anomaly_count, recent_anomaly_days, max_psi, volatile_column,
  avg_max_psi, true AS sufficient_history FROM profiles""",
)
_sql(
    "risk_forecast",
    _chain(_HISTORIES)
    + _RISK
    + f""", logged AS (SELECT ds, tbl, arg_min(round(score, 6), (-round(score, 6), sync)) AS psi, arg_min(sync, (-round(score, 6), sync)) AS at
  FROM report WHERE nb > 0 AND {_ANOMALOUS} AND round(score, 6) > 0 GROUP BY ALL),
merged AS (SELECT p.ds, p.tbl, fingerprint_count, volatile_column,
  CASE WHEN l.psi IS NULL THEN max_psi ELSE greatest(max_psi, l.psi) END AS max_psi,
  CASE WHEN l.psi IS NULL THEN anomaly_count ELSE greatest(anomaly_count, 1) END AS anomaly_count,
  CASE WHEN l.psi IS NOT NULL AND (recent_anomaly_days IS NULL OR round(epoch(TIMESTAMP '{R.AS_OF}' - l.at) / 86400, 2) < recent_anomaly_days)
    THEN round(epoch(TIMESTAMP '{R.AS_OF}' - l.at) / 86400, 2) ELSE recent_anomaly_days END AS days
  FROM profiles p LEFT JOIN logged l USING (ds, tbl)),
scored AS (SELECT *, CAST(least(least(anomaly_count * 20, 50) + CASE WHEN days <= 3 THEN 30 WHEN days <= 7 THEN 20 WHEN days <= 14 THEN 10 ELSE 0 END
  + CASE WHEN max_psi > 2 THEN 15 WHEN max_psi > 0.5 THEN 8 WHEN max_psi > 0.25 THEN 4 ELSE 0 END, 100) AS INTEGER) AS risk_score FROM merged)
SELECT ds AS dataset_id, tbl AS table_name, risk_score,
  CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 45 THEN 'HIGH' WHEN risk_score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN anomaly_count > 0 THEN 'Column ''' || coalesce(volatile_column, 'None') || ''' drifted ' || anomaly_count ||
    ' time(s) in recent history, most recently ' || CASE WHEN days <> 0 THEN CAST(round_even(days, 0) AS BIGINT) || ' days ago' ELSE 'recently' END || '.'
  ELSE 'No significant drift history — baseline is stable across ' || fingerprint_count || ' fingerprints.' END AS reason,
  volatile_column, max_psi, anomaly_count, days AS recent_anomaly_days, fingerprint_count FROM scored
UNION ALL SELECT 'app', 'never_loaded', 5, 'LOW', 'No significant drift history — baseline is stable across 0 fingerprints.', NULL, 0, 0, NULL, 0
UNION ALL SELECT 'app', 'unreadable', 0, 'UNKNOWN', 'Unable to compute — check fingerprint history', NULL, 0, 0, NULL, 0""",
)

# --- lineage --------------------------------------------------------------------------------------------------------

_sql(
    "manifest_node_table",
    f"""
WITH m AS (SELECT *, CAST(c_custkey AS VARCHAR) AS graph FROM {_MODELS})
SELECT graph, 'model.crm.' || graph AS uid, 'active_' || graph AS name, 'model' AS resource_type, '' AS source_name,
  CAST(NULL AS VARCHAR) AS owner_name, CAST(NULL AS VARCHAR) AS owner_email, 'models/active_' || graph || '.sql' AS original_file_path,
  sql AS raw_code, 'source.crm.region,source.crm.customer' AS depends_on FROM m
UNION ALL SELECT graph, 'source.crm.' || t, t, 'source', 'crm', NULL, NULL, NULL, NULL, '' FROM m, (VALUES ('region'), ('customer')) AS v(t)
UNION ALL SELECT graph, 'exposure.crm.' || graph, 'board_' || graph, 'exposure', '', c_name, 'board@example.com', NULL, NULL,
  'model.crm.' || graph || ',model.crm.unknown' FROM m
""",
)
_GRAPH = """
ship AS (SELECT l_orderkey, l_suppkey, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
nodes AS (SELECT 'region:' || r_regionkey AS uid, r_name AS name, 'source' AS node_type, CAST(NULL AS VARCHAR) AS owner, '' AS sql FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'model', NULL, 'select * from region where r_name is not null -- ' || n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'segment ' || c_mktsegment, 'model', NULL,
    'select * from nation where segment = ''' || c_mktsegment || '''' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey, 'model', NULL, '' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, o_orderpriority, 'model', NULL, '' FROM orders
  UNION ALL SELECT 'shipment:' || l_orderkey || '-' || l_suppkey, flag, 'exposure',
    CASE flag WHEN 'R' THEN 'returns desk' WHEN 'A' THEN 'desk@example.com' END, '' FROM ship),
links AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION SELECT 'order:' || l_orderkey, 'shipment:' || l_orderkey || '-' || l_suppkey FROM ship
  UNION SELECT 'supplier:' || l_suppkey, 'shipment:' || l_orderkey || '-' || l_suppkey FROM ship),
edges AS (SELECT src, dst FROM links SEMI JOIN nodes ON links.src = nodes.uid)
"""
_REACH = (
    "WITH RECURSIVE "
    + _GRAPH
    + """, walk AS (SELECT 'region:' || r_regionkey AS start, 'region:' || r_regionkey AS uid, 0 AS hop FROM region
  UNION SELECT w.start, e.dst, w.hop + 1 FROM walk w JOIN edges e ON e.src = w.uid),
reached AS (SELECT start, uid, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY ALL HAVING min(hop) > 0),
blast AS (SELECT s.name AS source_table, r.start, r.uid, r.hop, n.node_type, n.name,
  CASE r.hop WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS severity, n.owner,
  contains(n.sql, 'r_name') AS references_column FROM reached r JOIN nodes n ON n.uid = r.uid JOIN nodes s ON s.uid = r.start)
"""
)
_sql("lineage_edges", "WITH " + _GRAPH + "SELECT src, dst FROM edges")
_sql(
    "blast_radius",
    _REACH + "SELECT source_table, uid, hop, node_type, name, severity, owner, references_column FROM blast",
)
_sql(
    "blast_edges",
    _REACH
    + """, members AS (SELECT start, uid FROM reached UNION SELECT start, start FROM reached)
SELECT DISTINCT a.start AS start_uid, na.name AS from_name, nb.name AS to_name FROM edges e JOIN members a ON a.uid = e.src
JOIN members b ON b.uid = e.dst AND b.start = a.start JOIN nodes na ON na.uid = e.src JOIN nodes nb ON nb.uid = e.dst""",
)
_sql(
    "blast_display",
    _REACH
    + """SELECT source_table, hop, name AS id, node_type, severity, owner, references_column, count(*) AS nodes FROM blast GROUP BY ALL
UNION ALL SELECT r_name, 0, r_name, 'source', 'flagged', NULL, false, 1 FROM region""",
)
_sql(
    "blast_summary",
    _REACH
    + """SELECT source_table, uid, '  [' || upper(severity) || '] ' || node_type || ': ' || name ||
  coalesce(' (owner: ' || owner || ')', '') || CASE WHEN references_column THEN ' [references column]' ELSE '' END AS line FROM blast
UNION ALL SELECT DISTINCT source_table, '', 'Blast radius for ' || source_table || '.r_name:' FROM blast
UNION ALL SELECT 'not ' || r_name, '', 'No downstream dependencies for not ' || r_name || '.r_name' FROM region""",
)
_sql(
    "owners",
    _REACH
    + """SELECT DISTINCT source_table, owner, asset_count FROM
  (SELECT source_table, owner, count(*) OVER (PARTITION BY source_table) AS asset_count FROM blast) WHERE owner IS NOT NULL""",
)
_sql(
    "reach_changes",
    _REACH
    + """, edges2 AS (SELECT src, dst FROM edges WHERE NOT (dst LIKE 'customer:%' AND
    dst IN (SELECT uid FROM nodes WHERE name IN ('segment BUILDING', 'segment MACHINERY')))
  UNION SELECT 'region:' || n_regionkey, 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment = 'BUILDING'),
walk2 AS (SELECT 'region:' || r_regionkey AS start, 'region:' || r_regionkey AS uid, 0 AS hop FROM region
  UNION SELECT w.start, e.dst, w.hop + 1 FROM walk2 w JOIN edges2 e ON e.src = w.uid),
reached2 AS (SELECT start, uid, CAST(min(hop) AS INTEGER) AS hop FROM walk2 GROUP BY ALL HAVING min(hop) > 0)
SELECT start AS start_uid, uid, a.hop AS hop_before, b.hop AS hop_after FROM reached a FULL JOIN reached2 b USING (start, uid)
WHERE a.hop IS DISTINCT FROM b.hop""",
)
_sql("hop_layers", _REACH + "SELECT start AS start_uid, hop, count(*) AS nodes FROM reached GROUP BY ALL")
_sql(
    "hop_positions",
    _REACH
    + """SELECT start AS start_uid, hop, uid, row_number() OVER (PARTITION BY start, hop ORDER BY uid) - 1 AS place FROM reached""",
)
_sql(
    "model_sql",
    "WITH "
    + _GRAPH
    + """SELECT uid, name, 'models/' || name || '.sql' AS file_path, sql FROM nodes WHERE node_type = 'model'
  AND (name IN (SELECT n_name FROM nation) OR name IN (SELECT 'segment ' || c_mktsegment FROM customer))""",
)

# --- KPIs -----------------------------------------------------------------------------------------------------------

_FACTS = """(SELECT o_orderkey AS deal_id, n_regionkey AS stage_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS close_date,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS is_deleted
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_LIVE = f"{_FACTS} f JOIN region ON stage_id = r_regionkey WHERE NOT is_deleted"
_KPI = "SELECT coalesce(CAST(sum(amount) AS DOUBLE), 0) AS pipeline_value, count(*) AS deal_count FROM "
_sql("kpi_by_label", f"{_KPI} {_LIVE} AND r_name = 'EUROPE'")
_sql(
    "kpi_after_rename",
    f"{_KPI} {_FACTS} f JOIN (SELECT r_regionkey, CASE WHEN r_name = '{R.RENAMED_REGION[0]}' THEN '{R.RENAMED_REGION[1]}' ELSE r_name END "
    "AS label FROM region) ON stage_id = r_regionkey WHERE NOT is_deleted AND label = 'EUROPE'",
)
_sql("kpi_open_dates", f"{_KPI} {_LIVE} AND r_name = 'EUROPE' AND close_date >= TIMESTAMP '{R.OPEN_FROM}'")
_sql(
    "kpi_by_id",
    f"""SELECT r_regionkey AS stage_id, coalesce(CAST(sum(amount) FILTER (WHERE NOT is_deleted) AS DOUBLE), 0) AS pipeline_value_at_risk
FROM region LEFT JOIN {_FACTS} f ON stage_id = r_regionkey WHERE r_regionkey IN (0, 3) GROUP BY 1""",
)
_sql(
    "staging_model",
    f"""SELECT deal_id, stage_id, r_name AS stage_label, CAST(amount AS DOUBLE) AS amount, strftime(close_date, '%Y-%m-%d') AS close_day
FROM {_LIVE} AND r_name = 'EUROPE'""",
)
_sql(
    "mart_by_stage",
    f"""SELECT r_name AS stage_label, count(*) AS deal_count, CAST(sum(amount) AS DOUBLE) AS pipeline_value,
  CAST(sum(CASE WHEN close_date >= TIMESTAMP '{R.OPEN_FROM}' THEN amount ELSE 0 END) AS DOUBLE) AS active_pipeline_value FROM {_LIVE} GROUP BY 1""",
)
_sql("stage_totals", f"SELECT stage_id, count(*) AS deals, CAST(sum(amount) AS DOUBLE) AS total_value FROM {_FACTS} GROUP BY 1")
_sql(
    "relabel",
    f"""SELECT CASE WHEN c_mktsegment = '{R.RENAMED_SEGMENT[0]}' THEN '{R.RENAMED_SEGMENT[1]}' ELSE c_mktsegment END AS c_mktsegment,
  count(*) AS rows, (SELECT count(*) FROM customer WHERE c_mktsegment = '{R.RENAMED_SEGMENT[0]}') AS affected_rows FROM customer GROUP BY 1""",
)

# --- monitoring, syncs, incidents -----------------------------------------------------------------------------------

_sql(
    "connector_table_list",
    "SELECT o_custkey AS connector_id, o_orderstatus AS schema_name, o_orderpriority AS table_name, o_totalprice > 400000 AS enabled FROM orders",
)
_sql(
    "schema_lookup",
    "SELECT o_custkey AS connector_id, o_orderpriority AS table_name, "
    f"arg_min(o_orderstatus, list_position({list(R.SCHEMA_ORDER)}, o_orderstatus)) AS schema_name FROM orders GROUP BY 1, 2",
)
_COVERAGE = f"""(SELECT o_custkey AS connector_id, o_orderstatus AS schema_name, o_orderpriority AS table_name, bool_or(o_totalprice > 400000) AS enabled,
  o_orderpriority IN (SELECT table_name FROM {_COVERED} WHERE dataset_id = '{R.COVERED_DATASET}') AS has_baseline FROM orders GROUP BY 1, 2, 3)"""
_sql("coverage", f"SELECT * FROM {_COVERAGE}")
_sql(
    "coverage_summary",
    f"""SELECT connector_id, count(*) AS total_tables, count(*) FILTER (WHERE has_baseline) AS monitored_tables,
  CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE has_baseline) / count(*), 0) AS BIGINT) AS coverage_pct FROM {_COVERAGE} GROUP BY 1""",
)
_sql(
    "drift_trend",
    _chain(_HISTORIES)
    + f"""SELECT strftime(sync, '%Y-%m-%d') AS sync_day, ds || '.' || tbl AS table_key, round(score, 6) AS psi, max_col AS column_name,
  {_ANOMALOUS} AS is_anomalous FROM report WHERE nb > 0 ORDER BY sync DESC, ds || '.' || tbl DESC LIMIT 200""",
)
_INCIDENTS = """
log AS (SELECT 'r' || (event_id // 3) AS report_id, ts, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'dismiss' WHEN 'click' THEN 'reenable' WHEN 'signup' THEN 'investigate'
    ELSE event_type END AS action FROM events),
opened AS (SELECT 'r' || (event_id // 3) AS report_id, min(ts) AS opened_at FROM events WHERE value < 60 GROUP BY 1),
letters AS (SELECT o.report_id, o.opened_at, coalesce(string_agg(CASE action WHEN 'approve' THEN 'a' WHEN 'dismiss' THEN 'd' WHEN 'reenable' THEN 'e' ELSE '.' END, ''
  ORDER BY l.ts, l.seq), '') AS story, list(l.seq ORDER BY l.ts, l.seq) AS seqs, list(l.ts ORDER BY l.ts, l.seq) AS times
  FROM opened o LEFT JOIN log l ON l.report_id = o.report_id AND l.ts >= o.opened_at GROUP BY ALL),
placed AS (SELECT *, length(regexp_extract(story, '^[^ad]*[ad]')) AS at_decision,
  CASE WHEN regexp_matches(story, '^[^ad]*a.*e') THEN length(regexp_extract(story, '^[^ad]*a[^e]*e')) ELSE 0 END AS at_return FROM letters),
states AS (SELECT report_id, opened_at, CASE WHEN at_return > 0 THEN 'reenabled' WHEN story[at_decision] = 'a' THEN 'quarantined'
    WHEN story[at_decision] = 'd' THEN 'dismissed' ELSE 'pending' END AS state,
  CASE story[at_decision] WHEN 'a' THEN 'approve' WHEN 'd' THEN 'dismiss' END AS decision,
  CASE WHEN at_decision > 0 THEN seqs[at_decision] END AS decided_seq, CASE WHEN at_return > 0 THEN seqs[at_return] END AS reenabled_seq,
  CASE WHEN at_return > 0 THEN times[at_return] END AS reenabled_at, CASE WHEN at_decision > 0 THEN times[at_decision] END AS decided_at
  FROM placed)
"""
_MERGES = """
best AS (SELECT 'r' || (event_id // 3) AS report_id, arg_max(event_id, (value, event_id)) AS pr_number,
  arg_max(ts, (value, event_id)) AS merged_at, max(value) AS top FROM events
  WHERE value > 20 GROUP BY 1),
merges AS (SELECT report_id, pr_number, CASE WHEN top > 60 THEN 'closed' ELSE 'open' END AS pr_state, top > 60 AS merged, merged_at,
  'https://example.com/pr/' || pr_number AS pr_url FROM best)
"""
_STATES = "SELECT report_id, state, decision, decided_seq, reenabled_seq FROM states"
_sql("incident_state", "WITH " + _INCIDENTS + _STATES)
_sql("stream_incident_state", "WITH " + _INCIDENTS + _STATES)
_sql(
    "incident_log",
    "WITH "
    + _INCIDENTS
    + """SELECT strftime(ts, '%Y-%m-%d') AS event_day, action, count(*) AS events, count(DISTINCT report_id) AS incidents
FROM log WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""",
)
for _name in ("incident_log_replayed", "stream_incident_log"):
    ORACLE[_name] = ORACLE["incident_log"].replace("WHERE ts >= TIMESTAMP '2024-01-10' ", "")
_sql(
    "event_outcomes",
    "WITH "
    + _INCIDENTS
    + """SELECT l.report_id, l.seq, l.action, CASE WHEN l.action = 'approve' AND l.seq = s.decided_seq THEN 'executed'
  WHEN l.action = 'dismiss' AND l.seq = s.decided_seq THEN 'dismissed' WHEN l.action = 'reenable' AND l.seq = s.reenabled_seq THEN 'reenabled'
  WHEN l.action = 'investigate' THEN 'flagged_for_investigation' WHEN l.action IN ('approve', 'dismiss', 'reenable') THEN 'rejected'
  ELSE 'unknown_action' END AS outcome FROM log l LEFT JOIN states s USING (report_id)""",
)
_sql(
    "merge_checks",
    "WITH "
    + _INCIDENTS
    + ", "
    + _MERGES
    + """SELECT a.report_id, CASE WHEN s.report_id IS NULL THEN 'not_found' WHEN m.report_id IS NULL THEN 'no_pr' WHEN merged THEN 'reenabled'
  ELSE 'pr_open' END AS status, CASE WHEN s.report_id IS NOT NULL THEN pr_number END AS pr_number,
  CASE WHEN s.report_id IS NOT NULL THEN pr_state END AS pr_state, CASE WHEN s.report_id IS NOT NULL THEN pr_url END AS pr_url
FROM (SELECT DISTINCT report_id FROM log) a LEFT JOIN (SELECT report_id FROM states WHERE state = 'quarantined') s USING (report_id)
LEFT JOIN merges m USING (report_id)""",
)
_sql(
    "auto_reenabled",
    "WITH "
    + _INCIDENTS
    + ", "
    + _MERGES
    + """SELECT CASE WHEN state = 'quarantined' AND merged THEN 'reenabled' ELSE state END AS state, count(*) AS incidents
FROM states LEFT JOIN merges USING (report_id) GROUP BY 1""",
)
_sql(
    "quarantined",
    "WITH "
    + _INCIDENTS
    + ", "
    + _MERGES
    + "SELECT report_id, pr_number, pr_url FROM states LEFT JOIN merges USING (report_id) WHERE state = 'quarantined'",
)
_sql(
    "resolution_times",
    "WITH "
    + _INCIDENTS
    + """, closed AS (SELECT report_id, (epoch_us(reenabled_at) - epoch_us(opened_at)) // 1000000 AS elapsed_seconds FROM states WHERE state = 'reenabled')
SELECT report_id, elapsed_seconds, CASE WHEN elapsed_seconds >= 60 THEN (elapsed_seconds // 60) || 'm ' || (elapsed_seconds % 60) || 's'
  ELSE elapsed_seconds || 's' END AS elapsed FROM closed""",
)
_sql(
    "monitor_summary",
    _chain(_EVENTS)
    + ", "
    + _INCIDENTS
    + f"""SELECT (SELECT count(*) FROM {_COVERED}) AS tables_watched, (SELECT count(*) FROM states WHERE state = 'pending') AS active_incidents,
  CAST(0.25 AS DOUBLE) AS psi_threshold, CAST(7 AS INTEGER) AS baseline_age, round(score, 6) AS latest_psi, max_col AS latest_psi_column,
  strftime(sync, '%Y-%m-%d') AS latest_checked_at, {_ANOMALOUS} AS is_anomalous FROM report WHERE nb > 0 ORDER BY sync DESC LIMIT 1""",
)
_sql(
    "activity_feed",
    "SELECT event_id AS seq, event_type AS agent, props AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
)
_SYNC_EVENTS = """(SELECT CASE event_type WHEN 'signup' THEN 'accepted' ELSE 'ignored' END AS status, 'c' || user_id AS connector_id,
  CASE WHEN value > 30 THEN 'app' ELSE 'hubspot' END AS dataset_id, CASE WHEN value > 10 THEN event_type ELSE 'deal_pipeline_stage' END AS table_name
  FROM events)"""
_sql(
    "sync_event_intake",
    f"SELECT dataset_id, table_name, status, count(*) AS events, count(DISTINCT connector_id) AS connectors FROM {_SYNC_EVENTS} GROUP BY 1, 2, 3",
)
_sql(
    "sync_fan_out",
    f"""SELECT connector_id, 'crm' AS dataset_id, r_name AS table_name, count(*) AS checks
FROM {_SYNC_EVENTS} CROSS JOIN region WHERE status = 'accepted' GROUP BY 1, 2, 3""",
)
_CHANGES = """SELECT connector_id, seq, last_seen, succeeded_at FROM (SELECT 'c' || user_id AS connector_id, event_id AS seq,
  strftime(ts, '%Y-%m-%d') AS succeeded_at, lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_seen
  FROM events WHERE value >= 10) WHERE last_seen <> succeeded_at"""
_sql("sync_changes", _CHANGES)
_sql("stream_sync_changes", _CHANGES)
_sql(
    "stream_merged_incidents",
    "WITH "
    + _INCIDENTS
    + ", "
    + _MERGES
    + """SELECT report_id, pr_number, (epoch_us(greatest(merged_at, decided_at)) - epoch_us(opened_at)) // 1000000 AS elapsed_seconds,
  epoch_us(greatest(merged_at, decided_at)) AS closed_us FROM states JOIN merges USING (report_id) WHERE state = 'quarantined' AND merged""",
)
_sql(
    "stream_staleness",
    f"""WITH loads AS (SELECT DISTINCT 'c' || user_id AS table_name, epoch_us(ts) AS us FROM events),
gaps AS (SELECT *, lead(us) OVER (PARTITION BY table_name ORDER BY us) AS following FROM loads),
late AS (SELECT *, us + {R.SILENT_SECONDS * 1_000_000} AS due FROM gaps)
SELECT table_name, 'stale' AS alarm, us AS loaded_us, due AS at_us FROM late
  WHERE coalesce(following > due, due // 1000 < (SELECT max(us) // 1000 FROM loads))
UNION ALL SELECT table_name, 'recovered', us, following FROM late WHERE following > due""",
)
_sql(
    "stream_daily_drift",
    _chain(
        _cells(
            "app", "events", _DAY, "(SELECT * FROM events WHERE event_type IS DISTINCT FROM 'error')",
            [("event_type", "c"), ("props", "c"), ("user_id", "n"), ("value", "n")],
        )
    )
    + f"""SELECT strftime(sync, '%Y-%m-%d') AS sync_day, round(score, 6) AS psi, max_col AS column_name, {_ANOMALOUS} AS is_anomalous
FROM report WHERE nb > 0""",
)
