"""The registered queries as plain SQL, written independently of the operators.

Left out are the queries that SQL cannot express: forests, iterative classifiers and many principal components,
and the end-to-end selection on top of them.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

FLOWS = """flows AS (
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS flow_id,
  concat('10.0.0.', CAST(l_suppkey % 250 AS VARCHAR)) AS src_ip, concat('10.1.0.', CAST(l_partkey % 250 AS VARCHAR)) AS dst_ip,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS sbytes,
  CASE WHEN l_partkey % 19 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity * 100 END AS dbytes,
  l_quantity AS spkts, CAST(l_linenumber AS DOUBLE) AS dpkts, l_tax + 0.0e0 AS dur,
  CAST(l_suppkey % 256 AS INT) AS sttl, CAST(l_partkey % 256 AS INT) AS dttl,
  CAST(l_linenumber AS INT) AS ct_srv_src, CAST(l_suppkey % 7 AS INT) AS ct_state_ttl,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_linestatus END AS state,
  concat('p', CAST(l_partkey % 3 AS VARCHAR)) AS proto, l_returnflag AS attack_type, l_shipdate AS ts FROM lineitem)"""

NUMERIC = ["sbytes", "dbytes", "spkts", "dpkts", "dur", "sttl", "dttl", "ct_srv_src", "ct_state_ttl"]


def _finite(c: str) -> str:
    return f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"


MEDIANS = "med AS (SELECT " + ", ".join(f"median({_finite(c)}) AS {c}" for c in NUMERIC) + " FROM flows)"


def _clean(source: str) -> str:
    filled = ", ".join(f"coalesce({_finite('s.' + c)}, med.{c}, 0) AS {c}" for c in NUMERIC)
    return f"SELECT s.flow_id, {filled}, coalesce(s.state, 'Missing') AS state, s.proto, s.attack_type, s.ts FROM {source} s, med"


CLEANED = f"{FLOWS}, {MEDIANS}, cleaned AS ({_clean('flows')})"

_R = [
    f"CAST((1 + (event_id * {f} + {o}) % 97 + CASE WHEN y = {i} THEN 60 ELSE 0 END) AS DOUBLE) AS r{i}"
    for i, (f, o) in enumerate(zip((23757, 31676, 39595, 47514, 55433), (0, 104729, 209458, 314187, 418916)))
]
SCORES = (
    "c AS (SELECT event_id, ts, user_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
    "WHEN 'signup' THEN 3 ELSE 4 END AS INT) AS y FROM events), r AS (SELECT *, " + ", ".join(_R) + " FROM c), "
    "scores AS (SELECT event_id, ts, user_id, y, [" + ", ".join(f"r{i} / (r0+r1+r2+r3+r4)" for i in range(5)) + "] AS probs FROM r), "
    "predicted AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS predicted FROM scores)"
)


def _round(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0e0"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# Sources and sinks

_DAYS = "['Monday','Tuesday','Wednesday','Thursday-Infiltration','Thursday-Web','Friday-DDoS','Friday-Portscan','Friday-Botnet','Friday','Sunday']"
oracle(
    "label_from_filename",
    f"""WITH p AS (SELECT p_partkey, p_partkey % 10 AS d,
  concat({_DAYS}[CAST(p_partkey % 10 AS INT) + 1], '-', replace(p_type, ' ', '-'), '-no-metadata') AS source_file FROM part),
l AS (SELECT p_partkey, source_file, CASE d WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'Bruteforce' WHEN 2 THEN 'DoS' WHEN 3 THEN 'Infiltration'
  WHEN 4 THEN 'WebAttacks' WHEN 5 THEN 'DDoS' WHEN 6 THEN 'Portscan' WHEN 7 THEN 'Botnet'
  ELSE split_part(replace(source_file, '-no-metadata', ''), '-', -1) END AS attack_type FROM p)
SELECT p_partkey, attack_type, CAST(CASE WHEN attack_type = 'BENIGN' THEN 0 ELSE 1 END AS INT) AS attack_label, source_file FROM l""",
)
oracle(
    "assemble_folder",
    f"""WITH {FLOWS} SELECT flow_id, {_round('spkts')} AS spkts, CASE WHEN attack_type IN ('A', 'R') THEN {_round('sbytes')} END AS sbytes,
CASE WHEN attack_type = 'R' THEN dttl END AS dttl, CASE WHEN attack_type = 'N' THEN {_round('dbytes')} END AS dbytes,
CASE attack_type WHEN 'A' THEN 'BENIGN' WHEN 'N' THEN 'Infiltration' ELSE 'Scan' END AS attack_type,
CAST(CASE attack_type WHEN 'A' THEN 0 ELSE 1 END AS INT) AS attack_label,
CASE attack_type WHEN 'A' THEN 'Monday-WorkingHours' WHEN 'N' THEN 'Thursday-Infiltration-no-metadata' ELSE 'Sunday-Scan-no-metadata' END AS source_file
FROM flows""",
)
oracle(
    "assemble_conflicts",
    f"""WITH {FLOWS} SELECT flow_id, CAST(CASE attack_type WHEN 'N' THEN spkts ELSE sttl END AS DOUBLE) AS x,
CASE attack_type WHEN 'A' THEN CAST(ct_srv_src AS VARCHAR) WHEN 'N' THEN CAST(dttl AS VARCHAR) ELSE proto END AS mark,
CASE attack_type WHEN 'A' THEN 'BENIGN' WHEN 'N' THEN 'DDoS' ELSE 'Scan' END AS attack_type,
CAST(CASE attack_type WHEN 'A' THEN 0 ELSE 1 END AS INT) AS attack_label,
CASE attack_type WHEN 'A' THEN 'Monday' WHEN 'N' THEN 'Friday-DDoS' ELSE 'Sunday-Scan' END AS source_file FROM flows""",
)
oracle(
    "union_by_name",
    """SELECT c_custkey, c_mktsegment, c_acctbal AS balance FROM customer
UNION ALL BY NAME SELECT s_suppkey, s_nationkey AS nation, s_acctbal AS balance FROM supplier""",
)
oracle(
    "dataset_metadata",
    f"""WITH {FLOWS}, n AS (SELECT attack_type, count(*) AS n FROM flows GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_samples, CAST(17 AS BIGINT) AS total_features,
string_agg(attack_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY attack_type) AS class_distribution,
string_agg(attack_type, ',' ORDER BY attack_type) AS attack_types,
(SELECT string_agg(DISTINCT 'capture-' || proto, ',' ORDER BY 'capture-' || proto) FROM flows) AS source_files FROM n""",
)
oracle(
    "linked_metadata",
    f"""WITH {FLOWS}, n AS (SELECT attack_type, count(*) AS n FROM flows GROUP BY 1)
SELECT 'capture-' || dst_ip AS source, count(*) AS n, (SELECT CAST(sum(n) AS BIGINT) FROM n) AS total_samples,
(SELECT count(DISTINCT dst_ip) FROM flows) AS n_source_files,
(SELECT string_agg(attack_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY attack_type) FROM n) AS class_distribution FROM flows GROUP BY dst_ip""",
)
oracle(
    "read_write_roundtrip",
    """SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus AS split, f.format
FROM orders, (SELECT unnest(['parquet', 'csv']) AS format) f""",
)

# Profiles

oracle(
    "class_distribution",
    f"WITH {FLOWS} SELECT attack_type, count(*) AS n, {_round('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share FROM flows GROUP BY attack_type",
)
oracle("topk_classes", "SELECT l_returnflag AS attack_type, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, attack_type LIMIT 2")
oracle("sorted_classes", "SELECT DISTINCT l_returnflag AS attack_type FROM lineitem ORDER BY 1")
oracle("table_shape", "SELECT count(*) AS n_rows, CAST(16 AS BIGINT) AS n_columns FROM lineitem")

_TYPES = {c: "string" for c in ("flow_id", "src_ip", "dst_ip", "state", "proto", "attack_type")}
_TYPES |= {c: "double" for c in ("sbytes", "dbytes", "spkts", "dpkts", "dur")}
_TYPES |= {c: "int" for c in ("sttl", "dttl", "ct_srv_src", "ct_state_ttl")} | {"ts": "timestamp_ntz"}
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM flows" for c, kind in _TYPES.items()
)
oracle("null_profile", f"WITH {FLOWS} {_MISSING}")
oracle(
    "step_profile",
    f"""WITH {FLOWS} SELECT 'clean' AS operation, (SELECT count(*) FROM flows) AS rows_before,
(SELECT count(*) FROM (SELECT DISTINCT spkts, dpkts, dur, attack_type FROM flows)) AS rows_after,
'flow_id,src_ip,dst_ip,sbytes,dbytes,spkts,dpkts,dur,sttl,dttl,ct_srv_src,ct_state_ttl,state,proto,attack_type,ts' AS columns_before,
'spkts,dpkts,dur,attack_type' AS columns_after,
'ct_srv_src,ct_state_ttl,dbytes,dst_ip,dttl,flow_id,proto,sbytes,src_ip,state,sttl,ts' AS removed_columns""",
)
oracle(
    "schema_diff",
    f"""WITH {FLOWS}, n AS (SELECT count(*) AS n, count(*) - count(sbytes) AS sbytes, count(*) - count(state) AS state FROM flows)
SELECT 'flow_id' AS "column", 'string' AS left_type, n AS left_rows, 0 AS left_missing, 'string' AS right_type, n AS right_rows, 0 AS right_missing, 'same' AS status FROM n
UNION ALL SELECT 'sbytes', 'double', n, sbytes, NULL, NULL, NULL, 'only_left' FROM n
UNION ALL SELECT 'dbytes', NULL, NULL, NULL, 'double', n, 0, 'only_right' FROM n
UNION ALL SELECT 'sttl', 'int', n, 0, 'bigint', n, 0, 'type_changed' FROM n
UNION ALL SELECT 'state', 'string', n, state, 'string', n, state, 'same' FROM n""",
)
_ROLES = " UNION ALL ".join(
    "SELECT '{0}' AS \"column\", '{1}' AS role, count({0}) AS n_values FROM flows".format(
        c,
        "identifier" if c in ("flow_id", "src_ip", "dst_ip") else "label" if c == "attack_type" else "categorical" if kind == "string" else "other" if c == "ts" else "numeric",
    )
    for c, kind in _TYPES.items()
)
oracle("select_roles", f"WITH {FLOWS} {_ROLES}")

# Cleaning

oracle(
    "clean_impute",
    f"WITH {CLEANED} SELECT flow_id, {', '.join(NUMERIC)}, state, proto, attack_type FROM cleaned",
)
oracle(
    "exact_medians",
    f"WITH {FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_round(f'quantile_cont({_finite(c)}, 0.5)')} AS median FROM flows" for c in NUMERIC),
)
oracle("dedup_flows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
oracle(
    "dedup_keyed",
    "SELECT min(o_orderkey) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority, o_orderdate",
)
oracle(
    "dedup_conflicts",
    """SELECT min(l_returnflag) AS l_returnflag, l_suppkey, l_quantity, l_linenumber FROM lineitem
GROUP BY l_suppkey, l_quantity, l_linenumber HAVING count(DISTINCT l_returnflag) = 1""",
)

# Features

FEATURES = {
    "bytes_ratio": "sbytes / (dbytes + 1)",
    "total_bytes": "sbytes + dbytes",
    "packets_ratio": "spkts / (dpkts + 1)",
    "total_packets": "spkts + dpkts",
    "avg_bytes_per_packet": "(sbytes + dbytes) / (spkts + dpkts + 1)",
    "src_bytes_per_second": "sbytes / (dur + 0.001e0)",
    "dst_bytes_per_second": "dbytes / (dur + 0.001e0)",
    "packets_per_second": "spkts / (dur + 0.001e0)",
    "service_state_interaction": "ct_srv_src * ct_state_ttl",
    "ttl_difference": "abs(sttl - dttl)",
}


def _feature_query(names: list[str]) -> str:
    return f"WITH {CLEANED} SELECT flow_id, {', '.join(f'{FEATURES[c]} AS {c}' for c in names)} FROM cleaned"


oracle("features_ratio", _feature_query(list(FEATURES)[:5]))
oracle("features_rate", _feature_query(list(FEATURES)[5:8]))
oracle("features_interaction", _feature_query(list(FEATURES)[8:]))
oracle("features_cic", f"WITH {FLOWS} SELECT flow_id, spkts / (dur + 1) AS fwd_packets_per_second FROM flows")

# Encoders

oracle(
    "align_schema",
    f"""WITH {FLOWS} SELECT flow_id, spkts, CAST(0 AS INT) AS sttl, coalesce(state, 'Missing') AS state, 'Missing' AS service, proto,
CAST(0 AS DOUBLE) AS rate FROM flows""",
)


def _hot(column: str, values: list[str], prefix: str) -> str:
    return ", ".join(f"CAST(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS {prefix}_{v}" for v in values)


oracle(
    "onehot_wide",
    f"""WITH {FLOWS} SELECT flow_id, spkts, {_hot('proto', ['p0', 'p1', 'p2'], 'proto')},
{_hot("coalesce(state, 'Missing')", ['F', 'Missing', 'O'], 'state')} FROM flows""",
)
oracle(
    "onehot_vector",
    f"""WITH {FLOWS}, t AS (SELECT flow_id, proto, coalesce(state, 'Missing') AS state FROM flows)
SELECT flow_id, {', '.join(f"CAST(proto = 'p{i}' AS DOUBLE) AS h{i}" for i in range(3))},
{', '.join(f"CAST(state = '{v}' AS DOUBLE) AS h{i}" for i, v in ((3, 'F'), (4, 'Missing'), (5, 'O')))} FROM t""",
)
oracle(
    "onehot_model_wide",
    f"""WITH {FLOWS}, r AS (SELECT row_number() OVER () AS id, flow_id, attack_type, spkts, proto, dst_ip AS host FROM flows),
d AS (SELECT DISTINCT attack_type AS c, spkts, proto, host FROM r), m AS (SELECT min(spkts) AS lo, max(spkts) - min(spkts) AS span FROM d),
z AS (SELECT 1 + count(DISTINCT proto) + count(DISTINCT host) AS v FROM d),
s AS (SELECT c, count(*) AS n, sum((spkts - lo) / span) AS x FROM d, m GROUP BY c),
k AS (SELECT c, ln(n + 1) AS pi, ln(x + 1) AS tx, ln(x + 2 * n + v) AS total FROM s, z),
p AS (SELECT c, proto, ln(count(*) + 1) AS t FROM d GROUP BY c, proto), h AS (SELECT c, host, ln(count(*) + 1) AS t FROM d GROUP BY c, host),
w AS (SELECT id, flow_id, k.c, pi + (spkts - lo) / span * (tx - total) + coalesce(p.t, 0) + coalesce(h.t, 0) - 2 * total AS w
  FROM r CROSS JOIN m CROSS JOIN k LEFT JOIN p ON p.c = k.c AND p.proto = r.proto LEFT JOIN h ON h.c = k.c AND h.host = r.host)
SELECT flow_id, {_round("1 - sum(CASE WHEN c = 'N' THEN exp(w) ELSE 0 END) / sum(exp(w))", 5)} AS score FROM w GROUP BY id, flow_id""",
)
oracle(
    "onehot_unknown",
    f"""WITH {FLOWS}, t AS (SELECT flow_id, attack_type, CASE WHEN attack_type = 'N' THEN proto || 'n' ELSE proto END AS proto FROM flows)
SELECT flow_id, attack_type, {_hot('proto', ['p0', 'p1', 'p2'], 'proto')} FROM t""",
)
_PRIORITY = "idx AS (SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS y FROM (SELECT DISTINCT o_orderpriority FROM orders))"
oracle("label_index", f"WITH {_PRIORITY} SELECT o_orderkey, o_orderpriority, y FROM orders JOIN idx USING (o_orderpriority)")
oracle(
    "label_names",
    f"""WITH {SCORES}, idx AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events))
SELECT event_id, event_type AS predicted_class FROM predicted LEFT JOIN idx ON predicted = i""",
)
oracle(
    "unseen_labels",
    """SELECT DISTINCT o_orderstatus || '/' || o_orderpriority AS class FROM orders
EXCEPT SELECT o_orderstatus || '/' || o_orderpriority FROM orders WHERE o_orderstatus = 'F'""",
)
oracle(
    "label_onehot",
    f"WITH {_PRIORITY} SELECT o_orderkey, {', '.join(f'CAST(y = {i} AS DOUBLE) AS y{i}' for i in range(5))} FROM orders JOIN idx USING (o_orderpriority)",
)
oracle(
    "one_vs_rest",
    f"WITH {SCORES} SELECT event_id, CAST(i AS INT) AS class_index, CAST(y = i AS INT) AS is_class FROM scores, range(5) t(i)",
)

# Scalers


def _scale_query(fit: str, apply: str, digits: int | None = None) -> str:
    columns = ["sbytes", "dbytes", "spkts", "dur", "sttl"]
    fitted = ", ".join(fit.format(c=c) for c in columns)
    applied = ", ".join(f"{_round(apply.format(c=c), digits) if digits else apply.format(c=c)} AS {c}" for c in columns)
    return f"WITH {CLEANED}, fit AS (SELECT {fitted} FROM cleaned) SELECT flow_id, {applied} FROM cleaned, fit"


oracle("scale_minmax", _scale_query("min({c}) AS {c}_a, max({c}) - min({c}) AS {c}_b", "({c} - {c}_a) / {c}_b"))
oracle("scale_standard", _scale_query("avg({c}) AS {c}_a, stddev_pop({c}) AS {c}_b", "({c} - {c}_a) / {c}_b", 6))
oracle(
    "scale_robust",
    _scale_query("median({c}) AS {c}_a, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_b", "({c} - {c}_a) / {c}_b"),
)

# Ranking

RANKED = ["sbytes", "dbytes", "spkts", "dpkts", "dur", "sttl"]


def _anova(label: str) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {label} AS class, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM cleaned GROUP BY {label}" for c in RANKED
    )
    return f"""g AS ({cells}), gm AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS gm FROM g),
anova AS (SELECT feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score FROM gm GROUP BY feature)"""


def _psi(x: str) -> str:
    """Digamma by ten recurrence steps and the asymptotic series."""
    x = f"CAST({x} AS DOUBLE)"
    y = f"({x} + 10)"
    back = " + ".join(f"1 / ({x} + {i})" for i in range(10))
    return f"(ln({y}) - 0.5e0 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) - ({back}))"


def _mutual_info(label: str) -> str:
    """Three nearest rows of the class by sorted position; ball counts by as-of joins on running counts."""
    cells = " UNION ALL ".join(f"SELECT {i} AS f, {label} AS c, CAST({c} AS DOUBLE) AS v FROM cleaned" for i, c in enumerate(RANKED))
    lags = ", ".join(f"lag(v, {j}) OVER w AS b{j}, lead(v, {j}) OVER w AS a{j}" for j in (1, 2, 3))
    inf = "CAST('Infinity' AS DOUBLE)"
    left = ["0"] + [f"coalesce(v - b{j}, {inf})" for j in (1, 2, 3)]
    right = ["0"] + [f"coalesce(a{j} - v, {inf})" for j in (1, 2, 3)]
    radius = "least(" + ", ".join(f"greatest({left[j]}, {right[3 - j]})" for j in range(4)) + ")"
    low = "coalesce(" + ", ".join(f"CASE WHEN {left[j]} = r THEN b{j} END" for j in (1, 2, 3)) + ", v - r)"
    high = "coalesce(" + ", ".join(f"CASE WHEN {right[j]} = r THEN a{j} END" for j in (1, 2, 3)) + ", v + r)"
    closer = " + ".join(f"CASE WHEN {side[j]} < r THEN 1 ELSE 0 END" for side in (left, right) for j in (1, 2, 3))
    return f"""cells AS ({cells}), ranked AS (SELECT f, c, v, row_number() OVER (PARTITION BY f, c, v) AS copy,
count(*) OVER (PARTITION BY f, c, v) AS n, count(*) OVER (PARTITION BY f, c) AS nc, count(*) OVER (PARTITION BY f) AS nf FROM cells),
near AS (SELECT *, {lags} FROM ranked WINDOW w AS (PARTITION BY f, c ORDER BY v, copy)),
rad AS (SELECT *, {radius} AS r FROM near WHERE copy = 1),
ball AS (SELECT f, c, v, n, nc, nf, r, CASE WHEN r = 0 THEN n ELSE 1 + {closer} END AS k, {low} AS lo, {high} AS hi FROM rad),
cum AS (SELECT f, v, sum(count(*)) OVER (PARTITION BY f ORDER BY v) AS upto, count(*) AS here FROM cells GROUP BY f, v),
up AS (SELECT ball.*, cum.upto AS below_hi FROM ball ASOF LEFT JOIN cum ON ball.f = cum.f AND ball.hi > cum.v),
down AS (SELECT up.*, cum.upto AS upto_lo FROM up ASOF LEFT JOIN cum ON up.f = cum.f AND up.lo >= cum.v),
balls AS (SELECT down.*, CASE WHEN r = 0 THEN cum.here ELSE coalesce(below_hi, 0) - coalesce(upto_lo, 0) END AS m
  FROM down JOIN cum ON down.f = cum.f AND down.v = cum.v),
mi AS (SELECT {RANKED!r}[f + 1] AS feature, greatest(0, max({_psi('nf')}) + sum(n * ({_psi('k')} - {_psi('nc')} - {_psi('m')})) / max(nf)) AS mi_score
  FROM balls GROUP BY f)"""


oracle("anova_f", f"WITH {CLEANED}, {_anova('attack_type')} SELECT feature, {_round('f_score')} AS f_score FROM anova")
oracle("mutual_info", f"WITH {CLEANED}, {_mutual_info('state')} SELECT feature, {_round('mi_score')} AS mi_score FROM mi")
_NORM = "coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)"
oracle(
    "rank_consensus",
    f"""WITH {CLEANED}, {_anova('attack_type')}, {_mutual_info('attack_type')},
norms AS (SELECT feature, {_NORM.format(c='f_score')} AS f_score_norm, {_NORM.format(c='mi_score')} AS mi_score_norm FROM anova JOIN mi USING (feature))
SELECT feature, {_round('f_score_norm', 5)} AS f_score_norm, {_round('mi_score_norm', 5)} AS mi_score_norm,
{_round('(f_score_norm + mi_score_norm) / 2', 5)} AS consensus FROM norms""",
)
_PICK = " ".join(f"WHEN '{c}' THEN {c}" for c in RANKED)
oracle(
    "select_topk",
    f"""WITH {CLEANED}, {_anova('attack_type')},
best AS (SELECT max(feature) FILTER (place = 1) AS a, max(feature) FILTER (place = 2) AS b, max(feature) FILTER (place = 3) AS c
  FROM (SELECT feature, row_number() OVER (ORDER BY f_score DESC, feature) AS place FROM anova))
SELECT flow_id, CASE a {_PICK} END AS feature_1, CASE b {_PICK} END AS feature_2, CASE c {_PICK} END AS feature_3 FROM cleaned, best""",
)

# Splits and weights


def _quota(name: str, source: str, drawn: str) -> str:
    """Largest-remainder quota ``q`` per class of ``source(c, n)`` for ``drawn`` rows of ``total``."""
    return f"""{name}_x AS (SELECT c, n, n * {drawn} / total AS x, {drawn} AS drawn FROM (SELECT *, CAST(sum(n) OVER () AS DOUBLE) AS total FROM {source})),
{name} AS (SELECT c, n, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, c) <= drawn - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS q FROM {name}_x)"""


def _split_cte(rows: str) -> str:
    return f"""o AS ({rows}), ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42'))) AS place FROM o),
counts AS (SELECT c, count(*) AS n FROM o GROUP BY c)"""


_ORDERS = _split_cte("SELECT o_orderkey, o_orderpriority AS c FROM orders")
_THREE = f"""{_ORDERS}, {_quota('test', 'counts', 'ceil(total * 0.2e0)')}, rest AS (SELECT c, n - q AS n FROM test),
{_quota('val', 'rest', 'ceil(total * (0.1e0 / (1 - 0.2e0)))')},
parts AS (SELECT o_orderkey, ranked.c AS o_orderpriority, CASE WHEN place <= test.q THEN 'test' WHEN place <= test.q + val.q THEN 'val' ELSE 'train' END AS split
  FROM ranked JOIN test ON ranked.c = test.c JOIN val ON ranked.c = val.c)"""
oracle(
    "split_two_way",
    f"""WITH {_ORDERS}, {_quota('test', 'counts', 'ceil(total * 0.2e0)')}
SELECT o_orderkey, ranked.c AS o_orderpriority, CASE WHEN place <= q THEN 'test' ELSE 'train' END AS split FROM ranked JOIN test ON ranked.c = test.c""",
)
oracle("split_three_way", f"WITH {_THREE} SELECT * FROM parts")
oracle(
    "split_metadata",
    f"""WITH {_THREE}, n AS (SELECT split, o_orderpriority AS c, count(*) AS n FROM parts GROUP BY 1, 2)
SELECT split, CAST(sum(n) AS BIGINT) AS num_samples, string_agg(c || '=' || CAST(n AS VARCHAR), ',' ORDER BY c) AS class_counts,
CAST(1 AS DOUBLE) AS share_total, 0.1e0 AS val_size FROM n GROUP BY split""",
)
_HOLDOUT = f"""{_split_cte("SELECT o_orderkey, CAST(CASE WHEN o_orderpriority < '2' THEN 1 ELSE 0 END AS INT) AS c FROM orders")},
{_quota('val', 'counts', 'ceil(total * 0.15e0)')},
parts AS (SELECT o_orderkey, ranked.c AS label, CASE WHEN place <= q THEN 'validation' ELSE 'train' END AS split FROM ranked JOIN val ON ranked.c = val.c
  UNION ALL SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INT), 'test' FROM customer)"""
oracle("split_holdout", f"WITH {_HOLDOUT} SELECT * FROM parts")
oracle(
    "split_distribution",
    f"""WITH {_HOLDOUT}, a AS (SELECT split, label FROM parts UNION ALL SELECT 'original', label FROM parts WHERE split <> 'test')
SELECT split, label, count(*) AS n, {_round('100.0e0 * count(*) / sum(count(*)) OVER (PARTITION BY split)')} AS percent FROM a GROUP BY split, label""",
)
_WEIGHTS = "w AS (SELECT o_orderstatus, sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE) AS weight FROM orders GROUP BY o_orderstatus)"
oracle("class_weights", f"WITH {_WEIGHTS} SELECT o_orderstatus, {_round('weight')} AS weight FROM w")
oracle("sample_weights", f"WITH {_WEIGHTS} SELECT o_orderkey, o_orderstatus, {_round('weight')} AS weight FROM orders JOIN w USING (o_orderstatus)")

# Model input, scoring

_CENTS = "CAST(round(value * 100) AS BIGINT)"
oracle(
    "sequence_windows",
    f"""WITH {SCORES}, e AS (SELECT event_id, scores.user_id, scores.ts, concat_ws(':', CAST({_CENTS} AS VARCHAR), CAST(y AS VARCHAR)) AS step
  FROM scores JOIN events USING (event_id)),
s AS (SELECT event_id, list(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS steps FROM e)
SELECT event_id, array_to_string(steps, ',') AS sequence FROM s WHERE len(steps) = 4""",
)
oracle(
    "stream_sequences",
    f"""WITH e AS (SELECT *, concat_ws(':', CAST({_CENTS} AS VARCHAR), CASE WHEN event_type = 'error' THEN '1' ELSE '0' END) AS step FROM events),
s AS (SELECT event_id, list(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS steps FROM e)
SELECT event_id, array_to_string(steps, ',') AS sequence FROM s WHERE len(steps) = 4""",
)
oracle(
    "sequence_windows_padded",
    f"""WITH e AS (SELECT *, concat_ws(':', CAST({_CENTS} AS VARCHAR), CASE WHEN event_type = 'error' THEN '1' ELSE '0' END) AS step FROM events),
s AS (SELECT event_id, coalesce(lag(step, 2) OVER w, '0:0') AS a, coalesce(lag(step, 1) OVER w, '0:0') AS b, step FROM e
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, concat_ws(',', a, b, step) AS sequence FROM s""",
)
oracle(
    "batch_scores",
    """SELECT event_id, CAST(CASE WHEN value > 1 THEN 1 ELSE 0 END AS INT) AS predicted, 1 / (1 + value) AS p0, value / (1 + value) AS p1 FROM events""",
)
_ALERTS = """s AS (SELECT event_id, ts, concat('10.0.0.', CAST(user_id % 250 AS VARCHAR)) AS src_ip, concat('10.1.0.', CAST(event_id % 250 AS VARCHAR)) AS dst_ip,
  (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS score FROM events),
hits AS (SELECT *, 'WARNING' AS level, printf('ALERT: Malicious traffic detected from %s to %s (score: %.2f)', src_ip, dst_ip, score) AS message FROM s WHERE score > 0.9e0)"""
oracle("alerts", f"WITH {_ALERTS} SELECT level, message, ts AS event_time, event_id, src_ip FROM hits")

# Evaluation

oracle(
    "confusion",
    f"""WITH {SCORES}, grid AS (SELECT CAST(a.i AS INT) AS t, CAST(b.i AS INT) AS p FROM range(6) a(i), range(6) b(i))
SELECT t AS true_class, p AS predicted_class, count(event_id) AS n FROM grid LEFT JOIN predicted ON y = t AND predicted = p GROUP BY t, p""",
)
oracle(
    "confusion_pct",
    f"""WITH {SCORES}, k AS (SELECT y AS c FROM predicted UNION SELECT predicted FROM predicted),
n AS (SELECT a.c AS t, b.c AS p, count(event_id) AS n FROM k a CROSS JOIN k b LEFT JOIN predicted ON y = a.c AND predicted = b.c GROUP BY 1, 2)
SELECT t AS true_class, p AS predicted_class, {_round('100.0e0 * n / nullif(sum(n) OVER (PARTITION BY t), 0)')} AS percent FROM n""",
)
_REPORT = """k AS (SELECT y AS c FROM predicted UNION SELECT predicted FROM predicted),
n AS (SELECT c, count(*) FILTER (y = c AND predicted = c) AS tp, count(*) FILTER (y <> c AND predicted = c) AS fp,
  count(*) FILTER (y = c AND predicted <> c) AS fn FROM k, predicted GROUP BY c),
rep AS (SELECT c AS class, tp, fp, fn, tp + fn AS support, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
  coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1 FROM n)"""
oracle(
    "classification_report",
    f"""WITH {SCORES}, {_REPORT} SELECT class, tp, fp, fn, support, {_round('precision')} AS precision, {_round('recall')} AS recall, {_round('f1')} AS f1 FROM rep""",
)
oracle(
    "accuracy_macro_f1",
    f"""WITH {SCORES}, {_REPORT} SELECT {_round('(SELECT avg(CAST(y = predicted AS INT)) FROM predicted)')} AS accuracy,
{_round('avg(precision)')} AS macro_precision, {_round('avg(recall)')} AS macro_recall, {_round('avg(f1)')} AS macro_f1 FROM rep""",
)
_CELLS = "cells AS (SELECT event_id, y, CAST(i AS INT) AS class, probs[i + 1] AS p FROM scores, range(5) t(i))"
_MICRO = "micro AS (SELECT count(*) FILTER (p > 0.5 AND class = y) AS tp, count(*) FILTER (p > 0.5 AND class <> y) AS fp, count(*) FILTER (p <= 0.5 AND class = y) AS fn FROM cells)"
oracle(
    "threshold_metrics",
    f"WITH {SCORES}, {_CELLS}, {_MICRO} SELECT tp, fp, fn, {_round('tp / CAST(tp + fp AS DOUBLE)')} AS precision, {_round('tp / CAST(tp + fn AS DOUBLE)')} AS recall FROM micro",
)
_TOP3 = "avg(CAST(len(list_filter(probs, lambda p: p > probs[y + 1])) < 3 AS INT))"
_CE = "avg(-ln(greatest(least(probs[y + 1], 1 - 1e-7), 1e-7)))"
_MSE = "(SELECT avg(d) FROM (SELECT (p - floor(p * 10) / 10) * (p - floor(p * 10) / 10) AS d FROM cells))"
oracle("topk_accuracy", f"WITH {SCORES} SELECT {_round(_TOP3)} AS top3_accuracy FROM scores")
oracle(
    "joint_loss",
    f"""WITH {SCORES}, {_CELLS} SELECT {_round(_CE)} AS cross_entropy, {_round(_MSE)} AS mse, {_round(f'{_CE} + 0.3e0 * {_MSE}')} AS joint_loss FROM scores""",
)
oracle(
    "evaluation_summary",
    f"""WITH {SCORES}, {_CELLS}, {_MICRO}, {_REPORT} SELECT count(*) AS n_rows, {_round('avg(CAST(y = predicted AS INT))')} AS accuracy,
{_round('(SELECT tp / CAST(tp + fp AS DOUBLE) FROM micro)')} AS precision, {_round('(SELECT tp / CAST(tp + fn AS DOUBLE) FROM micro)')} AS recall,
{_round('(SELECT avg(f1) FROM rep)')} AS macro_f1, (SELECT fp FROM micro) AS false_positives, (SELECT fn FROM micro) AS false_negatives,
{_round(_TOP3)} AS top3_accuracy, {_round(_CE)} AS cross_entropy, {_round(_MSE)} AS mse, {_round(f'{_CE} + 0.3e0 * {_MSE}')} AS loss FROM predicted""",
)
_ROC = """g AS (SELECT class, p AS score, count(*) FILTER (class = y) AS pos, count(*) FILTER (class <> y) AS neg FROM cells GROUP BY class, p),
roc AS (SELECT class, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn
  FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
pts AS (SELECT class, score, CAST(tp AS DOUBLE) / np AS tpr, CAST(fp AS DOUBLE) / nn AS fpr, np FROM roc
  UNION ALL SELECT DISTINCT class, NULL, 0.0e0, 0.0e0, np FROM roc),
steps AS (SELECT class, np, tpr, fpr, lag(tpr) OVER w AS tpr0, lag(fpr) OVER w AS fpr0 FROM pts WINDOW w AS (PARTITION BY class ORDER BY score DESC NULLS FIRST)),
areas AS (SELECT class, max(np) AS np, sum((fpr - fpr0) * (tpr + tpr0) / 2) AS auc FROM steps GROUP BY class)"""
oracle(
    "roc_points",
    f"WITH {SCORES}, {_CELLS}, {_ROC} SELECT class, {_round('score')} AS threshold, {_round('fpr')} AS fpr, {_round('tpr')} AS tpr FROM pts",
)
oracle(
    "roc_points_pruned",
    f"""WITH {SCORES}, {_CELLS}, {_ROC},
seq AS (SELECT g.class, g.score, pos, neg, row_number() OVER w AS place, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
  FROM g WINDOW w AS (PARTITION BY g.class ORDER BY g.score DESC)),
kept AS (SELECT class, score FROM seq WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg)
SELECT pts.class, {_round('pts.score')} AS threshold, {_round('fpr')} AS fpr, {_round('tpr')} AS tpr
FROM pts LEFT JOIN kept ON pts.class = kept.class AND pts.score = kept.score WHERE pts.score IS NULL OR kept.class IS NOT NULL""",
)
oracle("auc_ovr", f"WITH {SCORES}, {_CELLS}, {_ROC} SELECT class, CAST(np AS BIGINT) AS n_pos, {_round('auc')} AS auc FROM areas")
oracle(
    "auc_summary",
    f"WITH {SCORES}, {_CELLS}, {_ROC} SELECT {_round('avg(auc)')} AS auc_macro, {_round('sum(np * auc) / sum(np)')} AS auc_weighted FROM areas",
)
oracle(
    "binned_auc",
    f"""WITH {SCORES}, {_CELLS}, cuts AS (SELECT i, CASE i WHEN 0 THEN -1e-7 WHEN 199 THEN 1 + 1e-7 ELSE i / 199.0e0 END AS cut FROM range(200) t(i)),
tot AS (SELECT class, count(*) FILTER (class = y) AS np, count(*) FILTER (class <> y) AS nn FROM cells GROUP BY class),
vals AS (SELECT class, p, count(*) FILTER (class = y) AS pos, count(*) FILTER (class <> y) AS neg FROM cells GROUP BY class, p),
rates AS (SELECT tot.class, i, coalesce(sum(pos), 0) / CAST(max(np) AS DOUBLE) AS tpr, coalesce(sum(neg), 0) / CAST(max(nn) AS DOUBLE) AS fpr
  FROM tot CROSS JOIN cuts LEFT JOIN vals ON vals.class = tot.class AND vals.p > cut GROUP BY tot.class, i),
st AS (SELECT class, tpr, fpr, lead(tpr) OVER w AS tpr1, lead(fpr) OVER w AS fpr1 FROM rates WINDOW w AS (PARTITION BY class ORDER BY i))
SELECT class, {_round('sum((tpr + tpr1) / 2 * (fpr - fpr1))')} AS binned_auc FROM st WHERE tpr1 IS NOT NULL GROUP BY class""",
)
oracle(
    "feature_histogram",
    f"""WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 40 AS width FROM events),
h AS (SELECT event_type AS label, CAST(least(floor((value - lo) / width), 39) AS INT) AS bin, count(*) AS n, max(lo) AS lo, max(width) AS width FROM events, b GROUP BY 1, 2)
SELECT label, bin, {_round('lo + bin * width')} AS bin_start, n, {_round('n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE)')} AS share,
{_round('n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE) / width')} AS density FROM h""",
)
oracle(
    "feature_density",
    f"""WITH v AS (SELECT l_returnflag AS label, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_returnflag AS label, count(*) AS total, stddev_samp(l_quantity) * pow(count(*), -0.2e0) AS h, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
g AS (SELECT label, total, h, CAST(i AS INT) AS point, (lo - 3 * h) + i * (((hi + 3 * h) - (lo - 3 * h)) / 199) AS position FROM s, range(200) t(i))
SELECT g.label, point, {_round('max(position)')} AS position, {_round('sum(n * exp(-0.5e0 * pow((position - x) / h, 2)) / (total * h * sqrt(2 * pi())))')} AS density
FROM g JOIN v ON g.label = v.label GROUP BY g.label, point""",
)
oracle(
    "feature_density_outlier",
    f"""WITH l AS (SELECT l_returnflag AS label, CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 1e6 ELSE CAST(l_extendedprice AS DOUBLE) / 1000 END AS price FROM lineitem),
v AS (SELECT label, price AS x, count(*) AS n FROM l GROUP BY 1, 2),
s AS (SELECT label, count(*) AS total, stddev_samp(price) * pow(count(*), -0.2e0) AS h, min(price) AS lo, max(price) AS hi FROM l GROUP BY 1),
g AS (SELECT label, total, h, CAST(i AS INT) AS point, (lo - 3 * h) + i * (((hi + 3 * h) - (lo - 3 * h)) / 199) AS position FROM s, range(200) t(i))
SELECT g.label, point, {_round('max(position)')} AS position, {_round('sum(n * exp(-0.5e0 * pow((position - x) / h, 2)) / (total * h * sqrt(2 * pi())))')} AS density
FROM g JOIN v ON g.label = v.label GROUP BY g.label, point""",
)
_HOURS = "by_hour AS (SELECT date_trunc('hour', ts) AS hour, avg(CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0.0e0 END) AS ratio, count(*) AS n FROM events GROUP BY 1)"
oracle(
    "attack_timeline",
    f"""WITH {_HOURS}, grid AS (SELECT unnest(generate_series((SELECT min(hour) FROM by_hour), (SELECT max(hour) FROM by_hour), INTERVAL 1 HOUR)) AS hour)
SELECT hour, {_round('ratio')} AS attack_ratio, coalesce(n, 0) AS n FROM grid LEFT JOIN by_hour USING (hour)""",
)

# Scalar functions

oracle(
    "scalar_strings",
    """SELECT p_partkey, p_type AS stem, replace(p_brand, 'Brand#', '') AS tail, contains(p_type, 'STEEL') AS has_token FROM part""",
)
oracle(
    "scalar_math",
    f"""WITH {SCORES} SELECT event_id, date_trunc('hour', ts) AS hour, predicted, {_round('abs(probs[1] - probs[2])')} AS difference,
{_round('CASE WHEN y = 0 THEN 0 ELSE probs[1] / y END')} AS safe_ratio, CAST(nullif(y, 0) AS DOUBLE) AS no_nan FROM predicted""",
)
oracle(
    "scalar_json",
    """SELECT 'INFO' AS level, 'event ' || event_type AS message, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)

# Streaming: the emitted rows equal the batch result over the windows that the watermark has closed

oracle("stream_alerts", f"WITH {_ALERTS} SELECT level, message, ts AS event_time FROM hits")
oracle(
    "stream_dead_letter",
    """WITH e AS (SELECT event_id, event_type = 'error' AND event_id % 2 = 1 AS broken FROM events)
SELECT 'good' AS message, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM e WHERE NOT broken
UNION ALL SELECT 'Packet processing failed: malformed record', count(*), NULL FROM e WHERE broken""",
)
_CLOSED = "(SELECT max(ts) FROM {source}) - INTERVAL 1 HOUR"
oracle(
    "stream_timeline",
    f"""WITH {_HOURS} SELECT hour, {_round('ratio')} AS attack_ratio, n FROM by_hour
WHERE hour + INTERVAL 1 HOUR <= {_CLOSED.format(source='events')}""",
)
oracle("stream_dedup", "SELECT event_id, event_type, value FROM events")
oracle(
    "stream_alert_rate",
    f"""WITH h AS (SELECT ts, concat('10.0.0.', CAST(user_id % 250 AS VARCHAR)) AS src_ip FROM events WHERE value > 50)
SELECT date_trunc('day', ts) AS window_start, src_ip, count(*) AS n_alerts FROM h
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED.format(source='h')} GROUP BY 1, 2""",
)

# The fitted flow model

_PROTO, _STATE = _hot("proto", ["p0", "p1", "p2"], "proto"), _hot("state", ["F", "Missing", "O"], "state")
_MODEL_COLUMNS = [*NUMERIC, *FEATURES, *[f"proto_p{i}" for i in range(3)], "state_F", "state_Missing", "state_O"]
_DERIVED = ", ".join(f"{e} AS {c}" for c, e in FEATURES.items())


def _model_table(source: str) -> str:
    return f"SELECT flow_id, attack_type, {', '.join(NUMERIC)}, {_DERIVED}, {_PROTO}, {_STATE} FROM ({_clean(source)})"


_MODEL = f"""{FLOWS}, {MEDIANS}, uniq AS (SELECT min(flow_id) AS flow_id, {', '.join(NUMERIC)}, state, proto, attack_type, ts FROM flows
  GROUP BY {', '.join(NUMERIC)}, state, proto, attack_type, ts),
fit AS (SELECT {', '.join(f'min({c}) AS {c}_a, max({c}) - min({c}) AS {c}_b' for c in _MODEL_COLUMNS)} FROM ({_model_table('uniq')})),
scaled AS (SELECT flow_id, attack_type, {', '.join(f'({c} - {c}_a) / CASE WHEN {c}_b = 0 THEN 1 ELSE {c}_b END AS {c}' for c in _MODEL_COLUMNS)}
  FROM ({_model_table('flows')}), fit)"""
oracle(
    "flow_model_scaled_means",
    f"WITH {_MODEL} "
    + " UNION ALL ".join(f"SELECT attack_type, '{c}' AS feature, {_round(f'avg({c})')} AS mean FROM scaled GROUP BY attack_type" for c in _MODEL_COLUMNS),
)
oracle(
    "flow_model_save_load",
    f"""WITH {_MODEL} SELECT m.model, count(*) AS n, {', '.join(f'{_round(f"avg({c})")} AS {c}' for c in ('bytes_ratio', 'ttl_difference', 'proto_p1'))}
FROM scaled, (SELECT unnest(['fitted', 'reloaded']) AS model) m GROUP BY m.model""",
)

# The same results by the paths that large tables take

for _ranged, _plain in {
    "roc_points_ranged": "roc_points",
    "auc_ovr_ranged": "auc_ovr",
    "mutual_info_ranged": "mutual_info",
    "sequence_windows_hot": "sequence_windows_padded",
}.items():
    oracle(_ranged, ORACLES[_plain])
oracle(
    "feature_histogram_gaps",
    f"""WITH {FLOWS}, f AS (SELECT attack_type, dbytes FROM flows WHERE isfinite(dbytes)),
b AS (SELECT min(dbytes) AS lo, (max(dbytes) - min(dbytes)) / 20 AS width FROM f),
h AS (SELECT attack_type AS label, CAST(least(floor((dbytes - lo) / width), 19) AS INT) AS bin, count(*) AS n, max(lo) AS lo, max(width) AS width FROM f, b GROUP BY 1, 2)
SELECT label, bin, {_round('lo + bin * width')} AS bin_start, n, {_round('n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE)')} AS share,
{_round('n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE) / width')} AS density FROM h""",
)

# Models with a closed form

oracle("reconstruction_full", "SELECT vec_id, CAST(0 AS DOUBLE) AS rebuilt_error, CAST(0 AS DOUBLE) AS reconstruction_error FROM embeddings")
oracle(
    "reconstruction_pair",
    f"""WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
v AS (SELECT count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM p)
SELECT n, {_round('((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c)) / 2', 5)} AS mean_error FROM v""",
)
_COUNTS = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, CAST(l_linenumber AS DOUBLE) AS b,
CAST(l_partkey % 7 AS DOUBLE) AS c, CASE WHEN l_linestatus = 'O' THEN 1.0e0 ELSE 0.0e0 END AS y FROM lineitem)"""
oracle(
    "bayes_scores",
    f"""WITH {_COUNTS}, s AS (SELECT y, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM r GROUP BY y),
t AS (SELECT y, ln(n + 1) AS pi, ln((a + 1) / (a + b + c + 3)) AS ta, ln((b + 1) / (a + b + c + 3)) AS tb, ln((c + 1) / (a + b + c + 3)) AS tc FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_round('1 / (1 + exp((v.pi - u.pi) + r.a * (v.ta - u.ta) + r.b * (v.tb - u.tb) + r.c * (v.tc - u.tc)))', 5)} AS p0
FROM r, (SELECT * FROM t WHERE y = 0) u, (SELECT * FROM t WHERE y = 1) v""",
)
oracle(
    "joint_model_loss",
    f"""WITH {_COUNTS}, s AS (SELECT y, count(*) AS n, sum(a) AS a, sum(b) AS b FROM r GROUP BY y),
t AS (SELECT y, ln(n + 1) AS pi, ln((a + 1) / (a + b + 2)) AS ta, ln((b + 1) / (a + b + 2)) AS tb FROM s),
p AS (SELECT r.y, 1 / (1 + exp((v.pi - u.pi) + r.a * (v.ta - u.ta) + r.b * (v.tb - u.tb))) AS p0 FROM r, (SELECT * FROM t WHERE y = 0) u, (SELECT * FROM t WHERE y = 1) v),
e AS (SELECT avg(-ln(least(greatest(CASE WHEN y = 0 THEN p0 ELSE 1 - p0 END, 1e-7), 1 - 1e-7))) AS ce FROM p),
c AS (SELECT var_pop(a) AS a, var_pop(b) AS b, covar_pop(a, b) AS c FROM r),
m AS (SELECT ((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c)) / 2 AS mse FROM c)
SELECT {_round('ce', 5)} AS cross_entropy, {_round('mse', 5)} AS mse, {_round('ce + 0.3e0 * mse', 5)} AS joint_loss FROM e, m""",
)
oracle(
    "joint_detector",
    f"""WITH {FLOWS}, m AS (SELECT min(spkts) AS al, max(spkts) - min(spkts) AS aspan, min(ct_srv_src) AS bl, max(ct_srv_src) - min(ct_srv_src) AS bspan FROM flows),
r AS (SELECT row_number() OVER () AS id, flow_id, attack_type, (spkts - al) / aspan AS a, (ct_srv_src - bl) / bspan AS b FROM flows, m),
v AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM r),
l AS (SELECT *, (va + vb) / 2 - sqrt(pow((va - vb) / 2, 2) + ab * ab) - va AS low FROM v),
e AS (SELECT ma, mb, ab / sqrt(ab * ab + low * low) AS x, low / sqrt(ab * ab + low * low) AS y FROM l),
s AS (SELECT attack_type AS c, count(*) AS n, sum(a) AS a, sum(b) AS b FROM r GROUP BY c),
k AS (SELECT c, ln(n + 1) AS pi, ln((a + 1) / (a + b + 2)) AS ta, ln((b + 1) / (a + b + 2)) AS tb FROM s),
w AS (SELECT id, flow_id, r.a, r.b, k.c, pi + r.a * ta + r.b * tb AS w FROM r, k)
SELECT flow_id, {_round("1 - sum(CASE WHEN c = 'N' THEN exp(w) ELSE 0 END) / sum(exp(w))", 5)} AS score,
{_round("pow((any_value(a) - any_value(ma)) * any_value(x) + (any_value(b) - any_value(mb)) * any_value(y), 2) / 2", 5)} AS reconstruction_error
FROM w, e GROUP BY id, flow_id""",
)
oracle(
    "model_folds",
    f"""WITH r AS (SELECT l_linenumber AS n, l_partkey % 5 AS p, l_suppkey % 3 AS q, CASE WHEN l_linenumber + l_partkey % 5 >= 6 THEN 1 ELSE 0 END AS y,
  CAST('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8) AS BIGINT) % 3 AS fold FROM lineitem),
folds AS (SELECT unnest([0, 1, 2]) AS f),
s AS (SELECT f, y, ln(count(*) + 1) AS pi, ln((sum(n) + 1) / (sum(n + p + q) + 3)) AS tn, ln((sum(p) + 1) / (sum(n + p + q) + 3)) AS tp,
  ln((sum(q) + 1) / (sum(n + p + q) + 3)) AS tq FROM r, folds WHERE fold <> f GROUP BY f, y),
bayes AS (SELECT r.y, CASE WHEN (v.pi - u.pi) + n * (v.tn - u.tn) + p * (v.tp - u.tp) + q * (v.tq - u.tq) > 0 THEN 1 ELSE 0 END AS said
  FROM r JOIN s u ON u.f = r.fold AND u.y = 0 JOIN s v ON v.f = r.fold AND v.y = 1),
x AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, y, fold FROM r" for c in "npq")}),
b AS (SELECT f, feature, v, count(*) AS k, sum(y) AS t FROM x, folds WHERE fold <> f GROUP BY 1, 2, 3),
c AS (SELECT f, feature, v, sum(k) OVER w AS kl, sum(t) OVER w AS tl, sum(k) OVER (PARTITION BY f, feature) AS ka, sum(t) OVER (PARTITION BY f, feature) AS ta
  FROM b WINDOW w AS (PARTITION BY f, feature ORDER BY v)),
split AS (SELECT * FROM c WHERE kl < ka QUALIFY row_number() OVER (PARTITION BY f ORDER BY tl * 1.0e0 * tl / kl + (kl - tl) * 1.0e0 * (kl - tl) / kl
  + (ta - tl) * 1.0e0 * (ta - tl) / (ka - kl) + (ka - kl - ta + tl) * 1.0e0 * (ka - kl - ta + tl) / (ka - kl) DESC) = 1),
stump AS (SELECT x.y, CASE WHEN v <= edge THEN CASE WHEN 2 * tl > kl THEN 1 ELSE 0 END ELSE CASE WHEN 2 * (ta - tl) > ka - kl THEN 1 ELSE 0 END END AS said
  FROM x JOIN (SELECT f, feature, v AS edge, kl, tl, ka, ta FROM split) z ON z.f = x.fold AND z.feature = x.feature),
said AS (SELECT 'bayes' AS candidate, y, said FROM bayes UNION ALL SELECT 'stump', y, said FROM stump),
f1 AS (SELECT candidate, class, 2.0e0 * count_if(y = class AND said = class) / (count_if(y = class) + count_if(said = class)) AS f1
  FROM said, (SELECT unnest([0, 1]) AS class) GROUP BY 1, 2 HAVING count_if(y = class) + count_if(said = class) > 0),
m AS (SELECT candidate, avg(f1) AS macro_f1 FROM f1 GROUP BY 1)
SELECT candidate, {_round('macro_f1', 5)} AS macro_f1, row_number() OVER (ORDER BY macro_f1 DESC, candidate) = 1 AS chosen FROM m""",
)
oracle(
    "sequence_bayes",
    f"""WITH e AS (SELECT event_id, CAST(event_id % 5 AS DOUBLE) AS c, CAST(event_id % 3 AS DOUBLE) AS d, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y,
  lag(event_id) OVER w % 5 AS a, lag(event_id) OVER w % 3 AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT * FROM e WHERE a IS NOT NULL),
t AS (SELECT y, ln(count(*) + 1) AS pi, {", ".join(f"ln((sum({c}) + 1) / (sum(a + b + c + d) + 4)) AS t{c}" for c in "abcd")} FROM r GROUP BY y)
SELECT event_id, {_round('1 / (1 + exp((v.pi - u.pi) + r.a * (v.ta - u.ta) + r.b * (v.tb - u.tb) + r.c * (v.tc - u.tc) + r.d * (v.td - u.td)))', 5)} AS p0
FROM r, (SELECT * FROM t WHERE y = 0) u, (SELECT * FROM t WHERE y = 1) v""",
)
oracle(
    "stream_dead_scores",
    """WITH f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flow_id, l_partkey % 3 AS proto FROM lineitem)
SELECT 'scored' AS message, count(*) AS n, count(DISTINCT flow_id) AS n_flows FROM f WHERE proto <> 2
UNION ALL SELECT 'Packet processing failed: unknown category in proto: p2', count(*), count(DISTINCT flow_id) FROM f WHERE proto = 2""",
)
oracle("vector_sums", f"WITH {_COUNTS} SELECT y, sum(c) AS s0, sum(a) AS s1, sum(b) AS s2 FROM r GROUP BY y")
oracle(
    "fit_checks",
    f"""WITH {FLOWS}, {_split_cte('SELECT flow_id AS o_orderkey, attack_type AS c FROM flows')}, {_quota('test', 'counts', 'ceil(total * 0.2e0)')},
rest AS (SELECT c, n - q AS n FROM test), {_quota('val', 'rest', 'ceil(total * (0.1e0 / (1 - 0.2e0)))')},
parts AS (SELECT ranked.c, CASE WHEN place <= test.q THEN 'test' WHEN place <= test.q + val.q THEN 'val' ELSE 'train' END AS part
  FROM ranked JOIN test ON ranked.c = test.c JOIN val ON ranked.c = val.c),
k AS (SELECT part, c, count(*) AS n FROM parts GROUP BY 1, 2)
SELECT part, CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_missing, true AS same_schema, '' AS unseen,
{_round('max(n) / CAST(sum(n) AS DOUBLE)')} AS largest_share FROM k GROUP BY part""",
)

_SMALL = "r AS (SELECT l_linenumber AS n, l_partkey % 5 AS p, l_suppkey % 3 AS q, CASE WHEN l_linenumber + l_partkey % 5 >= 6 THEN 1.0e0 ELSE 0.0e0 END AS y FROM lineitem)"
_GAINS = f"""{_SMALL}, x AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, y FROM r" for c in "npq")}),
b AS (SELECT feature, v, count(*) AS k, sum(y) AS s FROM x GROUP BY 1, 2),
c AS (SELECT feature, sum(k) OVER w AS kl, sum(s) OVER w AS sl, sum(k) OVER (PARTITION BY feature) AS ka, sum(s) OVER (PARTITION BY feature) AS sa
  FROM b WINDOW w AS (PARTITION BY feature ORDER BY v)),
g AS (SELECT feature, max(2 * (sl / kl) * (sl / kl) * kl / ka + 2 * ((sa - sl) / (ka - kl)) * ((sa - sl) / (ka - kl)) * (ka - kl) / ka) AS gain
  FROM c WHERE kl < ka GROUP BY feature),
best AS (SELECT feature, row_number() OVER (ORDER BY gain DESC) AS place FROM g)"""
oracle("stump_importance", f"WITH {_GAINS} SELECT feature, CASE WHEN place = 1 THEN 1.0e0 ELSE 0.0e0 END AS rf_importance FROM best")
oracle(
    "stump_elimination",
    f"""WITH {_GAINS} SELECT feature, CAST(CASE WHEN place = 1 THEN 1 ELSE 1 + row_number() OVER (PARTITION BY place = 1 ORDER BY feature DESC) END AS INT) AS rfe_rank
FROM best""",
)
oracle("stream_detector_agreement", "SELECT CAST(0 AS BIGINT) AS n_differing, true AS any_alert")

_LISTED = "(SELECT string_agg(label || '=' || CAST(n AS VARCHAR), ',' ORDER BY label) FROM k WHERE split = '{}')"
oracle(
    "holdout_metadata",
    f"""WITH {_HOLDOUT}, k AS (SELECT split, CAST(label AS VARCHAR) AS label, count(*) AS n FROM parts GROUP BY 1, 2),
t AS (SELECT CAST(sum(n) FILTER (split = 'train') AS BIGINT) AS a, CAST(sum(n) FILTER (split = 'validation') AS BIGINT) AS b, CAST(sum(n) FILTER (split = 'test') AS BIGINT) AS c FROM k)
SELECT a + b AS original_training_samples, c AS original_test_samples, a AS new_train_samples, b AS validation_samples, c AS test_samples, 0.15e0 AS val_size,
CAST(42 AS INT) AS random_state, {_LISTED.format('train')} AS train_distribution, {_LISTED.format('validation')} AS val_distribution, {_LISTED.format('test')} AS test_distribution FROM t""",
)
oracle("source_counts", f"WITH {FLOWS} SELECT concat('capture-', proto) AS source, count(*) AS n FROM flows GROUP BY 1")
