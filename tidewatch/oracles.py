"""DuckDB SQL of the registered queries, composed from named parts over the test tables."""

from __future__ import annotations

_PARTS = {
    "service": """SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS unique_key, o_orderdate AS created_date, o_orderpriority AS complaint_type, o_orderstatus AS status,
        CASE WHEN o_orderkey % 5 > 0 THEN 'd' || chr(39) || o_orderkey % 3 END AS descriptor, lpad((o_custkey % 12 + 1)::VARCHAR, 2, '0') || ' BRONX' AS community_board FROM orders""",
    "ship": "SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey",
    "req": """SELECT o_orderkey::VARCHAR AS unique_key, o_orderdate AS created_date, CASE WHEN o_orderstatus <> 'O' THEN shipped END AS closed_date,
        c_mktsegment AS agency, CASE WHEN o_orderkey % 7 <> 0 THEN c_mktsegment || ' agency ' END AS agency_name, o_orderpriority AS complaint_type,
        CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE lower(o_orderpriority) END AS descriptor, o_orderstatus AS status,
        CASE WHEN o_orderkey % 97 = 0 THEN '  ' ELSE r_name END AS borough, lpad((n_nationkey % 18 + 1)::VARCHAR, 2, '0') || ' ' || r_name AS community_board,
        CASE o_orderkey % 3 WHEN 0 THEN 'online' WHEN 1 THEN ' mobile ' ELSE 'PHONE' END AS open_data_channel_type
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN ship ON l_orderkey = o_orderkey""",
    "stg": """SELECT unique_key AS request_id, created_date AS created_at_local, closed_date AS closed_at_local, upper(trim(agency)) AS agency, trim(agency_name) AS agency_name,
        trim(complaint_type) AS problem, nullif(trim(descriptor), '') AS problem_detail, upper(trim(status)) AS status, upper(trim(borough)) AS borough,
        upper(trim(community_board)) AS community_district, upper(trim(open_data_channel_type)) AS channel FROM req""",
    "fct": """SELECT *, created_at_local::DATE AS created_date, closed_at_local::DATE AS closed_date, closed_at_local IS NOT NULL AS is_closed,
        CASE WHEN closed_at_local IS NOT NULL THEN date_diff('minute', created_at_local, closed_at_local) / 1440.0::DOUBLE END AS resolution_days FROM stg""",
    "district_parts": """SELECT community_board, CASE WHEN n LIKE '%UNSPECIFIED%' THEN 'Unspecified' WHEN num <> '' THEN boro || ' ' || lpad(ltrim(num, '0'), greatest(2, length(ltrim(num, '0')))::INT, '0') ELSE ttl END AS district,
        CASE WHEN n LIKE '%UNSPECIFIED%' OR num = '' THEN 'Unspecified' ELSE boro END AS borough
        FROM (SELECT community_board, n, num, list_aggregate(list_transform(regexp_extract_all(lower(regexp_extract(n, '^[0-9]+\\s+(.*)$', 1)), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS boro,
                     list_aggregate(list_transform(regexp_extract_all(lower(community_board), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS ttl
              FROM (SELECT community_board, upper(regexp_replace(community_board, '^\\s+|\\s+$', '', 'g')) AS n, regexp_extract(upper(regexp_replace(community_board, '^\\s+|\\s+$', '', 'g')), '^([0-9]+)\\s+\\S', 1) AS num FROM boards))""",
    "boards": "SELECT DISTINCT community_board FROM req",
    "daily": "SELECT l_shipdate::DATE AS date, l_returnflag AS district, l_linestatus AS problem, count(*) AS requests FROM lineitem GROUP BY ALL",
    "pan": """SELECT d.date, s.district, s.problem, coalesce(requests, 0)::BIGINT AS requests
        FROM (SELECT DISTINCT district, problem FROM daily) s CROSS JOIN (SELECT unnest(generate_series(DATE '1995-01-02', DATE '2001-11-04', INTERVAL 1 DAY))::DATE AS date) d
        LEFT JOIN daily USING (date, district, problem)""",
    "rob": """SELECT date, district, problem, observed, CASE WHEN len(past) = 8 THEN list_median(past) END AS expected,
        CASE WHEN len(past) = 8 THEN greatest(1.4826::DOUBLE * list_median(list_transform(past, lambda v: abs(v - list_median(past)))), 1.0::DOUBLE) END AS scale
        FROM (SELECT date, district, problem, requests::DOUBLE AS observed, list(requests::DOUBLE) OVER (PARTITION BY district, problem, isodow(date) ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS past FROM pan)""",
    "mom": """SELECT date, district, problem, requests::DOUBLE AS observed, count(*) OVER w AS past_n, sum(requests::DOUBLE) OVER w AS s, sum(requests::DOUBLE * requests) OVER w AS q, median(requests::DOUBLE) OVER w AS past_median
        FROM pan WINDOW w AS (PARTITION BY district, problem, isodow(date) ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)""",
    "nb": """SELECT *, CASE WHEN past_n > 0 THEN greatest(sqrt(expected + alpha * expected * expected), 1.0::DOUBLE) END AS scale
        FROM (SELECT *, CASE WHEN past_n > 0 THEN least(greatest((CASE WHEN past_n > 1 THEN greatest((q - s * s / past_n) / (past_n - 1), 0.0::DOUBLE) ELSE expected END - greatest(expected, 1.0::DOUBLE)) / greatest(expected * expected, 1.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) END AS alpha
              FROM (SELECT *, s / nullif(past_n, 0) AS expected FROM mom))""",
}

_NEEDS = {
    "req": ["ship"], "stg": ["req"], "fct": ["stg"], "boards": ["req"], "district_parts": ["boards"], "pan": ["daily"], "rob": ["pan"], "mom": ["pan"], "nb": ["mom"],
}

_ID = "'SIG-' || upper(substr(sha256(lower('volume_surge|' || district || '|' || problem || '|' || date::VARCHAR)), 1, 10))"


def _alerts(source: str, where: str, effect: str, score: str, upper: str, excess: str, detector: str, affected: str) -> str:
    return f"""SELECT {_ID} AS id, 'volume_surge' AS type, date, district, problem, observed, expected, {effect} AS effect, {score} AS anomaly_score, {score} AS calibrated_score,
        {upper} AS upper_bound, {excess} AS excess_count, '{detector}' AS detector, ({affected})::BIGINT AS affected_count FROM {source} WHERE {where}"""


def _robust(extra: str = "") -> str:
    return _alerts("rob", f"expected >= 1 AND observed - expected >= 2 AND observed / greatest(expected, 1.0) >= 1.5 AND (observed - expected) / scale >= 2 {extra}", "observed / greatest(expected, 1.0::DOUBLE)", "(observed - expected) / scale", "expected + 2.0::DOUBLE * scale", "observed - expected", "robust_seasonal", "observed")


def _counts(z: float, ratio: float, delta: float, spike: str, detector: str = "nb_conformal") -> str:
    where = f"past_n >= 13 AND expected >= 1 AND observed - expected >= {delta} AND observed / greatest(expected, 1.0) >= {ratio} AND (observed > expected + {z} * scale {spike})"
    return _alerts("nb", where, "observed / greatest(expected, 1.0::DOUBLE)", "(observed - expected) / scale", f"expected + {z}::DOUBLE * scale", "observed - expected", detector, "observed")


_PARTS |= {
    "by_series": "SELECT district, problem, tp, coalesce(n, 0) - tp AS fp, events - tp AS fn FROM (SELECT district, problem, count(*) AS events, count(matched) AS tp FROM matched GROUP BY ALL) LEFT JOIN (SELECT district, problem, count(*) AS n FROM epi GROUP BY ALL) USING (district, problem)",
    "robust": _robust(),
    "counts": _counts(2, 1.2, 2, ""),
    "spikes": _counts(3, 1.2, 2, "OR (expected >= 2 AND observed / greatest(expected, 1.0) >= 1.6)"),
    "shift_rows": """SELECT date, district, problem, observed, base AS expected, count(base) OVER w AS n, sum(base) OVER w AS bs, sum(observed) OVER w AS os, count(*) FILTER (WHERE observed >= base * 1.25::DOUBLE) OVER w AS hi
        FROM (SELECT *, CASE WHEN past_n >= 13 THEN past_median END AS base FROM mom) WINDOW w AS (PARTITION BY district, problem ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "shifts": _alerts("shift_rows", "n = 3 AND bs / 3 >= 1 AND hi >= 2 AND os / greatest(bs, 1.0) >= 1.25 AND os - bs >= 3", "os / greatest(bs, 1.0::DOUBLE)", "(os - bs) / greatest(sqrt(bs), 1.0::DOUBLE)", "expected * 1.25::DOUBLE", "os - bs", "hybrid_nb_ewma", "os"),
    "own_spikes": _counts(2, 1.4, 1, "", "hybrid_nb_ewma"),
    "hybrid": "SELECT * FROM shifts UNION ALL SELECT * FROM own_spikes ANTI JOIN shifts USING (date, district, problem)",
    "numbered": """SELECT *, sum(begins) OVER (PARTITION BY district, problem ORDER BY date) AS episode
        FROM (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY district, problem ORDER BY date) <= 7 THEN 0 ELSE 1 END AS begins FROM robust)""",
    "epi": """SELECT f.id, f.type, f.date, district, problem, b.observed, b.expected, b.effect, b.anomaly_score, b.calibrated_score, b.upper_bound, f.excess_count, f.detector, f.affected_count, episode_start, episode_end, persistence
        FROM (SELECT district, problem, arg_min(numbered, date) AS f, arg_max(numbered, struct_pack(a := anomaly_score, b := -(date - DATE '1970-01-01'))) AS b, min(date) AS episode_start, max(date) AS episode_end, count(*) AS persistence FROM numbered GROUP BY district, problem, episode)""",
    "ranks": """SELECT *, 0.5::DOUBLE * strength_pct + 0.3::DOUBLE * impact_pct + 0.2::DOUBLE * persistence_pct AS priority_score
        FROM (SELECT *, (rank() OVER (ORDER BY anomaly_score) + (count(*) OVER (PARTITION BY anomaly_score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS strength_pct,
                     (rank() OVER (ORDER BY affected_count) + (count(*) OVER (PARTITION BY affected_count) - 1) / 2.0::DOUBLE) / count(*) OVER () AS impact_pct,
                     (rank() OVER (ORDER BY persistence) + (count(*) OVER (PARTITION BY persistence) - 1) / 2.0::DOUBLE) / count(*) OVER () AS persistence_pct FROM epi)""",
    "ranked": "SELECT *, CASE WHEN priority_score >= 0.9 THEN 'high' ELSE 'watch' END AS severity, row_number() OVER (ORDER BY priority_score DESC, date DESC, district, problem) AS place FROM ranks",
    "ev": """SELECT 'EV-' || district || '-' || problem || '-' || date::VARCHAR AS event_id, district, problem, date AS start, (date + 6)::DATE AS \"end\", ['spike', 'level_shift', 'gradual_ramp'][(year(date) % 3 + 1)::INT] AS scenario
        FROM pan WHERE day(date) = 1 AND month(date) % 3 = 1""",
    "matched": """SELECT event_id, ev.district, ev.problem, scenario, min(episode_start) AS matched, CASE WHEN min(episode_start) IS NOT NULL THEN greatest(min(episode_start) - any_value(start), 0) END AS delay_days
        FROM ev LEFT JOIN epi ON epi.district = ev.district AND epi.problem = ev.problem AND episode_start BETWEEN start AND \"end\" + 2 GROUP BY ALL""",
    "score": """SELECT tp, events - tp AS fn, eps - tp AS fp, delay, series FROM (SELECT count(*) AS events, count(matched) AS tp, coalesce(median(delay_days), 0)::DOUBLE AS delay, count(DISTINCT (district, problem)) AS series FROM matched), (SELECT count(*) AS eps FROM epi)""",
    "met": """SELECT tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, fp / greatest(series * (2498 / 7.0::DOUBLE), 1) * 708 AS false_alerts_per_week, delay AS median_detection_delay_days, tp AS true_positive, fp AS false_positive, fn AS false_negative FROM score""",
    "base8": "SELECT date, district, problem, observed::BIGINT AS observed, expected AS baseline FROM rob",
    "level": "SELECT district, problem, greatest(median(requests), 5.0::DOUBLE) AS level, sum(requests::DOUBLE) AS s, sum(requests::DOUBLE * requests) AS q, count(*) AS n FROM pan GROUP BY ALL",
    "weekday_level": "SELECT district, problem, isodow(date) - 1 AS k, greatest(median(requests), 1.0::DOUBLE) AS m FROM pan GROUP BY ALL",
    "template": "SELECT district, problem, level, least(greatest((q / n - (s / n) * (s / n) - level) / greatest(level * level, 1.0::DOUBLE), 0.02::DOUBLE), 0.5::DOUBLE) AS alpha FROM level",
    "picked": "SELECT req.* FROM req JOIN district_parts p USING (community_board) WHERE complaint_type IN (SELECT complaint_type FROM req GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) AND regexp_matches(p.district, '0[1-9]$')",
    "eligible": "SELECT district, problem, count(*) AS days, median(requests)::DOUBLE AS median_requests FROM pan GROUP BY ALL HAVING count(*) >= 70 AND median(requests) >= 1",
}
_NEEDS |= {
    "robust": ["rob"], "counts": ["nb"], "spikes": ["nb"], "shift_rows": ["mom"], "shifts": ["shift_rows"], "own_spikes": ["nb"], "hybrid": ["shifts", "own_spikes"], "numbered": ["robust"],
    "by_series": ["matched", "epi"], "epi": ["numbered"], "ranks": ["epi"], "ranked": ["ranks"], "ev": ["pan"], "matched": ["ev", "epi"], "score": ["matched", "epi"], "met": ["score"], "base8": ["rob"], "level": ["pan"],
    "weekday_level": ["pan"], "template": ["level"], "picked": ["req", "district_parts"], "eligible": ["pan"],
}

_CODES = "SELECT (100 * b + n)::INT AS code, name || ' ' || lpad(n::VARCHAR, 2, '0') AS district FROM (VALUES (1, 'Manhattan', 12), (2, 'Bronx', 12), (3, 'Brooklyn', 18), (4, 'Queens', 14), (5, 'Staten Island', 3)) AS t(b, name, most), unnest(range(1, most + 1)) AS u(n)"


_ALERT = ["id", "type", "date", "district", "problem", "observed", "expected", "effect", "anomaly_score", "calibrated_score", "upper_bound", "excess_count", "detector", "affected_count"]
_REALS = {"observed", "expected", "effect", "anomaly_score", "calibrated_score", "upper_bound", "excess_count", "strength_pct", "impact_pct", "persistence_pct", "priority_score"}


def _with(parts: list[str], body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for p in parts:
        add(p)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in order) + "\n" + body if order else body


def _columns(names: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in _REALS else c for c in names)


_EPISODE = [*_ALERT, "episode_start", "episode_end", "persistence"]
_RANKED = [*_EPISODE, "strength_pct", "impact_pct", "persistence_pct", "priority_score", "severity"]
_INVENTORY = "SELECT count(*) AS requests, count(*) FILTER (WHERE w) AS unresolved_as_of, count(*) FILTER (WHERE w AND created_date < TIMESTAMP '1998-12-02') AS aged_open FROM (SELECT created_date, closed_date IS NULL OR closed_date >= TIMESTAMP '1999-01-01' AS w FROM req WHERE created_date >= TIMESTAMP '1997-01-01' AND created_date < TIMESTAMP '1999-01-01')"
_TREND = "SELECT id, date, observed, baseline FROM base8 JOIN ({}) USING (district, problem) QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC) <= 180"
_DIMS = "community_district, borough, agency, problem"


def oracle_sql() -> dict[str, str]:
    q = {
        "stg_normalize": (["stg"], "SELECT * FROM stg"),
        "fct_requests": (["fct"], "SELECT * FROM fct"),
        "contract_valid": (["req"], "SELECT unique_key, created_date, closed_date, trim(agency) AS agency, agency_name, trim(complaint_type) AS complaint_type, descriptor, trim(status) AS status, trim(borough) AS borough, trim(community_board) AS community_board, open_data_channel_type FROM req WHERE trim(borough) <> '' AND (closed_date IS NULL OR closed_date >= created_date)"),
        "contract_quarantine": (["req"], "SELECT unique_key, created_date, closed_date, concat_ws(',', CASE WHEN trim(borough) = '' THEN 'borough_blank' END, CASE WHEN closed_date < created_date THEN 'closed_before_created' END) AS broken_rules FROM req WHERE trim(borough) = '' OR closed_date < created_date"),
        "mart_daily_metrics": (["fct"], f"SELECT created_date AS metric_date, {_DIMS}, channel, count(*) AS request_count, count(*) FILTER (WHERE is_closed) AS closed_count, median(resolution_days) FILTER (WHERE is_closed) AS median_resolution_days FROM fct GROUP BY ALL"),
        "mart_closure_cohorts": (["fct"], "SELECT date_trunc('week', created_date)::DATE AS cohort_week, community_district, problem, count(*) AS requests, count(*) FILTER (WHERE is_closed AND resolution_days <= 7) AS closed_within_7_days, count(*) FILTER (WHERE NOT is_closed) AS right_censored_requests FROM fct GROUP BY ALL"),
        "mart_open_age": (["fct"], f"SELECT {_DIMS}, count(*) FILTER (WHERE NOT is_closed) AS unresolved_requests, count(*) FILTER (WHERE NOT is_closed AND created_at_local <= TIMESTAMP '1999-06-30' - INTERVAL 30 DAY) AS aged_30d_requests FROM fct GROUP BY ALL"),
        "mart_quality": (["fct"], "SELECT count(*) AS rows_checked, count(DISTINCT request_id) AS unique_request_ids, count(*) FILTER (WHERE community_district = 'UNSPECIFIED') AS unspecified_district_rows, count(*) FILTER (WHERE closed_at_local < created_at_local) AS invalid_date_rows, count(*) FILTER (WHERE problem IS NULL OR problem = '') AS missing_problem_rows FROM fct"),
        "constraint_violations": (["fct"], "SELECT 'not_null' AS \"check\", 'request_id' AS \"column\", count(*) FILTER (WHERE request_id IS NULL) AS n_violations FROM fct UNION ALL SELECT 'not_null', 'created_at_local', count(*) FILTER (WHERE created_at_local IS NULL) FROM fct UNION ALL SELECT 'not_null', 'problem_detail', count(*) FILTER (WHERE problem_detail IS NULL) FROM fct UNION ALL SELECT 'not_null', 'agency_name', count(*) FILTER (WHERE agency_name IS NULL) FROM fct UNION ALL SELECT 'unique', 'request_id', count(*) FROM (SELECT request_id FROM fct GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unique', 'problem', count(*) FROM (SELECT problem FROM fct GROUP BY 1 HAVING count(*) > 1)"),
        "window_filter_count": (["req"], f"SELECT requests FROM ({_INVENTORY})"),
        "open_as_of": (["req"], f"SELECT unresolved_as_of, aged_open FROM ({_INVENTORY})"),
        "global_counts": (["req"], _INVENTORY),
        "coverage": (["req"], "SELECT count(*) AS rows_checked, " + ", ".join(f"round(100 * count({c}) / count(*), 1) AS {c}_coverage" for c in ("closed_date", "agency_name", "community_board")) + " FROM req"),
        "top_problems": (["req"], "SELECT complaint_type, count(*) AS requests FROM req GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
        "top_agencies": (["req"], "SELECT agency, count(*) AS requests FROM req GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
        "channels": (["req"], "SELECT open_data_channel_type, count(*) AS requests FROM req GROUP BY 1"),
        "daily_sparse": (["req"], "SELECT created_date::DATE AS day, community_board, complaint_type, count(*) AS requests FROM req GROUP BY ALL"),
        "selected_daily": (["picked"], "SELECT created_date::DATE AS day, community_board, complaint_type, count(*) AS requests FROM picked GROUP BY ALL"),
        "dense_panel": (["pan"], "SELECT * FROM pan"),
        "injected_effects": (["pan", "ev", "weekday_level"], ", e AS (SELECT *, CASE scenario WHEN 'spike' THEN 3.5::DOUBLE WHEN 'level_shift' THEN 2.0::DOUBLE ELSE 2.25::DOUBLE END AS strength FROM ev), x AS (SELECT p.date, p.district, p.problem, p.requests, m, CASE WHEN start IS NULL THEN 1.0::DOUBLE WHEN scenario = 'gradual_ramp' THEN 1.25::DOUBLE + (strength - 1.25::DOUBLE) * (p.date - start) / greatest(\"end\" - start, 1) ELSE strength END AS factor, start FROM pan p JOIN weekday_level w ON w.district = p.district AND w.problem = p.problem AND k = isodow(p.date) - 1 LEFT JOIN e ON e.district = p.district AND e.problem = p.problem AND p.date BETWEEN start AND \"end\") SELECT date, district, problem, round(CASE WHEN start IS NULL THEN requests::DOUBLE ELSE ceil(greatest(requests * factor, m * factor)) END, 6) AS requests, round(factor, 6) AS factor FROM x"),
        "candidate_choice": ([], "SELECT place, n_name, passes FROM (SELECT *, f1 >= 0.8 AND rate <= 5 AND delay <= 2 AND weakest >= 0.7 AS passes FROM (SELECT n_nationkey::BIGINT AS place, n_name, 0.7::DOUBLE + (n_nationkey * 7 % 25) / 80.0::DOUBLE AS f1, (n_nationkey * 3 % 8)::DOUBLE AS rate, (n_nationkey % 4)::DOUBLE AS delay, 0.5::DOUBLE + (n_nationkey % 10) / 20.0::DOUBLE AS weakest, n_nationkey % 3 AS complexity FROM nation)) ORDER BY passes DESC, f1 DESC, rate, weakest DESC, complexity, place LIMIT 1"),
        "district_codes": ([], f"SELECT k AS code, district, count(*) AS customers FROM (SELECT ((c_custkey % 6 + 1) * 100 + c_custkey % 23)::INT AS k FROM customer) LEFT JOIN ({_CODES}) ON code = k GROUP BY ALL"),
        "boundary_map": ([], f"SELECT c.code, c.district, 'g' || c.code AS geometry, coalesce(requests, 0)::BIGINT AS requests, CASE WHEN requests IS NULL THEN 'normal' WHEN requests % 2 = 0 THEN 'watch' ELSE 'high' END AS severity FROM ({_CODES}) c LEFT JOIN (SELECT (c_custkey % 5 + 1) * 100 + c_custkey % 20 AS code, count(*) AS requests FROM customer GROUP BY 1) n ON n.code = c.code"),
        "canonical_hashes": ([], """SELECT n_nationkey, sha256('{"area":{"region":' || n_regionkey || '},"comment":null,"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS sha256 FROM nation"""),
        "stream_daily_counts": ([], "SELECT o_orderdate::DATE AS day, o_orderstatus AS community_board, o_orderpriority AS complaint_type, count(*) AS requests FROM orders WHERE o_orderdate::DATE + INTERVAL 1 DAY <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 2 DAY GROUP BY ALL"),
        "stream_deduplicated": ([], "SELECT DISTINCT l_orderkey AS unique_key FROM lineitem"),
        "stream_sessions": (["epi"], f"SELECT {_columns(_EPISODE)} FROM epi WHERE episode_end + 7 <= (SELECT max(date) FROM robust)"),
        "stream_ingest": (["req"], "SELECT CASE WHEN o = '' THEN 'kept' ELSE o END AS outcome, count(*) AS requests FROM (SELECT concat_ws(',', CASE WHEN trim(borough) = '' THEN 'borough_blank' END, CASE WHEN closed_date < created_date THEN 'closed_before_created' END) AS o FROM req) GROUP BY ALL"),
        "replayed_episodes": (["robust"], ", known AS (SELECT * FROM robust JOIN (SELECT unnest(generate_series(DATE '1998-07-01', DATE '1999-06-30', INTERVAL 1 DAY))::DATE AS known_on) ON date <= known_on), num AS (SELECT *, sum(begins) OVER (PARTITION BY known_on, district, problem ORDER BY date) AS episode FROM (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY known_on, district, problem ORDER BY date) <= 7 THEN 0 ELSE 1 END AS begins FROM known)), " + f"epk AS ({_PARTS['epi'].replace('numbered', 'num').replace('SELECT f.id', 'SELECT known_on, f.id').replace('FROM (SELECT district', 'FROM (SELECT known_on, district').replace('GROUP BY district', 'GROUP BY known_on, district')}) SELECT known_on, {_columns(_EPISODE)} FROM epk"),
        "dense_districts": (["req", "district_parts"], ", c AS (SELECT created_date::DATE AS date, p.district, complaint_type AS problem, count(*) AS n FROM req JOIN district_parts p USING (community_board) WHERE created_date::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL) SELECT d.date, s.district, s.problem, coalesce(n, 0)::BIGINT AS requests FROM (SELECT DISTINCT district, problem FROM c) s CROSS JOIN (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS date) d LEFT JOIN c USING (date, district, problem)"),
        "dup_row_gate": ([], "SELECT l_orderkey, l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
        "dup_key_gate": ([], "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
        "coverage_gate": (["req"], "SELECT min(created_date)::DATE AS first_day, max(created_date)::DATE AS last_day, min(created_date)::DATE = DATE '1997-01-01' AND max(created_date)::DATE = DATE '1998-12-31' AS complete FROM req"),
        "reconcile": (["daily"], "SELECT (SELECT sum(requests) FROM daily)::BIGINT AS grouped, (SELECT count(*) FROM lineitem) AS source, (SELECT sum(requests) FROM daily) = (SELECT count(*) FROM lineitem) AS reconciled"),
        "observed_counts": (["req"], "SELECT count(*) AS source, count(*) AS grouped, min(created_date)::DATE AS first_day, max(created_date)::DATE AS last_day, true AS reconciled, true AS complete, round(100 * count(closed_date) / count(*), 1) AS closed_date_coverage, round(100 * count(community_board) / count(*), 1) AS community_board_coverage FROM req"),
        "trend_rollups": (["pan"], "SELECT 'city' AS kind, date, NULL::VARCHAR AS district, NULL::VARCHAR AS problem, sum(requests)::BIGINT AS observed FROM pan GROUP BY date UNION ALL SELECT 'district', date, district, NULL, sum(requests)::BIGINT FROM pan WHERE date >= DATE '2001-08-01' GROUP BY date, district UNION ALL SELECT 'problem', date, NULL, problem, sum(requests)::BIGINT FROM pan WHERE date >= DATE '2001-08-01' GROUP BY date, problem UNION ALL SELECT 'map', NULL, district, NULL, sum(requests)::BIGINT FROM pan WHERE date > DATE '2001-11-04' - 28 GROUP BY district"),
        "served_signals": (["ranked"], "SELECT id, place::INT AS place, district, problem, district AS borough, date AS as_of, severity, 'More ' || problem || ' than usual for the weekday' AS title FROM ranked WHERE place <= 24 AND district = 'R' AND severity = 'watch' ORDER BY place LIMIT 20 OFFSET 1"),
        "served_signal": (["ranked"], "SELECT id, type, district, problem, date AS as_of, persistence, episode_start, episode_end, 4 AS evidence FROM ranked WHERE place = 1"),
        "served_trends": (["pan"], "SELECT date, sum(requests)::BIGINT AS observed FROM pan WHERE district = 'A' AND date BETWEEN DATE '2001-09-01' AND DATE '2001-10-15' GROUP BY date"),
        "served_signal_trend": (["ranked", "base8"], "SELECT date, observed, baseline FROM (" + _TREND.format("SELECT id, district, problem FROM ranked WHERE place = 1") + ")"),
        "served_map": (["ranked", "pan"], "SELECT t.district, t.district AS borough, coalesce(s.severity, 'normal') AS value FROM (SELECT DISTINCT district FROM pan) t LEFT JOIN (SELECT district, arg_min(severity, place) AS severity FROM ranked WHERE place <= 24 GROUP BY 1) s USING (district)"),
        "served_dimensions": (["pan", "req"], "SELECT DISTINCT 'districts' AS kind, district AS value, NULL::BIGINT AS requests FROM pan UNION ALL SELECT DISTINCT 'boroughs', district, NULL FROM pan UNION ALL SELECT 'problems', trim(complaint_type), count(*) FROM req GROUP BY 2 UNION ALL (SELECT 'agencies', trim(agency), count(*) FROM req GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 50) UNION ALL SELECT 'channels', trim(open_data_channel_type), count(*) FROM req GROUP BY 2"),
        "served_facts": (["ranked", "pan", "req"], ", inv AS (SELECT count(*) AS requests, count(*) FILTER (WHERE w) AS unresolved_as_of, count(*) FILTER (WHERE w AND created_date < TIMESTAMP '2001-10-06') AS aged_open FROM (SELECT created_date, closed_date IS NULL OR closed_date >= TIMESTAMP '2001-11-05' AS w FROM req WHERE created_date >= TIMESTAMP '1997-01-01' AND created_date < TIMESTAMP '2001-11-05')), m AS (SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN round(100 * count(closed_date) / count(*), 1) END AS c, CASE WHEN count(*) > 0 THEN round(100 * count(community_board) / count(*), 1) END AS b FROM req WHERE created_date >= TIMESTAMP '2001-11-01' AND created_date < TIMESTAMP '2001-12-01') SELECT 'meta' AS section, * FROM (VALUES ('artifact_version', '2001.11-v1'), ('method_version', '2.0.0'), ('window_start', '1997-01-01'), ('window_end', '2001-11-04'), ('readiness', 'revalidation_required')) v(name, value) UNION ALL SELECT 'gates', * FROM (VALUES ('min_f1', '0.8'), ('max_false_per_week', '5.0'), ('max_delay_days', '2.0'), ('min_scenario_recall', '0.7'), ('min_review_precision', '0.65')) UNION ALL SELECT 'summary', 'requests', requests::VARCHAR FROM inv UNION ALL SELECT 'summary', 'unresolved_as_of', unresolved_as_of::VARCHAR FROM inv UNION ALL SELECT 'summary', 'aged_open', aged_open::VARCHAR FROM inv UNION ALL SELECT 'quality', 'rows_checked', n::VARCHAR FROM m UNION ALL SELECT 'quality', 'closed_date_coverage', c::VARCHAR FROM m UNION ALL SELECT 'quality', 'district_field_coverage', b::VARCHAR FROM m UNION ALL SELECT 'quality', 'panel_rows', count(*)::VARCHAR FROM pan UNION ALL SELECT 'quality', 'panel_requests', sum(requests)::BIGINT::VARCHAR FROM pan UNION ALL SELECT 'quality', 'districts', count(DISTINCT district)::VARCHAR FROM pan UNION ALL SELECT 'summary', 'signals', count(*)::VARCHAR FROM ranked WHERE place <= 24 UNION ALL SELECT 'summary', 'high_signals', count(*)::VARCHAR FROM ranked WHERE place <= 24 AND severity = 'high'"),
        "served_health": ([], "SELECT 'ok' AS status, '2001.11-v1' AS artifact"),
        "published_manifest": (["ranked", "pan", "req", "base8"], "SELECT 'signals' AS section, count(*) AS rows FROM ranked WHERE place <= 24 UNION ALL SELECT 'trends', (SELECT count(DISTINCT date) FROM pan) + (SELECT count(*) FROM (SELECT DISTINCT date, district FROM pan WHERE date >= DATE '2001-08-01')) + (SELECT count(*) FROM (SELECT DISTINCT date, problem FROM pan WHERE date >= DATE '2001-08-01')) + (SELECT count(*) FROM (" + _TREND.format("SELECT id, district, problem FROM ranked WHERE place <= 24") + ")) UNION ALL SELECT 'map', count(DISTINCT district) FROM pan UNION ALL SELECT 'dimensions', (SELECT 2 * count(DISTINCT district) FROM pan) + (SELECT count(DISTINCT complaint_type) + least(50, count(DISTINCT agency)) + count(DISTINCT open_data_channel_type) FROM req) UNION ALL SELECT 'facts', 21"),
        "csv_export": ([], """SELECT s_suppkey, 'say "' || s_name || '", again' AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey::VARCHAR END AS nation FROM supplier"""),
        "boundary_files": ([], f"SELECT c.code, c.district, coalesce(n, 0)::BIGINT AS customers FROM ({_CODES}) c LEFT JOIN (SELECT (c_custkey % 5 + 1) * 100 + c_custkey % 20 AS code, count(*) AS n FROM customer GROUP BY 1) x ON x.code = c.code"),
        "label_files": ([], "SELECT ['clear_anomaly', 'plausible_anomaly', 'unsupported', 'uncertain'][(o_orderkey % 4 + 1)::INT] AS label, count(*) AS cases, sum(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS evidence FROM orders GROUP BY 1"),
        "configured_alerts": (["robust", "counts", "hybrid"], "SELECT 'robust_seasonal-h8-z2-d2' AS configuration, 0 AS complexity, count(*) AS alerts FROM robust HAVING count(*) > 0 UNION ALL SELECT 'nb_conformal-h13-z2-d2', 1, count(*) FROM counts HAVING count(*) > 0 UNION ALL SELECT 'hybrid_nb_ewma-h13-z2-d1', 2, count(*) FROM hybrid HAVING count(*) > 0"),
        "bootstrap_ci": (["by_series"], ", p AS (SELECT *, row_number() OVER (ORDER BY district, problem) - 1 AS place, count(*) OVER () AS n FROM by_series), k AS (SELECT draw, ('0x' || substr(md5('311|' || draw || '|' || k), 1, 12))::BIGINT % n AS place FROM range(500) d(draw), (SELECT place AS k, n FROM p)), s AS (SELECT draw, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k JOIN p USING (place) GROUP BY draw), r AS (SELECT tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM s), m AS (SELECT 'precision' AS metric, p AS v FROM r UNION ALL SELECT 'recall', r FROM r UNION ALL SELECT 'f1', 2 * p * r / greatest(p + r, 1e-12::DOUBLE) FROM r) SELECT metric, round(quantile_cont(v, 0.025), 3) AS low, round(quantile_cont(v, 0.975), 3) AS high FROM m GROUP BY metric"),
        "marts_refreshed": (["fct"], f"SELECT part, sum(n)::BIGINT AS requests, sum(c)::BIGINT AS closed, count(*) AS groups FROM (SELECT strftime(created_date, '%Y-%m') AS part, created_date, {_DIMS}, channel, count(*) AS n, count(*) FILTER (WHERE is_closed) AS c FROM fct WHERE request_id::BIGINT % 2 = 0 OR year(created_date) = 1997 GROUP BY ALL) GROUP BY part"),
        "service_filtered": (["service"], "SELECT unique_key, created_date, complaint_type, descriptor FROM service WHERE created_date >= TIMESTAMP '1997-01-01' AND complaint_type IN ('1-URGENT', '5-LOW') AND length(descriptor) > 2"),
        "service_parts": (["service"], "SELECT complaint_type, status, count(*) AS requests, count(*) AS keys FROM service GROUP BY ALL"),
        "service_cached": (["service"], "SELECT created_date::DATE AS day, community_board, count(*) AS requests FROM service GROUP BY ALL"),
        "schema_drift": ([], "SELECT field, kind, count(*) AS records, CASE WHEN field = 'sla_days' THEN 'new' WHEN kind = 'BIGINT' THEN 'changed' ELSE 'known' END AS verdict FROM (SELECT unnest(list_filter([{'field': 'unique_key', 'kind': 'STRING'}, {'field': 'created_date', 'kind': 'STRING'}, {'field': CASE WHEN k % 3 > 0 THEN 'complaint_type' END, 'kind': 'STRING'}, {'field': CASE WHEN k % 10 = 0 THEN 'sla_days' END, 'kind': 'BIGINT'}, {'field': 'status', 'kind': CASE WHEN k % 25 = 0 THEN 'BIGINT' ELSE 'STRING' END}], lambda x: x.field IS NOT NULL), recursive := true) FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 1)) GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*), 'corrupt' FROM orders WHERE o_orderkey % 50 = 1"),
        "status_drift": (["req"], "SELECT upper(trim(status)) AS status, count(*) AS requests FROM req WHERE upper(trim(status)) NOT IN ('O', 'F') GROUP BY ALL"),
        "column_difference": ([], "SELECT t AS table_name, c AS missing FROM (VALUES ('orders'), ('lineitem'), ('events')) x(t), (VALUES ('l_orderkey'), ('o_orderkey'), ('event_id')) y(c) WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'orders' AS t, column_name FROM (DESCRIBE orders) UNION ALL SELECT 'lineitem', column_name FROM (DESCRIBE lineitem) UNION ALL SELECT 'events', column_name FROM (DESCRIBE events)) d WHERE d.t = x.t AND d.column_name = y.c)"),
        "trend_city": (["pan"], "SELECT date, sum(requests)::BIGINT AS observed FROM pan GROUP BY 1"),
        "trend_district": (["pan"], "SELECT date, district, sum(requests)::BIGINT AS observed FROM pan WHERE date >= DATE '2001-08-01' GROUP BY ALL"),
        "trend_problem": (["pan"], "SELECT date, problem, sum(requests)::BIGINT AS observed FROM pan WHERE date >= DATE '2001-08-01' GROUP BY ALL"),
        "map_28d": (["pan"], "SELECT district, sum(requests)::BIGINT AS requests FROM pan WHERE date >= DATE '2001-11-04' - 27 GROUP BY 1"),
        "eligible_series": (["eligible"], "SELECT * FROM eligible"),
        "official_dim": (["district_parts"], ", l(b, n) AS (VALUES ('Manhattan', 12), ('Bronx', 12), ('Brooklyn', 18), ('Queens', 14), ('Staten Island', 3)), x AS (SELECT district FROM district_parts UNION SELECT b || ' ' || lpad(k::VARCHAR, 2, '0') FROM l, unnest(range(1, n + 2)) u(k)) SELECT district, regexp_replace(district, ' [^ ]*$', '') AS borough, EXISTS (SELECT 1 FROM l WHERE district = b || ' ' || lpad(least(n, greatest(1, try_cast(regexp_extract(district, '[0-9]+$') AS INT)))::VARCHAR, 2, '0')) AS official FROM x"),
        "dimensions": (["req", "district_parts"], "SELECT string_agg(DISTINCT agency, '|' ORDER BY agency) AS agencies, string_agg(DISTINCT complaint_type, '|' ORDER BY complaint_type) AS problems, string_agg(DISTINCT trim(open_data_channel_type), '|' ORDER BY trim(open_data_channel_type)) AS channels, (SELECT string_agg(DISTINCT district, '|' ORDER BY district) FROM district_parts) AS districts FROM req"),
        "signal_ids": (["pan"], f"SELECT date, district, problem, {_ID} AS id FROM pan"),
        "strip_text": (["req"], "SELECT unique_key, trim(agency_name) AS agency_name, trim(descriptor) AS descriptor FROM req"),
        "robust_baseline": (["rob"], "SELECT * FROM rob"),
        "nb_baseline": (["nb"], "SELECT date, district, problem, past_n, round(expected, 6) AS expected, round(alpha, 6) AS alpha, round(scale, 6) AS scale, past_median FROM nb"),
        "trend_baseline": (["base8"], "SELECT * FROM base8"),
        "trend_long": (["base8"], "SELECT date, district, problem, 'observed' AS kind, observed::DOUBLE AS value FROM base8 UNION ALL SELECT date, district, problem, 'baseline', baseline FROM base8 WHERE baseline IS NOT NULL"),
        "robust_alerts": (["robust"], f"SELECT {_columns(_ALERT)} FROM robust"),
        "robust_as_of": (["robust"], f"SELECT {_columns(_ALERT)} FROM robust WHERE date <= DATE '1999-06-30'"),
        "nb_alerts": (["counts"], f"SELECT {_columns(_ALERT)} FROM counts"),
        "nb_spike_alerts": (["spikes"], f"SELECT {_columns(_ALERT)} FROM spikes"),
        "shift_alerts": (["shifts"], f"SELECT {_columns(_ALERT)} FROM shifts"),
        "hybrid_alerts": (["hybrid"], f"SELECT {_columns(_ALERT)} FROM hybrid"),
        "merged_episodes": (["epi"], f"SELECT {_columns(_EPISODE)} FROM epi"),
        "ranked_signals": (["ranked"], f"SELECT {_columns(_RANKED)} FROM ranked"),
        "top_signals": (["ranked"], "SELECT place::INT AS place, id, date, district, problem, round(priority_score, 6) AS priority_score, severity FROM ranked WHERE place <= 24"),
        "recent_candidates": (["epi"], f"SELECT {_columns(_EPISODE)} FROM epi WHERE (SELECT count(*) FROM epi WHERE date >= DATE '2001-11-04' - 200) >= 40 AND date >= DATE '2001-11-04' - 200 UNION ALL SELECT {_columns(_EPISODE)} FROM (SELECT * FROM epi WHERE (SELECT count(*) FROM epi WHERE date >= DATE '2001-11-04' - 200) < 40 ORDER BY date DESC, district, problem LIMIT 80)"),
        "summary": (["ranked"], "SELECT count(*) AS signals, count(*) FILTER (WHERE severity = 'high') AS high_signals, count(DISTINCT district) AS districts FROM ranked"),
        "signal_trends": (["ranked", "base8"], _TREND.format("SELECT id, district, problem FROM ranked WHERE place <= 24")),
        "trend_lookup": (["ranked", "base8"], _TREND.format("SELECT id, district, problem FROM ranked WHERE place <= 24 AND district = 'R' AND problem = 'F' ORDER BY place LIMIT 1")),
        "trend_range": (["pan"], "SELECT date, district, sum(requests)::BIGINT AS observed FROM pan WHERE district = 'A' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' GROUP BY ALL"),
        "map_severity": (["ranked", "pan"], "SELECT t.district, t.district AS borough, t.requests, coalesce(s.severity, 'normal') AS severity FROM (SELECT district, sum(requests)::BIGINT AS requests FROM pan WHERE date >= DATE '2001-11-04' - 27 GROUP BY 1) t LEFT JOIN (SELECT district, arg_min(severity, place) AS severity FROM ranked WHERE place <= 2 GROUP BY 1) s USING (district)"),
        "signals_filtered": (["ranked"], "SELECT id, date, district, problem, round(priority_score, 6) AS priority_score, severity FROM ranked WHERE district = 'R' AND severity = 'watch' ORDER BY place LIMIT 20 OFFSET 5"),
        "signal_detail": (["ranked"], f"SELECT {_columns(_RANKED)} FROM ranked WHERE district = 'R' AND problem = 'F' AND date = DATE '1995-03-20'"),
        "district_options": (["district_parts"], "SELECT DISTINCT district FROM district_parts WHERE district LIKE 'A%'"),
        "episode_match": (["matched"], "SELECT event_id, district, problem, scenario, matched, delay_days::INT AS delay_days FROM matched"),
        "scenario_recall": (["matched"], "SELECT scenario, count(matched) / count(*) AS recall FROM matched GROUP BY 1"),
        "episode_metrics": (["met"], "SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / greatest(precision + recall, 1e-12), 6) AS f1, round(false_alerts_per_week, 6) AS false_alerts_per_week, median_detection_delay_days, true_positive, false_positive, false_negative FROM met"),
        "by_series_counts": (["matched", "epi"], "SELECT district, problem, tp, coalesce(n, 0) - tp AS fp, events - tp AS fn FROM (SELECT district, problem, count(*) AS events, count(matched) AS tp FROM matched GROUP BY ALL) LEFT JOIN (SELECT district, problem, count(*) AS n FROM epi GROUP BY ALL) USING (district, problem)"),
        "control_fp_rate": (["epi", "pan"], "SELECT e AS episodes, series, round(e / (greatest(series, 1) * greatest(days / 7.0, 1.0)) * 708, 6) AS false_alerts_per_week FROM (SELECT count(*) AS e FROM epi), (SELECT count(DISTINCT (district, problem)) AS series, (max(date) - min(date))::DOUBLE AS days FROM pan)"),
        "gate_eval": (["met", "matched"], "SELECT *, f1_ok AND false_ok AND delay_ok AND scenario_ok AS passed FROM (SELECT 2 * precision * recall / greatest(precision + recall, 1e-12) >= 0.8 AS f1_ok, false_alerts_per_week <= 5 AS false_ok, median_detection_delay_days <= 2 AS delay_ok, (SELECT min(r) FROM (SELECT count(matched) / count(*) AS r FROM matched GROUP BY scenario)) >= 0.7 AS scenario_ok FROM met)"),
        "km_closure": (["fct"], ", o AS (SELECT agency, CASE WHEN is_closed THEN resolution_days ELSE (DATE '2003-01-01' - created_date)::DOUBLE END AS t, is_closed AS e FROM fct WHERE NOT is_closed OR resolution_days >= 0), c AS (SELECT agency, t, count(*) AS n, count(*) FILTER (WHERE e) AS d FROM o GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY agency ORDER BY t DESC) AS risk FROM c) SELECT agency, round(1 - product(CASE WHEN t <= 400 THEN 1 - d / risk ELSE 1 END), 6) AS closure_probability FROM r GROUP BY 1"),
        "km_closure_all": (["fct"], ", o AS (SELECT CASE WHEN is_closed THEN resolution_days ELSE (DATE '2003-01-01' - created_date)::DOUBLE END AS t, is_closed AS e FROM fct WHERE NOT is_closed OR resolution_days >= 0), c AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE e) AS d FROM o GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS risk FROM c) SELECT round(1 - product(CASE WHEN t <= 400 THEN 1 - d / risk ELSE 1 END), 6) AS closure_probability FROM r"),
        "series_template": (["template", "weekday_level"], "SELECT district, problem, round(level, 6) AS level, round(alpha, 6) AS alpha, " + ", ".join(f"(SELECT m FROM weekday_level w WHERE w.district = t.district AND w.problem = t.problem AND k = {k}) AS day_{k}" for k in range(7)) + " FROM template t"),
        "winsorize": (["pan"], "SELECT date, district, problem, round(low, 6) AS low, round(high, 6) AS high, round(least(greatest(requests::DOUBLE, low), high), 6) AS clipped FROM pan JOIN (SELECT district, problem, quantile_cont(requests::DOUBLE, 0.05) AS low, quantile_cont(requests::DOUBLE, 0.95) AS high FROM pan GROUP BY ALL) USING (district, problem)"),
        "quiet_offsets": (["template", "weekday_level"], "SELECT date, district, problem FROM (SELECT date, district, problem, count(*) FILTER (WHERE requests < 1.5 * m AND requests < m + 3.0 * sqrt(m + alpha * m * m)) OVER (PARTITION BY district, problem ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n FROM pan JOIN template USING (district, problem) JOIN weekday_level w USING (district, problem) WHERE w.k = isodow(date) - 1) WHERE n = 7"),
        "strata_plan": (["eligible"], ", e AS (SELECT district, problem, row_number() OVER (ORDER BY district, problem) - 1 AS p, count(*) OVER () AS n FROM eligible), x AS (SELECT i::INT AS i, district, problem, ['spike', 'level_shift', 'gradual_ramp'][(i % 3 + 1)::INT] AS scenario FROM range(60) r(i) JOIN e ON p = i % n) SELECT i, district, problem, scenario, CASE WHEN scenario = 'spike' THEN 1 ELSE [3, 7, 14][((i // 3) % 3 + 1)::INT] END::INT AS duration, (CASE scenario WHEN 'spike' THEN [2.75, 3.5, 5.0] WHEN 'level_shift' THEN [1.75, 2.0, 2.5] ELSE [1.75, 2.25, 3.0] END)[((i // 9) % 3 + 1)::INT]::DOUBLE AS strength, ['negative_binomial', 'weekly_block_bootstrap'][(i % 2 + 1)::INT] AS generator FROM x"),
        "control_pool": (["robust", "pan"], "SELECT district, problem, date, requests AS observed FROM pan ANTI JOIN robust USING (district, problem, date) WHERE date = DATE '2001-03-14'"),
        "review_points": (["ranked", "pan"], "SELECT id, r.district, r.problem, r.date AS index_date, p.date, requests AS observed FROM ranked r JOIN pan p ON p.district = r.district AND p.problem = r.problem AND p.date > r.date - 42 AND p.date <= r.date WHERE place <= 20"),
        "review_cases": (["ranked"], "SELECT 'REV-' || upper(substr(sha256('311|' || g || '|' || district || '|' || problem || '|' || date::VARCHAR), 1, 10)) AS case_id, substr(sha256('311|' || g), 1, 12) AS group_token, district, problem, date AS index_date FROM (SELECT *, CASE WHEN place <= 20 THEN 'top20' ELSE 'near_threshold' END AS g FROM ranked WHERE place <= 40)"),
        "review_score": ([], "SELECT CASE WHEN p / 20.0 >= 0.65 THEN 'passed' ELSE 'failed' END AS status, n AS sample_size, p AS top20_positive, round(p / 20.0::DOUBLE, 3) AS precision_at_20, round(e / 60.0::DOUBLE, 3) AS externally_correlated_rate FROM (SELECT count(*) AS n, count(*) FILTER (WHERE k <= 20 AND o_orderkey % 4 < 2) AS p, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS e FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders QUALIFY k <= 60))"),
    }
    out = {}
    for name, (parts, body) in q.items():
        out[name] = _with(parts, body)
    boards = "SELECT DISTINCT community_board FROM req UNION ALL VALUES (' 05 brooklyn '), ('Unspecified BRONX'), ('0 Unspecified'), ('QUEENS'), ('7  STATEN ISLAND'), ('012 QUEENS'), ('A1 BRONX')"
    out["parse_district_boards"] = _with(["district_parts"], "SELECT * FROM district_parts").replace(f"boards AS ({_PARTS['boards']})", f"boards AS ({boards})")
    return out
