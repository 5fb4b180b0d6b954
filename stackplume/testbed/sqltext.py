"""Shared pieces of the DuckDB oracles: named common table expressions and expression texts."""

from __future__ import annotations

from stackplume import constants as C
from stackplume.testbed.fixtures import FACTORIES, READINGS


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    arc = (
        f"(power(sin(radians({lat2}-({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*power(sin(radians({lon2}-({lon1}))/2),2))"
    )
    return f"(2*6371.0e0*atan2(sqrt({arc}),sqrt(1-{arc})))"


def num(value: float) -> str:
    return f"{value!r}e0" if "e" not in repr(value) else repr(value)


def even(x: str, places: int) -> str:
    """Half-even rounding of the printed decimal value, as the jobs do it."""
    return f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)),{places}) AS DOUBLE)"


def half_up(x: str, places: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)),{places}) AS DOUBLE)"


def band_sql(column: str, pollutant: str) -> str:
    g, m, p, s = (num(x) for x in C.RISK_THRESHOLDS[pollutant])
    v = column
    return (
        f"CASE WHEN {v} IS NULL THEN NULL WHEN {v}<={g} THEN 2*{v}/{g} WHEN {v}<={m} THEN 2+3*({v}-{g})/({m}-{g}) "
        f"WHEN {v}<={p} THEN 5+3*({v}-{m})/({p}-{m}) WHEN {v}<={s} THEN 8+2*({v}-{p})/({s}-{p}) ELSE 10e0 END"
    )


def national_sql(x: str) -> str:
    text = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x}<=0 THEN 0e0"
    for c_lo, c_hi, i_lo, i_hi in C.NATIONAL_PM25_BANDS:
        text += f" WHEN {x}<={num(c_hi)} THEN {num(i_hi - i_lo)}/{num(c_hi - c_lo)}*({x}-{num(c_lo)})+{num(i_lo)}"
    return text + " ELSE 500e0 END"


def epa_sql(x: str, bands) -> str:
    text = f"CASE WHEN {x} IS NULL THEN NULL"
    for upper, base, lower, span, width in bands:
        text += f" WHEN {x}<={num(upper)} THEN CAST(trunc({num(base)}+({num(span)}/{num(width)})*({x}-{num(lower)})) AS BIGINT)"
    return text + " ELSE 500 END"


def epa25_sql(x: str = "pm25") -> str:
    return epa_sql(f"(trunc({x}*10)/10e0)", C.EPA_PM25_BANDS)


def epa10_sql(x: str = "pm10") -> str:
    return epa_sql(f"trunc({x})", C.EPA_PM10_BANDS)


def ladder_sql(x: str, steps, last: str, op: str = "<=") -> str:
    text = f"CASE WHEN {x} IS NULL THEN NULL"
    for bound, label in steps:
        text += f" WHEN {x}{op}{bound} THEN '{label}'"
    return text + f" ELSE '{last}' END"


def epa_category_sql(x: str) -> str:
    return ladder_sql(x, C.EPA_CATEGORIES, C.EPA_LAST_CATEGORY)


def band_name_sql(x: str) -> str:
    return ladder_sql(x, [(b, n) for b, n, _ in C.NATIONAL_BANDS], C.NATIONAL_LAST_BAND[0])


def band_colour_sql(x: str) -> str:
    return ladder_sql(x, [(b, c) for b, _, c in C.NATIONAL_BANDS], C.NATIONAL_LAST_BAND[1])


def title_sql(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def case_sql(x: str, mapping: dict, default: str) -> str:
    text = f"CASE {x}"
    for key, value in mapping.items():
        shown = f"'{quote(value)}'" if isinstance(value, str) else num(float(value)) if isinstance(value, float) else str(value)
        text += f" WHEN '{quote(str(key))}' THEN {shown}"
    return text + f" ELSE {default} END"


def quote(text: str) -> str:
    return text.replace("'", "''")


def values_sql(rows, names: str, alias: str) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        return f"'{quote(v)}'" if isinstance(v, str) else num(v) if isinstance(v, float) else str(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) AS {alias}({names}))"


P = C.POLLUTANTS
PL = ", ".join(P)
_score_case = ", ".join(f"{band_sql(p, p)} AS {p}_score" for p in C.SCORED_POLLUTANTS)
_weights = "+".join(f"CASE WHEN {p}_score IS NULL THEN 0e0 ELSE {num(C.RISK_WEIGHTS[p])} END" for p in C.SCORED_POLLUTANTS)
_weighted = "+".join(f"coalesce({num(C.RISK_WEIGHTS[p])}*{p}_score,0e0)" for p in C.SCORED_POLLUTANTS)
_greatest = "greatest(" + ", ".join(f"{p}_score" for p in C.SCORED_POLLUTANTS) + ")"
_dominant = (
    f"CASE WHEN {_greatest} IS NULL THEN 'Unknown' "
    + " ".join(f"WHEN {p}_score={_greatest} THEN '{p}'" for p in C.SCORED_POLLUTANTS)
    + " END"
)
LEVEL = ladder_sql("composite_score", [(3, "Low"), (6, "Medium"), (8, "High")], "Critical", "<")


def _scored(source: str) -> str:
    return (
        f"SELECT *, CASE WHEN composite_score IS NULL THEN 'Unknown' ELSE {LEVEL} END AS risk_level, {_dominant} AS dominant_pollutant "
        f"FROM (SELECT *, CASE WHEN ({_weights})>0 THEN ({_weighted})/({_weights}) END AS composite_score "
        f"FROM (SELECT *, {_score_case} FROM {source}))"
    )


def _matched(order: str, max_km: float = 100) -> str:
    return (
        "SELECT f.*, "
        + ", ".join(f"CASE WHEN d.city IS NOT NULL THEN d.{p} WHEN m.city IS NOT NULL THEN m.{p} ELSE n.{p} END AS {p}" for p in P)
        + ", CASE WHEN d.city IS NOT NULL THEN 'station' WHEN m.city IS NOT NULL THEN 'city' ELSE 'national' END AS match_tier "
        "FROM factories f "
        f"LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY {order}) AS rn FROM near_city WHERE nearest_factory_distance_km<={max_km}) WHERE rn=1) d ON d.city=f.city "
        f"LEFT JOIN (SELECT city, {', '.join(f'avg({p}) AS {p}' for p in P)} FROM near_city GROUP BY city) m ON m.city=f.city "
        f"CROSS JOIN (SELECT {', '.join(f'avg({p}) AS {p}' for p in P)} FROM near_city) n"
    )


_high = {p: f"coalesce({p}_score>6,false)" for p in C.SCORED_POLLUTANTS}
_rule_when = (
    f"(r.condition='so2' AND {_high['so2']}) OR (r.condition='pm' AND ({_high['pm25']} OR {_high['pm10']})) "
    f"OR (r.condition='pm10' AND {_high['pm10']}) OR (r.condition='no2' AND {_high['no2']}) OR (r.condition='co' AND {_high['co']}) "
    f"OR (r.condition='o3' AND {_high['o3']}) "
    f"OR (r.condition='multiple' AND (({'+'.join(f'CAST({h} AS INT)' for h in _high.values())})>1 OR coalesce(composite_score>6,false))) "
    "OR r.condition='level:'||risk_level "
    f"OR r.condition='industry:'||{case_sql('lower(industry_type)', C.INDUSTRY_RULE_GROUPS, chr(39) + 'other' + chr(39))}"
)
PRIORITY_RANK = "CASE priority WHEN 'Immediate' THEN 0 WHEN 'Short-term' THEN 1 WHEN 'Long-term' THEN 2 ELSE 3 END"
_joined_priority = lambda p, n: f"coalesce(string_agg(CASE WHEN priority='{p}' THEN action END, ' | ' ORDER BY action),'') AS {n}"

CTES: dict[str, tuple[list[str], str]] = {
    "factories": ([], FACTORIES),
    "readings": ([], READINGS),
    "keyed": (["factories"], "SELECT *, CAST(regexp_extract(factory_id,'([0-9]+)',1) AS BIGINT) AS k FROM factories"),
    "readings_aqi": (
        ["readings"],
        "SELECT *, CASE WHEN pm25 IS NOT NULL AND pm10 IS NOT NULL THEN (pm25+pm10)/2 ELSE coalesce(pm25,pm10) END AS aqi_index FROM readings",
    ),
    "readings_dup": (
        ["readings"],
        "SELECT * FROM readings UNION ALL SELECT * REPLACE (event_id+1000000000 AS event_id) FROM readings WHERE event_id%10=0",
    ),
    "site_distance": (
        ["readings", "factories"],
        "SELECT s.station_lat, s.station_lon, s.city, min("
        + hav("s.station_lat", "s.station_lon", "f.latitude", "f.longitude")
        + ") AS d FROM (SELECT DISTINCT station_lat, station_lon, city FROM readings WHERE station_lat IS NOT NULL) s "
        "JOIN factories f ON f.city=s.city OR s.city NOT IN (SELECT city FROM factories) GROUP BY ALL",
    ),
    "near_city": (
        ["readings_aqi", "site_distance"],
        "SELECT r.*, s.d AS nearest_factory_distance_km FROM readings_aqi r JOIN site_distance s USING (station_lat, station_lon, city) WHERE s.d<=50",
    ),
    "joined": (
        ["readings", "factories"],
        "SELECT r.event_id, r.timestamp, r.station_name, r.station_lat, r.station_lon, r.source, "
        + ", ".join(f"r.{p}" for p in P)
        + ", f.*, s.d AS distance_to_nearest_station FROM readings r JOIN ("
        "SELECT station_lat, station_lon, factory_id, d FROM (SELECT *, row_number() OVER (PARTITION BY station_lat, station_lon ORDER BY d, factory_id) AS rn "
        "FROM (SELECT s.station_lat, s.station_lon, f.factory_id, "
        + hav("s.station_lat", "s.station_lon", "f.latitude", "f.longitude")
        + " AS d FROM (SELECT DISTINCT station_lat, station_lon FROM readings WHERE station_lat IS NOT NULL) s CROSS JOIN factories f)) WHERE rn=1) s "
        "USING (station_lat, station_lon) JOIN factories f ON f.factory_id=s.factory_id",
    ),
    "targets": (
        ["joined"],
        "SELECT * EXCLUDE (ws, p95), CASE WHEN ws/p95*10<0 THEN 0e0 WHEN ws/p95*10>10 THEN 10e0 ELSE ws/p95*10 END AS pollution_impact_score FROM "
        "(SELECT *, quantile_cont(ws,0.95) OVER () AS p95 FROM (SELECT *, "
        + "+".join(f"{p}*{num(C.TARGET_WEIGHTS[p])}" for p in ("pm25", "pm10", "no2", "so2", "co", "o3"))
        + " AS ws FROM joined))",
    ),
    "features": (
        ["targets"],
        "SELECT *, CAST(coalesce(CASE WHEN (pm25-avg(pm25) OVER ())/stddev_samp(pm25) OVER ()>2.5 THEN 1 ELSE 0 END,0) AS INTEGER) AS pollution_spike_flag, "
        "CASE WHEN month(timestamp) IN (12,1,2) THEN 'winter' WHEN month(timestamp) IN (3,4,5) THEN 'summer' WHEN month(timestamp) IN (6,7,8) THEN 'monsoon' ELSE 'post_monsoon' END AS season, "
        f"{case_sql('lower(industry_type)', C.INDUSTRY_RISK_WEIGHT, '6')} AS industry_risk_weight, "
        "avg(pm25) OVER (PARTITION BY factory_id ORDER BY timestamp, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r7, "
        "avg(pm25) OVER (PARTITION BY factory_id ORDER BY timestamp, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS r30 FROM targets",
    ),
    "binned": (
        ["features"],
        "SELECT f.*, CASE WHEN pollution_impact_score IS NOT NULL THEN "
        "len(list_filter(list_distinct([q[2],q[3],q[4],q[5]]), lambda e: e>q[1] AND pollution_impact_score>e)) END AS target_bin "
        "FROM features f CROSS JOIN (SELECT quantile_cont(pollution_impact_score,[0.0,0.2,0.4,0.6,0.8]) AS q FROM features)",
    ),
    "split": (
        ["binned"],
        "SELECT *, CASE WHEN pollution_impact_score IS NULL THEN NULL WHEN share<0.15 THEN 'test' WHEN share<0.15+0.15 THEN 'val' ELSE 'train' END AS split FROM ("
        "SELECT *, (row_number() OVER (PARTITION BY target_bin ORDER BY md5('42:'||event_id), event_id)-1)/CAST(count(*) OVER (PARTITION BY target_bin) AS DOUBLE) AS share FROM binned)",
    ),
    "monthly": (
        ["targets"],
        "SELECT factory_id, industry_type, city, CAST(2020+(event_id%36)//12 AS INTEGER) AS year, CAST((event_id%36)%12+1 AS INTEGER) AS month, "
        + ", ".join(f"avg({c}) AS {c}" for c in ["pollution_impact_score", *P])
        + " FROM targets WHERE pollution_impact_score IS NOT NULL GROUP BY ALL",
    ),
    "matched": (["near_city", "factories"], _matched("nearest_factory_distance_km, event_id")),
    "matched_first": (["near_city", "factories"], _matched("timestamp, event_id")),
    "matched_tight": (["near_city", "factories"], _matched("nearest_factory_distance_km, event_id", 2)),
    "scored": (["matched"], _scored("matched")),
    "scored_first": (["matched_first"], _scored("matched_first")),
    "rules": ([], "SELECT * FROM " + values_sql([(i, *r) for i, r in enumerate(C.RULES)], "rule_no, " + ", ".join(C.RULE_COLUMNS), "t")),
    "actions": (
        ["scored", "rules"],
        f"SELECT s.factory_id, r.* FROM scored s JOIN rules r ON {_rule_when}",
    ),
    "reports": (
        ["scored", "actions"],
        "SELECT s.* REPLACE (coalesce(composite_score,0e0) AS composite_score, "
        + ", ".join(f"coalesce({p}_score,0e0) AS {p}_score" for p in C.SCORED_POLLUTANTS)
        + f"), a.*, printf('%s is classified as %s risk with composite score %.2f. Top action: %s.', s.factory_name, s.risk_level, coalesce(s.composite_score,0e0), a.top_action) AS summary, "
        "'2024-02-01T00:00:00+00:00' AS generated_at FROM scored s JOIN (SELECT factory_id AS fid, "
        f"arg_min(action, {PRIORITY_RANK}*1000+order_no) AS top_action, count(*) AS n_actions, string_agg(action, ' > ' ORDER BY {PRIORITY_RANK}, action) AS all_actions, "
        + ", ".join([
            _joined_priority("Immediate", "immediate_actions"), _joined_priority("Short-term", "short_term_actions"),
            _joined_priority("Long-term", "long_term_actions"),
        ])
        + f", coalesce(string_agg(CASE WHEN category='Monitoring' THEN action END, ' | ' ORDER BY {PRIORITY_RANK}, action),'') AS monitoring_actions "
        "FROM (SELECT *, row_number() OVER (PARTITION BY factory_id ORDER BY action) AS order_no FROM actions) GROUP BY factory_id) a ON a.fid=s.factory_id",
    ),
    "advice": (
        ["targets"],
        "SELECT *, CASE WHEN pollution_impact_score<=3 THEN 'Low' WHEN pollution_impact_score<=6 THEN 'Medium' WHEN pollution_impact_score>6 THEN 'High' END AS risk_level FROM ("
        "SELECT factory_id, factory_name, industry_type, latitude, longitude, city, state, country, avg(pollution_impact_score) AS pollution_impact_score, "
        "avg(pm25) AS latest_pm25, avg(pm10) AS latest_pm10 FROM targets GROUP BY ALL)",
    ),
    "measurements": (
        ["readings"],
        " UNION ALL ".join(
            f"SELECT event_id*6+{i} AS seq, event_id, station_name, station_lat, station_lon, city, timestamp, '{p}' AS parameter, {p} AS value FROM readings"
            for i, p in enumerate(P)
        )
        + " UNION ALL SELECT event_id*6+1000000000, event_id, station_name, station_lat, station_lon, city, timestamp, 'pm25', pm25+1 FROM readings WHERE event_id%10=0",
    ),
}


def _needed(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(CTES[name][0], seen)
            seen.append(name)
    return seen


def sql(names: str, body: str, extra: str = "") -> str:
    """``body`` with the named expressions (and what they need) in front; ``extra`` adds more definitions."""
    parts = [f"{n} AS ({CTES[n][1]})" for n in _needed(names.split(), [])]
    if extra:
        parts.append(extra)
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def r6(columns: str) -> str:
    return ", ".join(f"round({c},6) AS {c}" for c in columns.replace(",", " ").split())
