"""Independent DuckDB SQL for every SQL-expressible registered query.

Written directly from the operator definitions (single-window forms where
the Spark side uses bounded/two-level constructions), over the raw driver
views.  Double outputs are rounded to 9 decimals like the Spark side.
"""

from __future__ import annotations

ND = 9

READINGS = """readings AS (
  SELECT min(event_id) AS row_id, user_id AS building_id, event_type AS meter,
         date_trunc('hour', ts) AS "timestamp", CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS meter_reading
  FROM events GROUP BY user_id, event_type, date_trunc('hour', ts))"""

LOG_READINGS = READINGS + """,
log_readings AS (
  SELECT row_id, building_id, meter, "timestamp",
         CASE WHEN meter_reading > -1 THEN ln(1 + meter_reading) END AS meter_reading
  FROM readings)"""

BAD = """bad AS (SELECT event_id AS pos FROM events WHERE value < 1)"""

BUILDINGS = """buildings AS (
  SELECT c.c_nationkey AS site_id, c.c_custkey AS building_id, c.c_mktsegment AS primary_use,
         c.c_acctbal AS square_feet, CAST(n.n_regionkey AS DOUBLE) AS floor_count
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

RAW_WEATHER = """raw_weather AS (
  SELECT l_orderkey % 25 AS site_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((l_partkey * 7 + l_linenumber * 131 + l_orderkey) % 720 AS INTEGER)) AS "timestamp",
         avg(l_quantity) - 10 AS air_temperature,
         stddev_samp(l_quantity) / 2 AS cloud_coverage,
         min(l_quantity) - 12 AS dew_temperature,
         max(l_quantity) - min(l_quantity) AS precip_depth_1_hr,
         max(l_extendedprice) AS sea_level_pressure,
         avg(l_partkey % 360) AS wind_direction,
         CAST(count(*) AS DOUBLE) AS wind_speed
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"""

ORDER_READINGS = """order_readings AS (
  SELECT o_orderkey AS row_id, o_custkey AS building_id, o_orderpriority AS meter,
         o_orderdate AS "timestamp", o_totalprice / 1000 AS meter_reading FROM orders)"""

WCOLS = ["air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr",
         "sea_level_pressure", "wind_direction", "wind_speed"]

FILLED = RAW_WEATHER + """,
wbounds AS (SELECT min("timestamp") AS lo, max("timestamp") AS hi FROM raw_weather),
wsites AS (SELECT DISTINCT site_id FROM raw_weather),
spine AS (SELECT s.site_id, unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS "timestamp"
          FROM wsites s, wbounds b),
missing AS (SELECT sp.site_id, sp."timestamp" FROM spine sp
            WHERE NOT EXISTS (SELECT 1 FROM raw_weather w
                              WHERE w.site_id = sp.site_id AND w."timestamp" = sp."timestamp")),
filled AS (
  SELECT site_id, "timestamp", """ + ", ".join(WCOLS) + """ FROM raw_weather
  UNION ALL
  SELECT site_id, "timestamp", """ + ", ".join("CAST(NULL AS DOUBLE)" for _ in WCOLS) + """ FROM missing)"""

MEAN_COLS = ["air_temperature", "dew_temperature", "wind_direction", "wind_speed"]
FFILL_COLS = ["cloud_coverage", "precip_depth_1_hr", "sea_level_pressure"]

IMPUTED = FILLED + """,
gm AS (SELECT site_id, day("timestamp") AS d, month("timestamp") AS m, """ + \
    ", ".join(f"avg({c}) AS {c}" for c in WCOLS) + """
       FROM filled GROUP BY 1, 2, 3),
gmf AS (SELECT site_id, d, m, """ + ", ".join(f"last_value({c} IGNORE NULLS) OVER k AS {c}" for c in FFILL_COLS) + """
        FROM gm WINDOW k AS (ORDER BY site_id, d, m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
wimp AS (
  SELECT f.site_id, f."timestamp", """ + ", ".join(
    f"coalesce(f.{c}, {'g' if c in MEAN_COLS else 'h'}.{c}) AS {c}" for c in WCOLS) + """
  FROM filled f
  LEFT JOIN gm g ON g.site_id = f.site_id AND g.d = day(f."timestamp") AND g.m = month(f."timestamp")
  LEFT JOIN gmf h ON h.site_id = f.site_id AND h.d = day(f."timestamp") AND h.m = month(f."timestamp"))"""


def lit(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def magnus(t: str, d: str) -> str:
    a, b = lit(17.625), lit(243.04)
    return f"({lit(100.0)} * exp({a} * {d} / ({b} + {d})) / exp({a} * {t} / ({b} + {t})))"


def base10(t: str, d: str) -> str:
    e0, a, b = lit(6.11), lit(7.5), lit(237.7)
    e = f"({e0} * pow({lit(10.0)}, {a} * {d} / ({b} + {d})))"
    es = f"({e0} * pow({lit(10.0)}, {a} * {t} / ({b} + {t})))"
    return f"({e} / {es} * {lit(100.0)})"


def feels(t: str, rh: str, v: str) -> str:
    tf = f"({t} * {lit(1.8)} + {lit(32.0)})"
    vp = f"pow({v}, {lit(0.16)})"
    chill = f"((({lit(35.74)} + {lit(0.6215)} * {tf}) - {lit(35.75)} * {vp}) + {lit(0.4275)} * {tf} * {vp})"
    simple = (f"({lit(0.5)} * ((({tf} + {lit(61.0)}) + ({tf} - {lit(68.0)}) * {lit(1.2)})"
              f" + {rh} * {lit(0.094)}))")
    c = [lit(x) for x in (-42.379, 2.04901523, 10.14333127, -0.22475541, -6.83783e-3,
                          -5.481717e-2, 1.22874e-3, 8.5282e-4, -1.99e-6)]
    t2, r2 = f"({tf} * {tf})", f"({rh} * {rh})"
    full = (f"(((((((({c[0]} + {c[1]} * {tf}) + {c[2]} * {rh}) + {c[3]} * {tf} * {rh}) + {c[4]} * {t2})"
            f" + {c[5]} * {r2}) + {c[6]} * {t2} * {rh}) + {c[7]} * {tf} * {r2}) + {c[8]} * {t2} * {r2})")
    low = (f"(({lit(13.0)} - {rh}) / {lit(4.0)} * sqrt(({lit(17.0)} - abs({tf} - {lit(95.0)})) / {lit(17.0)}))")
    high = f"(({rh} - {lit(85.0)}) / {lit(10.0)} * (({lit(87.0)} - {tf}) / {lit(5.0)}))"
    adj = (f"(CASE WHEN {rh} < 13 AND {tf} <= 112 THEN {full} - {low} "
           f"WHEN {rh} > 85 AND {tf} <= 87 THEN {full} + {high} ELSE {full} END)")
    hi = f"(CASE WHEN {simple} >= 80 THEN {adj} ELSE {simple} END)"
    return f"(CASE WHEN {tf} <= 50 AND {v} > 3 THEN {chill} WHEN {tf} >= 80 THEN {hi} ELSE {tf} END)"


WF = IMPUTED + """,
wrh AS (SELECT *, """ + magnus("air_temperature", "dew_temperature") + """ AS relative_humidity FROM wimp),
wfl AS (SELECT *, """ + feels("air_temperature", "relative_humidity", "wind_speed") + """ AS feels_like FROM wrh),
wf AS (SELECT *, lead(air_temperature, 1) OVER s AS air_temperature_lead1,
              lead(air_temperature, 2) OVER s AS air_temperature_lead2,
              lead(air_temperature, 3) OVER s AS air_temperature_lead3
       FROM wfl WINDOW s AS (PARTITION BY site_id ORDER BY "timestamp"))"""

BUILDING_FEATURES = BUILDINGS + """,
pu AS (SELECT primary_use, CAST(dense_rank() OVER (ORDER BY primary_use) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT primary_use FROM buildings WHERE primary_use IS NOT NULL)),
b1 AS (SELECT b.site_id, b.building_id, p.code AS primary_use, b.floor_count,
              CASE WHEN b.site_id IN (1) AND b.building_id NOT IN (150, 106)
                   THEN b.square_feet * """ + lit(10.7639) + """ ELSE b.square_feet END AS sqft
       FROM buildings b LEFT JOIN pu p ON b.primary_use = p.primary_use),
bf AS (SELECT site_id, building_id, primary_use, floor_count,
              CASE WHEN sqft > -1 THEN ln(1 + sqft) END AS square_feet,
              CASE WHEN ratio > -1 THEN ln(1 + ratio) END AS square_feet_floor
       FROM (SELECT *, CASE WHEN floor_count = 0 THEN sqft ELSE sqft / floor_count END AS ratio FROM b1))"""


def holidays_sql(dates) -> str:
    return ", ".join(f"DATE '{x}'" for x in dates)


def kfold(n_expr: str, pos: str, k: int) -> str:
    """Contiguous fold of position ``pos`` among n rows (first n mod k folds one larger)."""
    q = f"({n_expr} // {k})"
    r = f"({n_expr} - {q} * {k})"
    big = f"({r} * ({q} + 1))"
    return (f"CAST(CASE WHEN {pos} < {big} THEN {pos} // ({q} + 1) "
            f"ELSE {r} + ({pos} - {big}) // greatest({q}, 1) END AS INTEGER)")


FOLDED = LOG_READINGS + """,
folded AS (
  SELECT *, """ + kfold("n", "pos", 3) + """ AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos, count(*) OVER () AS n
        FROM log_readings))"""


def oof_cte(name: str, src: str, keys: list[str], out: str = "oof") -> str:
    """Leave-fold-out group mean, direct form: for each row, mean over other folds."""
    kc = ", ".join(keys)
    on = " AND ".join(f"a.{k} = g.{k}" for k in keys)
    return f"""{name} AS (
  SELECT a.*, CASE WHEN g.n > 0 THEN g.s / g.n ELSE fm.m END AS {out}
  FROM {src} a
  LEFT JOIN (SELECT x.{', x.'.join(keys)}, f.fold, count(x.meter_reading) AS n, sum(x.meter_reading) AS s
             FROM (SELECT DISTINCT fold FROM {src}) f JOIN {src} x ON x.fold <> f.fold
             GROUP BY {', '.join('x.' + k for k in keys)}, f.fold) g ON {on} AND g.fold = a.fold
  LEFT JOIN (SELECT f.fold, avg(x.meter_reading) AS m
             FROM (SELECT DISTINCT fold FROM {src}) f JOIN {src} x ON x.fold <> f.fold
             GROUP BY f.fold) fm ON fm.fold = a.fold)""".replace("{kc}", kc)


OOF = FOLDED + ",\n" + oof_cte("oof_t", "folded", ["building_id", "meter"])

THREE = FOLDED + """,
folded_h AS (SELECT *, hour("timestamp") AS hour FROM folded),
""" + oof_cte("m1", "folded", ["building_id", "meter"], "p1") + ",\n" + \
    oof_cte("m2", "folded_h", ["meter", "hour"], "p2") + ",\n" + \
    oof_cte("m3", "folded", ["building_id"], "p3") + """,
three AS (SELECT m1.row_id, m1.p1, m2.p2, m3.p3 FROM m1 JOIN m2 USING (row_id) JOIN m3 USING (row_id))"""


def rnd(sql: str, cols: list[str]) -> str:
    """Round the named double columns of a query to ND decimals."""
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, {ND}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) q"


def w(ctes: str, body: str, dbl: list[str]) -> str:
    return rnd(f"WITH {ctes}\n{body}", dbl)


RCOLS = 'row_id, building_id, meter, "timestamp", meter_reading'
WOUT = 'site_id, "timestamp", ' + ", ".join(WCOLS)
INTERP = ["air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr"]
ROLL = ["mean", "median", "min", "max", "std", "skew"]
CAL = ('o_orderkey AS row_id, o_orderdate AS "timestamp"')


def _interp_sql(base: str = None, src: str = "filled") -> str:
    parts = []
    for c in INTERP:
        pv = f"last_value({c} IGNORE NULLS) OVER bk"
        pi = f"last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER bk"
        nv = f"first_value({c} IGNORE NULLS) OVER fw"
        ni = f"first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER fw"
        parts.append(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN ({pv}) IS NULL THEN {nv} "
                     f"WHEN ({nv}) IS NULL THEN {pv} "
                     f"ELSE ({pv}) + (({nv}) - ({pv})) * (i - ({pi})) / (({ni}) - ({pi})) END AS {c}")
    return (FILLED if base is None else base) + """,
numbered AS (SELECT site_id, "timestamp", """ + ", ".join(INTERP) + """,
                    row_number() OVER (PARTITION BY site_id ORDER BY "timestamp") AS i FROM """ + src + """),
interp AS (SELECT site_id, "timestamp", """ + ",\n  ".join(parts) + """
  FROM numbered
  WINDOW bk AS (PARTITION BY site_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         fw AS (PARTITION BY site_id ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


INTERPOLATED = _interp_sql()


def _rolling_cols() -> tuple[str, list[str]]:
    out, names = [], []
    for c in INTERP:
        for s in ROLL:
            fn = {"mean": f"avg({c})", "median": f"median({c})", "min": f"min({c})",
                  "max": f"max({c})", "std": f"stddev_samp({c})", "skew": f"skewness({c})"}[s]
            name = f"{c}_{s}_lag18"
            if s == "skew":
                out.append(f"CASE WHEN count({c}) OVER r >= 3 THEN {fn} OVER r END AS {name}")
            else:
                out.append(f"{fn} OVER r AS {name}")
            names.append(name)
    return ", ".join(out), names


_ROLL_SQL, ROLL_NAMES = _rolling_cols()

BUILD_DBL = ["square_feet", "floor_count", "square_feet_floor"]
WF_DBL = WCOLS + ["relative_humidity", "feels_like", "air_temperature_lead1",
                  "air_temperature_lead2", "air_temperature_lead3"]
TRAIN_WF = [c for c in WF_DBL if c not in ("sea_level_pressure", "wind_direction", "wind_speed")]
CAL_FEATURES = ("CAST(hour(\"timestamp\") AS INTEGER) AS hour, "
                "CAST(CASE WHEN isodow(\"timestamp\") - 1 IN (1, 2, 3) THEN 1 ELSE isodow(\"timestamp\") - 1 END AS INTEGER) AS day_of_week, "
                "CAST(dayofyear(\"timestamp\") AS INTEGER) AS year_day, "
                "CAST(coalesce(CAST(\"timestamp\" AS DATE) IN ({hol}), false) AS INTEGER) AS is_holiday, "
                "CAST(CASE WHEN month(\"timestamp\") IN (12, 1, 2) THEN 1 WHEN month(\"timestamp\") IN (3, 4, 5) THEN 2 "
                "WHEN month(\"timestamp\") IN (6, 7, 8) THEN 3 WHEN month(\"timestamp\") IN (9, 10, 11) THEN 4 "
                "ELSE month(\"timestamp\") END AS INTEGER) AS month, "
                "CAST(CASE WHEN month(\"timestamp\") IN (1, 2, 3, 4) THEN 1 WHEN month(\"timestamp\") IN (5, 6, 7, 8) THEN 2 "
                "WHEN month(\"timestamp\") IN (9, 10, 11, 12) THEN 3 ELSE month(\"timestamp\") END AS INTEGER) AS \"group\"")


def te_sql(n: str, m: str, prior: str) -> str:
    s = f"(1.0 / (1.0 + exp(-({n} - 1) / 1.0)))"
    return f"(CASE WHEN {n} = 1 THEN {prior} ELSE {prior} * (1 - {s}) + {m} * {s} END)"


def build(holidays, params) -> dict[str, str]:
    hol = holidays_sql(holidays)
    cal = CAL_FEATURES.replace("{hol}", hol)
    excl = params["excluded_building"]
    st = params["startup"]
    cut = params["train_cut"]
    y0, y1 = params["holdout_years"]
    meter = params["meter"]
    q: dict[str, str] = {}

    q["scan_readings"] = w(READINGS, "SELECT * FROM readings", ["meter_reading"])
    q["scan_limit"] = w(READINGS, "SELECT * FROM readings ORDER BY row_id LIMIT 1000", ["meter_reading"])
    q["preview"] = w(READINGS, "SELECT count(*) AS n_rows, 5 AS n_cols FROM readings", [])
    q["sink_fixed_decimals"] = w(OOF, "SELECT row_id, printf('%.4f', exp(oof) - 1) AS meter_reading FROM oof_t", [])
    q["sink_csv"] = w(OOF, "SELECT row_id, exp(oof) - 1 AS meter_reading FROM oof_t", ["meter_reading"])
    q["scan_csv"] = q["scan_feather"] = w(READINGS, 'SELECT row_id, building_id, meter, "timestamp", meter_reading FROM readings', ["meter_reading"])
    q["sink_ordered"] = w(OOF, """SELECT row_id, exp(oof) - 1 AS meter_reading, row_number() OVER (ORDER BY row_id) - 1 AS pos
        FROM oof_t""", ["meter_reading"])
    q["bucketed_truth"] = w(OOF, """SELECT r.building_id, r.meter, r."timestamp", r.row_id, r.meter_reading, exp(o.oof) - 1 AS predicted,
        avg(r.meter_reading) OVER (PARTITION BY r.building_id, r.meter) AS profile_mean
        FROM readings r LEFT JOIN oof_t o USING (building_id, meter, "timestamp")""", ["meter_reading", "predicted", "profile_mean"])
    q["segment_outputs"] = w(OOF, "SELECT row_id, meter, oof AS meter_reading_oof FROM oof_t",
                             ["meter_reading_oof"])
    q["align_to_template"] = w(OOF, """SELECT r.row_id, p.meter_reading FROM oof_t r
        LEFT JOIN (SELECT row_id, exp(oof) - 1 AS meter_reading FROM oof_t WHERE fold <> 0) p USING (row_id)""",
                               ["meter_reading"])
    q["segment_filter"] = w(READINGS, f"SELECT * FROM readings WHERE meter = '{meter}'", ["meter_reading"])
    q["in_not_in"] = w(BUILDINGS, "SELECT * FROM buildings WHERE site_id IN (1) AND NOT building_id IN (150, 106)",
                       ["square_feet", "floor_count"])
    q["exclude_entity"] = w(READINGS, f"SELECT * FROM readings WHERE building_id IS DISTINCT FROM {excl}",
                            ["meter_reading"])
    q["drop_startup_outliers"] = w(READINGS, f"""SELECT * FROM readings WHERE NOT coalesce(
        building_id <= {st['max_building']} AND meter = '{st['meter_value']}'
        AND "timestamp" < TIMESTAMP '{st['before']}', false)""", ["meter_reading"])
    q["drop_bad_rows"] = w(READINGS + ",\n" + BAD, """SELECT * FROM readings r
        WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.pos = r.row_id)""", ["meter_reading"])
    q["drop_bad_rows_bitmap"] = q["drop_bad_rows"]
    q["clip_negative"] = w(BUILDINGS, """SELECT building_id,
        CASE WHEN square_feet < 0 THEN 0.0 ELSE square_feet END AS square_feet FROM buildings""", ["square_feet"])
    q["clip_zero"] = w(BUILDINGS, """SELECT building_id,
        CASE WHEN square_feet < 0 THEN 0.0 ELSE square_feet END AS square_feet_clipped FROM buildings""",
                       ["square_feet_clipped"])
    q["fill_const"] = w(FILLED, "SELECT site_id, \"timestamp\", " + ", ".join(
        f"coalesce({c}, 0.0) AS {c}" for c in WCOLS) + " FROM filled", WCOLS)
    q["year_range"] = ("SELECT o_orderkey AS row_id, o_orderdate AS \"timestamp\" FROM orders "
                       "WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'")
    q["project_drop"] = w(RAW_WEATHER, "SELECT site_id, \"timestamp\", air_temperature, cloud_coverage, "
                          "dew_temperature, precip_depth_1_hr FROM raw_weather",
                          ["air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr"])
    q["project_except"] = w(READINGS, "SELECT building_id, meter, \"timestamp\" FROM readings", [])
    q["area_per_floor"] = w(BUILDINGS, """SELECT building_id, square_feet, floor_count,
        CASE WHEN floor_count = 0 THEN square_feet ELSE square_feet / floor_count END AS square_feet_floor
        FROM buildings""", ["square_feet", "floor_count", "square_feet_floor"])
    q["unit_convert"] = w(BUILDINGS, f"""SELECT building_id, site_id,
        CASE WHEN site_id IN (1) AND NOT building_id IN (150, 106) THEN square_feet * {lit(10.7639)}
             ELSE square_feet END AS square_feet FROM buildings""", ["square_feet"])
    q["month_bucket"] = """SELECT o_orderkey AS row_id,
        CAST(CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1 WHEN month(o_orderdate) IN (3, 4, 5) THEN 2
             WHEN month(o_orderdate) IN (6, 7, 8) THEN 3 WHEN month(o_orderdate) IN (9, 10, 11) THEN 4
             ELSE month(o_orderdate) END AS INTEGER) AS season,
        CAST(CASE WHEN month(o_orderdate) IN (1, 2, 3, 4) THEN 1 WHEN month(o_orderdate) IN (5, 6, 7, 8) THEN 2
             WHEN month(o_orderdate) IN (9, 10, 11, 12) THEN 3 ELSE month(o_orderdate) END AS INTEGER) AS third
        FROM orders"""
    q["row_id"] = w(READINGS + ",\n" + BAD, """SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos
        FROM readings r WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.pos = r.row_id)""", [])
    tiers = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647),
             ("bigint", -9223372036854775808, 9223372036854775807)]

    def int_case(c):
        arms = " ".join(f"WHEN min({c}) > {float(a)!r} AND max({c}) < {float(b)!r} THEN '{n}'"
                        for n, a, b in tiers)
        return f"CASE WHEN min({c}) IS NULL THEN 'bigint' {arms} ELSE 'bigint' END"

    fmax = repr(3.4028234663852886e38)
    q["narrow_schema"] = w(READINGS, f"""
        SELECT 'row_id' AS column_name, CAST(min(row_id) AS DOUBLE) AS min_value,
               CAST(max(row_id) AS DOUBLE) AS max_value, {int_case('row_id')} AS target_type FROM readings
        UNION ALL
        SELECT 'building_id', CAST(min(building_id) AS DOUBLE), CAST(max(building_id) AS DOUBLE),
               {int_case('building_id')} FROM readings
        UNION ALL
        SELECT 'meter_reading', min(meter_reading), max(meter_reading),
               CASE WHEN min(meter_reading) IS NULL THEN 'double'
                    WHEN min(meter_reading) > -{fmax} AND max(meter_reading) < {fmax} THEN 'float'
                    ELSE 'double' END FROM readings""", ["min_value", "max_value"])
    q["cast_flags"] = "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_f FROM orders"

    q["join_building"] = w(READINGS + ",\n" + BUILDING_FEATURES,
                           "SELECT r.*, bf.site_id, bf.primary_use, bf.square_feet, bf.floor_count, bf.square_feet_floor "
                           "FROM readings r LEFT JOIN bf USING (building_id)", ["meter_reading"] + BUILD_DBL)
    q["join_weather"] = w(READINGS + ",\n" + BUILDINGS + ",\n" + WF,
                          "SELECT r.*, b.site_id, " + ", ".join(f"wf.{c}" for c in WF_DBL) +
                          " FROM readings r LEFT JOIN buildings b USING (building_id) "
                          "LEFT JOIN wf ON wf.site_id = b.site_id AND wf.\"timestamp\" = r.\"timestamp\"",
                          ["meter_reading"] + WF_DBL)
    q["join_inner"] = w(READINGS + ",\n" + BUILDINGS,
                        "SELECT r.*, b.site_id, b.primary_use, b.square_feet, b.floor_count "
                        "FROM readings r JOIN buildings b USING (building_id) WHERE b.square_feet > 0",
                        ["meter_reading", "square_feet", "floor_count"])
    q["agg_back"] = w(LOG_READINGS, """SELECT r.*, p.mean_building_meter, p.median_building_meter
        FROM log_readings r LEFT JOIN (SELECT building_id, meter, avg(meter_reading) AS mean_building_meter,
              median(meter_reading) AS median_building_meter FROM log_readings GROUP BY 1, 2) p
        USING (building_id, meter)""", ["meter_reading", "mean_building_meter", "median_building_meter"])
    q["join_truth"] = w(OOF, """SELECT r.building_id, r.meter, r."timestamp", r.meter_reading AS meter_reading_true,
        p.meter_reading_pred FROM readings r LEFT JOIN (SELECT building_id, meter, "timestamp",
        exp(oof) - 1 AS meter_reading_pred FROM oof_t) p USING (building_id, meter, "timestamp")""",
                        ["meter_reading_true", "meter_reading_pred"])

    q["group_mean"] = w(FILLED, """SELECT site_id, CAST(day("timestamp") AS INTEGER) AS day,
        CAST(month("timestamp") AS INTEGER) AS month,
        avg(air_temperature) AS air_temperature_mean FROM filled GROUP BY 1, 2, 3""", ["air_temperature_mean"])
    q["profile_mean_median"] = w(LOG_READINGS, """SELECT building_id, meter, avg(meter_reading) AS mean_building_meter,
        median(meter_reading) AS median_building_meter FROM log_readings GROUP BY 1, 2""",
                                 ["mean_building_meter", "median_building_meter"])
    q["profile_by_hour"] = w(LOG_READINGS, """SELECT building_id, meter, CAST(hour("timestamp") AS INTEGER) AS hour,
        avg(meter_reading) AS mean_building_meter_hour, median(meter_reading) AS median_building_meter_hour
        FROM log_readings GROUP BY 1, 2, 3""", ["mean_building_meter_hour", "median_building_meter_hour"])
    q["profile_by_season"] = w(ORDER_READINGS, """SELECT building_id, meter,
        CASE WHEN month("timestamp") IN (12, 1, 2) THEN 1 WHEN month("timestamp") IN (3, 4, 5) THEN 2
             WHEN month("timestamp") IN (6, 7, 8) THEN 3 WHEN month("timestamp") IN (9, 10, 11) THEN 4 END AS season,
        max(meter_reading) AS meter_reading_max, avg(meter_reading) AS meter_reading_mean,
        stddev_samp(meter_reading) AS meter_reading_std FROM order_readings GROUP BY 1, 2, 3""",
                               ["meter_reading_max", "meter_reading_mean", "meter_reading_std"])
    full = ["max", "mean", "std", "skew", "median", "q80", "q30", "kurt", "mad", "ptp"]
    q["profile_full"] = w(READINGS, """SELECT a.building_id, a.meter, a.meter_reading_max, a.meter_reading_mean,
        a.meter_reading_std, a.meter_reading_skew, a.meter_reading_median, a.meter_reading_q80,
        a.meter_reading_q30, a.meter_reading_kurt, m.meter_reading_mad, a.meter_reading_ptp
      FROM (SELECT building_id, meter, max(meter_reading) AS meter_reading_max,
              avg(meter_reading) AS meter_reading_mean, stddev_samp(meter_reading) AS meter_reading_std,
              CASE WHEN count(meter_reading) >= 3 THEN skewness(meter_reading) END AS meter_reading_skew,
              median(meter_reading) AS meter_reading_median,
              quantile_cont(meter_reading, 0.8) AS meter_reading_q80,
              quantile_cont(meter_reading, 0.3) AS meter_reading_q30,
              CASE WHEN count(meter_reading) >= 4 THEN kurtosis(meter_reading) END AS meter_reading_kurt,
              max(meter_reading) - min(meter_reading) AS meter_reading_ptp
            FROM readings GROUP BY 1, 2) a
      JOIN (SELECT r.building_id, r.meter, avg(abs(r.meter_reading - g.mu)) AS meter_reading_mad
            FROM readings r JOIN (SELECT building_id, meter, avg(meter_reading) AS mu FROM readings GROUP BY 1, 2) g
            USING (building_id, meter) GROUP BY 1, 2) m USING (building_id, meter)""",
                          [f"meter_reading_{s}" for s in full])
    q["profile_fold_safe"] = w(FOLDED, """SELECT a.row_id, a.fold, p.meter_reading_mean, p.meter_reading_median,
        p.meter_reading_std FROM folded a LEFT JOIN (
          SELECT x.building_id, x.meter, f.fold, avg(x.meter_reading) AS meter_reading_mean,
                 median(x.meter_reading) AS meter_reading_median, stddev_samp(x.meter_reading) AS meter_reading_std
          FROM (SELECT DISTINCT fold FROM folded) f JOIN folded x ON x.fold <> f.fold
          GROUP BY 1, 2, 3) p ON p.building_id = a.building_id AND p.meter = a.meter AND p.fold = a.fold""",
                               ["meter_reading_mean", "meter_reading_median", "meter_reading_std"])
    q["profile_other_folds"] = w(FOLDED, """SELECT building_id, meter, CAST(f.fold AS INTEGER) AS fold, count(meter_reading) AS meter_reading_count,
        avg(meter_reading) AS meter_reading_mean, stddev_samp(meter_reading) AS meter_reading_std, min(meter_reading) AS meter_reading_min,
        max(meter_reading) AS meter_reading_max, max(meter_reading) - min(meter_reading) AS meter_reading_ptp,
        quantile_disc(meter_reading, 0.5) AS meter_reading_median
        FROM folded r JOIN (SELECT unnest([0, 1, 2]) AS fold) f ON r.fold <> f.fold
        GROUP BY building_id, meter, f.fold""", [f"meter_reading_{x}" for x in ("mean", "std", "min", "max", "ptp", "median")])
    q["quantiles"] = w(READINGS, """SELECT meter, quantile_cont(meter_reading, 0.3) AS q30,
        quantile_cont(meter_reading, 0.8) AS q80 FROM readings GROUP BY 1""", ["q30", "q80"])
    q["global_bounds"] = w(RAW_WEATHER, """SELECT first_ts, last_ts, date_diff('hour', first_ts, last_ts) + 1 AS total_hours
        FROM (SELECT min("timestamp") AS first_ts, max("timestamp") AS last_ts FROM raw_weather)""", [])
    q["value_counts"] = w(READINGS, "SELECT meter, count(*) AS n FROM readings GROUP BY 1", [])
    q["null_profile"] = w(FILLED, " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {cq} IS NULL) AS n_null FROM filled"
        for c, cq in [("site_id", "site_id"), ("timestamp", '"timestamp"')] + [(c, c) for c in WCOLS]), [])
    rm = "sqrt(avg(pow(meter_reading - oof, 2)))"
    both = "meter_reading IS NOT NULL AND oof IS NOT NULL"
    q["rmse"] = w(OOF, f"""SELECT {rm} AS rmse,
        count(*) FILTER (WHERE meter_reading IS NOT NULL AND oof IS NOT NULL) AS n_scored,
        count(*) FILTER (WHERE NOT (meter_reading IS NOT NULL AND oof IS NOT NULL)) AS n_unmatched FROM oof_t""",
                  ["rmse"])
    q["oof_score"] = q["rmse"]
    q["cv_mean_score"] = w(OOF, f"""SELECT avg(r) AS cv_mean_rmse, count(*) AS n_folds,
        CAST(sum(s) AS BIGINT) AS n_scored, CAST(sum(u) AS BIGINT) AS n_unmatched
        FROM (SELECT fold, {rm} AS r, count(*) FILTER (WHERE {both}) AS s, count(*) FILTER (WHERE NOT ({both})) AS u
              FROM oof_t GROUP BY fold)""", ["cv_mean_rmse"])
    q["score_by_segment"] = w(OOF, f"SELECT meter, {rm} AS rmse, count(*) FILTER (WHERE {both}) AS n_scored, "
                              f"count(*) FILTER (WHERE NOT ({both})) AS n_unmatched FROM oof_t GROUP BY 1",
                              ["rmse"])
    q["topk_mean"] = w(READINGS, """SELECT building_id, avg(meter_reading) AS mean_value FROM readings
        GROUP BY 1 ORDER BY mean_value DESC, building_id ASC LIMIT 20""", ["mean_value"])
    q["ensemble_mean"] = w(THREE, "SELECT row_id, ((p1 + p2) + p3) / 3 AS pred_mean FROM three", ["pred_mean"])
    clip = "CASE WHEN {x} < 0 THEN 0.0 ELSE {x} END"
    raw = "(((exp(p1) - 1) + (exp(p2) - 1)) + (exp(p3) - 1)) / 3"
    logm = "exp(((p1 + p2) + p3) / 3) - 1"
    q["ensemble_raw_space"] = w(THREE, f"SELECT row_id, {clip.format(x='(' + raw + ')')} AS meter_reading FROM three",
                                ["meter_reading"])
    q["ensemble_log_space"] = w(THREE, f"SELECT row_id, {clip.format(x='(' + logm + ')')} AS meter_reading FROM three",
                                ["meter_reading"])

    q["gap_fill"] = w(FILLED, "SELECT * FROM filled", WCOLS)
    q["missing_hours"] = w(FILLED, "SELECT * FROM missing", [])
    q["impute_group_mean"] = w(IMPUTED, "SELECT f.site_id, f.\"timestamp\", " + ", ".join(
        f"coalesce(f.{c}, g.{c}) AS {c}" if c in MEAN_COLS else f"f.{c}" for c in WCOLS) +
        " FROM filled f LEFT JOIN gm g ON g.site_id = f.site_id AND g.d = day(f.\"timestamp\") "
        "AND g.m = month(f.\"timestamp\")", WCOLS)
    q["impute_group_ffill"] = w(IMPUTED, "SELECT f.site_id, f.\"timestamp\", " + ", ".join(
        f"coalesce(f.{c}, h.{c}) AS {c}" if c in FFILL_COLS else f"f.{c}" for c in WCOLS) +
        " FROM filled f LEFT JOIN gmf h ON h.site_id = f.site_id AND h.d = day(f.\"timestamp\") "
        "AND h.m = month(f.\"timestamp\")", WCOLS)
    q["interpolate_linear"] = w(INTERPOLATED, "SELECT * FROM interp", INTERP)
    q["rolling_stats"] = w(INTERPOLATED, f"""SELECT site_id, "timestamp", {_ROLL_SQL} FROM interp
        WINDOW r AS (PARTITION BY site_id ORDER BY "timestamp" ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)""",
                           ROLL_NAMES)
    q["lead_features"] = w(IMPUTED, """SELECT site_id, "timestamp", air_temperature,
        lead(air_temperature, 1) OVER s AS air_temperature_lead1,
        lead(air_temperature, 2) OVER s AS air_temperature_lead2,
        lead(air_temperature, 3) OVER s AS air_temperature_lead3
        FROM wimp WINDOW s AS (PARTITION BY site_id ORDER BY "timestamp")""",
                           ["air_temperature", "air_temperature_lead1", "air_temperature_lead2",
                            "air_temperature_lead3"])

    for by_site, by_block in (("interpolate_linear", "interpolate_blocks"), ("rolling_stats", "rolling_blocks"), ("lead_features", "lead_blocks")):
        q[by_block] = q[by_site]
    q["union_by_name"] = w(READINGS + ",\n" + BAD, """
        SELECT * FROM readings r WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.pos = r.row_id)
        UNION ALL
        SELECT row_id, building_id, meter, "timestamp", CAST(NULL AS DOUBLE) FROM readings r
        WHERE EXISTS (SELECT 1 FROM bad b WHERE b.pos = r.row_id)""", ["meter_reading"])
    q["union_segments"] = w(FOLDED, """SELECT a.row_id, a.meter,
        CASE WHEN g.n > 0 THEN g.s / g.n ELSE fm.m END AS oof
      FROM folded a
      LEFT JOIN (SELECT x.meter, x.building_id, f.fold, count(x.meter_reading) AS n, sum(x.meter_reading) AS s
                 FROM (SELECT DISTINCT fold FROM folded) f JOIN folded x ON x.fold <> f.fold
                 GROUP BY 1, 2, 3) g ON g.meter = a.meter AND g.building_id = a.building_id AND g.fold = a.fold
      LEFT JOIN (SELECT x.meter, f.fold, avg(x.meter_reading) AS m
                 FROM (SELECT DISTINCT fold FROM folded) f JOIN folded x ON x.fold <> f.fold
                 GROUP BY 1, 2) fm ON fm.meter = a.meter AND fm.fold = a.fold""", ["oof"])
    q["sort_result"] = w(OOF, "SELECT row_id, exp(oof) - 1 AS meter_reading FROM oof_t ORDER BY row_id",
                         ["meter_reading"])

    q["log_target"] = w(READINGS, """SELECT row_id, CASE WHEN meter_reading > -1 THEN ln(1 + meter_reading) END
        AS log_meter_reading FROM readings""", ["log_meter_reading"])
    q["inverse_target"] = w(LOG_READINGS, "SELECT row_id, exp(meter_reading) - 1 AS meter_reading FROM log_readings",
                            ["meter_reading"])
    q["humidity_magnus"] = w(IMPUTED, "SELECT site_id, \"timestamp\", " +
                             magnus("air_temperature", "dew_temperature") + " AS relative_humidity FROM wimp",
                             ["relative_humidity"])
    q["humidity_base10"] = w(IMPUTED, "SELECT site_id, \"timestamp\", " +
                             base10("air_temperature", "dew_temperature") + " AS relative_humidity FROM wimp",
                             ["relative_humidity"])
    q["feels_like"] = w(IMPUTED + ",\nwrh AS (SELECT *, " + magnus("air_temperature", "dew_temperature") +
                        " AS relative_humidity FROM wimp)",
                        "SELECT site_id, \"timestamp\", " + feels("air_temperature", "relative_humidity", "wind_speed") +
                        " AS feels_like FROM wrh", ["feels_like"])
    q["calendar_features"] = """SELECT o_orderkey AS row_id, CAST(month(o_orderdate) AS INTEGER) AS month,
        CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(day(o_orderdate) AS INTEGER) AS day,
        CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(year(o_orderdate) AS INTEGER) AS year,
        CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
        CAST(dayofyear(o_orderdate) AS INTEGER) AS year_day FROM orders"""
    q["weekday_collapse"] = """SELECT o_orderkey AS row_id,
        CAST(CASE WHEN isodow(o_orderdate) - 1 IN (1, 2, 3) THEN 1 ELSE isodow(o_orderdate) - 1 END AS INTEGER)
        AS day_of_week FROM orders"""
    q["weekend_flag"] = """SELECT o_orderkey AS row_id, CAST(isodow(o_orderdate) - 1 >= 5 AS INTEGER) AS is_weekend
        FROM orders"""
    q["holiday_flag"] = f"""SELECT o_orderkey AS row_id,
        CAST(coalesce(CAST(o_orderdate AS DATE) IN ({hol}), false) AS INTEGER) AS is_holiday,
        CAST(coalesce(CAST(o_orderdate AS DATE) IN ({hol}) AND hour(o_orderdate) = 0 AND minute(o_orderdate) = 0
             AND second(o_orderdate) = 0, false) AS INTEGER) AS is_holiday_midnight FROM orders"""

    q["label_encode"] = w(BUILDING_FEATURES, "SELECT b.building_id, p.code AS primary_use FROM buildings b "
                          "LEFT JOIN pu p USING (primary_use)", [])
    q["target_encode"] = w(LOG_READINGS + f""",
        tr AS (SELECT * FROM log_readings WHERE "timestamp" < TIMESTAMP '{cut}'),
        te AS (SELECT * FROM log_readings WHERE "timestamp" >= TIMESTAMP '{cut}'),
        pr AS (SELECT avg(meter_reading) AS prior FROM tr),
        st AS (SELECT building_id, count(meter_reading) AS n, avg(meter_reading) AS m FROM tr GROUP BY 1)""",
                           f"""SELECT te.row_id, coalesce({te_sql('st.n', 'st.m', 'pr.prior')}, pr.prior) AS building_id_te
        FROM te LEFT JOIN st USING (building_id) CROSS JOIN pr""", ["building_id_te"])
    q["target_encode_oof"] = w(FOLDED + """,
        st AS (SELECT x.building_id, f.fold, count(x.meter_reading) AS n, sum(x.meter_reading) AS s
               FROM (SELECT DISTINCT fold FROM folded) f JOIN folded x ON x.fold <> f.fold GROUP BY 1, 2),
        fp AS (SELECT f.fold, avg(x.meter_reading) AS prior
               FROM (SELECT DISTINCT fold FROM folded) f JOIN folded x ON x.fold <> f.fold GROUP BY 1)""",
                               f"""SELECT a.row_id, a.fold,
        CASE WHEN st.n > 0 THEN {te_sql('st.n', 'st.s / st.n', 'fp.prior')} ELSE fp.prior END AS building_id_te
        FROM folded a LEFT JOIN st ON st.building_id = a.building_id AND st.fold = a.fold
        LEFT JOIN fp ON fp.fold = a.fold""", ["building_id_te"])

    q["folds_kfold"] = w(FOLDED, "SELECT row_id, fold FROM folded", [])
    q["folds_stratified"] = w(READINGS, f"""SELECT row_id, meter, {kfold('n', 'pos', 5)} AS fold
        FROM (SELECT row_id, meter, row_number() OVER (PARTITION BY meter ORDER BY row_id) - 1 AS pos,
                     count(*) OVER (PARTITION BY meter) AS n FROM readings)""", [])
    q["folds_group"] = w(ORDER_READINGS + """,
        t AS (SELECT row_id, CAST(CASE WHEN month("timestamp") <= 4 THEN 1 WHEN month("timestamp") <= 8 THEN 2 ELSE 3 END AS INTEGER) AS third
              FROM order_readings),
        f AS (SELECT third, CAST(row_number() OVER (ORDER BY n DESC, third DESC) - 1 AS INTEGER) AS fold
              FROM (SELECT third, count(*) AS n FROM t GROUP BY third))""", "SELECT row_id, third, fold FROM t JOIN f USING (third)", [])
    q["folds_group_building"] = "WITH RECURSIVE " + READINGS + """,
        s AS (SELECT building_id, n, row_number() OVER (ORDER BY n DESC, building_id DESC) AS i
              FROM (SELECT building_id, count(*) AS n FROM readings GROUP BY building_id)),
        g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS building_id, -1 AS fold,
                     CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c
              UNION ALL
              SELECT i, building_id, f, a + CASE WHEN f = 0 THEN n ELSE 0 END, b + CASE WHEN f = 1 THEN n ELSE 0 END,
                     c + CASE WHEN f = 2 THEN n ELSE 0 END
              FROM (SELECT s.i, s.building_id, s.n, a, b, c, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f
                    FROM g JOIN s ON s.i = g.i + 1))
        SELECT r.row_id, r.building_id, g.fold FROM readings r JOIN g USING (building_id)"""
    q["oof_group_mean"] = w(OOF, "SELECT row_id, fold, oof FROM oof_t", ["oof"])
    q["holdout_rmsle"] = w(OOF + f""",
        truth AS (
          SELECT building_id, meter, "timestamp",
                 CASE WHEN coalesce(meter_reading, 0) < 0 THEN 0.0 ELSE coalesce(meter_reading, 0) END AS meter_reading_true
          FROM readings
          WHERE "timestamp" >= TIMESTAMP '{y0:04d}-01-01 00:00:00' AND "timestamp" < TIMESTAMP '{y1 + 1:04d}-01-01 00:00:00'
            AND building_id IS DISTINCT FROM {excl}),
        hj AS (SELECT t.*, p.meter_reading_pred,
                      CASE WHEN t.meter_reading_true > -1 THEN ln(1 + t.meter_reading_true) END AS true_l1p,
                      CASE WHEN p.meter_reading_pred > -1 THEN ln(1 + p.meter_reading_pred) END AS pred_l1p
               FROM truth t LEFT JOIN (SELECT building_id, meter, "timestamp", exp(oof) - 1 AS meter_reading_pred
                                       FROM oof_t) p USING (building_id, meter, "timestamp"))""",
                           """SELECT sqrt(avg(pow(true_l1p - pred_l1p, 2))) AS rmse,
        count(*) FILTER (WHERE true_l1p IS NOT NULL AND pred_l1p IS NOT NULL) AS n_scored,
        count(*) FILTER (WHERE NOT (true_l1p IS NOT NULL AND pred_l1p IS NOT NULL)) AS n_unmatched FROM hj""",
                           ["rmse"])

    q["holdout_from_file"] = q["holdout_rmsle"]

    def wb(c):
        return (f"CASE WHEN {c} < 0.0 THEN 0 WHEN {c} >= 8.0 THEN 17 "
                f"ELSE CAST(floor(16 * ({c} - 0.0) / (8.0 - 0.0)) AS BIGINT) + 1 END")

    q["distribution_compare"] = w(OOF, f"""SELECT coalesce(a.bin, b.bin) AS bin, coalesce(a.n, 0) AS n_meter_reading,
        coalesce(b.n, 0) AS n_oof
        FROM (SELECT {wb('meter_reading')} AS bin, count(*) AS n FROM oof_t WHERE meter_reading IS NOT NULL GROUP BY 1) a
        FULL JOIN (SELECT {wb('oof')} AS bin, count(*) AS n FROM oof_t WHERE oof IS NOT NULL GROUP BY 1) b
        ON a.bin = b.bin""", [])

    frame_cols = (", ".join(f"wf.{c}" for c in TRAIN_WF))
    tf_ctes = READINGS + ",\n" + BAD + ",\n" + BUILDING_FEATURES + ",\n" + WF + """,
        kept AS (SELECT * FROM readings r WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.pos = r.row_id))"""
    tf_body = f"""SELECT r.row_id, r.building_id, r.meter, r."timestamp",
        CASE WHEN r.meter_reading > -1 THEN ln(1 + r.meter_reading) END AS meter_reading,
        bf.site_id, bf.primary_use, bf.square_feet, bf.floor_count, bf.square_feet_floor, {frame_cols},
        {cal.replace('"timestamp"', 'r."timestamp"')}
        FROM kept r LEFT JOIN bf USING (building_id)
        LEFT JOIN wf ON wf.site_id = bf.site_id AND wf."timestamp" = r."timestamp" """
    q["training_frame"] = w(tf_ctes, tf_body, ["meter_reading"] + BUILD_DBL + TRAIN_WF)
    stats = """avg(x.meter_reading) AS meter_reading_mean, median(x.meter_reading) AS meter_reading_median,
        stddev_samp(x.meter_reading) AS meter_reading_std"""
    names = "meter_reading_mean, meter_reading_median, meter_reading_std"
    profiled = ["air_temperature", "meter_reading_mean", "meter_reading_median", "meter_reading_std", "building_id_te"]
    q["profiled_training_frame"] = w(tf_ctes + f""",
        tf AS ({tf_body}),
        folded AS (SELECT *, {kfold('n', 'pos', 3)} AS fold FROM (
          SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos, count(*) OVER () AS n FROM tf WHERE meter_reading IS NOT NULL)),
        other AS (SELECT f.fold AS for_fold, x.* FROM (SELECT DISTINCT fold FROM folded) f JOIN folded x ON x.fold <> f.fold),
        p AS (SELECT building_id, meter, for_fold, {stats} FROM other x GROUP BY 1, 2, 3),
        st AS (SELECT building_id, for_fold, count(*) AS n, sum(meter_reading) AS s FROM other GROUP BY 1, 2),
        fp AS (SELECT for_fold, avg(meter_reading) AS prior FROM other GROUP BY 1)""",
                                     f"""SELECT a.row_id, a.fold, a.building_id, a.meter, a.air_temperature, {names},
        CASE WHEN st.n > 0 THEN {te_sql('st.n', 'st.s / st.n', 'fp.prior')} ELSE fp.prior END AS building_id_te
        FROM folded a LEFT JOIN p ON p.building_id = a.building_id AND p.meter = a.meter AND p.for_fold = a.fold
        LEFT JOIN st ON st.building_id = a.building_id AND st.for_fold = a.fold LEFT JOIN fp ON fp.for_fold = a.fold""", profiled)
    q["profiled_scoring_frame"] = w(tf_ctes + f""",
        tr AS (SELECT * FROM ({tf_body}) WHERE meter_reading IS NOT NULL AND "timestamp" < TIMESTAMP '{cut}'),
        p AS (SELECT building_id, meter, {stats} FROM tr x GROUP BY 1, 2),
        pr AS (SELECT avg(meter_reading) AS prior FROM tr),
        st AS (SELECT building_id, count(*) AS n, avg(meter_reading) AS m FROM tr GROUP BY 1)""",
                                    f"""SELECT r.row_id, r.building_id, r.meter, wf.air_temperature, {names},
        coalesce({te_sql('st.n', 'st.m', 'pr.prior')}, pr.prior) AS building_id_te
        FROM readings r LEFT JOIN bf USING (building_id) LEFT JOIN wf ON wf.site_id = bf.site_id AND wf."timestamp" = r."timestamp"
        LEFT JOIN p ON p.building_id = r.building_id AND p.meter = r.meter LEFT JOIN st ON st.building_id = r.building_id CROSS JOIN pr""", profiled)
    vector = ", ".join(f'coalesce(CAST("{c}" AS DOUBLE), -999.0)' for c in params["features"])
    q["assemble_features"] = f"""WITH frame AS ({q["training_frame"]}),
        codes AS (SELECT meter, row_number() OVER (ORDER BY meter) - 1 AS meter_code FROM (SELECT DISTINCT event_type AS meter FROM events))
        SELECT row_id, list_transform([{vector}], lambda x: round(x, {ND})) AS features
        FROM (SELECT frame.*, meter_code FROM frame LEFT JOIN codes USING (meter)) WHERE meter_reading IS NOT NULL"""
    lag_names = ", ".join(f"lg.{c}" for c in ROLL_NAMES)
    site_ctes = (READINGS + ",\n" + BUILDING_FEATURES + ",\n" + _interp_sql(RAW_WEATHER, "raw_weather") + f""",
        lags AS (SELECT site_id, "timestamp", {_ROLL_SQL} FROM interp
                 WINDOW r AS (PARTITION BY site_id ORDER BY "timestamp" ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)),
        base AS (
          SELECT r.*, b.site_id, p.code AS primary_use, b.square_feet, b.floor_count,
                 i.air_temperature, i.cloud_coverage, i.dew_temperature, i.precip_depth_1_hr
          FROM readings r JOIN buildings b USING (building_id)
          LEFT JOIN pu p ON b.primary_use = p.primary_use
          LEFT JOIN interp i ON i.site_id = b.site_id AND i."timestamp" = r."timestamp"
          WHERE NOT coalesce(r.building_id <= {st['max_building']} AND r.meter = '{st['meter_value']}'
                AND r."timestamp" < TIMESTAMP '{st['before']}' AND b.site_id = 0, false)),
        feat AS (SELECT *, CASE WHEN meter_reading > -1 THEN ln(1 + meter_reading) END AS log_meter_reading,
                        CAST(hour("timestamp") AS INTEGER) AS hour,
                        CAST(isodow("timestamp") - 1 AS INTEGER) AS weekday FROM base)""")
    q["site_training_frame"] = w(site_ctes,
                                 f"""SELECT f.*, p1.mean_building_meter, p1.median_building_meter,
        p2.mean_building_meter_hour, p2.median_building_meter_hour, {lag_names}
        FROM feat f
        JOIN (SELECT building_id, meter, avg(log_meter_reading) AS mean_building_meter,
                     median(log_meter_reading) AS median_building_meter FROM feat GROUP BY 1, 2) p1
          USING (building_id, meter)
        JOIN (SELECT building_id, meter, hour, avg(log_meter_reading) AS mean_building_meter_hour,
                     median(log_meter_reading) AS median_building_meter_hour FROM feat GROUP BY 1, 2, 3) p2
          USING (building_id, meter, hour)
        LEFT JOIN lags lg ON lg.site_id = f.site_id AND lg."timestamp" = f."timestamp" """,
                                 ["meter_reading", "square_feet", "floor_count", "log_meter_reading",
                                  "mean_building_meter", "median_building_meter", "mean_building_meter_hour",
                                  "median_building_meter_hour"] + INTERP + ROLL_NAMES)
    q["site_scoring_frame"] = w(site_ctes + """,
        p1 AS (SELECT building_id, meter, avg(log_meter_reading) AS mean_building_meter,
                      median(log_meter_reading) AS median_building_meter FROM feat GROUP BY 1, 2),
        p2 AS (SELECT building_id, meter, hour, avg(log_meter_reading) AS mean_building_meter_hour,
                      median(log_meter_reading) AS median_building_meter_hour FROM feat GROUP BY 1, 2, 3)""",
                                """SELECT r.row_id, b.site_id, p.code AS primary_use, i.air_temperature, CAST(hour(r."timestamp") AS INTEGER) AS hour,
        CAST(isodow(r."timestamp") - 1 AS INTEGER) AS weekday, mean_building_meter, median_building_meter,
        mean_building_meter_hour, median_building_meter_hour, lags.air_temperature_mean_lag18
        FROM readings r LEFT JOIN buildings b USING (building_id) LEFT JOIN pu p ON b.primary_use = p.primary_use
        LEFT JOIN interp i ON i.site_id = b.site_id AND i."timestamp" = r."timestamp"
        LEFT JOIN p1 ON p1.building_id = r.building_id AND p1.meter = r.meter
        LEFT JOIN p2 ON p2.building_id = r.building_id AND p2.meter = r.meter AND p2.hour = hour(r."timestamp")
        LEFT JOIN lags ON lags.site_id = b.site_id AND lags."timestamp" = r."timestamp" """,
                                ["air_temperature", "mean_building_meter", "median_building_meter", "mean_building_meter_hour",
                                 "median_building_meter_hour", "air_temperature_mean_lag18"])
    q["folds_per_segment"] = w(READINGS, f"""SELECT row_id, meter, {kfold('n', 'pos', 2)} AS fold
        FROM (SELECT row_id, meter, row_number() OVER (PARTITION BY meter ORDER BY row_id) - 1 AS pos,
                     count(*) OVER (PARTITION BY meter) AS n FROM readings)""", [])
    q["scoring_frame"] = w(READINGS + ",\n" + BUILDING_FEATURES + ",\n" + WF,
                           f"""SELECT r.row_id, r.building_id, r.meter, r."timestamp",
        bf.site_id, bf.primary_use, bf.square_feet, bf.floor_count, bf.square_feet_floor, {frame_cols},
        {cal.replace('"timestamp"', 'r."timestamp"')}
        FROM readings r LEFT JOIN bf USING (building_id)
        LEFT JOIN wf ON wf.site_id = bf.site_id AND wf."timestamp" = r."timestamp" """,
                           BUILD_DBL + TRAIN_WF)
    return q
