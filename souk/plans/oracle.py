"""DuckDB SQL for every registered query: the independent check.

Each query is written out from the tables (no shared code with the Spark
side beyond the constants), with the same survey rules: IEEE division, means
that skip NaN, half-even rounding, NULL-safe keys.  Floating outputs are
rounded to 6 decimals, like ``catalog.compare_form``.
"""

from __future__ import annotations

from souk import config
from souk.operators.report import TEXT
from souk.plans import roundtrip as RT
from souk.plans import template

ITEMS = list(config.BIND_ITEMS)
PRICES = [f"price_{i}" for i in ITEMS]
UNIT = list(config.BIND_UNIT_ITEMS)
MONTHS = "[" + ", ".join(f"'{m}'" for m in config.MONTH_NAMES) + "]"
WEST_NILE = ", ".join(f"'{r}'" for r in config.BIND_WEST_NILE)
AREAS = ", ".join(f"'{a}'" for a in config.REPORT_AREAS)
NUMERIC = list(config.BIND_NUMERIC)
LEVEL_KEYS = {
    "national": ["month", "collection_order"],
    "market": ["settlement", "market_final", "month", "collection_order"],
    "settlement": ["regions", "district", "settlement", "month", "collection_order"],
    "district": ["regions", "district", "month", "collection_order"],
    "region": ["regions", "month", "collection_order"],
}
CELL_KEYS = ["regions", "district", "settlement", "market_final", "month", "collection_order"]


# ----------------------------------------------------------------- helpers
def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def sc(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def nn(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def finite(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def safe_div(n: str, d: str) -> str:
    return (f"(CASE WHEN ({d}) = 0 THEN (CASE WHEN ({n}) > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN ({n}) < 0 THEN CAST('-inf' AS DOUBLE) WHEN ({n}) = 0 THEN CAST('nan' AS DOUBLE) END) "
            f"ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)")


def pct(cur: str, base: str) -> str:
    return f"({safe_div(f'({cur}) - ({base})', base)} * 100)"


def _exact_mean(total: str, n: str) -> str:
    """HALF_UP(total / n, 12 decimals) via integer arithmetic, then the
    nearest double (string -> double parsing is correctly rounded)."""
    num = f"(CAST(replace(CAST({total} AS VARCHAR), '.', '') AS HUGEINT) * 10000)"
    q_ = f"(abs({num}) // {n} + CASE WHEN 2 * (abs({num}) % {n}) >= {n} THEN 1 ELSE 0 END)"
    txt = f"CAST({q_} AS VARCHAR)"
    digits = f"lpad({txt}, CAST(greatest(length({txt}), 13) AS INTEGER), '0')"
    text = (f"(CASE WHEN {num} < 0 THEN '-' ELSE '' END || substr({digits}, 1, length({digits}) - 12)"
            f" || '.' || substr({digits}, length({digits}) - 11))")
    return f"CAST({text} AS DOUBLE)"


def clean_mean(x: str) -> str:
    dec = f"TRY_CAST(CASE WHEN abs({x}) < 1e7 THEN {x} END AS DECIMAL(18,8))"
    fits = f"coalesce(CAST({dec} AS DOUBLE) = {x}, false)"
    fin = f"CASE WHEN {fits} THEN {dec} END"
    rest = f"sum(CASE WHEN isfinite({x}) AND NOT {fits} THEN {x} END)"
    n = f"count(CASE WHEN isfinite({x}) THEN 1 END)"
    return (f"(CASE WHEN count(CASE WHEN isinf({x}) THEN 1 END) > 0 OR {n} = 0 THEN NULL "
            f"WHEN {rest} IS NOT NULL THEN (coalesce(CAST(sum({fin}) AS DOUBLE), 0) + {rest}) / {n} "
            f"ELSE {_exact_mean(f'sum({fin})', n)} END)")


def median(x: str) -> str:
    lst = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL AND NOT isnan({x})))"
    return (f"(CASE WHEN coalesce(len({lst}), 0) = 0 THEN NULL ELSE "
            f"({lst}[(len({lst}) + 1) // 2] + {lst}[len({lst}) // 2 + 1]) / 2 END)")


def region_rule(x: str) -> str:
    return f"(CASE WHEN {sc(x)} IN ({WEST_NILE}) THEN 'west nile' ELSE 'south west' END)"


def order_tag(month: str = "month") -> str:
    return (f"(CASE WHEN {month} = {lit(config.THIS_ROUND)} THEN 4 "
            f"WHEN {month} = {lit(config.LAST_ROUND)} THEN 3 ELSE 1 END)")


def r6(x: str) -> str:
    """Half-even at 6 decimals on the value's shortest decimal text -- the way
    Spark's ``bround`` rounds a double -- so exact decimal ties (p / 32, ...)
    fall the same way in both engines."""
    return (f"(CASE WHEN isfinite({x}) THEN CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), 6) "
            f"AS DOUBLE) ELSE {x} END)")


def with_(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes) + "\n" + body


def rounded(cols: list[str], src: str, dbl_cols: list[str]) -> str:
    d = set(dbl_cols)
    return "SELECT " + ", ".join(f"{r6(q(c))} AS {q(c)}" if c in d else q(c) for c in cols) + \
        f" FROM {src}"


# ----------------------------------------------------------------- bound inputs
RAW = f"""SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS uuid,
  CAST(month(o.o_orderdate) AS INTEGER) AS month, CAST(day(o.o_orderdate) AS INTEGER) AS day,
  lower(n.n_name) || '/' || lower(c.c_mktsegment) AS settlement,
  CASE WHEN l.l_suppkey % 17 = 0 THEN NULL WHEN l.l_suppkey % 10 = 0 THEN 'Other'
       ELSE 'S' || CAST(l.l_suppkey AS VARCHAR) END AS market,
  'part ' || CAST(l.l_partkey % 3 AS VARCHAR) AS market_other,
  {", ".join(f"CASE WHEN lower(p.p_type) = '{t}' THEN l.l_extendedprice END AS price_{t}" for t in ITEMS)},
  CASE WHEN l.l_quantity = 25 THEN CAST(0 AS DOUBLE) ELSE l.l_quantity END AS weight_economy,
  CASE WHEN l.l_quantity = 7 THEN CAST(99 AS DOUBLE) ELSE l.l_quantity END AS weight_large
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
WHERE month(o.o_orderdate) IN (3, 9, 10)"""

STACKED = """SELECT * FROM raw WHERE month = 10
UNION ALL BY NAME SELECT * FROM raw WHERE month = 9
UNION ALL BY NAME SELECT * EXCLUDE (market_other) FROM raw WHERE month = 3"""

ST = f"""SELECT * REPLACE (m AS month), {order_tag('m')} AS collection_order FROM (
  SELECT *, CASE WHEN month BETWEEN 1 AND 12 THEN {MONTHS}[month] END AS m FROM stacked)
WHERE m IS NOT NULL"""

SETTLEMENTS = f"""WITH sdim AS (
  SELECT lower(n.n_name) || '/' || lower(c.c_mktsegment) AS settlement, lower(n.n_name) AS district,
    min(c.c_custkey) AS objectid, 'Uganda' AS name, 'settlement' AS type,
    avg(c.c_acctbal) AS longitude, max(c.c_acctbal) AS latitude
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2)
SELECT settlement, district, objectid, name, type, longitude, latitude FROM sdim
UNION ALL
SELECT {lit(config.BIND_CENTROID_DISTRICT)}, district, NULL, NULL, NULL,
  avg({nn('longitude')}), avg({nn('latitude')})
FROM sdim WHERE district = {lit(config.BIND_CENTROID_DISTRICT)} GROUP BY district"""

DLOOKUP = f"""SELECT lower({sc('n_name')}) AS district, arg_min(r_name, n_nationkey) AS F15Regions,
  arg_min(n_name, n_nationkey) AS DName2019
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""

OBS = f"""SELECT s.month, 'uganda' AS country, sl.district, {region_rule('dl.F15Regions')} AS regions,
  s.settlement, CASE WHEN s.market = 'Other' THEN s.market_other ELSE s.market END AS market_final,
  s.uuid, {", ".join(f"s.{p}" for p in PRICES)}, s.weight_economy, s.weight_large
FROM st s LEFT JOIN (SELECT settlement, min(district) AS district FROM settlements GROUP BY settlement) sl
  ON s.settlement = sl.settlement
LEFT JOIN dlookup dl ON sl.district = dl.district"""


def rec(x: str) -> str:
    return f"(CASE WHEN {x} = 99 THEN NULL ELSE CAST({x} AS DOUBLE) END)"


def _ip_measure(item: str) -> str:
    p = f"price_{item}"
    if item in UNIT:
        return f"{safe_div(rec(p), rec(f'weight_{item}'))} AS {p}"
    return f"{rec(p)} AS {p}"


IP = f"""SELECT uuid, month, regions, district, settlement, market_final,
  {", ".join(_ip_measure(i) for i in ITEMS)}, {order_tag()} AS collection_order
FROM obs"""

BASE = [("raw", RAW), ("stacked", STACKED), ("st", ST), ("settlements", SETTLEMENTS),
        ("dlookup", DLOOKUP), ("obs", OBS), ("ip", IP)]


def level_sql(level: str) -> str:
    keys = ", ".join(LEVEL_KEYS[level])
    return f"SELECT {keys}, {', '.join(f'{clean_mean(p)} AS {p}' for p in PRICES)} FROM ip GROUP BY {keys}"


ALL_LEVELS = f"""SELECT CASE WHEN GROUPING(regions) = 1 THEN
    (CASE WHEN GROUPING(market_final) = 1 THEN 'national' ELSE 'market' END)
  WHEN GROUPING(settlement) = 1 THEN (CASE WHEN GROUPING(district) = 1 THEN 'region' ELSE 'district' END)
  ELSE 'settlement' END AS level,
  {", ".join(CELL_KEYS)}, {", ".join(f"{clean_mean(p)} AS {p}" for p in PRICES)}
FROM ip GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(k) + ")" for k in LEVEL_KEYS.values())})"""

MEANS = [(f"m_{lv}", level_sql(lv)) for lv in LEVEL_KEYS]


def _med(months: list[str]) -> str:
    keys = "settlement, district, regions, month, collection_order"
    ms = ", ".join(f"{median(p)} AS {p}" for p in PRICES)
    inlist = ", ".join(lit(m) for m in months)
    return f"SELECT {keys}, {ms} FROM ip WHERE month IN ({inlist}) GROUP BY {keys}"


def _impute(src: str, keys: str) -> str:
    ms = ", ".join(f"coalesce({p}, avg({nn(p)}) OVER (PARTITION BY {keys})) AS {p}" for p in PRICES)
    return f"SELECT settlement, district, regions, month, collection_order, {ms} FROM {src}"


FILL = ["settlement, month", "district, month", "regions, month", "regions"]


def _basket(src: str) -> str:
    lines = []
    for item, factors, _ in config.BIND_BASKET_ITEMS:
        e = f"price_{item}"
        for f in factors:
            e = f"{e} * {dbl(f)}"
        lines.append(f"round_even({e} * {dbl(config.HOUSEHOLD_SIZE)}, 0) AS meb_{item}")
    hyg = float(sum(v for _, v in config.BASKET_FIXED_HYGIENE))
    fixed = [(f"meb_{k}", float(v)) for k, v in config.BASKET_FIXED_OTHER]
    yearly = sum(v for _, v in config.BASKET_YEARLY) / 12
    food_terms = [f"price_{i}" for i in config.BIND_FOOD_TOTAL_ORDER]
    raw_line = {}
    for item, factors, _ in config.BIND_BASKET_ITEMS:
        e = f"price_{item}"
        for f in factors:
            e = f"{e} * {dbl(f)}"
        raw_line[f"price_{item}"] = f"({e} * {dbl(config.HOUSEHOLD_SIZE)})"
    food = " + ".join(raw_line[t] for t in food_terms)
    full = " + ".join([f"({food})"] + [dbl(v) for _, v in fixed] +
                      [dbl(hyg), dbl(yearly), dbl(config.BASKET_LIGHTING)])
    return f"""SELECT month, settlement, district, regions, collection_order, {", ".join(lines)},
  round_even({dbl(hyg)}, 0) AS meb_hygiene,
  {", ".join(f"round_even({dbl(v)}, 0) AS {n}" for n, v in fixed)},
  round_even({dbl(yearly)}, 0) AS meb_other_hdd, round_even({dbl(config.BASKET_LIGHTING)}, 0) AS meb_energy,
  round_even({food}, 0) AS meb_food, round_even({full}, 0) AS meb_full
FROM {src}"""


def meb_ctes(prefix: str, months: list[str]) -> list[tuple[str, str]]:
    out = [(f"{prefix}med", _med(months))]
    src = f"{prefix}med"
    for i, keys in enumerate(FILL):
        out.append((f"{prefix}imp{i}", _impute(src, keys)))
        src = f"{prefix}imp{i}"
    out.append((f"{prefix}meb", _basket(src)))
    return out


MEB_COLS = ([f"meb_{i}" for i in ITEMS] + ["meb_hygiene"] +
            [f"meb_{k}" for k, _ in config.BASKET_FIXED_OTHER] +
            ["meb_other_hdd", "meb_energy", "meb_food", "meb_full"])

MEB = (meb_ctes("b_", [config.BASELINE_ROUND]) +
       meb_ctes("c_", [config.THIS_ROUND, config.LAST_ROUND]) +
       [("meb", "SELECT * FROM b_meb UNION ALL BY NAME SELECT * FROM c_meb")])


def rollup_sql(level: str) -> str:
    prefix = "regional_" if level == "regional" else "national_"
    keys = ["regions", "month", "collection_order"] if level == "regional" else ["month", "collection_order"]
    cols = []
    for c in MEB_COLS:
        name = prefix + c if c in ("meb_food", "meb_full") else c
        cols.append(f"round_even(avg({nn(c)}), 0) AS {name}")
    extra = "" if level == "regional" else ", 'nationwide' AS regions"
    return f"SELECT {', '.join(keys)}, {', '.join(cols)}{extra} FROM meb GROUP BY {', '.join(keys)}"


ROLLUPS = [("meb_regional", rollup_sql("regional")), ("meb_national", rollup_sql("national"))]

BASELINES = {"last_round": 3, "march": 1}


def change_sql(src: str, keys: list[str], measures: list[str], required: list[str],
               strip: str = "price_") -> str:
    aggs = []
    for name, p in BASELINES.items():
        for m in measures:
            cur = f"max(CASE WHEN collection_order = 4 THEN {m} END)"
            base = f"max(CASE WHEN collection_order = {p} THEN {m} END)"
            aggs.append(f"{pct(cur, base)} AS {m.replace(strip, '')}_perct_{name}")
    having = ["count(CASE WHEN collection_order = 4 THEN 1 END) > 0"] + \
        [f"count(CASE WHEN collection_order = {BASELINES[n]} THEN 1 END) > 0" for n in required]
    k = ", ".join(keys)
    sel = (k + ", " if keys else "") + ", ".join(aggs)
    grp = f" GROUP BY {k}" if keys else ""
    return (f"SELECT {sel} FROM {src} WHERE collection_order IN (4, 3, 1){grp} "
            f"HAVING {' AND '.join(having)}")


def change_names(measures: list[str], strip: str = "price_") -> list[str]:
    return [f"{m.replace(strip, '')}_perct_{n}" for n in BASELINES for m in measures]


SLEVEL = ("SELECT settlement, month, collection_order, " + ", ".join(PRICES) +
          " FROM all_means WHERE level = 'settlement'")
CHANGES = [
    ("all_means", ALL_LEVELS),
    ("ch_settlement", change_sql("(SELECT * FROM all_means WHERE level = 'settlement')",
                                 ["settlement"], PRICES, ["last_round", "march"])),
    ("ch_region", change_sql("(SELECT * FROM all_means WHERE level = 'region')",
                             ["regions"], PRICES, ["last_round", "march"])),
    ("ch_national", "SELECT *, 'national' AS regions FROM (" +
     change_sql("(SELECT * FROM all_means WHERE level = 'national')", [], PRICES,
                ["last_round", "march"]) + ")"),
    ("ch_meb_settlement", change_sql("meb", ["settlement"], ["meb_food", "meb_full"], ["last_round"])),
    ("ch_meb_region", change_sql("meb_regional", ["regions"],
                                 ["regional_meb_food", "regional_meb_full"], ["last_round"])),
    ("ch_meb_national", "SELECT *, 'national' AS regions FROM (" +
     change_sql("meb_national", [], ["national_meb_food", "national_meb_full"], ["last_round"]) + ")"),
    ("ch_settlement_merged", "SELECT * FROM ch_settlement LEFT JOIN ch_meb_settlement USING (settlement)"),
]

CH_ITEM_COLS = change_names(PRICES)
CH_SMEB_COLS = change_names(["meb_food", "meb_full"])
CH_RMEB_COLS = change_names(["regional_meb_food", "regional_meb_full"])
CH_NMEB_COLS = change_names(["national_meb_food", "national_meb_full"])

RANK = f"""SELECT settlement, meb_full, rank FROM (
  SELECT settlement, meb_full,
    CAST(row_number() OVER (ORDER BY meb_full DESC NULLS LAST, settlement ASC NULLS LAST) AS INTEGER) AS rank,
    count(*) OVER () AS n
  FROM meb WHERE month = {lit(config.THIS_ROUND)}) WHERE rank <= 3
UNION ALL
SELECT settlement, meb_full, rank FROM (
  SELECT settlement, meb_full,
    CAST(row_number() OVER (ORDER BY meb_full DESC NULLS LAST, settlement ASC NULLS LAST) AS INTEGER) AS rank,
    count(*) OVER () AS n
  FROM meb WHERE month = {lit(config.THIS_ROUND)}) WHERE rank > n - 3"""

# ----------------------------------------------------------------- survey
SO = f"""SELECT CAST(o.o_orderkey AS VARCHAR) AS uuid, 'uganda' AS country, {region_rule('r.r_name')} AS regions,
  o.o_orderpriority, o.o_orderstatus, CAST(n.n_regionkey AS VARCHAR) AS home_region,
  CAST(n.n_nationkey AS VARCHAR) AS home_nation, o.o_totalprice,
  CASE WHEN o.o_orderkey % 11 = 0 THEN c.c_name ELSE CAST(c.c_acctbal AS VARCHAR) END AS customer_number
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey"""

SE = f"""SELECT uuid, country, regions, event_types,
  CASE WHEN coalesce(contains(event_types, {lit(config.BIND_FLAG_WORD)}), false) THEN 'yes' ELSE 'no' END AS mobile_accepted
FROM (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS uuid, 'uganda' AS country,
    CASE WHEN user_id % 2 = 0 THEN 'south west' ELSE 'west nile' END AS regions,
    array_to_string(list_sort(list_distinct(list(event_type))), ' ') AS event_types
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""

STAT_SELECT = """dependent_var, dependent_var_value, independent_var, independent_var_value,
  n / base AS numbers, sqrt((n / base) * (1 - n / base) / base) AS se,
  n / base - 1.96 * sqrt((n / base) * (1 - n / base) / base) AS min,
  n / base + 1.96 * sqrt((n / base) * (1 - n / base) / base) AS max,
  CAST(NULL AS VARCHAR) AS repeat_var, CAST(NULL AS VARCHAR) AS repeat_var_value"""


def _areas(src: str, cols: str) -> str:
    return (f"SELECT {cols}, 'country' AS independent_var, country AS independent_var_value FROM {src} "
            f"UNION ALL SELECT {cols}, 'regions' AS independent_var, regions AS independent_var_value FROM {src}")


def select_one_sql(src: str, questions: list[str]) -> str:
    qs = ", ".join(questions)
    long = (f"(UNPIVOT (SELECT uuid, country, regions, {qs} FROM {src}) ON {qs} "
            f"INTO NAME dependent_var VALUE answer)")
    return f"""SELECT {STAT_SELECT} FROM (
  SELECT *, sum(n) OVER (PARTITION BY dependent_var, independent_var, independent_var_value) AS base FROM (
    SELECT dependent_var, independent_var, independent_var_value, answer AS dependent_var_value, count(*) AS n
    FROM ({_areas(long, 'uuid, dependent_var, answer')}) GROUP BY ALL))"""


SM = f"""SELECT {STAT_SELECT} FROM (
  SELECT c.*, b.base FROM (
    SELECT dependent_var, independent_var, independent_var_value, option AS dependent_var_value, count(*) AS n
    FROM (SELECT dependent_var, independent_var, independent_var_value, uuid,
            unnest(list_distinct(string_split(answer, ' '))) AS option FROM sm_area)
    WHERE option <> '' GROUP BY ALL) c
  JOIN (SELECT dependent_var, independent_var, independent_var_value, count(*) AS base FROM sm_area GROUP BY ALL) b
  USING (dependent_var, independent_var, independent_var_value))"""

SM_AREA = _areas("(UNPIVOT (SELECT uuid, country, regions, event_types FROM se) ON event_types "
                 "INTO NAME dependent_var VALUE answer)", "uuid, dependent_var, answer")

NM = f"""SELECT dependent_var, CAST(NULL AS VARCHAR) AS dependent_var_value, independent_var, independent_var_value,
  numbers, se, numbers - 1.96 * se AS min, numbers + 1.96 * se AS max,
  CAST(NULL AS VARCHAR) AS repeat_var, CAST(NULL AS VARCHAR) AS repeat_var_value
FROM (SELECT dependent_var, independent_var, independent_var_value, {clean_mean('x')} AS numbers,
        stddev_samp(x) / sqrt(count(x)) AS se
  FROM ({_areas('''(UNPIVOT (SELECT uuid, country, regions, o_totalprice,
          TRY_CAST(customer_number AS DOUBLE) AS customer_number FROM so)
        ON o_totalprice, customer_number INTO NAME dependent_var VALUE x)''', 'dependent_var, x')})
  GROUP BY ALL)"""

SURVEY = [
    ("so", SO), ("se", SE),
    ("shares_one", select_one_sql("so", list(config.BIND_SELECT_ONE)) +
     " UNION ALL BY NAME " + select_one_sql("se", ["mobile_accepted"])),
    ("sm_area", SM_AREA), ("shares_multiple", SM), ("numeric", NM),
    ("stats", "SELECT * FROM shares_one UNION ALL BY NAME SELECT * FROM shares_multiple "
              "UNION ALL BY NAME SELECT * FROM numeric"),
    ("cat", f"SELECT * FROM stats WHERE dependent_var NOT IN ({', '.join(lit(n) for n in NUMERIC)})"),
    ("choice", "SELECT CAST(n_regionkey AS VARCHAR) AS name, arg_min(n_name, n_nationkey) AS label FROM nation GROUP BY 1"),
    ("catl", "SELECT cat.* REPLACE (coalesce(choice.label, cat.dependent_var_value) AS dependent_var_value) "
             "FROM cat LEFT JOIN choice ON cat.dependent_var_value = choice.name"),
]
STAT_COLS = ["dependent_var", "dependent_var_value", "independent_var", "independent_var_value",
             "numbers", "se", "min", "max", "repeat_var", "repeat_var_value"]
STAT_DBL = ["numbers", "se", "min", "max"]


def paste(*parts: str) -> str:
    return " || '_' || ".join(f"coalesce(CAST({p} AS VARCHAR), 'NA')" for p in parts)


def topk_sql(vars_: list[str], k: int) -> str:
    vs = ", ".join(lit(v) for v in vars_)
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY independent_var_value, dependent_var
    ORDER BY numbers DESC NULLS LAST, dependent_var_value ASC NULLS LAST) AS INTEGER) AS rank
  FROM catl WHERE dependent_var IN ({vs}) AND independent_var_value IN ({AREAS})) WHERE rank <= {k}"""


TOPK = [("topk", topk_sql(list(config.BIND_TOP3_VARS), 3) + " UNION ALL " +
         topk_sql(list(config.BIND_TOP2_VARS), 2))]

TOP_LONG = f"""SELECT 'numbers_' || {paste('independent_var_value', 'dependent_var', 'rank')} AS key,
  CAST(numbers * 100 AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS str FROM topk
UNION ALL
SELECT 'dependent_var_value_' || {paste('independent_var_value', 'dependent_var', 'rank')},
  CAST(NULL AS DOUBLE), CAST(dependent_var_value AS VARCHAR) FROM topk"""


def top_keys() -> list[str]:
    out = []
    for vars_, k in ((config.BIND_TOP3_VARS, 3), (config.BIND_TOP2_VARS, 2)):
        for area in config.REPORT_AREAS:
            for v in vars_:
                for r in range(1, k + 1):
                    out.append(f"{area}_{v}_{r}")
    return out


def pivot_two_sql() -> str:
    cols = []
    for k in top_keys():
        cols.append(f"max(numbers * 100) FILTER (WHERE new_var = {lit(k)}) AS {q('numbers_' + k)}")
        cols.append(f"max(dependent_var_value) FILTER (WHERE new_var = {lit(k)}) AS "
                    f"{q('dependent_var_value_' + k)}")
    return (f"SELECT {', '.join(cols)} FROM (SELECT {paste('independent_var_value', 'dependent_var', 'rank')} "
            f"AS new_var, numbers, dependent_var_value FROM topk)")


AREA_SCALARS = f"""SELECT {paste('independent_var_value', 'dependent_var')} AS key, CAST(numbers AS DOUBLE) AS num,
  CAST(NULL AS VARCHAR) AS str
FROM stats WHERE independent_var_value IN ({AREAS}) AND dependent_var IN ({', '.join(lit(v) for v in NUMERIC)})
UNION ALL
SELECT 'numbers_' || {paste('independent_var_value', 'dependent_var', 'dependent_var_value')},
  CAST(numbers * 100 AS DOUBLE), CAST(NULL AS VARCHAR)
FROM stats WHERE independent_var_value IN ({AREAS})
  AND dependent_var IN ({', '.join(lit(v) for v in config.BIND_SHARE_VARS)})
UNION ALL
SELECT 'dependent_var_value_' || {paste('independent_var_value', 'dependent_var', 'dependent_var_value')},
  CAST(NULL AS DOUBLE), CAST(dependent_var_value AS VARCHAR)
FROM stats WHERE independent_var_value IN ({AREAS})
  AND dependent_var IN ({', '.join(lit(v) for v in config.BIND_SHARE_VARS)})"""


def _num(x: str, d: int) -> str:
    return f"regexp_replace(CAST(round_even({x}, {d}) AS VARCHAR), '\\.0$', '')"


def _fmt(percent: bool) -> str:
    n2 = "round_even(numbers, 2)"
    if percent:
        main = f"({_num(f'{n2} * 100', 0)} || '%')"
        lo, hi = f"({_num('min * 100', 0)} || '%')", f"({_num('max * 100', 0)} || '%')"
    else:
        main, lo, hi = _num(n2, 2), _num("min", 2), _num("max", 0)
    interval = (f"(CASE WHEN min IS NULL AND max IS NULL THEN '' ELSE "
                f"'(' || coalesce({lo}, 'NA') || '-' || coalesce({hi}, 'NA') || ')' END)")
    s = f"(coalesce({main}, 'NA') || ' ' || {interval})"
    return f"(CASE WHEN {s} = '0 (0-0)' THEN '0' WHEN {s} = '0% (0%-0%)' THEN '0%' ELSE {s} END)"


STAT_FORMAT = f"""SELECT dependent_var, dependent_var_value, independent_var, independent_var_value,
  CASE WHEN dependent_var NOT IN ({', '.join(lit(n) for n in NUMERIC)}) THEN {_fmt(True)} ELSE {_fmt(False)} END
    AS formatted
FROM stats"""



def plan_sql() -> str:
    """The statistics of every analysable row of the plan, each from its respondent table."""
    so = {"o_orderpriority", "o_orderstatus", "home_region", "home_nation", "o_totalprice", "customer_number", "country", "regions"}
    se = {"event_types", "mobile_accepted", "country", "regions"}
    kinds = {name: type_.split(" ")[0] for name, type_ in config.BIND_QUESTIONS}
    parts = []
    for question, _, by, repeat in config.BIND_PLAN:
        for src, columns in (("so", so), ("se", se)):
            if not {question, by, *([repeat] if repeat else [])} <= columns:
                continue
            rep = f"CAST({repeat} AS VARCHAR)" if repeat else "CAST(NULL AS VARCHAR)"
            head = (f"{lit(question)} AS dependent_var, {lit(by)} AS independent_var, CAST({by} AS VARCHAR) AS independent_var_value, "
                    f"{lit(repeat) if repeat else 'CAST(NULL AS VARCHAR)'} AS repeat_var, {rep} AS repeat_var_value")
            seen = f"{question} IS NOT NULL" + (f" AND {repeat} IS NOT NULL" if repeat else "")
            if kinds[question] in ("decimal", "integer"):
                x = f"TRY_CAST({question} AS DOUBLE)"
                parts.append(f"""SELECT dependent_var, CAST(NULL AS VARCHAR) AS dependent_var_value, independent_var, independent_var_value,
  {clean_mean('x')} AS numbers, stddev_samp(x) / sqrt(count(x)) AS se, repeat_var, repeat_var_value
FROM (SELECT {head}, {x} AS x FROM {src} WHERE {seen} AND {x} IS NOT NULL) GROUP BY ALL""")
                continue
            option = f"unnest(list_distinct(string_split({question}, ' ')))" if kinds[question] == "select_multiple" else question
            keys = "dependent_var, independent_var, independent_var_value, repeat_var, repeat_var_value"
            parts.append(f"""SELECT dependent_var, option AS dependent_var_value, independent_var, independent_var_value,
  n / base AS numbers, sqrt((n / base) * (1 - n / base) / base) AS se, repeat_var, repeat_var_value
FROM (SELECT {keys}, option, count(*) AS n, any_value(base) AS base FROM (
    SELECT *, {option} AS option FROM (SELECT {head}, {question}, count(*) OVER (PARTITION BY {by}, {rep}) AS base
      FROM {src} WHERE {seen}))
  WHERE option <> '' GROUP BY ALL)""")
    return ("SELECT *, numbers - 1.96 * se AS min, numbers + 1.96 * se AS max FROM (" +
            " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts) + ")")


LISTS = """SELECT 'home_region' AS question, CAST(r_regionkey AS VARCHAR) AS code, r_name AS label FROM region
UNION ALL SELECT 'home_nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation"""
LABELLED_BY_LIST = """SELECT p.* REPLACE (coalesce(a.label, p.dependent_var_value) AS dependent_var_value,
  coalesce(b.label, p.independent_var_value) AS independent_var_value)
FROM planned p LEFT JOIN lists a ON p.dependent_var = a.question AND p.dependent_var_value = a.code
LEFT JOIN lists b ON p.independent_var = b.question AND p.independent_var_value = b.code"""

LABELLED = f"""SELECT s.dependent_var, l.label AS dependent_var_value, s.independent_var, s.independent_var_value,
  s.numbers, s.se, s.min, s.max, s.repeat_var, s.repeat_var_value
FROM (SELECT * FROM shares_one WHERE dependent_var = 'home_region') s
LEFT JOIN (SELECT name, arg_min(label, seq) AS label FROM (
    SELECT CAST(n_nationkey AS BIGINT) AS seq, CAST(n_regionkey AS VARCHAR) AS name, n_name AS label FROM nation)
  GROUP BY name) l ON s.dependent_var_value = l.name"""

AREA_BY_VAR = "SELECT independent_var_value, " + ", ".join(
    f"max({r6('numbers')}) FILTER (WHERE dependent_var || '.' || coalesce(dependent_var_value, 'NA') = {lit(k)}) AS {q(k)}"
    for k in config.BIND_AREA_KEYS) + " FROM stats GROUP BY independent_var_value"

# ----------------------------------------------------------------- cleaning
DATA_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SEQ = "10000000000000"
CLEAN_BASE = [
    ("cdata", "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 101 = 0"),
    ("cleanlog", f"""SELECT 1 * {SEQ} + o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS uuid, 'o_orderpriority' AS variable,
    '1-URGENT' AS new_value, CASE WHEN o_orderkey % 3 = 1 THEN 'TRUE' WHEN o_orderkey % 3 = 2 THEN 'FALSE' END AS change
  FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 2 * {SEQ} + o_orderkey, CAST(o_orderkey AS VARCHAR), 'o_orderpriority', CAST(NULL AS VARCHAR), 'TRUE'
  FROM orders WHERE o_orderkey % 14 = 0
  UNION ALL SELECT 3 * {SEQ} + o_orderkey, CAST(o_orderkey AS VARCHAR), 'no_such_column', 'x', 'TRUE'
  FROM orders WHERE o_orderkey % 21 = 0
  UNION ALL SELECT 4 * {SEQ} + o_orderkey, CAST(o_orderkey AS VARCHAR), 'o_orderstatus', 'F', 'TRUE'
  FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 5 * {SEQ}, '10000000', 'o_orderstatus', 'F', 'TRUE'"""),
    ("classified", f"""SELECT l.seq, l.uuid, l.variable, l.new_value,
    coalesce(l.change NOT IN ('F', 'FALSE', 'false', 'False'), true) AS change,
    CASE WHEN c.n > 1 THEN 'duplicated_id' WHEN c.n IS NULL THEN 'unknown_id'
      WHEN l.variable NOT IN ({', '.join(lit(c) for c in sorted(DATA_COLS))}) THEN 'unknown_variable' END AS reason
  FROM cleanlog l LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS id, count(*) AS n FROM cdata GROUP BY 1) c
    ON l.uuid = c.id"""),
    ("accepted", "SELECT * FROM classified WHERE reason IS NULL AND change"),
    ("last_write", """SELECT uuid, variable, new_value FROM (
    SELECT *, row_number() OVER (PARTITION BY uuid, variable ORDER BY seq DESC) AS rn FROM accepted) WHERE rn = 1"""),
]


def _clean_col(c: str, typ: str) -> str:
    if c == "o_orderkey":
        return c
    has = f"EXISTS (SELECT 1 FROM last_write w WHERE w.uuid = CAST(d.o_orderkey AS VARCHAR) AND w.variable = {lit(c)})"
    val = (f"(SELECT w.new_value FROM last_write w WHERE w.uuid = CAST(d.o_orderkey AS VARCHAR) "
           f"AND w.variable = {lit(c)})")
    if typ != "VARCHAR":
        val = f"TRY_CAST({val} AS {typ})"
    return f"CASE WHEN {has} THEN {val} ELSE d.{c} END AS {c}"


_TYPES = {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR",
          "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR"}
CLEAN = "SELECT " + ", ".join(_clean_col(c, _TYPES[c]) for c in DATA_COLS) + " FROM cdata d"
OLD_VALUE = "CASE " + " ".join(f"WHEN a.variable = {lit(c)} THEN CAST(d.{c} AS VARCHAR)"
                                for c in DATA_COLS if c != "o_orderkey") + " END"
CHANGELOG = f"""SELECT a.variable, a.uuid, {OLD_VALUE} AS old_value, a.new_value, a.change,
  'o_orderkey' AS id_column, a.seq
FROM accepted a LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS did, * FROM cdata) d ON a.uuid = d.did"""


# ----------------------------------------------------------------- report
def _w2l(src: str, prefix_sql: str, ids: list[str], cols: list[str]) -> str:
    casts = ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in cols)
    idl = ", ".join(ids)
    inner = f"SELECT {idl + ', ' if ids else ''}{casts} FROM {src}"
    return (f"SELECT {prefix_sql} || var AS key, val AS num, CAST(NULL AS VARCHAR) AS str FROM "
            f"({inner}) UNPIVOT INCLUDE NULLS (val FOR var IN ({', '.join(q(c) for c in cols)}))")


REGION_PREFIX = "(replace(regions, ' ', '') || '_')"
REGION_ONLY = "regions IS NOT NULL"
MEB_REG_COLS = [("regional_" + c if c in ("meb_food", "meb_full") else c) for c in MEB_COLS]
MEB_NAT_COLS = [("national_" + c if c in ("meb_food", "meb_full") else c) for c in MEB_COLS]

REPORT_PIECES = [
    _w2l("(SELECT * FROM all_means WHERE level = 'national' AND collection_order = 4)", "'national_'", [],
         PRICES),
    _w2l(f"(SELECT * FROM all_means WHERE level = 'region' AND collection_order = 4 AND {REGION_ONLY})",
         REGION_PREFIX, ["regions"], PRICES),
    _w2l("(SELECT * FROM all_means WHERE level = 'settlement' AND collection_order = 4)",
         "settlement || '_'", ["settlement"], PRICES),
    _w2l("(SELECT * FROM ch_national LEFT JOIN ch_meb_national USING (regions))", "'national_'", [],
         CH_ITEM_COLS + CH_NMEB_COLS),
    _w2l(f"""(SELECT * FROM (SELECT * REPLACE (lower(regions) AS regions) FROM ch_region)
        LEFT JOIN (SELECT * REPLACE (lower(regions) AS regions) FROM ch_meb_region) USING (regions)
        WHERE {REGION_ONLY})""", REGION_PREFIX, ["regions"], CH_ITEM_COLS + CH_RMEB_COLS),
    _w2l("ch_settlement_merged", "settlement || '_'", ["settlement"], CH_ITEM_COLS + CH_SMEB_COLS),
    _w2l("(SELECT * FROM meb WHERE collection_order = 4)", "settlement || '_'", ["settlement"], MEB_COLS),
    _w2l(f"(SELECT * FROM meb_regional WHERE collection_order = 4 AND {REGION_ONLY})", REGION_PREFIX,
         ["regions"], MEB_REG_COLS),
    _w2l("(SELECT * FROM meb_national WHERE collection_order = 4)", "'national_'", ["regions"], MEB_NAT_COLS),
    "SELECT 'national_regions' AS key, CAST(NULL AS DOUBLE) AS num, regions AS str "
    "FROM meb_national WHERE collection_order = 4",
    "SELECT 'num_market_assessed_' || level, CAST(num_market_assessed AS DOUBLE), CAST(NULL AS VARCHAR) FROM counts",
    "SELECT 'num_assessed_' || level, CAST(num_assessed AS DOUBLE), CAST(NULL AS VARCHAR) FROM counts",
    "SELECT 'expansive_rank_' || CAST(rank AS VARCHAR), CAST(NULL AS DOUBLE), settlement FROM rank_tb",
]

COUNTS = f"""SELECT 'national' AS level, count(*) AS num_market_assessed, CAST(sum(n) AS BIGINT) AS num_assessed
FROM cells
UNION ALL
SELECT regions, count(*), CAST(sum(n) AS BIGINT) FROM cells GROUP BY regions"""
CELLS = f"SELECT regions, market_final, count(*) AS n FROM ip WHERE month = {lit(config.THIS_ROUND)} GROUP BY 1, 2"

def report_row_sql() -> str:
    """The template's cells out of the long report ``rl``; every cell is named by its key."""
    num = ("CASE WHEN isnan(num) THEN 'NaN' WHEN isinf(num) THEN CASE WHEN num > 0 THEN 'Inf' ELSE '-Inf' END "
           "ELSE CAST(CAST(round_even(num, 0) AS HUGEINT) AS VARCHAR) END")
    texts = ", ".join(lit(key) for _, kind, key in template.cells() if kind == TEXT)
    keys = ", ".join(lit(key) for _, _, key in template.cells())
    return (f"SELECT * FROM (PIVOT (SELECT key, CASE WHEN key IN ({texts}) THEN str ELSE {num} END AS v "
            f"FROM (SELECT key, max(num) AS num, max(str) AS str FROM rl GROUP BY key)) ON key IN ({keys}) USING first(v))")


EXPORTED = list(zip(config.PRICE_TABLE_NAMES, [
    *(f"(SELECT * FROM all_means WHERE level = '{lv}')" for lv in ("market", "settlement", "district", "region", "national")),
    "ch_settlement_merged", "ch_region", "ch_national", "rank_tb"])) + list(zip(config.BASKET_TABLE_NAMES, [
        "meb", "meb_regional", "meb_national", "ch_meb_settlement", "ch_meb_region", "ch_meb_national"])) + [
    ("clean data", "cdata"), ("analysis", "stats"), ("report", "(SELECT 1)")]

# ----------------------------------------------------------------- files
_KEY = "CAST(split_part(uuid, '-', 1) AS BIGINT)"
_ROUND = "CASE month WHEN 10 THEN 'this' WHEN 9 THEN 'last' ELSE 'first' END"
_SPOILED = f"({_KEY} % {RT.CUT} = 0 OR {_KEY} % {RT.WORDED} = 0 OR {_KEY} % {RT.NAMELESS} = 0)"
FILE_ROWS = f"""SELECT uuid, month, day, settlement, market, CASE WHEN month <> 3 THEN market_other END AS market_other,
  {", ".join(PRICES)}, weight_economy, weight_large, CASE WHEN month = 10 THEN 'e' || CAST(day AS VARCHAR) END AS enumerator
FROM raw WHERE NOT {_SPOILED}"""
FILE_REJECTS = f"""SELECT round, reason, count(*) AS n FROM (
  SELECT {_ROUND} AS round, CASE WHEN {_KEY} % {RT.CUT} = 0 THEN 'malformed' WHEN {_KEY} % {RT.NAMELESS} = 0 THEN 'missing uuid'
    ELSE 'no integer month' END AS reason FROM raw WHERE {_SPOILED}) GROUP BY ALL"""
FILE_DRIFT = """SELECT DISTINCT round, "column", issue FROM (SELECT CASE month WHEN 10 THEN 'this' WHEN 9 THEN 'last' ELSE 'first' END AS round FROM raw)
JOIN (VALUES ('this', 'enumerator', 'unexpected'), ('last', 'weight_economy', 'moved'), ('last', 'uuid', 'moved'),
  ('first', 'market_other', 'missing')) AS d(round, "column", issue) USING (round)"""


# ----------------------------------------------------------------- queries
def _sql(ctes: list[tuple[str, str]], body: str) -> str:
    return with_(ctes, body)


def build() -> dict[str, str]:
    B = BASE
    out: dict[str, str] = {}
    meas = [f"price_{i}" for i in ITEMS] + ["weight_economy", "weight_large"]
    out["null_tokens_sentinels"] = _sql(B, "SELECT uuid, month, settlement, "
                                        "CASE WHEN market NOT IN ('', ' ', 'NA') THEN market END AS market, " +
                                        ", ".join(f"{r6(rec(m))} AS {m}" for m in meas) + " FROM st")
    out["round_stack"] = _sql(B, "SELECT uuid, month, collection_order, day, settlement, market, market_other FROM st")
    out["geo_enrich"] = _sql(B, "SELECT month, country, district, regions, settlement, market_final, uuid, " +
                             ", ".join(f"{r6(m)} AS {m}" for m in meas) + " FROM obs")
    out["centroid_union"] = _sql(B, "SELECT settlement, district, objectid, name, type, "
                                 f"{r6('longitude')} AS longitude, {r6('latitude')} AS latitude FROM settlements")
    out["market_other"] = _sql(B, "SELECT uuid, month, market, market_other, CASE WHEN market = 'Other' "
                               "THEN market_other ELSE market END AS market_final FROM st")
    out["unit_price"] = _sql(B, "SELECT uuid, month, settlement, collection_order, " +
                             ", ".join(f"{r6(finite(f'price_{i}'))} AS price_{i}" for i in UNIT) + " FROM ip")
    for lv in LEVEL_KEYS:
        cols = LEVEL_KEYS[lv] + PRICES
        out[f"mean_{lv if lv != 'region' else 'region'}"] = _sql(B + [("lv", level_sql(lv))],
                                                                 rounded(cols, "lv", PRICES))
    out["mean_all_levels"] = _sql(B + [("am", ALL_LEVELS)], rounded(["level"] + CELL_KEYS + PRICES, "am", PRICES))
    cnt = B + [("cells", CELLS), ("counts", COUNTS)]
    out["count_region"] = _sql(cnt, "SELECT * FROM counts WHERE level <> 'national'")
    out["count_national"] = _sql(cnt, "SELECT * FROM counts")
    out["settlements_per_region"] = _sql(B, "SELECT regions, month, count(*) AS markets_numer FROM "
                                         "(SELECT regions, month, settlement FROM ip GROUP BY ALL) GROUP BY regions, month")
    medc = meb_ctes("c_", [config.THIS_ROUND, config.LAST_ROUND])
    mkeys = ["settlement", "district", "regions", "month", "collection_order"]
    out["median_settlement"] = _sql(B + medc[:1], rounded(mkeys + PRICES, "c_med", PRICES))
    out["impute_hierarchical"] = _sql(B + medc[:5], rounded(mkeys + PRICES, "c_imp3", PRICES))
    mb = B + MEB
    meb_all = ["month"] + mkeys[:3] + ["collection_order"] + MEB_COLS
    out["basket_settlement"] = _sql(mb, rounded(meb_all, "meb", MEB_COLS))
    mr = mb + ROLLUPS
    out["basket_region"] = _sql(mr, rounded(["regions", "month", "collection_order"] + MEB_REG_COLS,
                                            "meb_regional", MEB_REG_COLS))
    out["basket_national"] = _sql(mr, rounded(["month", "collection_order"] + MEB_NAT_COLS + ["regions"],
                                              "meb_national", MEB_NAT_COLS))
    ch = mr + CHANGES
    out["pct_change_settlement"] = _sql(ch, rounded(["settlement"] + CH_ITEM_COLS, "ch_settlement", CH_ITEM_COLS))
    out["pct_change_region"] = _sql(ch, rounded(["regions"] + CH_ITEM_COLS, "ch_region", CH_ITEM_COLS))
    out["pct_change_national"] = _sql(ch, rounded(CH_ITEM_COLS + ["regions"], "ch_national", CH_ITEM_COLS))
    out["pct_change_meb_settlement"] = _sql(ch, rounded(["settlement"] + CH_SMEB_COLS, "ch_meb_settlement",
                                                        CH_SMEB_COLS))
    out["pct_change_meb_region"] = _sql(ch, rounded(["regions"] + CH_RMEB_COLS, "ch_meb_region", CH_RMEB_COLS))
    out["pct_change_meb_national"] = _sql(ch, rounded(CH_NMEB_COLS + ["regions"], "ch_meb_national",
                                                      CH_NMEB_COLS))
    out["pct_change_merged"] = _sql(ch, rounded(["settlement"] + CH_ITEM_COLS + CH_SMEB_COLS,
                                                "ch_settlement_merged", CH_ITEM_COLS + CH_SMEB_COLS))
    out["rank_top_bottom"] = _sql(mb + [("rank_tb", RANK)], "SELECT settlement, " + r6("meb_full") +
                                  " AS meb_full, rank FROM rank_tb")
    out["rank_all"] = _sql(mb, f"""SELECT settlement, {r6("meb_full")} AS meb_full, CAST(row_number() OVER (
      ORDER BY meb_full DESC NULLS LAST, settlement ASC NULLS LAST) AS INTEGER) AS rank
    FROM meb WHERE month = {lit(config.THIS_ROUND)}""")
    sv = SURVEY
    out["share_select_one"] = _sql(sv, rounded(STAT_COLS, "shares_one", STAT_DBL))
    out["share_select_multiple"] = _sql(sv, rounded(STAT_COLS, "shares_multiple", STAT_DBL))
    out["numeric_mean_ci"] = _sql(sv, rounded(STAT_COLS, "numeric", STAT_DBL))
    out["label_first_match"] = _sql(sv + [("labelled", LABELLED)], rounded(STAT_COLS, "labelled", STAT_DBL))
    out["top_answers"] = _sql(sv + TOPK + [("tl", TOP_LONG)], f"SELECT key, {r6('num')} AS num, str FROM tl")
    out["area_scalars"] = _sql(sv + [("a", AREA_SCALARS)], f"SELECT key, {r6('num')} AS num, str FROM a")
    out["stat_format"] = _sql(sv, STAT_FORMAT)
    tests = (f"SELECT {lit(config.BIND_SELECT_ONE[0])} AS dependent_var, CASE WHEN r_regionkey % 2 = 0 THEN 'regions' "
             "ELSE 'country' END AS independent_var, min((r_regionkey + 1) / 100) AS p_value FROM region GROUP BY ALL")
    out["attach_p_value"] = _sql(sv + [("tests", tests),
                                       ("pv", "SELECT * FROM stats LEFT JOIN tests USING (dependent_var, independent_var)")],
                                 rounded(STAT_COLS + ["p_value"], "pv", STAT_DBL + ["p_value"]))
    out["flag_substring"] = _sql(sv, "SELECT uuid, event_types, mobile_accepted FROM se")
    top_cols = [c for k in top_keys() for c in (f"numbers_{k}", f"dependent_var_value_{k}")]
    out["pivot_two_values"] = _sql(sv + TOPK + [("p2", pivot_two_sql())],
                                   rounded(top_cols, "p2", [c for c in top_cols if c.startswith("numbers_")]))
    out["area_by_var_wide"] = _sql(sv, f"SELECT * FROM ({AREA_BY_VAR})")
    out["unpivot_items"] = _sql(B + [("ms", level_sql("settlement"))],
                                "SELECT settlement, var_name, " + r6("var_value") + " AS var_value FROM "
                                "(SELECT settlement, " + ", ".join(PRICES) +
                                " FROM ms WHERE collection_order = 4) UNPIVOT INCLUDE NULLS "
                                "(var_value FOR var_name IN (" + ", ".join(PRICES) + "))")
    cl = CLEAN_BASE
    out["cleaning_apply"] = _sql(cl, rounded(DATA_COLS, f"({CLEAN})", ["o_totalprice"]))
    out["cleaning_changelog"] = _sql(cl, CHANGELOG)
    out["cleaning_rejects"] = _sql(cl, "SELECT * FROM classified WHERE reason IS NOT NULL")
    out["derive_followups"] = _sql(cl, "SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS "
                                   "status_f_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END "
                                   f"AS urgent_custkey FROM ({rounded(DATA_COLS, f'({CLEAN})', ['o_totalprice'])})")
    rep = ch + cnt[len(B):] + [("rank_tb", RANK)] + sv + TOPK + \
        [("rl", " UNION ALL ".join([*REPORT_PIECES, TOP_LONG, AREA_SCALARS]))]
    out["report_long"] = _sql(rep, f"SELECT key, {r6('num')} AS num, str FROM rl")
    out["report_row"] = _sql(rep, report_row_sql())
    planned = sv + [("planned", plan_sql())]
    out["analyse_plan"] = _sql(planned, rounded(STAT_COLS, "planned", STAT_DBL))
    out["label_by_list"] = _sql(planned + [("lists", LISTS), ("lbl", LABELLED_BY_LIST)], rounded(STAT_COLS, "lbl", STAT_DBL))
    raw = [("raw", RAW)]
    file_cols = ["uuid", "month", "day", "settlement", "market", "market_other", *PRICES, "weight_economy", "weight_large", "enumerator"]
    out["read_rounds_csv"] = _sql(raw + [("f", FILE_ROWS)], rounded(file_cols, "f", PRICES + ["weight_economy", "weight_large"]))
    out["read_rejects"] = _sql(raw, FILE_REJECTS)
    out["read_drift"] = _sql(raw, FILE_DRIFT)
    filed = [(n, FILE_ROWS if n == "stacked" else sql) for n, sql in B]
    out["means_from_files"] = _sql(filed + [("am", ALL_LEVELS)], rounded(["level"] + CELL_KEYS + PRICES, "am", PRICES))
    out["read_cleaning_log_csv"] = _sql(CLEAN_BASE[:2], "SELECT seq, uuid, variable, new_value, change FROM cleanlog")
    out["basket_from_file"] = out["basket_settlement"]
    out["means_incremental"] = out["mean_all_levels"]
    out["export_rows"] = _sql(rep + CLEAN_BASE[:1], "\nUNION ALL ".join(
        f"SELECT {lit(name)} AS \"table\", count(*) AS n_rows FROM {src}" for name, src in EXPORTED))
    out["export_summary"] = _sql(sv, f"SELECT dependent_var, dependent_var_value, independent_var, independent_var_value, "
                                 f"{r6('numbers')} AS numbers, repeat_var, repeat_var_value FROM stats")
    by_sett = CH_ITEM_COLS + CH_SMEB_COLS
    out["report_by_settlement"] = _sql(
        ch + [("rs", f"SELECT a.settlement, {', '.join('a.' + q(c) for c in PRICES)}, "
                     f"{', '.join('c.' + q(c) for c in by_sett)}, {', '.join('m.' + q(c) for c in MEB_COLS)} "
                     "FROM (SELECT * FROM all_means WHERE level = 'settlement' AND collection_order = 4) a "
                     "LEFT JOIN ch_settlement_merged c ON a.settlement IS NOT DISTINCT FROM c.settlement "
                     "LEFT JOIN (SELECT * FROM meb WHERE collection_order = 4) m "
                     "ON a.settlement IS NOT DISTINCT FROM m.settlement")],
        rounded(["settlement"] + PRICES + by_sett + MEB_COLS, "rs", PRICES + by_sett + MEB_COLS))
    return out


_CACHE: dict[str, str] | None = None


def oracle_sql() -> dict[str, str]:
    global _CACHE
    if _CACHE is None:
        _CACHE = build()
    return dict(_CACHE)
