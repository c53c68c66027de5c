"""DuckDB SQL twin of ``gapmeter.sources.adapter`` and ``gapmeter.plans.core``.

Used only to build the independent oracle queries in ``gapmeter.oracle.sql``:
the driver runs these against the same Parquet files and compares results.
Each helper returns a SQL fragment; nothing here runs Spark.
"""

from __future__ import annotations

from ..functions.arrays import ECO_CODE_WHITELIST
from ..sources.adapter import CODE_CYCLE


def num(x: str) -> str:
    t = f"replace(trim({x}), ',', '.')"
    return (f"(CASE WHEN regexp_full_match({t}, '-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?') "
            f"THEN TRY_CAST({t} AS DOUBLE) END)")


def date(x: str) -> str:
    h = f"substr(trim({x}), 1, 10)"
    return f"(CASE WHEN regexp_full_match({h}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({h} AS DATE) END)"


def blank(x: str) -> str:
    return f"nullif(trim({x}), '')"


def norm(x: str) -> str:
    return f"nullif(upper(regexp_replace(trim(coalesce({x}, '')), '[^A-Za-z0-9]+', '', 'g')), '')"


def letter(x: str) -> str:
    return f"upper(substr(trim(coalesce({x}, '')), 1, 1))"


def drive_class(ft: str, fm: str) -> str:
    t = f"lower(trim(coalesce({ft}, '')))"
    m = f"upper(trim(coalesce({fm}, '')))"
    return (f"(CASE WHEN {t} = 'hydrogen' THEN 'FCEV' WHEN {m} = 'E' THEN 'BEV' "
            f"WHEN {m} = 'P' THEN 'PHEV' WHEN {m} = 'H' THEN 'HEV' WHEN {m} = 'B' THEN 'BIFUEL' "
            f"WHEN {m} = 'F' THEN 'FLEX' WHEN {m} = 'M' AND {t} = 'diesel' THEN 'ICE_DIESEL' "
            f"WHEN {m} = 'M' AND {t} = 'petrol' THEN 'ICE_BENZIN' WHEN {m} = 'M' THEN 'ICE_SONSTIGE' "
            f"ELSE 'UNBEKANNT' END)")


def eco(x: str) -> str:
    wl = "[" + ",".join(f"'{c}'" for c in ECO_CODE_WHITELIST) + "]"
    toks = (f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), "
            f"lambda s: regexp_full_match(s, '[0-9]+') AND length(s) % 2 = 0)")
    pairs = (f"flatten(list_transform({toks}, lambda s: "
             f"list_transform(range(1, length(s) + 1, 2), lambda g: substr(s, g, 2))))")
    codes = f"list_sort(list_distinct(list_filter({pairs}, lambda q: list_contains({wl}, q))))"
    return (f"(CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL "
            f"WHEN len({codes}) > 0 THEN {codes} END)")


def rnd(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


BASE = """
base AS (
  SELECT l.*, o.*, c.*, n.*, r.*, p.*, s.*, l.l_orderkey AS k,
         CASE WHEN l.l_suppkey % 29 = 0 THEN NULL WHEN l.l_suppkey % 23 = 0 THEN 'F'
              ELSE CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'E' WHEN '2' THEN 'P'
              WHEN '3' THEN 'H' WHEN '4' THEN 'M' ELSE 'B' END END AS fm0,
         CAST(year(o.o_orderdate) AS INTEGER) AS yr,
         p.p_size * 40 + 500 AS mass
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
base2 AS (
  SELECT *, CASE WHEN l_partkey % 97 = 0 THEN 'hydrogen' WHEN fm0 = 'E' THEN 'electric'
         WHEN fm0 = 'P' THEN 'petrol/electric' WHEN l_returnflag = 'A' THEN 'petrol'
         WHEN l_returnflag = 'N' THEN 'diesel' ELSE 'lpg' END AS ft0
  FROM base
)"""

_CYC = "[" + ",".join(f"'{c}'" for c in CODE_CYCLE) + "]"
_C1 = f"list_extract({_CYC}, CAST(l_partkey % 12 + 1 AS INTEGER))"
_C2 = f"list_extract({_CYC}, CAST(l_suppkey % 12 + 1 AS INTEGER))"
_E = "concat('e', CAST(k % 9 AS VARCHAR))"

RAW = f"""
raw AS (
  SELECT CAST(k * 10 + l_linenumber AS VARCHAR) AS id,
    CASE WHEN k % 9 = 0 THEN lower(n_name) ELSE n_name END AS ms,
    CASE WHEN c_custkey % 5 < 2 THEN c_mktsegment WHEN c_custkey % 5 = 2 THEN '' END AS mp,
    s_name AS mh, p_brand AS man,
    CASE WHEN k % 4 = 1 THEN lower(p_brand) ELSE p_brand END AS mk,
    CASE WHEN k % 5 = 2 THEN upper(p_name) ELSE p_name END AS cn,
    CASE WHEN k % 17 = 0 THEN 'N1' WHEN k % 19 = 0 THEN '' WHEN k % 23 = 0 THEN NULL
         WHEN k % 7 = 0 THEN ' m1g' ELSE 'M1' END AS ct,
    CASE WHEN k % 13 = 0 THEN 'n/a' WHEN k % 11 = 0 THEN ''
         WHEN k % 3 = 0 THEN replace(CAST(CAST(mass AS DECIMAL(12,2)) AS VARCHAR), '.', ',')
         WHEN k % 7 = 0 THEN concat(' ', CAST(mass AS VARCHAR), ' ')
         ELSE CAST(CAST(mass AS DECIMAL(12,1)) AS VARCHAR) END AS m_kg,
    CAST(mass + 100 AS VARCHAR) AS mt,
    CASE WHEN fm0 = 'E' THEN '0' ELSE concat(CAST(60 + p_size * 3 AS VARCHAR),
         CASE WHEN k % 3 = 0 THEN ',' ELSE '.' END, CAST(p_partkey % 10 AS VARCHAR)) END AS ewltp,
    CASE WHEN k % 2 = 0 THEN upper(ft0) ELSE ft0 END AS ft,
    CASE WHEN k % 6 = 5 THEN ' ' || lower(fm0) || ' ' ELSE fm0 END AS fm,
    CAST(p_size * 3 + 40 AS VARCHAR) AS ep_kw,
    CASE WHEN fm0 IN ('E', 'P') THEN CAST(p_size * 4 + 120 AS VARCHAR) END AS z_whkm,
    CASE WHEN fm0 = 'E' THEN NULL ELSE concat(CAST(4 + p_size // 5 AS VARCHAR), '.',
         CAST(p_size % 5 * 2 AS VARCHAR)) END AS fc,
    CASE k % 4 WHEN 0 THEN concat({_E}, ' ', {_C1}, ' ', {_C2})
               WHEN 1 THEN concat({_E}, ' ', {_C1}, {_C2})
               WHEN 2 THEN concat({_E}, {_C1}, '  ', {_C2}) END AS it_code,
    CASE WHEN k % 4 < 3 THEN concat(CAST(l_linenumber AS VARCHAR), ',', CAST(p_partkey % 10 AS VARCHAR)) END AS erwltp,
    CASE WHEN k % 37 = 0 THEN strftime(o_orderdate, '%d.%m.%Y')
         WHEN k % 5 = 0 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T10:00')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dr,
    CAST(yr AS VARCHAR) AS jahr,
    CASE WHEN yr >= 2000 THEN 'P' ELSE 'F' END AS status,
    concat('co2cars_', CAST(yr AS VARCHAR), CASE WHEN yr >= 2000 THEN 'P' ELSE 'F' END, 'v',
           CAST(yr % 7 + 10 AS VARCHAR)) AS version_file,
    CASE WHEN k % 8 = 3 THEN '' ELSE concat('e', cast(l_partkey % 50 AS VARCHAR), '*', cast(l_suppkey % 9 AS VARCHAR)) END AS tan,
    concat('T', cast(l_partkey % 30 AS VARCHAR)) AS typ,
    cast(l_suppkey % 6 AS VARCHAR) AS va,
    CASE WHEN k % 10 <> 7 THEN cast(l_linenumber AS VARCHAR) END AS ve,
    CASE WHEN k % 21 = 0 THEN 'unbek.' WHEN fm0 = 'E' THEN '0' ELSE concat(cast(50 + p_size * 3 AS VARCHAR), '.', cast(p_partkey % 10 AS VARCHAR)) END AS enedc,
    CASE WHEN k % 33 = 0 THEN '' ELSE concat(cast(2500 + p_size * 10 AS VARCHAR), CASE WHEN k % 2 = 0 THEN ',5' ELSE '' END) END AS w_mm,
    CASE WHEN fm0 = 'E' THEN NULL ELSE cast(p_size * 50 + 900 AS VARCHAR) END AS ec_cm3,
    CASE WHEN k % 101 = 0 THEN '2' WHEN k % 103 <> 0 THEN '1' END AS r_count
  FROM base2
)"""

_RAW_COLS = ("ms mp mh man mk cn ct m_kg mt ewltp ft fm ep_kw z_whkm fc it_code erwltp dr "
             "status version_file tan typ va ve enedc w_mm ec_cm3 r_count").split()
_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in _RAW_COLS)

REG = f"""
cars AS (SELECT * FROM raw WHERE upper(trim(coalesce(ct, ''))) IN ('M1', 'M1G')),
dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jahr, id ORDER BY {_ORDER}) AS rn FROM cars)
  WHERE rn = 1
),
reg AS (
  SELECT CAST({num('id')} AS BIGINT) AS src_id, CAST({num('jahr')} AS INTEGER) AS jahr,
    upper(trim(ms)) AS ms, {blank('mp')} AS mp_pool, {blank('mh')} AS mh_name, {blank('man')} AS man_name,
    {blank('mk')} AS marke, {blank('cn')} AS handelsname, {norm('mk')} AS marke_norm,
    {norm('cn')} AS handelsname_norm, upper(trim(ct)) AS fahrzeugklasse,
    lower({blank('ft')}) AS ft, {letter('fm')} AS fm, {drive_class('ft', 'fm')} AS antriebsklasse,
    {drive_class('ft', 'fm')} IN ('BEV', 'PHEV', 'HEV', 'FCEV') AS ist_elektrifiziert,
    {drive_class('ft', 'fm')} IN ('BEV', 'PHEV') AS ist_extern_ladbar,
    {num('m_kg')} AS masse_kg, {num('mt')} AS pruefmasse_kg, {num('ewltp')} AS co2_wltp,
    {num('ep_kw')} AS leistung_kw, {num('z_whkm')} AS strom_wh_km, {num('fc')} AS verbrauch_l,
    {blank('it_code')} AS oeko_code_roh, {eco('it_code')} AS oeko_codes,
    {num('erwltp')} AS oeko_gutschrift, {date('dr')} AS zulassung_datum,
    {letter('status')} AS data_status, {blank('version_file')} AS source_version,
    {blank('tan')} AS genehmigung, {blank('typ')} AS typ, {blank('va')} AS variante, {blank('ve')} AS version,
    {num('enedc')} AS co2_nefz, CAST({rnd(num('w_mm'), 0)} AS INTEGER) AS radstand_mm, CAST({rnd(num('ec_cm3'), 0)} AS INTEGER) AS hubraum_cm3
  FROM dedup
)"""

_REAL = "(fuel_total_l / dist_total_km * 100)"
RW = f"""
rwsrc AS (
  SELECT concat(CAST(k AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS vehicle_id,
    n_name AS country, r_name AS region, CAST(yr AS VARCHAR) AS jahr_txt, o_orderstatus AS data_source,
    s_name AS mh, p_brand AS mk, p_name AS cn, CAST(mass AS DOUBLE) AS m_kg, CAST(mass + 100 AS DOUBLE) AS mt,
    CAST(p_size * 50 + 900 AS DOUBLE) AS ec_cm3, CAST(p_size * 3 + 40 AS DOUBLE) AS ep_kw,
    CASE WHEN k % 2 = 0 THEN upper(ft0) ELSE ft0 END AS ft, fm0 AS fm,
    CASE WHEN fm0 = 'E' THEN CAST(0 AS DOUBLE) ELSE CAST(600 + p_size * 30 + p_partkey % 10 AS DOUBLE) / 10 END AS ewltp,
    CASE WHEN fm0 = 'E' THEN NULL WHEN fm0 = 'P' THEN p_retailprice / 1000 ELSE p_retailprice / 100 END AS wltp_fc,
    CASE WHEN fm0 IN ('E', 'P') THEN CAST(p_size * 4 + 120 AS DOUBLE) END AS z_whkm,
    CASE WHEN fm0 IN ('E', 'P') THEN CAST(p_size * 2 + 30 AS DOUBLE) END AS e_range_km,
    CASE WHEN fm0 = 'E' THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / 100 END AS fuel_total_l,
    l_quantity * 100 AS dist_total_km,
    CASE WHEN fm0 = 'P' THEN l_quantity * 100 * l_discount * 8 END AS dist_cd_off_km,
    CASE WHEN fm0 = 'P' THEN l_tax * 10000 END AS grid_energy_kwh,
    CASE WHEN k % 50 = 0 THEN NULL WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS used_in_calc
  FROM base2
),
rw AS (
  SELECT vehicle_id, upper(trim(country)) AS land, region,
    CASE WHEN {num('jahr_txt')} BETWEEN 1900 AND 2100 THEN CAST(CAST({num('jahr_txt')} AS SMALLINT) AS INTEGER) END AS jahr,
    data_source, {blank('mh')} AS mh, {blank('mk')} AS marke, {blank('cn')} AS handelsname,
    {norm('mk')} AS marke_norm, {norm('cn')} AS handelsname_norm,
    m_kg AS masse_kg, mt AS pruefmasse_kg, ec_cm3 AS hubraum_cm3, ep_kw AS leistung_kw,
    lower({blank('ft')}) AS ft, {letter('fm')} AS fm, {drive_class('lower(ft)', 'fm')} AS antriebsklasse,
    {drive_class('lower(ft)', 'fm')} IN ('BEV', 'PHEV') AS ist_extern_ladbar,
    ewltp AS co2_wltp, wltp_fc AS fc_wltp, z_whkm AS strom_wh_km, e_range_km AS e_reichweite_km,
    fuel_total_l, dist_total_km, dist_cd_off_km, grid_energy_kwh AS grid_kwh,
    CASE WHEN dist_total_km > 0 THEN {rnd(_REAL, 3)} END AS fc_real,
    CASE WHEN dist_total_km > 0 AND wltp_fc > 0 THEN {rnd(_REAL + ' - wltp_fc', 3)} END AS gap_abs,
    CASE WHEN dist_total_km > 0 AND wltp_fc > 0 THEN {rnd('(' + _REAL + ' - wltp_fc) / wltp_fc * 100', 2)} END AS gap_pct,
    CASE WHEN dist_total_km > 0 AND dist_cd_off_km IS NOT NULL THEN {rnd('dist_cd_off_km / dist_total_km * 100', 3)} END AS anteil_elektrisch,
    used_in_calc = '1' AS eea_verwendbar,
    coalesce(dist_total_km, 0) >= 1000 AS hat_mindestlauf
  FROM rwsrc
),
ok AS (SELECT * FROM rw WHERE eea_verwendbar AND hat_mindestlauf AND gap_pct IS NOT NULL)"""


def with_reg(select: str) -> str:
    """Oracle query over the typed registration table ``reg`` (and ``raw``)."""
    return f"WITH {BASE},{RAW},{REG}\n{select}"


def with_raw(select: str) -> str:
    return f"WITH {BASE},{RAW}\n{select}"


def with_rw(select: str) -> str:
    """Oracle query over the meter table ``rw`` and its analysable subset ``ok``."""
    return f"WITH {BASE},{RW}\n{select}"


def with_all(select: str) -> str:
    return f"WITH {BASE},{RAW},{REG},{RW}\n{select}"
