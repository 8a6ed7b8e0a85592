"""The registered queries as SQL over the same tables.

These follow the rules in their long form: full grids of every key and period,
lags that step over rows, fills over the whole grid.  The operators avoid those
grids, so agreement is a check and not a restatement.
"""

from __future__ import annotations

from panelwise.plans.catalog import (
    COUNTRY,
    DROP,
    FISCAL_YEAR,
    LISTED,
    QUARTER,
    SINCE,
    SKIP,
    STOPPED_IN,
    UNIT,
    UNIT_NAMES,
)


def label(i: str = "period_idx") -> str:
    return (
        f"'FY' || lpad(CAST((({i} - 1) // 4) % 100 AS VARCHAR), 2, '0') || 'Q' || "
        f"CAST(({i} - 1) % 4 + 1 AS VARCHAR)"
    )


def idx(d: str) -> str:
    return f"CAST(year({d} + INTERVAL 3 MONTH) * 4 + quarter({d} + INTERVAL 3 MONTH) AS INTEGER)"


def total(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def total0(c: str) -> str:
    return f"coalesce({total(c)}, 0.0)"


def nonzero(*cols: str) -> str:
    return "(" + " OR ".join(f"coalesce({c}, 0) <> 0" for c in cols) + ")"


def pivot(on: str, values: list[str], using: str) -> str:
    """The block ``cells`` with a column for each listed value; a view may hold it."""
    return f"SELECT * FROM (PIVOT cells ON {on} IN ({quoted(values)}) USING {using})"


def quarters_between(first: int, last: int) -> list[str]:
    """Labels of fiscal quarters, by year * 4 + quarter."""
    return [f"FY{(i - 1) // 4 % 100:02d}Q{(i - 1) % 4 + 1}" for i in range(first, last + 1)]


# The calendar of the test tables: FY95Q2 to FY01Q4.
FIRST, LAST = 1995 * 4 + 2, 2001 * 4 + 4
# Numbers of owners that sites of the tables at scale 0.01 have.
OWNER_COUNTS = [f"owners_{n}" for n in range(1, 5)]


def recode(c: str, names: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE {c} END"


def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def filled(c: str, down: str = "dn", up: str = "up") -> str:
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER {down}, "
        f"first_value({c} IGNORE NULLS) OVER {up}) AS {c}"
    )


AGENCY = "CASE WHEN mech_code IN ('1','2') THEN 'A' WHEN mech_code IN ('3','4') THEN 'B' ELSE 'Dedup' END"

PANEL = f"""
panel0 AS (
  SELECT o_custkey AS orgunituid, substr(o_orderpriority, 1, 1) AS mech_code,
         {idx('o_orderdate')} AS period_idx, {total('o_totalprice')} AS value
  FROM orders GROUP BY ALL),
panel AS (
  SELECT orgunituid, mech_code, {AGENCY} AS fundingagency, period_idx, {label()} AS period, value
  FROM panel0)"""

ITEMS_PANEL = f"""
panel0 AS (
  SELECT l_partkey AS orgunituid, l_suppkey AS mech_code, {idx('l_shipdate')} AS period_idx,
         {total('l_quantity')} AS value
  FROM lineitem GROUP BY ALL),
panel AS (
  SELECT orgunituid, mech_code, n_name AS fundingagency, period_idx, {label()} AS period, value
  FROM panel0 LEFT JOIN supplier ON s_suppkey = mech_code
  LEFT JOIN nation ON n_nationkey = s_nationkey)"""

DIMS = """
org AS (
  SELECT c_custkey AS orgunituid, r_name AS operatingunit, n_name AS countryname, n_name AS snu1,
         n_name AS psnu, c_name AS facility
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
own AS (
  SELECT DISTINCT substr(o_orderpriority, 1, 1) AS mech_code, substr(o_orderpriority, 3) AS mech_name,
         'Partner ' || CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN '1'
                            ELSE substr(o_orderpriority, 1, 1) END AS primepartner
  FROM orders),
named AS (SELECT * FROM panel LEFT JOIN org USING (orgunituid) LEFT JOIN own USING (mech_code))"""

FLAGS = f"""
grid AS (
  SELECT t.orgunituid, t.mech_code, t.fundingagency, p.period_idx, x.value
  FROM (SELECT DISTINCT orgunituid, mech_code, fundingagency FROM panel) t
  CROSS JOIN (SELECT DISTINCT period_idx FROM panel) p
  LEFT JOIN panel x ON x.orgunituid = t.orgunituid AND x.mech_code = t.mech_code
    AND x.fundingagency = t.fundingagency AND x.period_idx = p.period_idx),
lone AS (
  SELECT *, CASE WHEN period_idx IN ((SELECT min(period_idx) FROM panel), (SELECT max(period_idx) FROM panel))
                 THEN FALSE
                 ELSE value IS NOT NULL AND lead(value) OVER w IS NULL AND lag(value) OVER w IS NULL
            END AS flag_loneobs
  FROM grid WINDOW w AS (PARTITION BY orgunituid, mech_code ORDER BY period_idx, fundingagency)),
seen AS (SELECT * FROM lone WHERE value IS NOT NULL),
ended AS (
  SELECT *, count(*) OVER (PARTITION BY orgunituid, period_idx) > 1 AS flag_multimech_site,
         max(period_idx) OVER (PARTITION BY orgunituid) AS last_site,
         max(period_idx) OVER (PARTITION BY orgunituid, mech_code) AS last_pair,
         period_idx = max(period_idx) OVER (PARTITION BY orgunituid, mech_code)
           AND period_idx <> max(period_idx) OVER () AS flag_end_sitexmech,
         lead(fundingagency) OVER s AS next_agency, lead(mech_code) OVER s AS next_mech
  FROM seen WINDOW s AS (PARTITION BY orgunituid ORDER BY period_idx, mech_code)),
typed AS (
  SELECT *, CASE WHEN flag_end_sitexmech AND last_pair = last_site THEN 'Transition out of PEPFAR'
                 WHEN flag_end_sitexmech AND flag_multimech_site THEN 'Consolidate multi-mechanism site'
                 WHEN flag_end_sitexmech AND fundingagency <> next_agency THEN 'Transition to other agency'
                 WHEN flag_end_sitexmech AND mech_code <> next_mech THEN 'Transition to other mechanism'
            END AS end_type
  FROM ended),
sgrid AS (
  SELECT s.orgunituid, p.period_idx, t.* EXCLUDE (orgunituid, period_idx)
  FROM (SELECT DISTINCT orgunituid FROM typed) s
  CROSS JOIN (SELECT DISTINCT period_idx FROM typed) p
  LEFT JOIN typed t ON t.orgunituid = s.orgunituid AND t.period_idx = p.period_idx),
stepped AS (
  SELECT *, CASE WHEN flag_multimech_site OR lag(flag_multimech_site) OVER w THEN 'standard'
                 ELSE 'adjusted' END AS method,
         CASE WHEN flag_multimech_site OR lag(flag_multimech_site, 2) OVER w THEN FALSE
              WHEN lag(value, 2) OVER w IS NULL THEN FALSE ELSE TRUE END AS vlc_valid
  FROM sgrid WINDOW w AS (PARTITION BY orgunituid ORDER BY period_idx, mech_code)),
flags AS (
  SELECT orgunituid, mech_code, fundingagency, period_idx, {label()} AS period, value, flag_loneobs,
         flag_multimech_site, {label('last_site')} AS last_obs_site,
         {label('last_pair')} AS last_obs_sitexmech, flag_end_sitexmech, end_type,
         CASE WHEN end_type = 'Transition to other agency' THEN fundingagency END AS agency_exiting,
         CASE WHEN end_type = 'Transition to other agency' THEN next_agency END AS agency_inheriting,
         method, vlc_valid
  FROM stepped WHERE mech_code IS NOT NULL)"""

FLAG_LIST = (
    "flag_loneobs, flag_multimech_site, last_obs_site, last_obs_sitexmech, flag_end_sitexmech, "
    "end_type, agency_exiting, agency_inheriting, method, vlc_valid"
)

FLAGGED = """
flagged AS (SELECT * FROM flags LEFT JOIN org USING (orgunituid) LEFT JOIN own USING (mech_code)),
review AS (SELECT * FROM flagged WHERE period_idx <> (SELECT min(period_idx) FROM flagged)),
ends AS (SELECT * FROM review WHERE fundingagency NOT IN ('Dedup') AND flag_end_sitexmech)"""

NET = f"""
pgrid AS (
  SELECT t.orgunituid, t.mech_code, p.period_idx, f.fundingagency AS agency0, coalesce(f.value, 0.0) AS stock
  FROM (SELECT DISTINCT orgunituid, mech_code FROM flags) t
  CROSS JOIN (SELECT DISTINCT period_idx FROM flags) p
  LEFT JOIN flags f ON f.orgunituid = t.orgunituid AND f.mech_code = t.mech_code AND f.period_idx = p.period_idx),
std AS (
  SELECT orgunituid, mech_code, period_idx, stock,
         coalesce(last_value(agency0 IGNORE NULLS) OVER dn, first_value(agency0 IGNORE NULLS) OVER up) AS fundingagency,
         stock - lag(stock) OVER (PARTITION BY orgunituid, mech_code ORDER BY period_idx) AS tx_net_new
  FROM pgrid
  WINDOW dn AS (PARTITION BY orgunituid, mech_code ORDER BY period_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         up AS (PARTITION BY orgunituid, mech_code ORDER BY period_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
sole AS (SELECT orgunituid, mech_code, period_idx, value FROM flags WHERE NOT flag_multimech_site),
solegrid AS (
  SELECT s.orgunituid, p.period_idx, x.mech_code, coalesce(x.value, 0.0) AS stock
  FROM (SELECT DISTINCT orgunituid FROM sole) s CROSS JOIN (SELECT DISTINCT period_idx FROM sole) p
  LEFT JOIN sole x ON x.orgunituid = s.orgunituid AND x.period_idx = p.period_idx),
adj0 AS (
  SELECT orgunituid, period_idx, {filled('mech_code')},
         lag(stock) OVER o AS tx_curr_lag_site, stock - lag(stock) OVER o AS tx_net_new_adj
  FROM solegrid
  WINDOW o AS (PARTITION BY orgunituid ORDER BY period_idx),
         dn AS (PARTITION BY orgunituid ORDER BY period_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         up AS (PARTITION BY orgunituid ORDER BY period_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
adj AS (SELECT * FROM adj0 WHERE {nonzero('tx_curr_lag_site', 'tx_net_new_adj')}),
comb AS (
  SELECT orgunituid, mech_code, period_idx, {label()} AS period, fundingagency, nullif(stock, 0) AS tx_curr,
         tx_net_new, nullif(tx_curr_lag_site, 0) AS tx_curr_lag_site, tx_net_new_adj
  FROM std LEFT JOIN adj USING (orgunituid, mech_code, period_idx)
  WHERE {nonzero('stock', 'tx_net_new', 'tx_net_new_adj')}),
left_rows AS (
  SELECT *, CASE WHEN tx_curr IS NULL AND tx_net_new < 0 THEN tx_net_new END AS own_exit,
         count(*) OVER (PARTITION BY orgunituid, period_idx) AS n
  FROM comb),
moved AS (
  SELECT *, CASE WHEN n = 2 THEN coalesce(own_exit, max(own_exit) OVER (PARTITION BY orgunituid, period_idx)) END AS amount
  FROM left_rows),
xfer AS (
  SELECT *, CASE WHEN tx_net_new IS NULL THEN NULL WHEN tx_net_new > 0 THEN -amount ELSE amount END AS xfer0
  FROM moved),
flagjoin AS (
  SELECT x.*, f.flag_loneobs, f.flag_multimech_site, f.last_obs_site, f.last_obs_sitexmech,
         coalesce(f.flag_end_sitexmech, FALSE) AS flag_end_sitexmech, f.end_type, f.agency_exiting,
         f.agency_inheriting, f.method, coalesce(f.vlc_valid, FALSE) AS vlc_valid
  FROM xfer x LEFT JOIN flags f
    ON f.orgunituid = x.orgunituid AND f.mech_code = x.mech_code AND f.period_idx = x.period_idx),
fillflags AS (
  SELECT * REPLACE ({filled('flag_loneobs')}, {filled('flag_multimech_site')}, {filled('last_obs_site')},
                    {filled('last_obs_sitexmech')}, {filled('method')})
  FROM flagjoin
  WINDOW dn AS (PARTITION BY orgunituid, mech_code ORDER BY period_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         up AS (PARTITION BY orgunituid, mech_code ORDER BY period_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
plus AS (
  SELECT *, CASE WHEN method <> 'standard' THEN xfer0 END AS tx_xfer,
         CASE WHEN method IS NULL THEN NULL WHEN method = 'adjusted' THEN tx_net_new_adj ELSE tx_net_new END
           AS tx_net_new_adj_plus
  FROM fillflags),
lagrid AS (
  SELECT s.orgunituid, p.period_idx, x.* EXCLUDE (orgunituid, period_idx)
  FROM (SELECT DISTINCT orgunituid FROM plus) s CROSS JOIN (SELECT DISTINCT period_idx FROM plus) p
  LEFT JOIN plus x ON x.orgunituid = s.orgunituid AND x.period_idx = p.period_idx),
totals AS (
  SELECT *, coalesce(CAST(sum(CAST(tx_curr AS DECIMAL(18,2))) OVER (PARTITION BY orgunituid, period_idx) AS DOUBLE), 0.0) AS site_total
  FROM lagrid),
stepback AS (
  SELECT *, lag(site_total, 2) OVER (PARTITION BY orgunituid ORDER BY period_idx, mech_code) AS two_back
  FROM totals),
back_periods AS (
  SELECT orgunituid, period_idx, lag(site_total, 2) OVER (PARTITION BY orgunituid ORDER BY period_idx) AS two_periods
  FROM (SELECT DISTINCT orgunituid, period_idx, site_total FROM totals)),
nn AS (
  SELECT *, CASE WHEN vlc_valid THEN two_back END AS tx_curr_lag2_site
  FROM stepback WHERE mech_code IS NOT NULL)"""

MEASURES = (
    "tx_curr, tx_net_new, tx_curr_lag_site, tx_curr_lag2_site, tx_net_new_adj, tx_net_new_adj_plus, tx_xfer"
)

RATIO_ROWS = f"""
vl0 AS (
  SELECT o_custkey AS orgunituid, substr(o_orderpriority, 1, 1) AS mech_code, {idx('l_shipdate')} AS period_idx,
         {total('l_quantity')} AS d, {total("CASE WHEN l_returnflag = 'A' THEN l_quantity END")} AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
vl AS (
  SELECT orgunituid, mech_code, {AGENCY} AS fundingagency, period_idx,
         CASE WHEN mech_code = '5' THEN -d ELSE d END AS tx_pvls_d, n AS tx_pvls
  FROM vl0)"""

FINAL = f"""
merged AS (
  SELECT * FROM nn FULL JOIN vl USING (orgunituid, mech_code, fundingagency, period_idx)),
facts AS (
  SELECT *, max(CASE WHEN vlc_valid IS NULL AND tx_pvls_d IS NULL THEN 1 ELSE 0 END) OVER g AS poisoned,
         max(CASE WHEN vlc_valid IS NULL AND tx_pvls_d < 0 THEN 1 ELSE 0 END) OVER g AS negative,
         max(CAST(vlc_valid AS INTEGER)) OVER g AS any_valid
  FROM merged WINDOW g AS (PARTITION BY orgunituid, period_idx)),
final0 AS (
  SELECT * REPLACE (
    CASE WHEN vlc_valid IS NULL AND poisoned = 0 AND negative = 1 THEN coalesce(any_valid, 1) = 1
         ELSE coalesce(vlc_valid, FALSE) END AS vlc_valid,
    coalesce(method, 'no TX_CURR reported') AS method,
    {label()} AS period)
  FROM facts),
final AS (SELECT * FROM final0 LEFT JOIN org USING (orgunituid) LEFT JOIN own USING (mech_code))"""

FISCAL = f"""
measures AS (
  SELECT orgunituid, mech_code, fundingagency, period_idx, 'tx_curr' AS indicator, value FROM panel
  UNION ALL
  SELECT orgunituid, mech_code, fundingagency, period_idx, 'tx_pvls_d', tx_pvls_d FROM vl),
cells AS (
  SELECT (period_idx - 1) // 4 AS fy, operatingunit, fundingagency, primepartner, indicator
  FROM measures LEFT JOIN org USING (orgunituid) LEFT JOIN own USING (mech_code)
  WHERE (period_idx - 1) // 4 >= {SINCE} AND fundingagency <> 'Dedup' GROUP BY ALL),
quarter_sums AS (
  SELECT operatingunit, fundingagency, primepartner, indicator, period_idx, {total0('value')} AS value
  FROM measures LEFT JOIN org USING (orgunituid) LEFT JOIN own USING (mech_code) GROUP BY ALL),
by_quarter AS (
  SELECT c.operatingunit, c.fundingagency, c.primepartner, c.indicator,
         CAST(c.fy * 4 + q.q AS INTEGER) AS period_idx, coalesce(s.value, 0.0) AS value
  FROM cells c CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS q) q
  LEFT JOIN quarter_sums s ON s.operatingunit = c.operatingunit AND s.fundingagency = c.fundingagency
    AND s.primepartner = c.primepartner AND s.indicator = c.indicator AND s.period_idx = c.fy * 4 + q.q),
by_indicator AS (
  SELECT operatingunit, fundingagency, primepartner, period_idx, {label()} AS period,
         max(CASE WHEN indicator = 'tx_curr' THEN value END) AS tx_curr,
         max(CASE WHEN indicator = 'tx_pvls_d' THEN value END) AS tx_pvls_d
  FROM by_quarter WHERE {label()} NOT IN ({quoted(SKIP)}) GROUP BY ALL),
msd AS (
  SELECT * EXCLUDE (tx_curr), 'MSD' AS source FROM (
    SELECT *, lag(tx_curr, 2) OVER (PARTITION BY operatingunit, fundingagency, primepartner ORDER BY period_idx) AS tx_curr_lag2
    FROM by_indicator) WHERE period NOT LIKE '{DROP}%'),
msd_partner AS (
  SELECT * EXCLUDE (tx_curr), 'MSD' AS source FROM (
    SELECT *, lag(tx_curr, 2) OVER (PARTITION BY primepartner ORDER BY period_idx, operatingunit, fundingagency) AS tx_curr_lag2
    FROM by_indicator) WHERE period NOT LIKE '{DROP}%')"""

VALIDATED = f"""
validated AS (
  SELECT period_idx, period, operatingunit, fundingagency, primepartner, {total0('tx_pvls_d')} AS tx_pvls_d,
         {total0('tx_curr_lag2_site')} AS tx_curr_lag2, 'Adjusted' AS source
  FROM final WHERE period NOT LIKE '%{DROP}%' AND fundingagency NOT LIKE '%Dedup%' AND vlc_valid
  GROUP BY ALL)"""

COMPARE = """
both_sources AS (
  SELECT *, CASE WHEN tx_curr_lag2 <> 0 THEN tx_pvls_d / tx_curr_lag2 END AS vlc
  FROM (SELECT * FROM msd UNION ALL BY NAME SELECT * FROM validated)),
kept AS (
  SELECT *, period_idx = max(period_idx) OVER (PARTITION BY operatingunit, fundingagency, primepartner) AS is_last
  FROM both_sources WHERE vlc IS NOT NULL),
latest AS (
  SELECT *, max(CASE WHEN is_last THEN tx_curr_lag2 ELSE 0 END)
           OVER (PARTITION BY operatingunit, fundingagency, primepartner) AS latest_tx
  FROM kept),
facets AS (
  SELECT *, fundingagency || '/' || primepartner || chr(10) || 'TX_CURR = '
           || format('{:,}', CAST(round_even(latest_tx, 0) AS BIGINT)) AS facet_label
  FROM latest),
facet_order AS (
  SELECT facet_label, dense_rank() OVER (ORDER BY m DESC) AS facet_rank
  FROM (SELECT facet_label, median(latest_tx) AS m FROM facets GROUP BY 1)),
compared AS (
  SELECT tx_pvls_d, tx_curr_lag2, source, operatingunit, fundingagency, primepartner, period, latest_tx,
         facet_label, facet_rank, round(vlc, 6) AS vlc,
         CASE WHEN source = 'Adjusted' THEN round(vlc, 6) END AS top_ln,
         round(min(vlc) OVER b, 6) AS pd_min, round(max(vlc) OVER b, 6) AS pd_max
  FROM facets JOIN facet_order USING (facet_label)
  WINDOW b AS (PARTITION BY operatingunit, fundingagency, primepartner, period_idx))"""


def by_owner(extra: str = "TRUE") -> str:
    return f"""
nn_named AS (
  SELECT * FROM nn LEFT JOIN org USING (orgunituid) LEFT JOIN own USING (mech_code)
  WHERE period_idx <> (SELECT min(period_idx) FROM nn)),
owner_sums AS (
  SELECT operatingunit, fundingagency, mech_code, primepartner, period_idx, period,
         {total0('tx_curr')} AS tx_curr, {total0('tx_net_new')} AS tx_net_new,
         {total0('tx_net_new_adj_plus')} AS tx_net_new_adj_plus
  FROM nn_named WHERE {extra} GROUP BY ALL),
owner_last AS (
  SELECT *, max(period_idx) OVER (PARTITION BY mech_code) AS last_idx, min(period_idx) OVER () AS first_idx
  FROM owner_sums),
owner_order AS (
  SELECT * EXCLUDE (last_idx, first_idx), {label('last_idx')} AS max_pd,
         CASE WHEN period_idx = last_idx THEN tx_curr ELSE 0.0 END AS "order",
         fundingagency || ' ' || mech_code || ' ' || primepartner AS "group"
  FROM owner_last WHERE last_idx <> first_idx),
group_order AS (
  SELECT "group", dense_rank() OVER (ORDER BY m DESC) AS group_rank
  FROM (SELECT "group", max("order") AS m FROM owner_order GROUP BY 1)),
owners AS (SELECT * FROM owner_order JOIN group_order USING ("group"))"""


DELTA = f"""
year_totals AS (
  SELECT operatingunit, fundingagency, mech_code, primepartner, "group", {total0('tx_net_new')} AS tx_net_new,
         {total0('tx_net_new_adj_plus')} AS tx_net_new_adj_plus, max("order") AS "order"
  FROM owners WHERE period LIKE '%{FISCAL_YEAR}%' AND max_pd <> '{STOPPED_IN}' GROUP BY ALL),
deltas AS (SELECT *, round(tx_net_new_adj_plus - tx_net_new, 2) AS delta FROM year_totals),
long AS (
  SELECT * EXCLUDE (tx_net_new, tx_net_new_adj_plus), 'tx_net_new' AS indicator, tx_net_new AS value FROM deltas
  UNION ALL
  SELECT * EXCLUDE (tx_net_new, tx_net_new_adj_plus), 'tx_net_new_adj_plus', tx_net_new_adj_plus FROM deltas)"""

# Month texts of the raw extract by fiscal quarter.
RAW = f"""
countries AS (
  SELECT DISTINCT CASE WHEN r_name IN ('AMERICA','ASIA') THEN r_name || ' Region' ELSE r_name END AS operatingunit,
         CASE WHEN r_name IN ('AMERICA','ASIA') THEN n_name ELSE r_name END AS countryname,
         CASE WHEN r_name IN ('AMERICA','ASIA') THEN n_nationkey % 2 + 4 WHEN r_name = 'AFRICA' THEN 4
              WHEN r_name = 'EUROPE' THEN 5 ELSE 0 END AS psnu_lvl
  FROM nation JOIN region ON n_regionkey = r_regionkey),
raw_rows AS (
  SELECT orgunituid, mech_code, fundingagency, period_idx, 'TX_CURR' AS indicator, 'N' AS part, value FROM panel
  UNION ALL
  SELECT orgunituid, mech_code, fundingagency, period_idx, 'TX_PVLS', 'N', tx_pvls FROM vl WHERE tx_pvls IS NOT NULL
  UNION ALL
  SELECT orgunituid, mech_code, fundingagency, period_idx, 'TX_PVLS', 'D', tx_pvls_d FROM vl),
raw AS (
  SELECT CASE (period_idx - 1) % 4 WHEN 0 THEN 'Oct to Dec ' || CAST((period_idx - 1) // 4 - 1 AS VARCHAR)
              WHEN 1 THEN 'Jan to Mar ' || CAST((period_idx - 1) // 4 AS VARCHAR)
              WHEN 2 THEN 'Apr to Jun ' || CAST((period_idx - 1) // 4 AS VARCHAR)
              ELSE 'Jul to Sep ' || CAST((period_idx - 1) // 4 AS VARCHAR) END AS period_text,
         CASE WHEN operatingunit IN ('AMERICA','ASIA') THEN operatingunit || ' Region' ELSE operatingunit END AS lvl3,
         snu1 AS lvl4, snu1 || ' district ' || CAST(orgunituid % 10 AS VARCHAR) AS lvl5, facility,
         CAST(orgunituid AS VARCHAR) AS orgunituid, fundingagency,
         CASE WHEN mech_code = '5' THEN '00000 De-dup - ' || mech_name
              ELSE '17 - ' || mech_code || ' - ' || mech_name END AS mech,
         indicator, part, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value_text
  FROM raw_rows LEFT JOIN org USING (orgunituid) LEFT JOIN own USING (mech_code)),
dated AS (
  SELECT *, strptime('1 ' || regexp_extract(period_text, '[A-Za-z]{{3}} [0-9]{{4}}'), '%d %b %Y') AS pdate,
         CASE WHEN lvl3 LIKE '%Region%' THEN lvl4 ELSE lvl3 END AS countryname,
         regexp_replace(mech, '^0000(0|1)', 'ZZZ - 0000\\1 -') AS mech_fixed
  FROM raw),
clean AS (
  SELECT {label(idx('pdate'))} AS period, lvl3 AS operatingunit, d.countryname, lvl4 AS snu1,
         CASE psnu_lvl WHEN 4 THEN lvl4 WHEN 5 THEN lvl5 END AS psnu, facility, orgunituid, fundingagency,
         mech_fixed AS mech, regexp_extract(mech_fixed, '^[A-Za-z0-9]+[^A-Za-z0-9]+([A-Za-z0-9]+)', 1) AS mech_code,
         regexp_extract(mech_fixed, '^[A-Za-z0-9]+[^A-Za-z0-9]+[A-Za-z0-9]+[^A-Za-z0-9]+(.*)$', 1) AS mech_name,
         indicator, part AS numeratordenom, CAST(value_text AS DOUBLE) AS value
  FROM dated d LEFT JOIN countries c ON c.countryname = d.countryname WHERE psnu_lvl IN (3, 4, 5))"""


def q(select: str, *blocks: str) -> str:
    return ("WITH " + ",".join(blocks) + "\n" + select) if blocks else select


PAIR = "orgunituid, mech_code, period"
BASE = (PANEL, FLAGS)
NAMED = (PANEL, DIMS)
REVIEW = (PANEL, DIMS, FLAGS, FLAGGED)
NETCHANGE = (PANEL, FLAGS, NET)
NAMED_NET = (PANEL, DIMS, FLAGS, NET)
WHOLE = (PANEL, DIMS, FLAGS, NET, RATIO_ROWS, FINAL)
AGGREGATE = (PANEL, DIMS, RATIO_ROWS, FISCAL)
COMPARED = (PANEL, DIMS, FLAGS, NET, RATIO_ROWS, FINAL, FISCAL, VALIDATED, COMPARE)


def shares(key: str) -> str:
    return f"""
SELECT {key}, n, round(n / sum(n) OVER (), 6) AS share,
       round(sum(n) OVER (ORDER BY n DESC, {key} ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share
FROM (SELECT {key}, count(*) AS n FROM ends GROUP BY 1)"""


OWNERS_PER_SITE = """
sizes AS (SELECT period, operatingunit, orgunituid, count(DISTINCT mech_code) AS n FROM named GROUP BY ALL),
unit_share AS (
  SELECT operatingunit, period, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multi
  FROM sizes GROUP BY ALL)"""

HALF_EVEN_SHARE = """
CASE WHEN 2 * (100 * multi - hundredths * sites) < sites THEN hundredths
     WHEN 2 * (100 * multi - hundredths * sites) > sites THEN hundredths + 1
     ELSE hundredths + hundredths % 2 END / 100.0"""

COUNTRY_SIZES = """
site_rows AS (
  SELECT period, operatingunit, CASE WHEN regexp_matches(operatingunit, 'AMERICA|ASIA') THEN snu1 ELSE operatingunit END AS country,
         orgunituid, count(*) AS n
  FROM named GROUP BY ALL),
sizes AS (
  SELECT period, operatingunit, country, count(*) FILTER (n > 1) AS multiple, count(*) FILTER (n = 1) AS single
  FROM site_rows GROUP BY ALL),
chosen AS (SELECT * FROM (SELECT *, sum(multiple) OVER (PARTITION BY operatingunit, country) AS s FROM sizes) WHERE s > 1),
ranks AS (SELECT country, dense_rank() OVER (ORDER BY m DESC) AS country_rank
          FROM (SELECT country, sum(multiple) AS m FROM chosen GROUP BY 1))"""

TRANSITION = """
all_pairs AS (SELECT period, count(*) AS all_mech_sites
              FROM (SELECT DISTINCT period, mech_code, orgunituid FROM review) GROUP BY 1),
end_pairs AS (SELECT period, count(*) AS trans_mech_sites
              FROM (SELECT DISTINCT period, mech_code, orgunituid FROM review WHERE flag_end_sitexmech) GROUP BY 1),
tshare AS (SELECT e.period, trans_mech_sites, all_mech_sites, trans_mech_sites / all_mech_sites AS share
           FROM end_pairs e LEFT JOIN all_pairs a ON a.period = e.period)"""

MULTI_SHARE = """
flag_sites AS (SELECT period, flag_multimech_site, count(*) AS n
               FROM (SELECT DISTINCT period, orgunituid, flag_multimech_site FROM review) GROUP BY ALL),
mshare AS (SELECT *, n / sum(n) OVER (PARTITION BY period) AS share FROM flag_sites)"""

SITE_TYPES = f"""
types AS (
  SELECT operatingunit, period, CASE WHEN method = 'adjusted' THEN 'single' ELSE 'multi' END AS site_type,
         {total0('value')} AS tx_curr, count(*) AS site_count
  FROM review GROUP BY ALL),
type_shares AS (
  SELECT *, round(tx_curr / sum(tx_curr) OVER (PARTITION BY operatingunit, period), 6) AS share_result,
         round(site_count / sum(site_count) OVER (PARTITION BY operatingunit, period), 6) AS share_sites
  FROM types)"""

LATEST = f"""
unit_stock AS (SELECT operatingunit, {total0('value')} AS n FROM named
               WHERE period_idx = (SELECT max(period_idx) FROM named) GROUP BY 1)"""

SITE_OWNERS = """
lists AS (
  SELECT operatingunit, orgunituid, period_idx, period, snu1, psnu, facility,
         string_agg(regexp_replace(fundingagency, '^(.*?)(De|up)', '\\1') || ' ' || mech_code, '|' ORDER BY mech_code) AS mechs
  FROM review WHERE flag_multimech_site GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    vl_rows = (PANEL, DIMS, RATIO_ROWS, RAW)
    return {
        "fiscal_periods": f"""
SELECT {label(idx('o_orderdate'))} AS period,
       CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
       count(*) AS n FROM orders GROUP BY ALL""",
        "quarter_list": """
WITH years AS (SELECT unnest(range(1995, 2002)) AS y), quarters AS (SELECT unnest([1, 2, 3, 4]) AS q),
wanted AS (SELECT CAST(y AS VARCHAR) || 'Q' || CAST(q AS VARCHAR) AS quarter FROM years CROSS JOIN quarters
           WHERE y * 4 + q > 1995 * 4 + 1 AND y * 4 + q <= 2001 * 4 + 3),
counted AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
                   count(*) AS n FROM orders GROUP BY 1)
SELECT wanted.quarter, n FROM wanted LEFT JOIN counted ON counted.quarter = wanted.quarter""",
        "orders_panel": q(f"SELECT {PAIR}, fundingagency, value FROM panel", PANEL),
        "clean_extract": q("SELECT * FROM clean", *vl_rows),
        "scope_extract": q(
            """
SELECT period_text AS "Period", indicator AS "Technical Area", 'Top Level Numerator' AS "Top Level", count(*) AS n
FROM dated WHERE part = 'N' AND year(pdate) * 4 + quarter(pdate) BETWEEN 1996 * 4 + 2 AND 1998 * 4 + 4
GROUP BY ALL""",
            *vl_rows,
        ),
        "latest_snapshot": f"""
SELECT o_orderkey, {label(idx('o_orderdate'))} AS snapshot, o_totalprice FROM orders
WHERE {idx('o_orderdate')} = (SELECT max({idx('o_orderdate')}) FROM orders)""",
        "densify_panel": q(
            f"""
SELECT t.orgunituid, t.mech_code, {label('p.period_idx')} AS period, coalesce(x.value, 0.0) AS value
FROM (SELECT DISTINCT orgunituid, mech_code FROM panel) t CROSS JOIN (SELECT DISTINCT period_idx FROM panel) p
LEFT JOIN panel x ON x.orgunituid = t.orgunituid AND x.mech_code = t.mech_code AND x.period_idx = p.period_idx""",
            PANEL,
        ),
        "fill_down_up": q(
            f"""
SELECT orgunituid, mech_code, {label()} AS period, {filled('value')} FROM grid
WINDOW dn AS (PARTITION BY orgunituid, mech_code ORDER BY period_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       up AS (PARTITION BY orgunituid, mech_code ORDER BY period_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
            *BASE,
        ),
        "sparse_exits": q(
            f"""
SELECT orgunituid, mech_code, {label()} AS period, coalesce(value, 0.0) AS value,
       CASE WHEN period_idx > (SELECT min(period_idx) FROM panel) THEN coalesce(before, 0.0) END AS prior,
       value IS NOT NULL AS observed
FROM (SELECT *, lag(value) OVER (PARTITION BY orgunituid, mech_code ORDER BY period_idx) AS before FROM grid)
WHERE value IS NOT NULL OR before IS NOT NULL""",
            *BASE,
        ),
        "lone_obs": q(f"SELECT {PAIR}, flag_loneobs FROM flags", *BASE),
        "multi_owner": q(f"SELECT {PAIR}, flag_multimech_site FROM flags", *BASE),
        "end_flags": q(
            f"SELECT {PAIR}, last_obs_site, last_obs_sitexmech, flag_end_sitexmech FROM flags", *BASE
        ),
        "end_types": q(f"SELECT {PAIR}, flag_end_sitexmech, end_type FROM flags", *BASE),
        "transition_parties": q(
            f"SELECT {PAIR}, end_type, agency_exiting, agency_inheriting FROM flags", *BASE
        ),
        "method_validity": q(f"SELECT {PAIR}, method, vlc_valid FROM flags", *BASE),
        "attach_metadata": q("SELECT * EXCLUDE (period_idx) FROM flagged", *REVIEW),
        "part_supplier_flags": q("SELECT * EXCLUDE (period_idx) FROM flags", ITEMS_PANEL, FLAGS),
        "crowded_supplier_flags": q("SELECT * EXCLUDE (period_idx) FROM flags", ITEMS_PANEL, FLAGS),
        "part_supplier_net_change": q(
            f"SELECT {PAIR}, fundingagency, {MEASURES}, {FLAG_LIST} FROM nn", ITEMS_PANEL, FLAGS, NET
        ),
        "ends_out": q(
            """
SELECT orgunituid, fundingagency, mech_code, mech_name, primepartner, period, value
FROM ends WHERE end_type = 'Transition out of PEPFAR'""",
            *REVIEW,
        ),
        "ever_multi_sites": q(
            f"""
SELECT {PAIR}, value, flag_multimech_site FROM flagged
WHERE orgunituid IN (SELECT orgunituid FROM review WHERE flag_multimech_site)""",
            *REVIEW,
        ),
        "ends_by_unit": q(shares("operatingunit"), *REVIEW),
        "ends_by_period": q(shares("period"), *REVIEW),
        "ends_by_type": q(shares("end_type"), *REVIEW),
        "agencies_losing": q(
            """SELECT agency_exiting, count(*) AS n FROM ends
WHERE end_type = 'Transition to other agency' GROUP BY 1""",
            *REVIEW,
        ),
        "agencies_gaining": q(
            """SELECT agency_inheriting, count(*) AS n FROM ends
WHERE end_type = 'Transition to other agency' GROUP BY 1""",
            *REVIEW,
        ),
        "net_change_standard": q(
            f"""
SELECT orgunituid, mech_code, {label()} AS period, stock AS tx_curr, tx_net_new FROM std
WHERE {nonzero('stock', 'tx_net_new')}""",
            *NETCHANGE,
        ),
        "net_change_adjusted": q(
            f"""
SELECT orgunituid, mech_code, {label()} AS period, tx_curr_lag_site, tx_net_new_adj FROM adj""",
            *NETCHANGE,
        ),
        "net_change_combined": q(
            f"SELECT {PAIR}, tx_curr, tx_net_new, tx_curr_lag_site, tx_net_new_adj, tx_net_new_adj_plus FROM plus",
            *NETCHANGE,
        ),
        "transfers": q(f"SELECT {PAIR}, xfer0 AS tx_xfer FROM xfer", *NETCHANGE),
        "flags_propagated": q(f"SELECT {PAIR}, tx_xfer, {FLAG_LIST} FROM plus", *NETCHANGE),
        "net_change_full": q(f"SELECT {PAIR}, fundingagency, {MEASURES}, {FLAG_LIST} FROM nn", *NETCHANGE),
        "lag2_rows": q(f"SELECT {PAIR}, tx_curr_lag2_site FROM nn", *NETCHANGE),
        "lag2_periods": q(
            f"""
SELECT {PAIR}, CASE WHEN vlc_valid THEN two_periods END AS tx_curr_lag2_site
FROM nn JOIN back_periods USING (orgunituid, period_idx)""",
            *NETCHANGE,
        ),
        "ratio_merge": q(
            f"SELECT {PAIR}, tx_curr, tx_net_new, tx_pvls_d, tx_pvls, method, vlc_valid FROM final", *WHOLE
        ),
        "multi_owner_pairs": q(
            """
SELECT operatingunit, mechs, string_agg(period, ',' ORDER BY period_idx) AS period,
       CAST(NULL AS VARCHAR) AS "rationale/context for multi mechs? full duplication?"
FROM (SELECT DISTINCT operatingunit, period_idx, period, mechs FROM lists) GROUP BY 1, 2""",
            *REVIEW,
            SITE_OWNERS,
        ),
        "multi_owner_sites": q(
            pivot("period", quarters_between(FIRST + 1, LAST), "max(mechs)"),
            *REVIEW,
            SITE_OWNERS,
            """
cells AS (SELECT operatingunit, orgunituid, snu1, psnu, facility, period, mechs,
                 CAST(NULL AS VARCHAR) AS "why multi mechs? pops serving? full duplication?" FROM lists)""",
        ),
        "multi_owner_histogram": q(
            pivot("n", OWNER_COUNTS, "max(sites)"),
            *NAMED,
            OWNERS_PER_SITE,
            """
cells AS (SELECT period, operatingunit, 'owners_' || n AS n, count(*) AS sites FROM sizes GROUP BY ALL)""",
        ),
        "multi_share_by_period": q(
            """
SELECT period, CAST(sum(single) AS BIGINT) AS single, CAST(sum(multi) AS BIGINT) AS multi,
       round(sum(multi) / (sum(single) + sum(multi)), 6) AS share_multi FROM unit_share GROUP BY 1""",
            *NAMED,
            OWNERS_PER_SITE,
        ),
        "multi_share_wide": q(
            pivot("period", quarters_between(FIRST, LAST), "max(share)"),
            *NAMED,
            OWNERS_PER_SITE,
            """
cells AS (SELECT operatingunit, period, round(multi / (single + multi), 6) AS share FROM unit_share)""",
        ),
        "multi_share_labels": q(
            f"""
SELECT {recode('operatingunit', UNIT_NAMES)} AS operatingunit, period, single, multi,
       nullif(CAST({HALF_EVEN_SHARE} AS DOUBLE), 0) AS share_multi,
       coalesce(place, (SELECT count(DISTINCT place) FROM unit_places) + 1) AS unit_rank
FROM (SELECT *, single + multi AS sites, (100 * multi) // (single + multi) AS hundredths FROM unit_share)
LEFT JOIN unit_places USING (operatingunit)""",
            *NAMED,
            OWNERS_PER_SITE,
            LATEST,
            "unit_places AS (SELECT operatingunit, dense_rank() OVER (ORDER BY n DESC) AS place FROM unit_stock)",
        ),
        "pairs_lost": q(
            f"""
SELECT orgunituid, mech_code, {label()} AS period FROM (
  SELECT orgunituid, mech_code, period_idx FROM panel
  WHERE value IS NOT NULL AND period_idx < (SELECT max(period_idx) FROM panel)
  EXCEPT SELECT orgunituid, mech_code, period_idx - 1 FROM panel WHERE value IS NOT NULL)""",
            PANEL,
        ),
        "orders_moved": f"""
WITH placed AS (
  SELECT o_custkey AS orgunituid, substr(o_orderpriority, 1, 1) AS mech_code, {idx('o_orderdate')} AS period_idx FROM orders)
SELECT orgunituid, mech_code, {label()} AS period, count(*) AS n FROM (
  SELECT * FROM placed EXCEPT ALL SELECT orgunituid, mech_code, period_idx - 1 FROM placed) GROUP BY ALL""",
        "median_order_rank": """
SELECT o_custkey, dense_rank() OVER (ORDER BY m DESC) AS customer_rank
FROM (SELECT o_custkey, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1)""",
        "customers_by_orders": """
SELECT o_custkey, n, round(n / sum(n) OVER (), 6) AS share,
       round(sum(n) OVER (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
        "largest_customers": """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10""",
        "trailing_sites": q(
            f"""
SELECT {label('p.period_idx')} AS period, count(DISTINCT orgunituid) AS sites, TRUE AS near
FROM (SELECT DISTINCT period_idx FROM panel) p
JOIN panel x ON x.period_idx BETWEEN p.period_idx - 3 AND p.period_idx GROUP BY p.period_idx""",
            PANEL,
        ),
        "landed_by_unit": q(
            """SELECT operatingunit, orgunituid, snu1, psnu, facility, mech_code, fundingagency, period, value
FROM review WHERE flag_multimech_site""",
            *REVIEW,
        ),
        "landed_snapshot": f"""
SELECT o_orderkey, {label(idx('o_orderdate'))} AS snapshot, o_totalprice FROM orders
WHERE {idx('o_orderdate')} = (SELECT max({idx('o_orderdate')}) FROM orders)""",
        "country_list": """
SELECT r_name AS operatingunit, n_name AS countryname, 'id' || n_nationkey AS countryname_uid,
       CAST(n_nationkey % 2 + 3 AS INTEGER) AS psnu_lvl, CAST(n_nationkey % 3 + 4 AS INTEGER) AS site_lvl
FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "multi_rows_one_unit": q(
            f"""
SELECT period, operatingunit, facility, orgunituid, mech_code, fundingagency, value
FROM (SELECT *, count(*) OVER (PARTITION BY period_idx, orgunituid) AS n FROM named)
WHERE n > 1 AND operatingunit = '{UNIT}'""",
            *NAMED,
        ),
        "multi_counts_ranked": q(
            """
SELECT country, period, operatingunit, multiple, single, country_rank, nullif(multiple, 0) AS lab
FROM chosen JOIN ranks USING (country)""",
            *NAMED,
            COUNTRY_SIZES,
        ),
        "multi_unit_count": q(
            "SELECT count(DISTINCT operatingunit) AS n FROM chosen", *NAMED, COUNTRY_SIZES
        ),
        "units_by_latest_stock": q(
            f"SELECT {recode('operatingunit', UNIT_NAMES)} AS operatingunit, n FROM unit_stock",
            *NAMED,
            LATEST,
        ),
        "sites_per_period": q(
            """SELECT period, count(DISTINCT orgunituid) AS all_sites FROM panel
WHERE period_idx <> (SELECT min(period_idx) FROM panel) GROUP BY 1""",
            PANEL,
        ),
        "sites_headline": q(
            f"""
SELECT {label('min(period_idx)')} AS first_period, {label('max(period_idx)')} AS last_period,
       round(avg(n), 6) AS mean_sites
FROM (SELECT period_idx, count(DISTINCT orgunituid) AS n FROM panel
      WHERE period_idx <> (SELECT min(period_idx) FROM panel) GROUP BY 1)""",
            PANEL,
        ),
        "largest_countries": q(
            """
SELECT countryname, n, round(n / sum(n) OVER (), 6) AS share,
       round(sum(n) OVER (ORDER BY n DESC, countryname ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share
FROM (SELECT countryname, count(DISTINCT orgunituid) AS n FROM review
      WHERE period_idx = (SELECT max(period_idx) FROM review) GROUP BY 1)
QUALIFY rank() OVER (ORDER BY n DESC) <= 5""",
            *REVIEW,
        ),
        "transition_share": q(
            "SELECT period, trans_mech_sites, all_mech_sites, round(share, 6) AS share FROM tshare",
            *REVIEW,
            TRANSITION,
        ),
        "transition_headline": q(
            f"""
SELECT round(max(share) FILTER (period = '{QUARTER}'), 6) AS quarter_share,
       round(avg(share) FILTER (period NOT LIKE '%Q4%'), 6) AS mean_share_not_q4,
       CAST(CAST(round_even(max(share) FILTER (period = '{QUARTER}') * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS quarter_percent
FROM tshare""",
            *REVIEW,
            TRANSITION,
        ),
        "ends_period_type": q(
            """
SELECT period, end_type, count(*) AS trans_mech_sites
FROM (SELECT DISTINCT period, mech_code, orgunituid, end_type FROM review WHERE flag_end_sitexmech) GROUP BY ALL""",
            *REVIEW,
        ),
        "multi_site_share": q(
            "SELECT period, flag_multimech_site, n, round(share, 6) AS share FROM mshare WHERE flag_multimech_site",
            *REVIEW,
            MULTI_SHARE,
        ),
        "multi_site_share_mean": q(
            "SELECT round(avg(share), 6) AS share FROM mshare WHERE flag_multimech_site", *REVIEW, MULTI_SHARE
        ),
        "site_type_shares": q("SELECT * FROM type_shares", *REVIEW, SITE_TYPES),
        "site_type_multi": q(
            f"""
SELECT {recode('g.operatingunit', UNIT_NAMES)} AS operatingunit, g.period, 'multi' AS site_type,
       coalesce(t.site_count, 0) AS site_count, coalesce(t.share_result, 0.0) AS share_result,
       coalesce(t.share_sites, 0.0) AS share_sites, r.unit_rank
FROM (SELECT DISTINCT operatingunit, period FROM type_shares) g
LEFT JOIN type_shares t ON t.operatingunit = g.operatingunit AND t.period = g.period AND t.site_type = 'multi'
LEFT JOIN (SELECT operatingunit, dense_rank() OVER (ORDER BY n DESC) AS unit_rank FROM unit_stock) r
  ON r.operatingunit = g.operatingunit
WHERE g.period IN ({quoted(LISTED)})""",
            *REVIEW,
            SITE_TYPES,
            LATEST,
        ),
        "net_change_by_owner": q("SELECT * EXCLUDE (period_idx) FROM owners", *NAMED_NET, by_owner()),
        "net_change_by_true_owner": q(
            "SELECT * EXCLUDE (period_idx) FROM owners", *NAMED_NET, by_owner("mech_code <> '5'")
        ),
        "net_change_delta_long": q("SELECT * FROM long", *NAMED_NET, by_owner("mech_code <> '5'"), DELTA),
        "net_change_labels": q(
            """
SELECT l.*, l.fundingagency || ' ' || l.mech_code || ' ' AS mech_agency,
       CASE WHEN delta = 0 AND indicator = 'tx_net_new' THEN value END AS match, owner_rank, unit_rank
FROM long l
JOIN (SELECT a, dense_rank() OVER (ORDER BY m) AS owner_rank FROM (
        SELECT fundingagency || ' ' || mech_code || ' ' AS a, median(delta) AS m FROM long GROUP BY 1)) o
  ON o.a = l.fundingagency || ' ' || l.mech_code || ' '
JOIN (SELECT operatingunit AS u, dense_rank() OVER (ORDER BY m DESC) AS unit_rank FROM (
        SELECT operatingunit, sum(CAST("order" AS DECIMAL(18,2))) AS m FROM long GROUP BY 1)) r
  ON r.u = l.operatingunit""",
            *NAMED_NET,
            by_owner("mech_code <> '5'"),
            DELTA,
        ),
        "ratio_aggregate": q("SELECT * EXCLUDE (period_idx) FROM msd", *AGGREGATE),
        "ratio_aggregate_by_partner": q("SELECT * EXCLUDE (period_idx) FROM msd_partner", *AGGREGATE),
        "ratio_validated": q("SELECT * EXCLUDE (period_idx) FROM validated", *WHOLE, VALIDATED),
        "ratio_compare": q("SELECT * FROM compared", *COMPARED),
        "ratio_compare_one_unit": q(
            f"SELECT * FROM compared WHERE operatingunit = '{UNIT}'", *COMPARED
        ),
        "lone_obs_wide": q(
            pivot("period", quarters_between(FIRST + 1, LAST - 1), "max(n)"),
            *REVIEW,
            """
lone_counts AS (SELECT period, mech_code, count(DISTINCT orgunituid) AS n FROM review
                WHERE flag_loneobs AND mech_code <> '5' GROUP BY ALL),
cells AS (SELECT *, max(n) OVER (PARTITION BY mech_code) AS max FROM lone_counts)""",
        ),
        "exits_by_country": q(
            """
SELECT countryname, period, end_type, count(*) AS exit_sites
FROM (SELECT DISTINCT countryname, period, orgunituid, mech_code, end_type FROM review
      WHERE end_type = 'Transition out of PEPFAR') GROUP BY ALL""",
            *REVIEW,
        ),
        "country_type_shares": q(
            f"""
SELECT countryname, period, end_type, n, round(n / sum(n) OVER (), 6) AS share
FROM (SELECT countryname, period, end_type, count(*) AS n FROM (
        SELECT DISTINCT countryname, period, orgunituid, mech_code, end_type FROM review
        WHERE countryname = '{COUNTRY}' AND period = '{QUARTER}') GROUP BY ALL)""",
            *REVIEW,
        ),
        "country_pairs": q(
            """
SELECT countryname, period, count(*) AS n
FROM (SELECT DISTINCT countryname, period, orgunituid, mech_code FROM review) GROUP BY ALL""",
            *REVIEW,
        ),
        "site_history_wide": q(
            pivot("period", quarters_between(FIRST, LAST), "max(value)"),
            *NETCHANGE,
            """
cells AS (SELECT orgunituid, mech_code, period, unnest(['tx_curr', 'tx_net_new', 'tx_net_new_adj']) AS indicator,
                 unnest([tx_curr, tx_net_new, tx_net_new_adj]) AS value FROM nn)""",
        ),
        "landed_extract": q("SELECT * FROM clean", *vl_rows),
        "landed_flags": q(
            "SELECT * EXCLUDE (period_idx) REPLACE (CAST(orgunituid AS VARCHAR) AS orgunituid) FROM flagged", *REVIEW
        ),
        "country_levels": """
SELECT r_name AS operatingunit,
       CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'id' || n_nationkey END AS operatingunituid,
       n_name AS countryname, CAST(n_nationkey % 3 + 4 AS INTEGER) AS site_lvl
FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "unit_hierarchy": "SELECT CAST(c_nationkey AS INTEGER) AS uid, c_custkey AS site FROM customer WHERE c_nationkey % 2 = 0",
        "lag1_periods": q(
            f"""
SELECT {PAIR}, CASE WHEN vlc_valid THEN one_period END AS tx_curr_lag1_site
FROM nn JOIN (SELECT orgunituid, period_idx, lag(site_total) OVER (PARTITION BY orgunituid ORDER BY period_idx) AS one_period
              FROM (SELECT DISTINCT orgunituid, period_idx, site_total FROM totals)) USING (orgunituid, period_idx)""",
            *NETCHANGE,
        ),
        "lag3_rows": q(
            f"""
SELECT {PAIR}, CASE WHEN vlc_valid THEN three_back END AS tx_curr_lag3_site
FROM (SELECT *, lag(site_total, 3) OVER (PARTITION BY orgunituid ORDER BY period_idx, mech_code) AS three_back FROM totals)
WHERE mech_code IS NOT NULL""",
            *NETCHANGE,
        ),
        **{
            f"ratio_valid_lag{n}": q(
                f"""
SELECT {PAIR.replace("period", label() + " AS period")},
       CASE WHEN flag_multimech_site OR coalesce(before_multi, FALSE) THEN FALSE ELSE before IS NOT NULL END AS vlc_valid
FROM (SELECT *, lag(flag_multimech_site, {n}) OVER w AS before_multi, lag(value, {n}) OVER w AS before
      FROM sgrid WINDOW w AS (PARTITION BY orgunituid ORDER BY period_idx, mech_code)) WHERE mech_code IS NOT NULL""",
                *BASE,
            )
            for n in (1, 3)
        },
        "multi_site_share_without_owner": q(
            """
SELECT period, flag_multimech_site, n, round(n / total, 6) AS share
FROM (SELECT *, sum(n) OVER (PARTITION BY period) AS total FROM (
        SELECT period, flag_multimech_site, count(DISTINCT orgunituid) AS n
        FROM review WHERE mech_code <> '5' GROUP BY ALL)) WHERE flag_multimech_site""",
            *REVIEW,
        ),
        "ratio_aggregate_stacked": q("SELECT * EXCLUDE (period_idx) FROM msd", *AGGREGATE),
    }
