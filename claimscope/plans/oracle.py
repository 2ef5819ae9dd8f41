"""DuckDB twins of the registered queries (same names, same columns).

Each string runs on the driver's pre-registered views of the test tables.
``CL`` re-derives the claims table exactly as
:func:`claimscope.sources.tables.claims_view` does; ``SC`` is the rule
score of :func:`claimscope.operators.fraud.rule_score` with the test
parameters (3 lines per member-month, factor 1.9, threshold 0.35).
"""

from __future__ import annotations

from claimscope import definitions as _D
from claimscope.sources.tables import CLAIM_COLUMNS

CL = """cl AS (
  SELECT
    concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
              CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR),
              CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)) AS line_id,
    CAST(l.l_orderkey AS VARCHAR) AS admit_id,
    p.p_brand AS icd10_code,
    o.o_orderstatus AS encounter,
    l.l_linestatus || '-' || substr(o.o_orderpriority, 1, 1) AS service_code,
    CAST(l.l_quantity AS INTEGER) AS quantity,
    CAST(l.l_extendedprice AS DECIMAL(12,2)) AS amount,
    CAST(l.l_partkey AS VARCHAR) AS service_id,
    p.p_type AS benefit,
    p.p_name AS benefit_desc,
    CAST(l.l_shipdate AS DATE) AS claim_prov_date,
    CAST(c.c_nationkey AS VARCHAR) AS claim_pod,
    CAST(DATE '1950-01-01' + CAST(c.c_custkey * 97 % 14000 AS INTEGER) AS DATE) AS dob,
    CASE WHEN c.c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
    CASE WHEN c.c_custkey % 3 = 0 THEN 'PRINCIPAL' WHEN c.c_custkey % 3 = 1 THEN 'SPOUSE'
         ELSE 'CHILD' END AS dependent_type,
    'AILMENT-' || CAST(p.p_size % 15 AS VARCHAR) AS ailment,
    lpad(CAST(c.c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS claim_me,
    CAST(l.l_orderkey AS VARCHAR) AS claim_ce,
    CAST(l.l_orderkey AS VARCHAR) || '/' || CAST(l.l_suppkey AS VARCHAR) AS claim_in_global,
    CAST(o.o_orderkey AS VARCHAR) AS claim_pa,
    CAST(c.c_custkey AS VARCHAR) AS claim_pr,
    s.s_name AS prov_name,
    CAST(c.c_custkey AS VARCHAR) AS pol_id,
    c.c_name AS pol_name,
    c.c_mktsegment AS cost_center,
    sn.n_name AS prov_location,
    sr.r_name AS prov_region,
    CAST(l.l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation sn ON sn.n_nationkey = s.s_nationkey
  JOIN region sr ON sr.r_regionkey = sn.n_regionkey
)"""

AGE = ("CAST(year(claim_prov_date) - year(dob) - CASE WHEN month(claim_prov_date) * 100 + "
       "day(claim_prov_date) < month(dob) * 100 + day(dob) THEN 1 ELSE 0 END AS INTEGER)")
MON = "CAST(date_trunc('month', claim_prov_date) AS DATE)"
CLA = f"cla AS (SELECT *, {AGE} AS age FROM cl)"

SC = f"""rt AS (SELECT claim_ce, sum(amount) AS claim_total FROM cl GROUP BY claim_ce),
rq AS (SELECT quantile_cont(CAST(claim_total AS DOUBLE), 0.25) AS q1,
              quantile_cont(CAST(claim_total AS DOUBLE), 0.75) AS q3 FROM rt),
rp AS (SELECT quantile_cont(CAST(quantity AS DOUBLE), 0.99) AS q99 FROM cl),
rr AS (SELECT claim_me, icd10_code, {MON} AS mon, count(*) AS n FROM cl GROUP BY 1, 2, 3),
rm AS (SELECT claim_me, {MON} AS mon, count(*) AS n FROM cl GROUP BY 1, 2),
rd AS (SELECT icd10_code, CAST(sum(amount) AS DOUBLE) / count(amount) AS mean_amount FROM cl GROUP BY 1),
rules AS (
  SELECT cl.*,
    coalesce(CAST(rt.claim_total AS DOUBLE) > rq.q3 + 1.5::DOUBLE * (rq.q3 - rq.q1), false) AS rule_claim_total_outlier,
    coalesce(rr.n > 1, false) AS rule_member_diagnosis_repeat,
    coalesce(rm.n > 3, false) AS rule_member_month_lines,
    coalesce(CAST(cl.quantity AS DOUBLE) >= rp.q99, false) AS rule_quantity_p99,
    coalesce(CAST(cl.amount AS DOUBLE) > 1.9::DOUBLE * rd.mean_amount, false) AS rule_amount_vs_diagnosis_mean
  FROM cl
  LEFT JOIN rt ON rt.claim_ce = cl.claim_ce
  LEFT JOIN rr ON rr.claim_me = cl.claim_me AND rr.icd10_code = cl.icd10_code
              AND rr.mon = CAST(date_trunc('month', cl.claim_prov_date) AS DATE)
  LEFT JOIN rm ON rm.claim_me = cl.claim_me AND rm.mon = CAST(date_trunc('month', cl.claim_prov_date) AS DATE)
  LEFT JOIN rd ON rd.icd10_code = cl.icd10_code
  CROSS JOIN rq CROSS JOIN rp
),
sc AS (
  SELECT *, CAST(CASE WHEN rule_claim_total_outlier THEN 0.35 ELSE 0.00 END
               + CASE WHEN rule_member_diagnosis_repeat THEN 0.25 ELSE 0.00 END
               + CASE WHEN rule_member_month_lines THEN 0.15 ELSE 0.00 END
               + CASE WHEN rule_quantity_p99 THEN 0.15 ELSE 0.00 END
               + CASE WHEN rule_amount_vs_diagnosis_mean THEN 0.10 ELSE 0.00 END AS DECIMAL(3,2)) AS fraud_score
  FROM rules
),
scf AS (SELECT *, fraud_score >= 0.35 AS fraud_flag FROM sc)"""

MONEY = "CAST(sum(amount) AS DECIMAL(22,2))"
AVG = "CAST(sum(amount) AS DOUBLE) / count(amount)"
ROWS = "SELECT line_id, claim_prov_date, amount FROM cl"


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join((CL,) + ctes) + "\n"


ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------ slice
ORACLE["flagship_monthly_by_benefit_12m"] = w() + f"""
SELECT benefit, {MON} AS month, count(*) AS line_count, count(DISTINCT claim_ce) AS claim_count,
       {MONEY} AS total_amount
FROM cl WHERE claim_prov_date > (SELECT max(claim_prov_date) FROM cl) - INTERVAL 12 MONTH
GROUP BY 1, 2"""

# ------------------------------------------------------------------ sources
ORACLE["s04_claims_scan"] = w() + "SELECT * FROM cl"
ORACLE["s04_stored_claims_scan"] = w() + "SELECT * FROM cl"
ORACLE["s05_dataset_aliases"] = w() + """
SELECT coalesce(claim_ce, line_id) AS claim_id, claim_prov_date AS date, prov_name AS provider_name, amount FROM cl"""
ORACLE["s07_filter_values"] = w() + "SELECT DISTINCT benefit AS value FROM cl WHERE benefit IS NOT NULL"
ORACLE["s07_filter_ranges"] = w() + """
SELECT min(claim_prov_date) AS min_date, max(claim_prov_date) AS max_date,
       min(amount) AS min_amount, max(amount) AS max_amount FROM cl"""

# ------------------------------------------------------------------ cleaning
ORACLE["c07_cleaning_stats"] = w() + f"""
SELECT o.n AS original_rows, f.n AS final_rows, o.n - f.n AS rows_removed,
       {len(CLAIM_COLUMNS)} AS original_cols, {len(CLAIM_COLUMNS)} AS final_cols, 0 AS cols_removed,
       '' AS columns_dropped
FROM (SELECT count(*) AS n FROM cl) o,
     (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM cl) d
      WHERE claim_prov_date IS NOT NULL AND amount IS NOT NULL) f"""
ORACLE["c08_preview"] = w() + "SELECT " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '-') AS {c}" for c in CLAIM_COLUMNS) + \
    " FROM (SELECT * FROM cl ORDER BY line_id LIMIT 20)"
ORACLE["c09_valid_range"] = w() + """
SELECT count(*) AS record_count, count(claim_prov_date) AS dated_records,
       min(claim_prov_date) AS first_date, max(claim_prov_date) AS last_date FROM cl"""

# ------------------------------------------------------------------ profiling
_DESCRIBE_COLS = ["quantity", "amount", "age"]
ORACLE["p01_describe"] = w(CLA, "v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM cla" for c in _DESCRIBE_COLS) + ")") + """
SELECT "column", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
       round(quantile_cont(value, 0.75), 4) AS p75, max(value) AS max
FROM v GROUP BY "column\""""
ORACLE["p02_null_profile"] = w() + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) AS row_count FROM cl"
    for c in CLAIM_COLUMNS)
ORACLE["p02_total_nulls"] = w() + "SELECT CAST(" + " + ".join(
    f"(count(*) - count({c}))" for c in CLAIM_COLUMNS) + " AS BIGINT) AS total_nulls FROM cl"
_DISTINCT_COLS = ["icd10_code", "benefit", "prov_name", "claim_me", "claim_ce", "cost_center"]
ORACLE["p02_distinct_profile"] = w() + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT CAST({c} AS VARCHAR)) AS distinct_count FROM cl"
    for c in _DISTINCT_COLS)
_CORR_COLS = ["quantity", "amount", "age", "label"]
_pairs = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
ORACLE["p03_correlation"] = w(CLA, "u AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c FROM cla"
    for a, b in _pairs) + ")") + """
SELECT col_a, col_b, round(coalesce(c, 0.0), 6) AS corr FROM u
UNION ALL SELECT col_b AS col_a, col_a AS col_b, round(coalesce(c, 0.0), 6) AS corr FROM u
UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{c}', '{c}', 1.0::DOUBLE)" for c in _CORR_COLS) + \
    ") d(col_a, col_b, corr)"


def _hist(col: str, src: str, bins: int = 10) -> str:
    return f"""
, r AS (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}),
b AS (SELECT CAST(CASE WHEN hi - lo = 0 THEN 1 ELSE least(floor((CAST({col} AS DOUBLE) - lo) / (hi - lo) * {bins}.0::DOUBLE), {bins - 1}) + 1 END AS INTEGER) AS bin
      FROM {src}, r WHERE {col} IS NOT NULL),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
SELECT s.bin, round(lo + (hi - lo) * (s.bin - 1) / {bins}.0::DOUBLE, 4) AS bin_low,
       round(lo + (hi - lo) * s.bin / {bins}.0::DOUBLE, 4) AS bin_high, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1})) s CROSS JOIN r LEFT JOIN c ON c.bin = s.bin"""


ORACLE["p04_histogram_amount"] = w().rstrip("\n").replace("\n", "\n", 1) + _hist("amount", "cl").replace("\n, r AS", ", r AS", 1)
ORACLE["p04_histogram_age"] = w(CLA).rstrip("\n") + _hist("age", "cla").replace("\n, r AS", ", r AS", 1)
ORACLE["p05_provider_counts"] = w() + "SELECT prov_name, count(*) AS line_count FROM cl GROUP BY 1"
_PCTS = [0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99]
ORACLE["p07_cost_percentiles"] = w() + " UNION ALL ".join(
    f"SELECT CAST({round(p * 100)} AS INTEGER) AS percentile, round(quantile_cont(CAST(amount AS DOUBLE), {p}), 4) AS value FROM cl"
    for p in _PCTS)
_BAND = (f"CASE WHEN {AGE} IS NULL THEN 'Unknown' WHEN {AGE} <= 17 THEN '0-17' WHEN {AGE} <= 34 THEN '18-34' WHEN {AGE} <= 49 THEN '35-49' "
         f"WHEN {AGE} <= 64 THEN '50-64' ELSE '65+' END")
ORACLE["p08_age_profile"] = w() + f"""
SELECT {_BAND} AS age_band, count(*) AS line_count, count(DISTINCT claim_me) AS unique_members, {MONEY} AS total_amount
FROM cl GROUP BY 1"""

# ------------------------------------------------------------------ filters
ORACLE["f01_period_12m"] = w() + ROWS + " WHERE claim_prov_date > (SELECT max(claim_prov_date) FROM cl) - INTERVAL 12 MONTH"
ORACLE["f02_calendar_year"] = w() + ROWS + " WHERE claim_prov_date >= DATE '1998-01-01' AND claim_prov_date < DATE '1999-01-01'"
ORACLE["f03_last_90_days"] = w() + ROWS + " WHERE claim_prov_date > (SELECT max(claim_prov_date) FROM cl) - INTERVAL 90 DAY"
ORACLE["f04_date_range"] = w() + ROWS + " WHERE claim_prov_date BETWEEN DATE '1996-02-01' AND DATE '1996-03-31'"
ORACLE["f05_equals_or_all"] = w() + ROWS + " WHERE benefit = 'PROMO' AND cost_center = 'BUILDING'"
ORACLE["f06_amount_range"] = w() + ROWS + " WHERE amount >= 1000 AND amount <= 2500"
ORACLE["f07_member_of"] = w() + ROWS + " WHERE icd10_code IN ('Brand#1', 'Brand#13', 'Brand#22')"
_F08 = """SELECT claim_ce AS claim_id, claim_prov_date AS date, claim_me, prov_name AS provider_name,
       benefit AS category, icd10_code AS diagnosis, amount FROM cl
WHERE claim_prov_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND amount >= 5000 AND amount <= 60000
  AND benefit IN ('PROMO', 'SMALL')"""
ORACLE["f08_custom_filter"] = w() + _F08
ORACLE["f08_filter_count"] = w() + f"SELECT count(*) AS filter_count FROM ({_F08}) x"
ORACLE["f09_risk_level"] = w(SC) + "SELECT line_id, fraud_score FROM sc WHERE fraud_score >= 0.4 AND fraud_score < 0.7"
ORACLE["f10_score_threshold"] = w(SC) + "SELECT line_id, fraud_score FROM sc WHERE fraud_score >= 0.40"
ORACLE["f11_text_search"] = w() + """SELECT line_id FROM cl
WHERE contains(lower(concat_ws(' ', line_id, icd10_code, benefit, prov_name)), 'brand#2')
  AND contains(lower(concat_ws(' ', line_id, icd10_code, benefit, prov_name)), 'promo')"""
ORACLE["f14_claim_lookup"] = w() + "SELECT line_id, amount FROM cl WHERE claim_ce = '7'"
ORACLE["f11_indexed_search"] = w() + """SELECT line_id, claim_prov_date, amount FROM cl
WHERE contains(lower(concat_ws(' ', line_id, icd10_code, benefit, prov_name)), '115-1-')
  AND contains(lower(concat_ws(' ', line_id, icd10_code, benefit, prov_name)), 'brand')"""
ORACLE["f14_indexed_lookup"] = w() + "SELECT line_id, claim_prov_date, amount FROM cl WHERE claim_ce = '7'"
ORACLE["f15_drilldown"] = w(SC) + """SELECT line_id AS claim_id, claim_prov_date AS date, claim_me,
  prov_name AS provider_name, icd10_code AS diagnosis, amount,
  CASE WHEN coalesce(fraud_flag, false) THEN 'Flagged' ELSE 'Approved' END AS status FROM scf"""


def _dbl(expr: str) -> str:
    return f"TRY_CAST(trim(CAST({expr} AS VARCHAR)) AS DOUBLE)"


ORACLE["x_numeric_functions"] = w() + f"""SELECT line_id,
  coalesce({_dbl('quantity')} * {_dbl('amount')}, 0.0::DOUBLE) AS x_multiply,
  coalesce({_dbl('amount')} / nullif({_dbl('quantity')}, 0.0::DOUBLE), 0.0::DOUBLE) AS x_div,
  coalesce({_dbl('amount')} / nullif({_dbl('quantity - quantity')}, 0.0::DOUBLE), 0.0::DOUBLE) AS x_div_zero,
  coalesce(abs({_dbl('amount * -1')}), 0.0::DOUBLE) AS x_abs,
  coalesce(abs({_dbl('benefit')}), 0.0::DOUBLE) AS x_abs_bad,
  coalesce(CAST(abs({_dbl('benefit')}) AS VARCHAR), CAST(benefit AS VARCHAR)) AS x_absval_bad,
  TRY_CAST(regexp_replace('KES ' || CAST(amount AS VARCHAR), '[^0-9.\\-]+', '', 'g') AS DOUBLE) AS x_amount_text
FROM cl"""


def _initcap(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split({expr}, ' '), "
            f"lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ')")


ORACLE["x_text_functions"] = w() + f"""SELECT line_id,
  coalesce(list_contains(list_transform(string_split(' promo, small ', ','), lambda x: upper(trim(x))), upper(CAST(benefit AS VARCHAR))), false) AS x_in_list,
  CASE WHEN coalesce(CAST(cost_center AS VARCHAR), '') = '' THEN false
       ELSE coalesce(list_contains(list_transform(string_split('building,machinery', ','), lambda x: upper(trim(x))), upper(CAST(cost_center AS VARCHAR))), false) END AS x_isin,
  CAST(claim_ce AS VARCHAR) IS NOT DISTINCT FROM CAST(admit_id AS VARCHAR) AS x_equals,
  substring(claim_me, 1, 4) || '****' AS x_mask,
  CASE WHEN CAST(CASE WHEN quantity > 25 THEN quantity END AS VARCHAR) IS NULL
         OR CASE WHEN quantity > 25 THEN quantity END = 0 THEN 'N/A'
       ELSE CAST(CASE WHEN quantity > 25 THEN quantity END AS VARCHAR) END AS x_default,
  upper(substring(lower(benefit_desc), 1, 1)) || substring(lower(benefit_desc), 2, 1073741824) AS x_capfirst,
  {_initcap('cost_center')} AS x_title,
  strftime(claim_prov_date, '%Y-%m') AS x_ym,
  strftime(claim_prov_date, '%B') AS x_month_name,
  'KES ' || format('{{:,.2f}}', CAST(amount AS DOUBLE)) AS x_money,
  {_initcap("replace(lower(concat_ws('_', encounter, gender)), '_', ' ')")} AS x_key_title,
  substring(prov_name, 3, greatest(length(prov_name) - 5, 0)) AS x_slice,
  encounter || '; ' || CASE WHEN quantity > 25 THEN 'many' ELSE 'None' END AS x_join,
  CAST(coalesce(length(CASE WHEN quantity > 9 THEN benefit_desc END), 0) AS INTEGER) AS x_length, upper(lower(dependent_type)) AS x_upper
FROM cl"""

# ------------------------------------------------------------------ order / page / sets
ORACLE["o01_newest_first_top20"] = w() + "SELECT line_id, claim_prov_date FROM cl ORDER BY claim_prov_date DESC, line_id LIMIT 20"
_HR = """SELECT line_id AS claim_id, claim_prov_date AS date, amount, prov_name AS provider, icd10_code, fraud_score
FROM sc WHERE fraud_score >= 0.35"""
ORACLE["o03_page"] = w(SC) + _HR + " ORDER BY fraud_score DESC, claim_id LIMIT 10 OFFSET 10"
ORACLE["o05_selected"] = w(SC) + "SELECT line_id, amount FROM cl WHERE line_id IN (SELECT line_id FROM sc WHERE fraud_score >= 0.5)"
ORACLE["o06_union_datasets"] = w() + """SELECT line_id, amount, CAST(NULL AS VARCHAR) AS dataset_note FROM cl WHERE claim_prov_date < DATE '1998-01-01'
UNION ALL SELECT line_id, amount, benefit AS dataset_note FROM cl WHERE claim_prov_date >= DATE '1998-01-01'"""

# ------------------------------------------------------------------ aggregates
ORACLE["a01_summary"] = w() + f"""SELECT total_claims, total_amount, unique_members,
  CAST(total_amount AS DOUBLE) / unique_members AS avg_per_member FROM (
  SELECT count(DISTINCT claim_ce) AS total_claims, {MONEY} AS total_amount, count(DISTINCT claim_me) AS unique_members FROM cl)"""
ORACLE["a02_summary_providers"] = w() + f"""SELECT total_claims, total_amount, unique_members, unique_providers,
  CAST(total_amount AS DOUBLE) / unique_members AS avg_per_member,
  CAST(total_claims AS DOUBLE) / unique_members AS claims_per_member FROM (
  SELECT count(DISTINCT claim_ce) AS total_claims, {MONEY} AS total_amount, count(DISTINCT claim_me) AS unique_members,
         count(DISTINCT prov_name) AS unique_providers FROM cl)"""
ORACLE["a03_home_summary"] = w() + f"""SELECT total_invoices, total_claims, total_amount, unique_members,
  CAST(total_amount AS DOUBLE) / unique_members AS avg_per_member FROM (
  SELECT count(DISTINCT claim_in_global) AS total_invoices, count(DISTINCT claim_ce) AS total_claims,
         {MONEY} AS total_amount, count(DISTINCT claim_me) AS unique_members FROM cl)"""
ORACLE["a04_period_summary"] = w() + f"""SELECT count(*) AS line_count, {MONEY} AS total_amount, {AVG} AS avg_amount,
  max(amount) AS max_amount FROM cl WHERE claim_prov_date >= DATE '2000-01-01' AND claim_prov_date < DATE '2001-01-01'"""
ORACLE["a05_overview"] = w() + f"SELECT count(*) AS line_count, {MONEY} AS total_amount, {AVG} AS avg_amount FROM cl"
ORACLE["a06_by_benefit"] = w() + f"SELECT benefit AS benefit_type, count(*) AS line_count, {MONEY} AS total_amount FROM cl GROUP BY 1"
ORACLE["a07_top_claimants"] = w() + f"""SELECT pol_name AS policy_holder, count(*) AS line_count, {MONEY} AS total_amount
FROM cl GROUP BY 1 ORDER BY total_amount DESC, policy_holder LIMIT 10"""
ORACLE["a08_top_members_masked"] = w() + f"""SELECT substring(claim_me, 1, 4) || '****' AS member, total_amount, line_count FROM (
  SELECT claim_me, {MONEY} AS total_amount, count(*) AS line_count FROM cl GROUP BY 1
  ORDER BY total_amount DESC, claim_me LIMIT 10)"""
ORACLE["a09_top_providers"] = w() + f"""SELECT prov_name, {MONEY} AS total_amount, count(*) AS line_count
FROM cl GROUP BY 1 ORDER BY total_amount DESC, prov_name LIMIT 10"""
ORACLE["a10_amount_by_benefit"] = w() + f"SELECT benefit, count(*) AS line_count, {MONEY} AS total_amount FROM cl GROUP BY 1"
ORACLE["a11_two_level"] = w() + f"""SELECT benefit, benefit_desc, CAST(GROUPING(benefit, benefit_desc) AS INTEGER) AS level,
  count(*) AS line_count, {MONEY} AS total_amount FROM cl GROUP BY ROLLUP (benefit, benefit_desc)"""
ORACLE["a12_claim_frequency"] = w() + """SELECT n_claims, count(*) AS members FROM (
  SELECT claim_me, count(DISTINCT claim_ce) AS n_claims FROM cl GROUP BY 1) GROUP BY 1"""
_LORENZ = """pt AS (SELECT prov_name, sum(amount) AS total_amount FROM cl GROUP BY 1),
lz AS (SELECT prov_name, CAST(total_amount AS DECIMAL(22,2)) AS total_amount,
  row_number() OVER (ORDER BY total_amount, prov_name) AS position,
  CAST(row_number() OVER (ORDER BY total_amount, prov_name) AS DOUBLE) / (SELECT count(*) FROM pt) AS provider_share,
  CAST(sum(total_amount) OVER (ORDER BY total_amount, prov_name ROWS UNBOUNDED PRECEDING) AS DOUBLE)
    / CAST((SELECT sum(total_amount) FROM pt) AS DOUBLE) AS amount_share FROM pt)"""
ORACLE["a13_lorenz"] = w(_LORENZ) + "SELECT * FROM lz"
ORACLE["a13_gini"] = w(_LORENZ) + """SELECT round(1.0::DOUBLE - (2.0::DOUBLE * sum(amount_share) - 1.0::DOUBLE) / count(*), 6) AS gini,
  count(*) AS providers FROM lz"""
ORACLE["a14_breakdown_sum"] = w() + f"""SELECT cost_center AS category, {MONEY} AS value_sum FROM cl
WHERE benefit IN ('PROMO', 'LARGE') GROUP BY 1"""
ORACLE["a14_breakdown_avg"] = w() + f"SELECT encounter AS category, {AVG} AS value_avg FROM cl GROUP BY 1"
ORACLE["a15_top_cost_centres"] = w() + f"""SELECT cost_center, count(*) AS line_count, {MONEY} AS total_amount
FROM cl GROUP BY 1 ORDER BY line_count DESC, cost_center LIMIT 10"""
ORACLE["a16_by_service"] = w() + f"SELECT service_code, count(*) AS line_count, {MONEY} AS total_amount FROM cl GROUP BY 1"
ORACLE["a17_provider_analysis"] = w() + f"""SELECT prov_name, count(*) AS line_count, {MONEY} AS total_amount,
  {AVG} AS avg_amount FROM cl GROUP BY 1"""
ORACLE["a18_diagnosis_treatment"] = w() + "SELECT icd10_code, service_code, count(*) AS line_count FROM cl GROUP BY 1, 2"
ORACLE["a19_top_ailments"] = w() + f"""SELECT ailment, count(*) AS line_count, {MONEY} AS total_amount
FROM cl GROUP BY 1 ORDER BY line_count DESC, ailment LIMIT 10"""
ORACLE["a20_age_service"] = w() + f"""SELECT {_BAND} AS age_band, service_code, count(*) AS line_count, {MONEY} AS total_amount
FROM cl GROUP BY 1, 2"""
ORACLE["a21_by_gender"] = w() + f"""SELECT gender, count(*) AS line_count, {MONEY} AS total_amount,
  count(DISTINCT claim_me) AS unique_members FROM cl GROUP BY 1"""
ORACLE["a22_treatment_distribution"] = w() + """SELECT service_code, line_count,
  CAST(line_count AS DOUBLE) / sum(line_count) OVER () AS share FROM (
  SELECT service_code, count(*) AS line_count FROM cl GROUP BY 1)"""
_EFF = f"""SELECT prov_name, count(*) AS total_claims, {MONEY} AS total_amount, {AVG} AS avg_amount,
  (SELECT {AVG} FROM cl) / ({AVG}) AS efficiency_score FROM cl GROUP BY 1"""
ORACLE["a23_provider_efficiency"] = w() + _EFF
ORACLE["a23_most_efficient"] = w() + _EFF + " ORDER BY efficiency_score DESC, prov_name LIMIT 10"
ORACLE["a24_break_even"] = w() + f"""SELECT prov_name, {AVG} AS avg_amount,
  250000.0::DOUBLE / nullif(({AVG}) * (1.0::DOUBLE - 0.35::DOUBLE), 0.0::DOUBLE) AS break_even_claims FROM cl GROUP BY 1"""
ORACLE["a26_period_breakdown"] = w() + """SELECT benefit AS category, count(*) AS value_count FROM cl
WHERE claim_prov_date > (SELECT max(claim_prov_date) FROM cl) - INTERVAL 24 MONTH GROUP BY 1"""

# ------------------------------------------------------------------ temporal
for _u in ("day", "week", "month", "quarter", "year"):
    ORACLE[f"w01_rollup_{_u}"] = w() + f"""SELECT CAST(date_trunc('{_u}', claim_prov_date) AS DATE) AS period,
  count(*) AS line_count, {MONEY} AS total_amount, {AVG} AS avg_amount, max(amount) AS max_amount,
  min(amount) AS min_amount FROM cl GROUP BY 1"""
_MT = f"mt AS (SELECT {MON} AS period, {MONEY} AS total_amount FROM cl GROUP BY 1)"
ORACLE["w02_cumulative"] = w(_MT) + """SELECT period, total_amount,
  CAST(sum(total_amount) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS DECIMAL(22,2)) AS cumulative_amount FROM mt"""
ORACLE["w03_day_of_week"] = w() + f"""SELECT CAST(isodow(claim_prov_date) AS INTEGER) AS dow, dayname(claim_prov_date) AS day_name,
  count(*) AS line_count, {MONEY} AS total_amount FROM cl GROUP BY 1, 2"""
ORACLE["w04_seasonality"] = w() + f"""SELECT CAST(month(claim_prov_date) AS INTEGER) AS month_of_year, count(*) AS line_count,
  {MONEY} AS total_amount, {AVG} AS avg_amount FROM cl GROUP BY 1"""
ORACLE["w05_hour_of_day"] = "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS event_count, round(sum(value), 4) AS total_value FROM events GROUP BY 1"
ORACLE["w06_monthly_box"] = w() + f"""SELECT {MON} AS month, CAST(min(amount) AS DOUBLE) AS min,
  round(quantile_cont(CAST(amount AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST(amount AS DOUBLE), 0.5), 4) AS median,
  round(quantile_cont(CAST(amount AS DOUBLE), 0.75), 4) AS q3, CAST(max(amount) AS DOUBLE) AS max FROM cl GROUP BY 1"""
ORACLE["w07_heatmap"] = w() + f"""SELECT CAST(month(claim_prov_date) AS INTEGER) AS month_of_year, CAST(isodow(claim_prov_date) AS INTEGER) AS dow,
  count(*) AS line_count, {MONEY} AS total_amount FROM cl GROUP BY 1, 2"""
ORACLE["w08_rolling_average"] = w(_MT) + """SELECT period, total_amount,
  CAST(sum(total_amount) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE)
  / count(*) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_avg FROM mt"""
ORACLE["w09_anomalies"] = w(_MT, """st AS (SELECT avg(CAST(total_amount AS DOUBLE)) AS m, stddev_samp(CAST(total_amount AS DOUBLE)) AS s FROM mt)""") + """
SELECT period, total_amount, round((CAST(total_amount AS DOUBLE) - m) / nullif(s, 0), 4) AS z_score,
  coalesce(abs((CAST(total_amount AS DOUBLE) - m) / nullif(s, 0)) > 2.0::DOUBLE, false) AS is_anomaly FROM mt, st"""


def _dense(keys: list[str]) -> str:
    """Dense monthly series per key set."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    jk = " AND ".join([f"a.{c} IS NOT DISTINCT FROM cal.{c}" for c in keys] + ["a.month = cal.month"])
    return f"""act AS (SELECT {kc}{MON} AS month, {MONEY} AS amount, count(*) AS line_count FROM cl GROUP BY ALL),
bnd AS (SELECT {kc}min(month) AS a, max(month) AS b FROM act {"GROUP BY " + k if keys else ""}),
cal AS (SELECT {kc}CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM bnd),
dm AS (SELECT {", ".join("cal." + c for c in keys) + ", " if keys else ""}cal.month,
  coalesce(a.amount, CAST(0 AS DECIMAL(22,2))) AS amount, CAST(coalesce(a.line_count, 0) AS BIGINT) AS line_count
  FROM cal LEFT JOIN act a ON {jk})"""


_T = "CAST((year(month) - 1970) * 12 + month(month) - 1 AS INTEGER)"
ORACLE["w10_decomposition"] = w(_dense([]), """tr AS (SELECT month, amount AS y, CASE WHEN count(*) OVER w1 = 12 AND count(*) OVER w2 = 12
    THEN CAST(sum(amount) OVER w1 + sum(amount) OVER w2 AS DOUBLE) / 24.0::DOUBLE END AS trend FROM dm
  WINDOW w1 AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING),
         w2 AS (ORDER BY month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)),
se AS (SELECT month(month) AS moy, avg(CAST(y AS DOUBLE) - trend) AS seasonal FROM tr WHERE trend IS NOT NULL GROUP BY 1)""") + """
SELECT month, y AS amount, trend, round(seasonal, 2) AS seasonal,
  round(CAST(y AS DOUBLE) - trend - seasonal, 2) AS residual FROM tr LEFT JOIN se ON se.moy = month(tr.month)"""
ORACLE["w11_weekly_pattern"] = w() + """SELECT CAST(isodow(day) AS INTEGER) AS dow, count(*) AS days,
  CAST(sum(amount) AS DOUBLE) / count(*) AS mean_amount FROM (
  SELECT claim_prov_date AS day, sum(amount) AS amount FROM cl GROUP BY 1) GROUP BY 1"""
ORACLE["w12_trend_line"] = w(_dense([]), f"""s AS (SELECT month, amount, {_T} AS t FROM dm),
f AS (SELECT regr_slope(CAST(amount AS DOUBLE), t) AS b, regr_intercept(CAST(amount AS DOUBLE), t) AS a FROM s)""") + """
SELECT month, amount, round(a + b * t, 2) AS trend FROM s, f"""
ORACLE["w13_growth_rate"] = w(_MT) + """SELECT period, total_amount,
  round(100.0::DOUBLE * (CAST(total_amount AS DOUBLE) / nullif(CAST(lag(total_amount) OVER (ORDER BY period) AS DOUBLE), 0.0::DOUBLE) - 1.0::DOUBLE), 4) AS growth_pct FROM mt"""
ORACLE["w14_dense_months"] = w(_dense(["benefit", "prov_region"])) + "SELECT * FROM dm"
ORACLE["w15_monthly_fraud_trend"] = w(SC) + f"""SELECT {MON} AS month, count(*) FILTER (WHERE fraud_score >= 0.35) AS cases,
  CAST(sum(CASE WHEN fraud_score >= 0.35 THEN amount END) AS DECIMAL(22,2)) AS fraud_amount, count(*) AS line_count
FROM sc GROUP BY 1"""
ORACLE["w16_trend_summary"] = w(SC) + """SELECT count(*) AS total_claims, count(*) FILTER (WHERE fraud_score >= 0.35) AS total_fraud,
  100.0::DOUBLE * (CAST(count(*) FILTER (WHERE fraud_score >= 0.35) AS DOUBLE) / count(*)) AS fraud_rate_pct,
  strftime(min(claim_prov_date), '%Y-%m') || ' to ' || strftime(max(claim_prov_date), '%Y-%m') AS analysis_period FROM sc"""
_SEG = f"""mb AS (SELECT claim_me, {MONEY} AS total_amount FROM cl GROUP BY 1),
cuts AS (SELECT quantile_cont(CAST(total_amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(total_amount AS DOUBLE), 0.5) AS q2,
  quantile_cont(CAST(total_amount AS DOUBLE), 0.75) AS q3 FROM mb),
seg AS (SELECT claim_me, total_amount, CASE WHEN total_amount IS NULL THEN 'Unknown' WHEN CAST(total_amount AS DOUBLE) <= q1 THEN 'Low'
  WHEN CAST(total_amount AS DOUBLE) <= q2 THEN 'Medium' WHEN CAST(total_amount AS DOUBLE) <= q3 THEN 'High'
  ELSE 'Very High' END AS segment FROM mb, cuts)"""
ORACLE["w17_member_segments"] = w(_SEG) + "SELECT * FROM seg"
ORACLE["w17_segment_summary"] = w(_SEG) + """SELECT segment, count(*) AS members,
  CAST(sum(total_amount) AS DECIMAL(22,2)) AS total_amount FROM seg GROUP BY 1"""
ORACLE["w18_provider_rank"] = w() + f"""SELECT prov_name, total_amount, dense_rank() OVER (ORDER BY total_amount DESC) AS rank FROM (
  SELECT prov_name, {MONEY} AS total_amount FROM cl GROUP BY 1)"""

# ------------------------------------------------------------------ forecasting


def _fit(keys: list[str]) -> str:
    kc = ", ".join(keys) + ", " if keys else ""
    gb = ("GROUP BY " + ", ".join(keys)) if keys else ""
    return f"""ser AS (SELECT {kc}month, CAST(amount AS DOUBLE) AS y, {_T} AS t FROM dm),
fit AS (SELECT {kc}regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, regr_r2(y, t) AS r2,
  count(*) AS n, max(t) AS last_t, max(month) AS last_month, arg_max(y, month) AS last_y,
  CASE WHEN count(*) > 2 THEN sqrt(greatest(0.0::DOUBLE, (regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t))
       / (count(*) - 2))) END AS resid_sd
  FROM ser {gb})"""


def _on(keys: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys) if keys else "true"


def _forecast(keys: list[str], horizon: int, z: float) -> str:
    kc = ", ".join(keys) + ", " if keys else ""
    return w(_dense(keys), _fit(keys)) + f"""SELECT {kc}CAST(last_month + to_months(step) AS DATE) AS month,
  round(intercept + slope * (last_t + step), 2) AS forecast,
  round(intercept + slope * (last_t + step) - {z}::DOUBLE * resid_sd, 2) AS lower,
  round(intercept + slope * (last_t + step) + {z}::DOUBLE * resid_sd, 2) AS upper
FROM fit CROSS JOIN (SELECT CAST(range AS INTEGER) AS step FROM range(1, {horizon + 1})) s"""


_FK = ["benefit"]
_SK = ["benefit", "prov_region"]
ORACLE["m01_forecast"] = _forecast(_FK, 6, 1.960)
ORACLE["m01_forecast_many_series"] = _forecast(_SK, 12, 1.645)

_LAGS = """lf AS (SELECT benefit, month, y, y - lag(y) OVER (PARTITION BY benefit ORDER BY month) AS x FROM ser),
lg AS (SELECT benefit, month, x, lag(x, 1) OVER (PARTITION BY benefit ORDER BY month) AS lag_1,
  lag(x, 2) OVER (PARTITION BY benefit ORDER BY month) AS lag_2, lag(x, 3) OVER (PARTITION BY benefit ORDER BY month) AS lag_3 FROM lf),
ok AS (SELECT * FROM lg WHERE lag_1 IS NOT NULL AND x IS NOT NULL),
ar AS (SELECT benefit, regr_slope(x, lag_1) AS coef, regr_intercept(x, lag_1) AS intercept, avg(lag_1) AS lag_mean,
  count(*) AS n, min(lag_1) AS lo, max(lag_1) AS hi FROM ok GROUP BY benefit)"""
ORACLE["m02_ar1_fit"] = w(_dense(_FK), _fit(_FK), _LAGS) + \
    "SELECT benefit, round(coef, 6) AS coef, round(intercept, 2) AS intercept, n FROM ar"
ORACLE["m03_lag_features"] = w(_dense(_FK), _fit(_FK), _LAGS) + \
    "SELECT benefit, month, round(x, 2) AS x, round(lag_1, 2) AS lag_1, round(lag_2, 2) AS lag_2, round(lag_3, 2) AS lag_3 FROM lg"
_HIST = """h AS (SELECT ser.benefit, ser.month, ser.y, fit.intercept + fit.slope * ser.t AS fit, fit.resid_sd, fit.last_month, fit.r2
  FROM ser JOIN fit ON ser.benefit IS NOT DISTINCT FROM fit.benefit)"""
ORACLE["m04_accuracy"] = w(_dense(_FK), _fit(_FK), _HIST) + """SELECT benefit,
  round(greatest(0.0::DOUBLE, 100.0::DOUBLE - 100.0::DOUBLE * avg(CASE WHEN y <> 0 THEN abs(y - fit) / abs(y) END)), 4) AS accuracy_pct,
  round(any_value(r2), 6) AS r2, round(avg(abs(y - fit)), 2) AS mae FROM h GROUP BY benefit"""


def _ftable(horizon: int) -> str:
    return f"""fc AS (SELECT benefit, CAST(last_month + to_months(step) AS DATE) AS month,
  round(intercept + slope * (last_t + step), 2) AS forecast,
  round(intercept + slope * (last_t + step) - 1.96::DOUBLE * resid_sd, 2) AS lower,
  round(intercept + slope * (last_t + step) + 1.96::DOUBLE * resid_sd, 2) AS upper, last_y
  FROM fit CROSS JOIN (SELECT CAST(range AS INTEGER) AS step FROM range(1, {horizon + 1})) s),
ft AS (SELECT benefit, month, forecast AS amount,
  round(100.0::DOUBLE * (forecast / nullif(coalesce(lag(forecast) OVER (PARTITION BY benefit ORDER BY month), round(last_y, 2)), 0.0::DOUBLE) - 1.0::DOUBLE), 4) AS growth_pct,
  lower, upper FROM fc)"""


ORACLE["m05_forecast_table"] = w(_dense(_FK), _fit(_FK), _ftable(3)) + "SELECT * FROM ft"
ORACLE["m05_next_month"] = w(_dense(_FK), _fit(_FK), _ftable(1), _HIST) + """, acc AS (SELECT benefit,
  round(greatest(0.0::DOUBLE, 100.0::DOUBLE - 100.0::DOUBLE * avg(CASE WHEN y <> 0 THEN abs(y - fit) / abs(y) END)), 4) AS accuracy_pct
  FROM h GROUP BY benefit)
SELECT ft.benefit, ft.month AS next_month, ft.amount, ft.growth_pct, acc.accuracy_pct FROM ft JOIN acc ON ft.benefit IS NOT DISTINCT FROM acc.benefit"""
ORACLE["m06_fitted_band"] = w(_dense(_FK), _fit(_FK), _HIST) + """SELECT benefit, month, round(y, 2) AS amount, round(fit, 2) AS fit,
  round(fit - 2.576::DOUBLE * resid_sd, 2) AS lower, round(fit + 2.576::DOUBLE * resid_sd, 2) AS upper FROM h"""
ORACLE["m07_band_summary"] = w(_dense(_FK), _fit(_FK)) + "SELECT benefit, round(1.96::DOUBLE * resid_sd, 2) AS half_width FROM fit"
ORACLE["m07_outside_band"] = w(_dense(_SK), _fit(_SK)) + f""", hh AS (SELECT ser.benefit, ser.prov_region, ser.month, ser.y,
  f.intercept + f.slope * ser.t AS fit, f.resid_sd, f.last_month FROM ser JOIN fit f ON {_on(_SK, 'ser', 'f')})
SELECT benefit, prov_region, month AS date, round(y, 2) AS amount FROM hh
WHERE month > last_month - INTERVAL 12 MONTH
  AND (y < fit - 1.645::DOUBLE * resid_sd OR y > fit + 1.645::DOUBLE * resid_sd)"""
ORACLE["m08_lag_contributions"] = w(_dense(_FK), _fit(_FK), _LAGS) + """SELECT ok.benefit, ok.month,
  round(ar.intercept + ar.coef * ok.lag_1, 2) AS prediction, round(ar.intercept + ar.coef * ar.lag_mean, 2) AS base_value,
  round(ar.coef * (ok.lag_1 - ar.lag_mean), 2) AS lag_1_contribution FROM ok JOIN ar ON ok.benefit IS NOT DISTINCT FROM ar.benefit"""
ORACLE["m09_partial_dependence"] = w(_dense(_FK), _fit(_FK), _LAGS) + """SELECT benefit, i,
  round(lo + (hi - lo) * i / 9.0::DOUBLE, 2) AS lag_1_value,
  round(intercept + coef * (lo + (hi - lo) * i / 9.0::DOUBLE), 2) AS mean_prediction
FROM ar CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, 10)) g"""
_SCEN = """scen(scenario, copay_pct, deductible_pct, utilization_pct) AS (VALUES
  ('baseline', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('higher_copay', 20.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE),
  ('deductible', 0.0::DOUBLE, 30.0::DOUBLE, -5.0::DOUBLE), ('growth', -10.0::DOUBLE, -10.0::DOUBLE, 15.0::DOUBLE)),
cur AS (SELECT benefit, CAST(sum(amount) AS DECIMAL(22,2)) AS current_total FROM cl GROUP BY 1),
wi AS (SELECT benefit, scenario, current_total,
  CAST(current_total AS DOUBLE) * (1.0::DOUBLE + utilization_pct / 100.0::DOUBLE)
    * (1.0::DOUBLE - 0.2::DOUBLE * copay_pct / 100.0::DOUBLE)
    * (1.0::DOUBLE - 0.15::DOUBLE * deductible_pct / 100.0::DOUBLE) AS projected_total FROM cur CROSS JOIN scen),
wis AS (SELECT *, CAST(current_total AS DOUBLE) - projected_total AS savings FROM wi)"""
ORACLE["m10_what_if"] = w(_SCEN) + """SELECT benefit, scenario, current_total, projected_total, savings,
  100.0::DOUBLE * (savings / nullif(CAST(current_total AS DOUBLE), 0.0::DOUBLE)) AS savings_percent FROM wis"""
ORACLE["m11_savings_text"] = w(_SCEN) + """SELECT benefit, scenario,
  CASE WHEN round(savings, 2) <> 0 THEN 'KES ' || format('{:,.2f}', savings) END AS savings_text FROM wis"""

# ------------------------------------------------------------------ fraud
_CT = """ct AS (SELECT claim_ce, CAST(sum(amount) AS DECIMAL(22,2)) AS claim_total, min(pol_name) AS pol_name,
  min(benefit_desc) AS benefit_desc, count(*) AS line_count FROM cl GROUP BY 1),
fq AS (SELECT quantile_cont(CAST(claim_total AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(claim_total AS DOUBLE), 0.75) AS q3 FROM ct),
fb AS (SELECT q1, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM fq),
cto AS (SELECT ct.*, CAST(claim_total AS DOUBLE) < lower OR CAST(claim_total AS DOUBLE) > upper AS is_outlier FROM ct, fb)"""
ORACLE["r01_iqr_bounds"] = w(_CT) + "SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper FROM fb"
ORACLE["r02_suspicious_claims"] = w(_CT) + "SELECT claim_ce AS claim_id, claim_total AS amount, pol_name, benefit_desc, line_count FROM cto WHERE is_outlier ORDER BY 2 DESC, 1"
ORACLE["r03_fraud_statistics"] = w(_CT) + """SELECT count(*) AS total_claims, count(*) FILTER (WHERE is_outlier) AS suspicious_claims,
  100.0::DOUBLE * (CAST(count(*) FILTER (WHERE is_outlier) AS DOUBLE) / count(*)) AS fraud_percentage FROM cto"""
ORACLE["r04_rule_score"] = w(SC) + """SELECT line_id, fraud_score, rule_claim_total_outlier, rule_member_diagnosis_repeat,
  rule_member_month_lines, rule_quantity_p99, rule_amount_vs_diagnosis_mean FROM sc"""
_FLAG = "fraud_score >= 0.35"
ORACLE["r05_run_summary"] = w(SC) + f"""SELECT count(*) FILTER (WHERE {_FLAG}) AS fraud_count, count(*) AS total_claims,
  CAST(sum(CASE WHEN {_FLAG} THEN amount END) AS DECIMAL(22,2)) AS fraud_amount,
  100.0::DOUBLE * (CAST(count(*) FILTER (WHERE {_FLAG}) AS DOUBLE) / count(*)) AS fraud_rate_pct FROM sc"""
ORACLE["r06_dashboard_summary"] = w(SC) + f"""SELECT *, 100.0::DOUBLE * (CAST(fraud_count AS DOUBLE) / total_claims) AS fraud_rate_pct,
  100.0::DOUBLE * (CAST(fraud_amount AS DOUBLE) / CAST(total_amount AS DOUBLE)) AS fraud_amount_pct FROM (
  SELECT count(*) FILTER (WHERE {_FLAG}) AS fraud_count, count(*) AS total_claims,
    CAST(sum(CASE WHEN {_FLAG} THEN amount END) AS DECIMAL(22,2)) AS fraud_amount,
    count(*) FILTER (WHERE fraud_score >= 0.70) AS high_risk_claims,
    CAST(sum(fraud_score) AS DOUBLE) / count(fraud_score) AS avg_fraud_score,
    CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount FROM sc)"""
ORACLE["r07_score_histogram"] = w(SC) + """SELECT b.bin, b.label, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count FROM
  (VALUES (0, '0.0-0.2'), (1, '0.2-0.4'), (2, '0.4-0.6'), (3, '0.6-0.8'), (4, '0.8-1.0')) b(bin, label)
  LEFT JOIN (SELECT CAST(least(floor(fraud_score * 5), 4) AS INTEGER) AS bin, count(*) AS cnt FROM sc GROUP BY 1) c ON c.bin = b.bin"""
ORACLE["r08_high_risk"] = w(SC) + _HR
ORACLE["r08_high_risk_page1"] = w(SC) + _HR + " ORDER BY fraud_score DESC, claim_id LIMIT 10"
ORACLE["r09_high_risk_details"] = w(SC) + f"""SELECT line_id AS claim_id, claim_prov_date AS date, amount, prov_name AS provider,
  icd10_code, fraud_score, service_code AS service_type, {AGE} AS patient_age FROM sc WHERE {_FLAG}"""


def _fraud_by(col: str) -> str:
    return f"""SELECT {col}, count(*) AS total_claims, count(*) FILTER (WHERE {_FLAG}) AS fraud_count,
  CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount, CAST(sum(CASE WHEN {_FLAG} THEN amount END) AS DECIMAL(22,2)) AS fraud_amount,
  100.0::DOUBLE * (CAST(count(*) FILTER (WHERE {_FLAG}) AS DOUBLE) / count(*)) AS fraud_rate_pct FROM sc GROUP BY 1"""


_PF = f"""pf AS ({_fraud_by('prov_name')}),
pfc AS (SELECT *, CASE WHEN fraud_rate_pct > 20.0 THEN 'High' WHEN fraud_rate_pct > 10.0 THEN 'Medium' ELSE 'Low' END AS risk_class FROM pf)"""
ORACLE["r10_provider_fraud"] = w(SC, _PF) + "SELECT * FROM pfc"
ORACLE["r12_provider_summary"] = w(SC, _PF) + """SELECT count(*) AS total_providers, count(*) FILTER (WHERE risk_class = 'High') AS high_risk_providers,
  round(avg(fraud_rate_pct), 6) AS avg_fraud_rate_pct, CAST(sum(fraud_count) AS BIGINT) AS total_fraud_cases FROM pfc"""
ORACLE["r13_provider_vs_average"] = w(SC, _PF) + """SELECT prov_name, fraud_rate_pct, round((SELECT avg(fraud_rate_pct) FROM pf), 6) AS avg_rate_pct FROM pf"""
ORACLE["r14_diagnosis_fraud"] = w(SC) + _fraud_by("icd10_code")
ORACLE["r15_fraud_by_hour"] = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM q),
e AS (SELECT ts, CAST(value AS DOUBLE) < lower OR CAST(value AS DOUBLE) > upper AS is_outlier FROM events, b)
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS event_count, count(*) FILTER (WHERE is_outlier) AS flagged,
  100.0::DOUBLE * count(*) FILTER (WHERE is_outlier) / count(*) AS flag_rate_pct FROM e GROUP BY 1"""
ORACLE["r16_by_location"] = w(SC) + _fraud_by("prov_location")
ORACLE["r17_by_service"] = w(SC) + _fraud_by("service_code")
ORACLE["r18_region_hotspots"] = w(SC) + _fraud_by("prov_region")
ORACLE["r19_provider_mean_risk"] = w(SC) + """SELECT prov_name AS provider, CAST(sum(fraud_score) AS DOUBLE) / count(fraud_score) AS fraud_risk_avg,
  CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount, count(*) AS claim_count FROM sc GROUP BY 1"""
for _d, _expr in (("benefit", "benefit"), ("gender", "gender"), ("month", MON)):
    ORACLE[f"r20_risk_by_{_d}"] = w(SC) + f"""SELECT {_expr} AS {_d}, CAST(sum(fraud_score) AS DOUBLE) / count(fraud_score) AS avg_score,
  count(*) AS line_count FROM sc GROUP BY 1"""
ORACLE["r20_amount_by_risk_level"] = w(SC) + """SELECT CASE WHEN fraud_score < 0.4 THEN 'Low' WHEN fraud_score < 0.7 THEN 'Medium' ELSE 'High' END AS risk_level,
  count(*) AS line_count, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount FROM sc GROUP BY 1"""
_DEC = f"""dec AS (SELECT CAST(1 AS BIGINT) AS decision_id, line_id, 'Flagged' AS status, CAST(claim_prov_date AS TIMESTAMP) AS decided_at FROM sc WHERE {_FLAG}
  UNION ALL SELECT CAST(2 AS BIGINT), line_id, 'Approved', CAST(claim_prov_date + INTERVAL 7 DAY AS TIMESTAMP) FROM sc WHERE {_FLAG} AND quantity >= 45),
lat AS (SELECT line_id, status FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY decided_at DESC, decision_id DESC) AS rn FROM dec) WHERE rn = 1),
rv AS (SELECT sc.*, coalesce(lat.status, 'Pending') AS status FROM sc LEFT JOIN lat ON lat.line_id = sc.line_id)"""
ORACLE["r21_potential_cases"] = w(SC, _DEC) + """SELECT line_id AS claim_id, claim_prov_date AS date, claim_me, prov_name AS provider_name,
  amount, fraud_score, status FROM rv
WHERE claim_prov_date >= DATE '1996-01-01' AND claim_prov_date <= DATE '2000-12-31' AND fraud_score >= 0.4 AND fraud_score < 0.7"""
ORACLE["r22_review_status"] = w(SC, _DEC) + "SELECT status, count(*) AS line_count FROM rv GROUP BY 1"

# ------------------------------------------------------------------ machine learning (SQL-expressible parts)
ORACLE["l02_binary_target"] = w() + """SELECT CAST(CAST(amount AS DOUBLE) > (SELECT quantile_cont(CAST(amount AS DOUBLE), 0.75) FROM cl) AS INTEGER) AS label,
  count(*) AS line_count FROM cl GROUP BY 1"""
ORACLE["l05_robust_z"] = w("""md AS (SELECT quantile_cont(CAST(amount AS DOUBLE), 0.5) AS med FROM cl),
dv AS (SELECT abs(CAST(amount AS DOUBLE) - med) AS dev FROM cl, md),
mad AS (SELECT quantile_cont(dev, 0.5) AS mad FROM dv),
z AS (SELECT dev / (1.4826::DOUBLE * mad) AS s FROM dv, mad)""") + """SELECT 'robust_z' AS detector,
  round(avg(s), 6) AS anomaly_score_mean, round(stddev_samp(s), 6) AS anomaly_score_std,
  count(*) FILTER (WHERE s > 3.5::DOUBLE) AS n_anomalies FROM z"""
ORACLE["l07_class_balance"] = w() + """SELECT count(*) AS sample_size, CAST(sum(label) AS BIGINT) AS positives,
  100.0::DOUBLE * CAST(sum(label) AS DOUBLE) / count(*) AS positive_pct FROM cl"""

TEST_LINE = "CAST('0x' || substr(md5(line_id), 1, 8) AS BIGINT) % 10000 < 3000"


def _least_squares(target: str, numeric: list[str], categorical: list[str], rows: str = "cla", where: str = "true",
                   train: str = f"NOT ({TEST_LINE})") -> str:
    """CTEs ``xs`` (every row with its features x and target y) and ``ols``
    (coefficients b): normal equations, solved by Gauss-Jordan elimination."""
    cats = ", ".join(f"list(DISTINCT {c} ORDER BY {c} NULLS FIRST) AS v_{c}" for c in categorical) or "1 AS one"
    flags = "".join(f" || list_transform(v_{c}[2:], lambda v: CASE WHEN {c} IS NOT DISTINCT FROM v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for c in categorical)
    numbers = ", ".join([f"coalesce(CAST({c} AS DOUBLE), 0)" for c in numeric] + [f"CAST({c} IS NULL AS DOUBLE)" for c in numeric])
    return f"""own AS (SELECT *, CAST({target} AS DOUBLE) AS y, {train} AS train FROM {rows} WHERE {where}),
cats AS (SELECT {cats} FROM own WHERE train),
xs AS (SELECT own.*, [1.0::DOUBLE, {numbers}]{flags} AS x FROM own, cats),
gram AS (SELECT i, j, sum(x[i] * x[j]) AS v FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM xs WHERE train AND y IS NOT NULL), unnest(range(1, len(x) + 1)) AS u(j) GROUP BY i, j),
prod AS (SELECT i, sum(x[i] * y) AS v FROM xs, unnest(range(1, len(x) + 1)) AS u(i) WHERE train AND y IS NOT NULL GROUP BY i),
aug AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list_append(list(gram.v + CASE WHEN i = j AND i > 1 THEN 1e-3 ELSE 0 END ORDER BY j), any_value(prod.v)) AS r FROM gram JOIN prod USING (i) GROUP BY i)),
gauss AS (SELECT 1 AS k, m FROM aug UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(r, lambda v, j: v - r[k] * p[j]) END)
  FROM (SELECT k, m, list_transform(m[k], lambda v: v / m[k][k]) AS p FROM gauss WHERE k <= len(m))),
ols AS (SELECT list_transform(m, lambda r: r[len(r)]) AS b FROM gauss ORDER BY k DESC LIMIT 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_CLASSIFIER = _least_squares("label", ["quantity", "amount", "age"], ["benefit", "gender", "dependent_type", "encounter", "cost_center"])
ORACLE["l03_linear_metrics"] = _recursive(w(CLA, _CLASSIFIER, """sc AS (SELECT label, list_dot_product(x, b) AS s FROM xs, ols WHERE NOT train),
cm AS (SELECT count(*) FILTER (WHERE s >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE s >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (WHERE s < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE s < 0.5 AND label = 0) AS tn FROM sc),
cell AS (SELECT s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM sc GROUP BY s),
auc AS (SELECT sum(p * (2 * below - n)) / (2.0::DOUBLE * sum(p) * sum(n)) AS roc_auc FROM (SELECT *, sum(n) OVER (ORDER BY s) AS below FROM cell))""")) + """
SELECT 'linear_probability' AS model, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(roc_auc, 6) AS roc_auc, tp, fp, fn, tn FROM cm, auc"""
ORACLE["m12_claim_predictions"] = _recursive(w(CLA, _CLASSIFIER)) + """
SELECT line_id AS claim_id, CAST(amount AS DOUBLE) AS amount, CAST(p >= 0.5 AS INTEGER) AS predicted_label, round(greatest(p, 1 - p) * 100, 2) AS confidence_pct
FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(x, b))) AS p FROM xs, ols)"""
ORACLE["m13_batch_predict"] = ORACLE["m12_claim_predictions"]
_INPUTS = [("quantity", 1), ("amount", 2), ("age", 3), ("benefit", 0), ("gender", 0), ("dependent_type", 0), ("encounter", 0), ("cost_center", 0)]


def _dealt(c: str, numeric: bool) -> str:
    """Rows right with column ``c`` dealt anew: value i of one hash order goes
    to row i of another."""
    name = "amount_d" if c == "amount" else c
    # first feature of this input and how many it has
    value = {"quantity": "list_concat(list_concat(x[1:1], [new_x[2]]), x[3:])", "amount": "list_concat(list_concat(x[1:2], [new_x[3]]), x[4:])",
             "age": "list_concat(list_concat(x[1:3], [new_x[4]]), x[5:])"}.get(c)
    if not numeric:
        before = [k for k, n in _INPUTS if not n][: [k for k, n in _INPUTS if not n].index(c)]
        at = "7" + "".join(f" + len(v_{k}) - 1" for k in before)
        value = f"list_concat(list_concat(x[1:{at}], new_x[{at} + 1:{at} + len(v_{c}) - 1]), x[{at} + len(v_{c}):])"
    h = "CAST('0x' || substr(md5(line_id || ':{}'), 1, 12) AS BIGINT)"
    return f"""SELECT '{name}' AS feature, count(*) FILTER (WHERE (list_dot_product({value}, b) >= 0.5) = (label = 1)) AS r FROM
  (SELECT x, label, row_number() OVER (ORDER BY {h.format('to')}, line_id) AS i FROM xs WHERE NOT train) t
  JOIN (SELECT x AS new_x, row_number() OVER (ORDER BY {h.format(name)}, line_id) AS i FROM xs WHERE NOT train) v USING (i), cats, ols"""


ORACLE["l06_permutation_importance"] = _recursive(w(CLA, _CLASSIFIER)) + f"""
SELECT feature, round((base - r)::DOUBLE / n, 6) AS importance, n AS rows FROM ({' UNION ALL '.join(_dealt(c, bool(n)) for c, n in _INPUTS)}),
  (SELECT count(*) AS n, count(*) FILTER (WHERE (list_dot_product(x, b) >= 0.5) = (label = 1)) AS base FROM xs, ols WHERE NOT train)"""
ORACLE["l08_claims_regression"] = _recursive(w(CLA, _least_squares("amount", ["quantity", "age"], ["benefit", "gender", "encounter"], where="amount IS NOT NULL"))) + """
SELECT 'linear_regression' AS model, round(sqrt(sum((y - p) * (y - p)) / count(*)), 4) AS rmse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS test_rows
FROM (SELECT y, list_dot_product(x, b) AS p FROM xs, ols WHERE NOT train)"""
ORACLE["m02_pooled_ar3"] = _recursive(w(_dense(_SK), _fit(_SK), f"""dx AS (SELECT {', '.join(_SK)}, month, y - lag(y) OVER (PARTITION BY {', '.join(_SK)} ORDER BY month) AS x0 FROM ser),
lagged AS (SELECT *, {', '.join(f'lag(x0, {k}) OVER (PARTITION BY {", ".join(_SK)} ORDER BY month) AS lag_{k}' for k in (1, 2, 3))} FROM dx)""",
    _least_squares("x0", ["lag_1", "lag_2", "lag_3"], [], "lagged", "x0 IS NOT NULL AND lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL", "true"))) + """
SELECT unnest(['intercept', 'lag_1', 'lag_2', 'lag_3']) AS term, round(unnest(b[1:4]), 4) AS coefficient FROM ols"""
_POINTS = """unit AS (SELECT avg(CAST(amount AS DOUBLE)) AS m0, stddev_samp(CAST(amount AS DOUBLE)) AS s0, avg(quantity) AS m1, stddev_samp(quantity) AS s1, avg(age) AS m2, stddev_samp(age) AS s2 FROM cla),
pt AS (SELECT (coalesce(CAST(quantity AS DOUBLE), m1) - m1) / s1 AS a, (coalesce(CAST(amount AS DOUBLE), m0) - m0) / s0 AS b, (coalesce(CAST(age AS DOUBLE), m2) - m2) / s2 AS c FROM cla, unit)"""
ORACLE["l05_kmeans_distance"] = _recursive(w(CLA, _POINTS, """km AS (SELECT 0 AS r, list_transform(range(4), lambda i: [-1 + 2 * i / 3::DOUBLE, -1 + 2 * i / 3::DOUBLE, -1 + 2 * i / 3::DOUBLE]) AS cs
  UNION ALL SELECT r + 1, list_transform(range(4), lambda i: coalesce(new[i], cs[i + 1])) FROM (
    SELECT any_value(r) AS r, any_value(cs) AS cs, map_from_entries(list((near, mean))) AS new FROM (
      SELECT any_value(r) AS r, any_value(cs) AS cs, near, [avg(a), avg(b), avg(c)] AS mean FROM (
        SELECT r, cs, a, b, c, list_position(ds, list_min(ds)) - 1 AS near FROM (
          SELECT r, cs, a, b, c, list_transform(cs, lambda z: (a - z[1]) * (a - z[1]) + (b - z[2]) * (b - z[2]) + (c - z[3]) * (c - z[3])) AS ds FROM km, pt WHERE r < 10)) GROUP BY near) HAVING count(*) > 0)),
last AS (SELECT cs FROM km WHERE r = 10),
sc AS (SELECT sqrt(list_min(list_transform(cs, lambda z: (a - z[1]) * (a - z[1]) + (b - z[2]) * (b - z[2]) + (c - z[3]) * (c - z[3])))) AS s FROM last, pt)""")) + """
SELECT 'kmeans' AS detector, round(avg(s), 6) AS anomaly_score_mean, round(stddev_samp(s), 6) AS anomaly_score_std,
  count(*) FILTER (WHERE s > (SELECT quantile_cont(s, 0.99) FROM sc)) AS n_anomalies FROM sc"""


def _grouped_squares(name: str, rows: str, keys: list[str], xs: list[str], y: str) -> str:
    """CTE ``name`` (keys, b, n): least squares of each group."""
    k = ", ".join(keys)
    on = lambda a, c: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {c}.{x}" for x in keys)
    return f"""{name}_x AS (SELECT {k}, [{', '.join(xs)}] AS x, {y} AS y FROM {rows}),
{name}_g AS (SELECT {k}, i, j, sum(x[i] * x[j]) AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM {name}_x), unnest(range(1, len(x) + 1)) AS u(j) GROUP BY {k}, i, j),
{name}_p AS (SELECT {k}, i, sum(x[i] * y) AS v, count(*) AS n FROM {name}_x, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY {k}, i),
{name}_m AS (SELECT {k}, list(r ORDER BY i) AS m, any_value(n) AS n FROM (SELECT {', '.join(f'g.{x}' for x in keys)}, g.i, list_append(list(g.v ORDER BY j), any_value(p.v)) AS r, any_value(p.n) AS n
  FROM {name}_g g JOIN {name}_p p ON g.i = p.i AND {on('g', 'p')} GROUP BY {', '.join(f'g.{x}' for x in keys)}, g.i) GROUP BY {k}),
{name}_s AS (SELECT {k}, n, 1 AS k_, m FROM {name}_m UNION ALL
  SELECT {k}, n, k_ + 1, list_transform(m, lambda r, i: CASE WHEN i = k_ THEN p ELSE list_transform(r, lambda v, j: v - r[k_] * p[j]) END)
  FROM (SELECT *, list_transform(m[k_], lambda v: v / m[k_][k_]) AS p FROM {name}_s WHERE k_ <= len(m))),
{name} AS (SELECT {k}, n, list_transform(m, lambda r: r[len(r)]) AS b FROM {name}_s WHERE k_ > len(m))"""


def _arima(keys: list[str]) -> str:
    k, w_ = ", ".join(keys), f"OVER (PARTITION BY {', '.join(keys)} ORDER BY month)"
    on = " AND ".join(f"a.{x} IS NOT DISTINCT FROM c.{x}" for x in keys)
    return _recursive(w(_dense(keys), _fit(keys), f"""d0 AS (SELECT {k}, month, y, y - lag(y) {w_} AS x0 FROM ser),
d1 AS (SELECT *, lag(x0, 1) {w_} AS l1, lag(x0, 2) {w_} AS l2, lag(x0, 3) {w_} AS l3 FROM d0),
full_lags AS (SELECT * FROM d1 WHERE l3 IS NOT NULL)""", _grouped_squares("ar_long", "full_lags", keys, ["1.0::DOUBLE", "l1", "l2", "l3"], "x0"),
        f"""d2 AS (SELECT a.*, x0 - (b[1] + b[2] * l1 + b[3] * l2 + b[4] * l3) AS e FROM full_lags a JOIN ar_long c ON {on}),
d3 AS (SELECT *, lag(e) {w_} AS e1 FROM d2), d4 AS (SELECT * FROM d3 WHERE e1 IS NOT NULL)""",
        _grouped_squares("arma", "d4", keys, ["1.0::DOUBLE", "l1", "e1"], "x0"),
        f"last_one AS (SELECT * FROM d3 QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY month DESC) = 1)")) + f"""
SELECT {', '.join(f'a.{x}' for x in keys)}, round(b[2], 6) AS ar, round(b[3], 6) AS ma, round(b[1], 2) AS intercept, n, CAST(month + INTERVAL 1 MONTH AS DATE) AS next_month,
  round(y + b[1] + b[2] * x0 + b[3] * e, 2) AS next_amount FROM last_one a JOIN arma c ON {on}"""


ORACLE["m02_arima111"] = _arima(_FK)
ORACLE["m02_arima111_many_series"] = _arima(_SK)

# ------------------------------------------------------------------ streaming (same answer as batch)
_EV_DAILY = """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS event_count, round(sum(value), 4) AS total_value
FROM events GROUP BY 1, 2"""
ORACLE["st_w01_daily_event_rollup"] = _EV_DAILY
ORACLE["w01_daily_event_rollup_batch"] = _EV_DAILY

# ------------------------------------------------------------------ CSV import round trip
from claimscope.definitions import CSV_HEADER_MAP as _HDR  # noqa: E402

ORACLE["s01_csv_import_roundtrip"] = w() + "SELECT " + ", ".join(d for _, d in _HDR) + " FROM cl"

_SERVICES = ["F-1", "F-2", "F-3", "F-4", "F-5", "O-1", "O-2", "O-3", "O-4", "O-5"]
ORACLE["a18_diagnosis_treatment_wide"] = w() + "SELECT icd10_code, " + ", ".join(
    f"count(*) FILTER (WHERE service_code = '{v}') AS \"{v}\"" for v in _SERVICES) + " FROM cl GROUP BY icd10_code"
ORACLE["w07_heatmap_wide"] = w() + "SELECT CAST(month(claim_prov_date) AS INTEGER) AS month_of_year, " + ", ".join(
    f"count(*) FILTER (WHERE isodow(claim_prov_date) = {d}) AS \"{d}\"" for d in range(1, 8)) + " FROM cl GROUP BY 1"
ORACLE["a23_least_efficient"] = w() + _EFF + " ORDER BY efficiency_score ASC, prov_name LIMIT 10"
ORACLE["m07_outside_band_count"] = w(_dense(_SK), _fit(_SK)) + f""", hh AS (SELECT ser.benefit, ser.prov_region, ser.month, ser.y,
  f.intercept + f.slope * ser.t AS fit, f.resid_sd, f.last_month FROM ser JOIN fit f ON {_on(_SK, 'ser', 'f')})
SELECT benefit, prov_region, count(*) AS months_outside FROM hh
WHERE month > last_month - INTERVAL 12 MONTH
  AND (y < fit - 1.645::DOUBLE * resid_sd OR y > fit + 1.645::DOUBLE * resid_sd)
GROUP BY 1, 2"""

# ------------------------------------------------------------------ the same over claims with nulls
CL_NULLS = CL.replace("cl AS (", "cl0 AS (", 1) + """,
cl AS (SELECT * REPLACE (
  CASE WHEN quantity % 7 <> 0 THEN icd10_code END AS icd10_code,
  CASE WHEN quantity % 5 <> 0 THEN benefit END AS benefit,
  CASE WHEN quantity % 4 <> 1 THEN dob END AS dob,
  CASE WHEN quantity <> 31 THEN claim_prov_date END AS claim_prov_date,
  CASE WHEN quantity <> 13 AND right(prov_name, 1) <> '3' AND right(claim_me, 2) <> '07' THEN amount END AS amount) FROM cl0)"""
WITH_NULLS = ("p01_describe", "p07_cost_percentiles", "p08_age_profile", "a13_lorenz", "a20_age_service", "a23_provider_efficiency",
              "w06_monthly_box", "w14_dense_months", "w17_member_segments", "w17_segment_summary", "w18_provider_rank",
              "m01_forecast_many_series", "m04_accuracy", "m05_forecast_table", "m05_next_month", "m06_fitted_band", "m07_band_summary",
              "m08_lag_contributions", "m09_partial_dependence", "m02_arima111", "r02_suspicious_claims", "r03_fraud_statistics", "r04_rule_score")
for _n in WITH_NULLS:
    ORACLE[f"{_n}_with_nulls"] = ORACLE[_n].replace(CL, CL_NULLS, 1)

ORACLE["c06_clean_dirty_claims"] = w("""di AS (
  SELECT CASE WHEN quantity % 9 <> 0 THEN claim_prov_date END AS claim_prov_date, CASE WHEN quantity % 11 <> 0 THEN amount END AS amount,
    icd10_code, CASE WHEN quantity = 50 THEN claim_pod END AS mostly_missing FROM cl)""") + """
SELECT DISTINCT claim_prov_date, amount, icd10_code FROM di WHERE claim_prov_date IS NOT NULL AND amount IS NOT NULL"""
ORACLE["x_map_functions"] = w() + """SELECT encounter, CAST(coalesce(sum(CASE WHEN service_code = 'F-1' THEN CAST(amount AS DOUBLE) END), 0) AS DECIMAL(22,2)) AS f1_total,
  count(DISTINCT service_code) AS services FROM cl GROUP BY 1"""

ORACLE["x_collection_functions"] = w("""per AS (SELECT benefit, cost_center, count(*) AS n, count(*) FILTER (WHERE gender = 'M') AS men FROM cl GROUP BY 1, 2),
row AS (SELECT benefit, list(cost_center ORDER BY cost_center) AS k, list(n ORDER BY cost_center) AS n, list(men ORDER BY cost_center) AS men FROM per GROUP BY 1)""") + """
SELECT benefit, n[list_position(k, 'BUILDING')] AS building, CAST(NULL AS BIGINT) AS absent, array_to_string(k, '|') AS keys,
  array_to_string(list_transform(range(1, len(k) + 1), lambda i: array_to_string(list_transform(range(1, len(k) + 1), lambda j: CASE WHEN i = j THEN n[i] ELSE 0 END), ' ')), '/') AS matrix,
  array_to_string(list_transform(range(1, len(k) + 1), lambda i: k[i] || '=' || men[i]), '|') AS pairs FROM row"""
ORACLE["c03_rejects"] = w() + """SELECT * FROM (
  SELECT admit_id, 'AMOUNT' AS field, CASE quantity % 10 WHEN 3 THEN 'abc' ELSE '99999999999999' END AS value, CASE quantity % 10 WHEN 3 THEN 'not a number' ELSE 'out of range' END AS reason
    FROM cl WHERE quantity % 10 IN (3, 8)
  UNION ALL SELECT admit_id, 'CLAIM_PROV_DATE', CAST(claim_prov_date AS VARCHAR), 'not a date' FROM cl WHERE quantity % 10 = 4
  UNION ALL SELECT admit_id, 'DOB', '31/02/1980', 'not a date' FROM cl WHERE quantity % 10 = 6
  UNION ALL SELECT admit_id, 'QUANTITY', 'x' || quantity, 'not a number' FROM cl WHERE quantity % 10 = 5
  UNION ALL SELECT admit_id, NULL, NULL, 'wrong number of fields' FROM cl WHERE quantity % 10 = 7)"""
ORACLE["c03_accepted"] = w() + """SELECT benefit, count(*) AS lines, count(*) FILTER (WHERE quantity % 10 <> 5) AS quantities, count(*) FILTER (WHERE quantity % 10 <> 6) AS births,
  count(*) FILTER (WHERE quantity % 10 <> 4) AS dates, CAST(sum(CASE WHEN quantity % 10 IN (3, 8) THEN 0 ELSE amount END) AS DECIMAL(22,2)) AS total_amount
FROM cl WHERE quantity % 10 <> 7 GROUP BY benefit"""
ORACLE["c10_accents_roundtrip"] = w() + """SELECT admit_id, service_id, 'Clínica São José n° ' || prov_name AS prov_name, 'Ñandú & Øster ' || pol_name AS pol_name FROM cl"""
ORACLE["s01_quoted_line_ends"] = w() + "SELECT " + ", ".join(
    "benefit_desc || ', \"said\"' || chr(10) || cost_center || chr(10) || '\"' AS benefit_desc" if d == "benefit_desc" else d for _, d in _HDR) + " FROM cl"


def _rows_of(bundle: str, result: str, sql: str) -> str:
    return f"SELECT '{bundle}' AS bundle, '{result}' AS result, count(*) AS rows FROM ({sql})"


_FORECAST_6 = w(_dense(_FK), _fit(_FK), _ftable(6)) + "SELECT * FROM ft"
ORACLE["s10_report_bundles"] = "\nUNION ALL ".join(_rows_of(*r) for r in (
    ("forecast", "forecast", _FORECAST_6), ("forecast", "accuracy", ORACLE["m04_accuracy"]), ("fraud", "summary", ORACLE["r06_dashboard_summary"]),
    ("fraud", "high_risk", ORACLE["r08_high_risk"]), ("fraud", "providers", ORACLE["r10_provider_fraud"]), ("fraud", "diagnoses", ORACLE["r14_diagnosis_fraud"]),
    ("provider", "efficiency", ORACLE["a23_provider_efficiency"]), ("provider", "fraud", ORACLE["r10_provider_fraud"]),
    ("member", "segments", ORACLE["w17_member_segments"]), ("member", "frequency", ORACLE["a12_claim_frequency"])))
_PCT = ", ".join(f"{p}::DOUBLE" for p in _D.COST_PERCENTILES)
ORACLE["p07_sketched_percentiles"] = w(f"""sk AS (SELECT benefit, CAST(floor(ln(CAST(amount AS DOUBLE)) * 4096) AS BIGINT) AS bucket, count(*) AS n, min(CAST(amount AS DOUBLE)) AS low, max(CAST(amount AS DOUBLE)) AS high
  FROM cl WHERE strftime(claim_prov_date, '%Y-%m') BETWEEN '1996-01' AND '1997-06' AND amount > 0 GROUP BY 1, 2),
rk AS (SELECT *, sum(n) OVER (PARTITION BY benefit ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY benefit) AS total FROM sk)""") + f"""
SELECT benefit, CAST(p * 100 AS INTEGER) AS pct, round(low, 2) AS low, round(high, 2) AS high FROM rk, (SELECT unnest([{_PCT}]) AS p)
WHERE floor(p * (total - 1)) < upto AND floor(p * (total - 1)) >= upto - n"""
