"""Chosen definitions: every parameter the dashboard pages name without a
formula.  They are our definitions, kept in one place, and the DuckDB oracle
repeats them literally."""

from __future__ import annotations

from decimal import Decimal

# --- fixed values -----------------------------------------------------------
# Tokens that the CSV import treats as missing (pandas read_csv defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
             "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
             "None", "n/a", "nan", "null"]
# Amount texts mapped to missing before the numeric cast.
AMOUNT_BLANKS = ["-", "", " - ", " -   "]
# Valid amount pattern of the import report.
AMOUNT_PATTERN = r"^-?\d+(\.\d+)?$"
# Date format of the source CSV (day/month/four-digit year).
CSV_DATE_FORMAT = "d/M/yyyy"
# Source CSV header -> claims column.
CSV_HEADER_MAP = [
    ("ADMIT_ID", "admit_id"), ("ICD10_CODE", "icd10_code"),
    ("ENCOUNTER", "encounter"), ("CODE", "service_code"),
    ("QUANTITY", "quantity"), ("AMOUNT", "amount"),
    ("SERVICE_ID", "service_id"), ("BENEFIT_TYPE", "benefit"),
    ("BENEFIT_DESC", "benefit_desc"), ("CLAIM_PROV_DATE", "claim_prov_date"),
    ("CLAIM_POOL_NR", "claim_pod"), ("DOB", "dob"), ("Gender", "gender"),
    ("DependentType", "dependent_type"), ("Ailment", "ailment"),
    ("CLAIM_MEMBER_NUMBER", "claim_me"), ("CLAIM_CENTRAL_ID", "claim_ce"),
    ("CLAIM_INVOICE_NR", "claim_in_global"), ("GLOBAL_INVOICE_NR", "claim_pa"),
    ("CLAIM_PATIENT_FILE_NUMBER", "claim_pr"), ("PROV_NAME", "prov_name"),
    ("POL_ID", "pol_id"), ("POL_NAME", "pol_name"), ("CostCentre", "cost_center"),
]
# Result-column aliases of uploaded datasets: wanted name -> fallbacks.
DATASET_ALIASES = {
    "claim_id": ["claim_id", "claim_ce", "line_id"],
    "date": ["date", "claim_prov_date"],
    "provider_name": ["provider_name", "prov_name"],
}
# Display titles for result keys; other keys: '_' -> ' ', words capitalised.
KEY_TITLES = {
    "avg_fraud_score": "Average Fraud Score",
    "fraud_percentage": "Fraud Percentage",
    # The chart titles of the page.
    "fraud_pie": "Fraud Risk Distribution",
    "amount_hist": "Claim Amount Distribution by Risk Level",
    "suspicious_bar": "Top Suspicious Claims by Amount",
    "providers_bar": "Top Suspicious Providers by Fraud Risk",
    "benefit_risk_bar": "Fraud Risk by Benefit Type",
    "amount_scatter": "Claim Amount vs Risk Level",
    "fraud_trend": "Monthly Fraud Risk Trend",
    "gender_risk_bar": "Fraud Risk by Gender",
}
CURRENCY_PREFIX = "KES "
MASK_SUFFIX = "****"
MASK_KEEP = 4

# --- cleaning ---------------------------------------------------------------
SPARSE_COLUMN_LIMIT = 0.80        # drop a column at >= 80 % missing
PREVIEW_ROWS = 20

# --- periods ----------------------------------------------------------------
RELATIVE_MONTHS = {"all": None, "3m": 3, "6m": 6, "12m": 12, "24m": 24}
RECENT_DAYS = (30, 90, 365)
ROLLUP_UNITS = ("day", "week", "month", "quarter", "year")

# --- profiling --------------------------------------------------------------
COST_PERCENTILES = [0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99]
AGE_BANDS = [(0, 17, "0-17"), (18, 34, "18-34"), (35, 49, "35-49"),
             (50, 64, "50-64"), (65, None, "65+")]

# --- fraud ------------------------------------------------------------------
IQR_K = 1.5
RISK_BANDS = [(0.4, "Low"), (0.7, "Medium")]  # else High
HIGH_RISK_SCORE = 0.7
SCORE_BINS = 5
PROVIDER_RISK = [(20.0, "High"), (10.0, "Medium")]  # rate % above -> class
# Rule weights (decimal(3,2)); the score is their exact sum.
RULE_WEIGHTS = {
    "claim_total_outlier": Decimal("0.35"),
    "member_diagnosis_repeat": Decimal("0.25"),
    "member_month_lines": Decimal("0.15"),
    "quantity_p99": Decimal("0.15"),
    "amount_vs_diagnosis_mean": Decimal("0.10"),
}
RULE_MAX_LINES = 5       # n: more than n lines of one member in a month
RULE_QTY_PCT = 0.99      # q: quantity at or above this percentile
RULE_AMOUNT_FACTOR = 3.0  # k: amount above k x diagnosis mean
# Parameters the test data need (FIXTURES section 2).
TEST_RULE_MAX_LINES = 3
TEST_RULE_AMOUNT_FACTOR = 1.9
TEST_THRESHOLD = 0.35
ROBUST_Z_LIMIT = 3.5
MAD_SCALE = 1.4826

# --- forecasting ------------------------------------------------------------
Z_SCORES = {90: 1.645, 95: 1.960, 99: 2.576}
ROLLING_PERIODS = 3
ANOMALY_Z = 2.0
COPAY_WEIGHT = 0.20
DEDUCTIBLE_WEIGHT = 0.15
