"""Fixed values of the receivables domain.

These lists, labels and patterns decide results, so they are stated here once, in
their natural order, and imported everywhere else.
"""

# Aging buckets in report order.
BUCKET_ORDER = ("0-30", "31-45", "46-60", "60+")

# Patterns searched for in a lower-cased aging label, first hit wins.
BUCKET_SEARCH = (
    ("0-30", r"0\s*[-_]?\s*30|0\s*to\s*30"),
    ("31-45", r"31\s*[-_]?\s*45|31\s*to\s*45"),
    ("46-60", r"46\s*[-_]?\s*60|46\s*to\s*60"),
    ("60+", r"60\s*\+|60\s*plus|60\s*over"),
)

# Whole labels (blanks removed) accepted when no pattern is found.
BUCKET_EXACT = (
    ("0-30", ("0-30", "0_30", "030")),
    ("31-45", ("31-45", "31_45", "3145")),
    ("46-60", ("46-60", "46_60", "4660")),
    ("60+", ("60+", "60over", "60")),
)

# Candidate column names of each role, in priority order.
ROLE_CANDIDATES = {
    "aging_bucket": ("claim_balance_aging", "pm_chasing", "aging_bucket", "aging", "bucket"),
    "worked_by": ("report_worked_by", "worked_by", "employee", "assigned_to", "owner"),
    "claim_id": ("claim_id", "claim_number", "claim_no", "id"),
    "balance": ("claim_balance", "outstanding_balance", "balance", "open_balance"),
    "recovered": ("recovered_amount", "dollars_recovered", "collected_amount"),
    "amount": ("claim_amount", "amount", "total_amount"),
    "status": ("claim_status", "status"),
    "filter_date": ("submission_date", "report_worked_date", "date_of_service", "resubmission_date"),
}

# Name parts that give a column its type.
DATE_NAME_PARTS = ("report_worked_date", "submission_date", "resubmission_date")
MONEY_NAME_PARTS = ("balance", "amount", "recovered", "collected", "paid", "charge")
BUCKET_NAME_PARTS = ("aging_bucket", "aging", "bucket")

# Whole cells that mean "no value".
NULL_MARKERS = ("", "nan", "None")

# Stand-ins shown for a missing worker or status.
MISSING_WORKER = "Unassigned"
MISSING_STATUS = "Blank"

# Text of a missing id inside a composite key.
MISSING_ID = "<NA>"

# Metric names of the topline table, in report order.
TOPLINE_METRICS = (
    "Total Claims",
    "Open Claims",
    "Closed Claims",
    "Total Outstanding Balance",
    "Total Balance Reductions",
)

# Snapshot days of the four-week trend page.
TREND_DATES = ("2026-05-04", "2026-05-11", "2026-05-18", "2026-05-26")
