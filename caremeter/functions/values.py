"""Fixed values. These must equal the published data's own codes, labels and measure ids."""

# --- fixed values: text tokens that stand for "no value" -------------------------------
MISSING_TOKENS = ("", "Not Available", "N/A")

# --- fixed values: text patterns accepted by the casts ---------------------------------
INT_PATTERN = r"^\d+\z"
DECIMAL_PATTERN = r"^\d+\.?\d*\z"
CUT_DECIMALS_PATTERN = r"^\d+\.\d{12}\d*[1-9]\d*\z"
DATE_PREFIX_PATTERN = r"^\d{2}/\d{2}/\d{4}"
LAST_TOKEN_PATTERN = r"[^_]+\z"
BLANK_PATTERN = r"^\s*\z"

# --- fixed values: footnote codes ------------------------------------------------------
BLOCKED_CODES = ("1", "2", "3", "4", "5", "7", "8", "12", "13", "23", "28", "29")
NO_SCORE = "No Score"
REASON_TIERS = (
    ("No Score", ("1", "4", "5")),
    ("Not Applicable", ("7", "12", "13")),
    ("Use With Caution", ("2", "3", "11", "23", "28", "29")),
)
ZERO_INFECTIONS_TIER = ("No Score - Zero Infections", ("8",))

GROUP_FLAG_CODES = {
    "not_reported": "5",
    "not_participating": "19",
    "dod_hospital": "22",
    "data_issue": "23",
}
STATUS_FEDERAL = "Federal (DoD, VA)"
STATUS_NOT_PARTICIPATING = "Not Participating"
STATUS_DATA_ISSUE = "Data Quality Issue"
STATUS_INSUFFICIENT = "Insufficient Data"
STATUS_FULL = "Fully Rated"
STATUS_PARTIAL = "Partially Rated"
STATUS_NONE = "Not Rated"

# --- fixed values: measure groups of the facility table --------------------------------
# group -> (has better/no different/worse counts, tests the data-issue code)
MEASURE_GROUPS = {
    "mort": (True, True),
    "safety": (True, True),
    "readm": (True, True),
    "pt_exp": (False, False),
    "te": (False, False),
}

# --- fixed values: ownership -----------------------------------------------------------
GOVERNMENT_PATTERNS = ("%government%", "%veterans%", "%defense%")
NON_PROFIT_PATTERN = "%non-profit%"
FOR_PROFIT_VALUES = ("Proprietary", "Physician")
TRIBAL_VALUE = "Tribal"

# --- fixed values: comparison wording --------------------------------------------------
COMPARISONS = (
    ("%better%", "Better"),
    ("%no different%", "No Different"),
    ("%worse%", "Worse"),
)

# --- fixed values: census regions ------------------------------------------------------
REGIONS = {
    "Northeast": ("CT", "ME", "MA", "NH", "RI", "VT", "NJ", "NY", "PA"),
    "Midwest": ("IL", "IN", "MI", "OH", "WI", "IA", "KS", "MN", "MO", "NE", "ND", "SD"),
    "South": ("DE", "FL", "GA", "MD", "NC", "SC", "VA", "DC", "WV", "AL", "KY", "MS", "TN",
              "AR", "LA", "OK", "TX"),
    "West": ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY", "AK", "CA", "HI", "OR", "WA"),
    "Territory": ("PR", "GU", "VI", "AS", "MP"),
}

# --- fixed values: measures ------------------------------------------------------------
ED_CONDITION = "Emergency Department"
ED_WAIT_MEASURES = ("OP_18a", "OP_18b", "OP_18c", "OP_18d")
ED_WAIT_CAP_MINUTES = 1440
IMAGING_MEASURES = ("OP-10", "OP-13", "OP-39")
IMAGING_OFF_SCALE = "OP-8"
IMAGING_OUTLIER = "OP-39"
PROCESS_CONDITIONS = ("Colonoscopy care", "Healthcare Personnel Vaccination")
INFECTION_RATIO_SUFFIX = "SIR"
INFECTION_MEASURE_COUNT = 6
INFECTION_ROWS_PER_FACILITY = 36
MIN_RATED = 3
OUTCOME_CATEGORIES = (("MORT%", "Mortality"), ("PSI%", "Patient Safety"), ("COMP%", "Complications"))
OUTCOME_PREFIXES = {"mort": "MORT%", "psi": "PSI%", "comp_cat": "COMP%"}
GAP_MEASURES = {
    "complications": ("PSI_03", "PSI_90"),
    "outpatient_imaging": ("OP-10",),
    "infections": ("HAI_1_SIR",),
}
ACUTE_TYPES = ("Acute Care Hospitals", "Acute Care - Veterans Administration")
