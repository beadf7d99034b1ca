"""Fixed values.

Everything in this file must keep these exact values for results to be right:
word lists, patterns, label maps, coefficients, limits and message texts. They
are data, not logic; every operator takes them as default arguments.
"""

from __future__ import annotations

from typing import NamedTuple

# --- Label maps: raw text to class, exact match only -------------------------

LABELS_SOURCE_A = {"ckd": 1, "ckd\t": 1, "notckd": 0}
LABELS_SOURCE_B = {"ckd": 1, "notckd": 0}

# --- Tokens -------------------------------------------------------------------

RANGE_PATTERN = r"^(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)$"
LESS_PATTERN = r"^<\s*(-?\d+(?:\.\d+)?)$"
AT_LEAST_PATTERN = r"^(?:>=|≥)\s*(-?\d+(?:\.\d+)?)$"
SPREADSHEET_PATTERN = r"^\d{1,2}-[A-Za-z]{3}$"
COARSE_BOUND_PATTERN = r"^(<|>|>=|<=|≥|≤)\s*[-+]?\d"
COARSE_RANGE_PATTERN = r"^[-+]?\d+(\.\d+)?\s*-\s*[-+]?\d+(\.\d+)?$"
MONTH_TOKENS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")

YES_WORDS = ("yes", "y", "1", "true", "present", "abnormal", "poor")
NO_WORDS = ("no", "n", "0", "false", "notpresent", "normal", "good")
BINARY_VOCABULARIES = {
    "binary_text_yes_no": ("yes", "no"),
    "binary_text_present_absent": ("present", "notpresent"),
    "binary_text_normal_abnormal": ("normal", "abnormal"),
    "binary_text_good_poor": ("good", "poor"),
}
LOW_CARDINALITY_LIMIT = 10
EXCEL_WARNING = "contains_excel_style_month_tokens"
MISSING_MARK = "__MISSING__"

# --- Features -----------------------------------------------------------------

FEATURES = (
    "age", "al", "ane", "appet", "ba", "bgr", "bu", "cad", "dm", "hemo", "htn", "pc",
    "pcc", "pcv", "pe", "pot", "rbc", "rbcc", "sc", "sg", "sod", "su", "wbcc",
)
CLINICAL_FEATURES = (
    "age", "sex", "sbp", "dbp", "bmi", "egfr", "uacr", "hba1c", "scr", "potassium",
    "dm", "htn", "cvd", "proteinuria_flag",
)

# Fixed: request fields that are read as numbers, in the order in which they are read.
RESEARCH_NUMBERS = ("sc", "hemo", "pcv", "bu", "al", "sg", "rbcc")
CLINICAL_NUMBERS = ("age", "scr", "potassium", "egfr", "uacr", "hba1c", "sbp")


class FeatureGroups(NamedTuple):
    """Which features the audit and the rules treat specially."""

    low_risk_binary: tuple[str, ...] = ("ane", "cad", "dm", "htn", "pe")
    mapped_binary: tuple[str, ...] = ("appet", "ba", "pc", "pcc", "rbc")
    spreadsheet_risk: tuple[str, ...] = ("age", "al", "su")
    interval_risk: tuple[str, ...] = (
        "age", "bgr", "bu", "hemo", "pcv", "pot", "rbcc", "sc", "sg", "sod", "wbcc",
    )
    stage_like: tuple[str, ...] = ("al", "su")
    repairable_spreadsheet: tuple[str, ...] = ("age",)


SPECIAL_COLUMN_PAIRS = {"bp": "bp (Diastolic)"}

# --- Alignment texts ----------------------------------------------------------

EXACT_MATCH_NOTE = (
    "Exact column-name match across datasets. Confirm coding, units, and allowable values before final approval."
)
SPECIAL_PAIR_NAME = "blood_pressure_candidate"
SPECIAL_PAIR_NOTE = (
    "{a} metadata says 'bp' is blood pressure. {b} explicitly names this field diastolic blood pressure. "
    "Do not auto-merge without manual confirmation."
)
UNMATCHED_NOTE = (
    "Present only in dataset {source}. Excluded from the shared schema unless you later define a "
    "justified derivation rule."
)
DROPPED_REASON = "Not selected for shared aligned export."

# --- Audit texts --------------------------------------------------------------

PRE_BINNED_REASON = "dataset_{b}_appears_pre_binned_while_dataset_{a}_is_not"
TYPE_NOTES = {
    "manual_review_required": (
        "Do not harmonize automatically. Confirm semantic direction, category coding, "
        "and whether cross-dataset transformation is methodologically acceptable."
    ),
    "numeric_continuous": (
        "Keep as numeric for dataset-specific modeling inputs, but verify range units and whether one "
        "dataset is pre-binned."
    ),
    "numeric_or_ordinal_review": (
        "Low-cardinality numeric feature. Confirm whether downstream treatment should be ordinal numeric "
        "or categorical."
    ),
    "binary": "Binary feature family matches. Audit the positive/negative direction before encoding.",
    "categorical": "Treat as categorical after confirming the exact category vocabulary.",
}

# --- Rule texts ---------------------------------------------------------------

RULE_NOTES = {
    "low_risk_binary": (
        "Likely a simple binary representation mismatch, but the 0/1 direction in dataset {b} must be "
        "confirmed before mapping."
    ),
    "mapped_binary": (
        "Feature appears binary, but the semantic direction of dataset {b} numeric codes must be confirmed "
        "before any shared mapping is declared safe."
    ),
    "repairable_spreadsheet": (
        "The token 20-Dec is likely a spreadsheet-corrupted interval label such as 12 - 20, but this should "
        "be confirmed before repair."
    ),
    "stage_like": (
        "Excel-like tokens are present, but the original ordinal/bin semantics cannot be recovered with high "
        "confidence from the observed values alone."
    ),
    "interval": (
        "Safe repair is limited to preserving order as within-dataset bin codes. This does not imply "
        "equivalence to dataset {a} continuous values."
    ),
    "spreadsheet_suffix": "High-risk feature due to Excel-like token or ordinal ambiguity.",
    "interval_suffix": "Not yet safe to treat as the same feature space as dataset {a}.",
}
DIRECTION_NOTES = {
    "low_risk_binary": "Likely binary mismatch only, but {b} code direction still needs explicit confirmation.",
    "mapped_binary": "Binary-looking feature, but {b} code direction and semantic polarity are not yet confirmed.",
    "other": "Manual review required.",
}

# --- Leakage screen -----------------------------------------------------------

TARGET_LIKE_NAMES = ("target", "label", "class")
MIN_OBSERVED = 10
LEAKAGE_NOTES = {
    "target_name": "Feature name itself looks target-like and would require immediate review.",
    "numeric": (
        "Very strong univariate numeric separation. This is worth interpretation, but may still be clinically plausible."
    ),
    "categorical": (
        "Near-perfect categorical separation appears in train and remains strong in test. Review is warranted."
    ),
    "train_only": (
        "Train-only perfect separation does not hold on test; this looks more like small-sample instability "
        "than obvious leakage."
    ),
    "none": "No obvious leakage signature from this quick univariate screen.",
}
CLINICAL_CONTEXT = {
    "hemo": "Hemoglobin is clinically relevant for anemia and CKD severity, so a strong signal is plausible.",
    "pcv": "Packed cell volume is closely related to anemia burden and is clinically plausible as a strong CKD signal.",
    "sg": "Urine specific gravity can reflect renal concentrating ability, so a strong signal is clinically plausible.",
    "sc": "Serum creatinine is a core renal marker, so a strong signal is expected rather than automatically suspicious.",
    "rbcc": "Red blood cell count may reflect anemia-related CKD burden and can legitimately carry strong signal.",
    "al": "Albumin in urine is a clinically meaningful kidney-related feature and can be strongly predictive.",
    "dm": "Diabetes status is a plausible CKD risk factor, but binary perfect separation on train alone should be treated cautiously.",
    "htn": "Hypertension status is a plausible CKD risk factor, but binary perfect separation on train alone should be treated cautiously.",
    "bgr": "Blood glucose is clinically plausible and may correlate with diabetes-related CKD burden.",
    "bu": "Blood urea is a renal-function marker and can legitimately show strong signal.",
}
DEFAULT_CONTEXT = (
    "Strong signal is visible in this quick screen. It should be interpreted, but it is not automatically target leakage."
)

# --- Modelling ----------------------------------------------------------------

SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
REPLICATES = 2000
CONFIDENCE = 0.95
SIGNIFICANCE = 0.05
METRICS = (
    "auroc", "auprc", "accuracy", "precision", "recall_sensitivity", "specificity", "f1_score", "brier_score",
)
HIGH_RISK, MODERATE_RISK = 0.7, 0.4


# --- Contribution terms: sign * clip((x - centre) / scale, low, high) ---------


class Term(NamedTuple):
    feature: str
    message: str
    centre: float = 0.0
    scale: float = 1.0
    low: float | None = None
    high: float | None = None
    sign: int = 1


class Flag(NamedTuple):
    feature: str
    message: str
    weight: float
    word: str = "yes"


RESEARCH_TERMS = (
    Term("sc", "Higher serum creatinine increased the returned risk profile.", 1.2, 4.0, 0.0, 0.18),
    Term("hemo", "Lower hemoglobin contributed to a higher-risk pattern.", 12.5, 8.0, -0.16, 0.1, -1),
    Term("pcv", "Packed cell volume shifted the prediction toward the returned class.", 38.0, 20.0, -0.12, 0.08, -1),
    Term("bu", "Elevated blood urea aligned with the higher-risk profile.", 35.0, 220.0, 0.0, 0.12),
    Term("al", "Albumin level contributed to the urinalysis-driven signal.", 0.0, 25.0, None, 0.16),
    Term("sg", "Specific gravity influenced the concentration-related risk signal.", 1.015, 0.02, -0.1, 0.1, -1),
    Term("rbcc", "Red blood cell count contributed to the hematology signal.", 4.5, 3.0, -0.08, 0.08, -1),
)
RESEARCH_FLAGS = (
    Flag("htn", "Hypertension increased the returned risk profile.", 0.08),
    Flag("dm", "Diabetes mellitus increased the returned risk profile.", 0.08),
    Flag("cad", "Coronary artery disease added a smaller positive contribution.", 0.05),
    Flag("ane", "Anemia aligned with a higher-risk interpretation.", 0.07),
    Flag("pe", "Pedal edema increased the returned risk profile.", 0.06),
    Flag("appet", "Poor appetite contributed to the higher-risk pattern.", 0.05, "poor"),
)
CLINICAL_TERMS = (
    Term("egfr", "Lower eGFR increased the clinical intake risk summary.", 60.0, -80.0, 0.0, 0.18),
    Term("uacr", "Higher UACR increased the returned clinical risk summary.", 30.0, 1000.0, 0.0, 0.16),
    Term("scr", "Higher serum creatinine strengthened the higher-risk pattern.", 1.2, 6.0, 0.0, 0.16),
    Term("hba1c", "Higher HbA1c contributed to the metabolic risk profile.", 6.5, 10.0, 0.0, 0.09),
    Term("sbp", "Elevated systolic blood pressure contributed to the returned risk.", 125.0, 140.0, 0.0, 0.08),
    Term("age", "Older age contributed modestly to the clinical risk summary.", 45.0, 120.0, 0.0, 0.08),
)
CLINICAL_FLAGS = (
    Flag("dm", "Diabetes mellitus increased the returned risk profile.", 0.1),
    Flag("htn", "Hypertension increased the returned risk profile.", 0.09),
    Flag("proteinuria_flag", "Proteinuria history strengthened the renal risk interpretation.", 0.1),
    Flag("cvd", "Cardiovascular disease increased the overall clinical risk summary.", 0.06),
)
RESEARCH_FALLBACK = Flag(
    "intake", "No strong heuristic summary was available from the submitted research inputs.", 0.02
)
CLINICAL_FALLBACK = Flag(
    "intake", "No strong heuristic summary was available from the submitted clinical inputs.", 0.02
)
CONTRIBUTION_LIMIT = 6

# --- Clinical fields that may be carried over to research fields --------------

NUMERIC_TRANSLATION = {"age": "age", "scr": "sc", "potassium": "pot"}
BINARY_TRANSLATION = {"dm": "dm", "htn": "htn"}
TRANSLATION_NOTES = {
    "proteinuria_flag": (
        "proteinuria_flag was not force-mapped to albumin because the semantic equivalence is not strict."
    ),
    "cvd": "cvd was not force-mapped to cad because the clinical scopes are related but not identical.",
    "egfr": (
        "egfr was retained for clinical interpretation but not directly injected into the research feature space."
    ),
    "uacr": (
        "uacr was retained for clinical interpretation but not directly injected into the research feature space."
    ),
}
RESEARCH_NOTE = (
    "Inference completed with the current research model. Explanation items are operational summaries for UI "
    "guidance rather than formal SHAP attributions."
)
CLINICAL_NOTE = (
    "Inference completed through a provisional clinical-to-research adapter. The score comes from the current "
    "research model after conservative field translation."
)


# --- Additive scorecards: sign * clip((x - centre) * factor / divisor, low, high)


class Points(NamedTuple):
    feature: str
    factor: float = 1.0
    divisor: float = 1.0
    centre: float = 0.0
    low: float | None = None
    high: float | None = None
    sign: int = 1


class Word(NamedTuple):
    feature: str
    word: str
    weight: float


# The order is the order of the additions.
CLINICAL_BASE, RESEARCH_BASE = 0.2, 0.18
CLINICAL_SCORECARD = (
    Points("age", 1.0, 400.0, 0.0, None, 0.12),
    Word("dm", "yes", 0.12),
    Word("htn", "yes", 0.11),
    Word("cvd", "yes", 0.08),
    Word("proteinuria_flag", "yes", 0.1),
    Points("scr", 1.0, 10.0, 0.0, None, 0.15),
    Points("egfr", 1.0, 250.0, 45.0, 0.0, None, -1),
    Points("uacr", 1.0, 1200.0, 0.0, None, 0.14),
    Points("hba1c", 1.0, 40.0, 0.0, None, 0.09),
    Points("sbp", 1.0, 300.0, 120.0, 0.0, 0.08),
)
RESEARCH_SCORECARD = (
    Word("htn", "yes", 0.11),
    Word("dm", "yes", 0.11),
    Word("cad", "yes", 0.05),
    Word("pe", "yes", 0.07),
    Word("ane", "yes", 0.08),
    Word("appet", "poor", 0.05),
    Word("pc", "abnormal", 0.05),
    Word("rbc", "abnormal", 0.05),
    Points("al", 0.05),
    Points("su", 0.03),
    Points("sc", 1.0, 16.0, 0.0, None, 0.16),
    Points("bu", 1.0, 260.0, 0.0, None, 0.12),
    Points("bgr", 1.0, 1000.0, 0.0, None, 0.08),
    Points("hemo", 0.022, 1.0, 11.0, 0.0, None, -1),
    Points("pcv", 0.005, 1.0, 35.0, 0.0, None, -1),
    Points("rbcc", 0.03, 1.0, 4.0, 0.0, None, -1),
    Points("sg", 7.5, 1.0, 1.01, 0.0, None, -1),
)
SCORECARD_BOUNDS = (0.02, 0.98)
SCORECARD_DIGITS = 3


# --- Threshold messages: (feature, comparison, bound, name, text, weight) -----

CLINICAL_MESSAGES = (
    ("uacr", ">=", 30, "UACR", "Albuminuria burden is contributing positive signal to the clinical risk estimate.", 0.14),
    ("egfr", "<=", 60, "eGFR", "Reduced eGFR is contributing positive signal to the clinical risk estimate.", 0.12),
    ("scr", ">=", 1.2, "serum creatinine", "Elevated serum creatinine is increasing the clinical risk score.", 0.11),
    ("dm", "=", "yes", "diabetes mellitus", "Diabetes mellitus is contributing to the clinical risk profile.", 0.09),
    ("htn", "=", "yes", "hypertension", "Hypertension is contributing to the clinical risk profile.", 0.08),
)
RESEARCH_MESSAGES = (
    ("hemo", "<", 11, "hemoglobin", "Lower hemoglobin is pushing the research-mode score upward and aligns with the anemia-related risk signal.", 0.14),
    ("hemo", ">=", 11, "hemoglobin", "Higher hemoglobin is acting as a protective signal in the current research-mode profile.", -0.06),
    ("pcv", "<", 35, "packed cell volume", "Lower packed cell volume is contributing positive signal to the research-mode estimate.", 0.11),
    ("pcv", ">=", 35, "packed cell volume", "Higher packed cell volume is acting as a stabilizing signal in the current profile.", -0.05),
    ("sc", ">=", 1.5, "serum creatinine", "Elevated serum creatinine is pushing the research-mode score upward.", 0.16),
    ("sg", "<=", 1.01, "specific gravity", "Lower urine specific gravity is contributing positive signal to the research-mode estimate.", 0.09),
    ("sg", ">", 1.01, "specific gravity", "Higher urine specific gravity is acting as a protective signal in the current profile.", -0.04),
    ("bu", ">=", 40, "blood urea", "Higher blood urea is contributing to the upward prediction signal.", 0.12),
    ("al", ">=", 2, "albumin", "Albumin level is adding positive signal to the research-mode estimate.", 0.1),
    ("htn", "=", "yes", "hypertension", "Hypertension is contributing to the upward research-mode risk signal.", 0.09),
    ("dm", "=", "yes", "diabetes mellitus", "Diabetes mellitus is contributing to the upward research-mode risk signal.", 0.09),
)
MESSAGE_LIMIT = 5

# --- Accepted value ranges per field ------------------------------------------

CLINICAL_RANGES = {
    "age": (18.0, 95.0),
    "sbp": (70.0, 240.0),
    "dbp": (40.0, 140.0),
    "bmi": (10.0, 60.0),
    "egfr": (1.0, 140.0),
    "uacr": (0.0, 5000.0),
    "hba1c": (3.0, 20.0),
    "scr": (0.1, 20.0),
    "potassium": (1.5, 8.0),
}
RESEARCH_RANGES = {
    "age": (2.0, 90.0),
    "bgr": (22.0, 490.0),
    "bu": (1.5, 391.0),
    "sc": (0.4, 76.0),
    "sod": (4.5, 163.0),
    "pot": (2.5, 47.0),
    "hemo": (3.1, 17.8),
    "pcv": (9.0, 54.0),
    "wbcc": (2200.0, 26400.0),
    "rbcc": (2.1, 8.0),
}

# --- Response reading ---------------------------------------------------------

FALLBACK_CONTRIBUTIONS = (0.16, 0.13, 0.1, 0.08, 0.06)
LAST_FALLBACK_CONTRIBUTION = 0.05
PROTECTIVE_WORDS = ("protect", "lower", "decreas")
DEFAULT_RESPONSE_NOTE = "Prediction completed successfully."
DEFAULT_MESSAGE = "No explanation note returned."

# --- Model life cycle ---------------------------------------------------------

STATUSES = ("candidate", "approved", "active", "retired")
REQUIRED_MODEL_FIELDS = ("model_id", "status")

# --- Operations ---------------------------------------------------------------

REPORT_PREFIX = "REPORT RequestId:"
REPORT_FIELDS = (
    "request_id", "duration_ms", "billed_duration_ms", "memory_size_mb", "max_memory_used_mb", "init_duration_ms"
)
REPORT_PATTERN = (
    r"REPORT RequestId: ([^\t]+)\t"
    r"Duration: ([0-9.]+) ms\t"
    r"Billed Duration: ([0-9.]+) ms\t"
    r"Memory Size: ([0-9.]+) MB\t"
    r"Max Memory Used: ([0-9.]+) MB\t"
    r"(?:Init Duration: ([0-9.]+) ms\t)?"
)
QUANTILES = (0.5, 0.95, 0.99)


class Alarm(NamedTuple):
    name: str
    metric: str
    statistic: str
    period_seconds: int
    periods: int
    datapoints: int
    threshold: float
    comparison: str


ALARMS = (
    Alarm("errors-any", "errors", "sum", 60, 1, 1, 1.0, ">="),
    Alarm("api-5xx-any", "server_errors", "sum", 60, 1, 1, 1.0, ">="),
    Alarm("duration-p95-high", "duration_ms", "p95", 60, 3, 2, 3000.0, ">"),
)
