"""Texts, codes and patterns that stored records and their readers share."""

# -- record states ----------------------------------------------------------
STATUS_PENDING_PHARMACY = "pending_pharmacy"
PHARMACY_PENDING = "pending"
STATUS_DISPENSED = "dispensed"
STATUS_FULFILLED = "fulfilled"
REQUEST_PENDING = "Pending"
REQUEST_COMPLETED = "Completed"
DEFAULT_REQUESTER = "DOC-001"

# -- audit columns every committed record carries -----------------------------
AUDIT_IS_LEAK = False
AUDIT_RISK_SCORE = 0.0

# -- document ids and names ----------------------------------------------------
REPORT_ID_PREFIX = "LAB-"
REQUEST_ID_PREFIX = "REQ-"
ATTACHMENT_FOLDER = "lab_reports"
AUDIO_EXTENSIONS = (".wav", ".mp3", ".ogg", ".webm", ".m4a")

# -- time formats ----------------------------------------------------------------
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SECONDS = "yyyy-MM-dd HH:mm:ss"
CALENDAR_DATE = "yyyy-MM-dd"
FILE_STAMP = "yyyyMMdd_HHmmss"
DISPLAY_DATE = "MMM d, yyyy"
DISPLAY_TIME = "hh:mm a"

# -- transcript lines ---------------------------------------------------------------
DOCTOR_LABEL = "Doctor"
PATIENT_LABEL = "Patient"
ENGLISH = "en-IN"
HINDI = "hi-IN"
KANNADA = "kn-IN"

# Every character that counts as white space in Unicode text.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# -- display defaults ------------------------------------------------------------------
DASHBOARD_DEFAULTS = {
    "timestamp": "N/A",
    "patient_id": "N/A",
    "raw_transcript": "No transcript",
    "status": "unknown",
    "diagnosis": "Pending",
}
PHARMACY_DEFAULTS = {
    "medication": "Unknown Medication",
    "dosage": "Check with doctor",
    "diagnosis": "General Consult",
}
TIMELINE_DEFAULTS = {
    "diagnosis": "Not specified.",
    "medication": "None",
    "dosage": "N/A",
}
DISPENSED_LABEL = "Dispensed"
NOT_DISPENSED_LABEL = "Pending Pharmacy"

# -- patient history ----------------------------------------------------------------------
HISTORY_DATE_DEFAULT = "Unknown"
HISTORY_TEXT_DEFAULT = "N/A"
HISTORY_VISITS = 3
NO_HISTORY = "No previous records found."
MIN_CONVERSATION_CHARS = 10

# -- extracted drafts -----------------------------------------------------------------------
DRAFT_KEYS = ("symptoms", "diagnosis", "medication", "dosage", "lab_tests")
DRAFT_TEXT_DEFAULTS = {
    "diagnosis": "General consultation",
    "medication": "Paracetamol 500mg",
    "dosage": "1 tablet twice daily after food for 3 days",
}
EMPTY_DRAFT = {"diagnosis": "Pending", "medication": "None", "dosage": "None"}
PENDING_TEST_SUFFIX = " - Pending Laboratory"

# -- laboratory analyses ------------------------------------------------------------------------
ANALYSIS_KEYS = ("summary", "risk_level", "recommendation")
ANALYSIS_UNAVAILABLE = ("AI analysis unavailable", "Unknown", "N/A")
ANALYSIS_NOT_CONFIGURED = ("AI Gemini is not configured.", "Unknown", "Consult doctor.")
RISK_LEVELS = "Low/Medium/High"
# A backslash and the letter n: two characters, no line break.
LAB_LINE_SEPARATOR = "\\n"

# -- model calls ------------------------------------------------------------------------------------
RATE_LIMIT_MARKS = ("429", "RESOURCE_EXHAUSTED")
TRIES_PER_MODEL = 2
RATE_LIMIT_WAIT_SECONDS = 10

# -- goods-receipt keyword rule ---------------------------------------------------------------------
RISK_WORDS = ("crushed", "missing")
RISK_SCORE_HIT = 0.9
RISK_SCORE_MISS = 0.1
