"""Closed vocabularies and table layouts."""

from __future__ import annotations

# Result statuses, the checks and who does them, data classes, path and file rules.
STATUSES = ["PASS", "ACCEPTED", "ACCEPTED_ALTERNATIVE", "WARNING", "UNCERTAINTY", "ERROR", "BLOCK"]
BLOCKING = ["ERROR", "BLOCK"]
CHECKS = [
    ("inspection", "inspection-agent", "inspection-audit", "Structure inspection evidence and facts."),
    ("report", "report-audit-agent", "report-review", "Audit the report against the ТЗ and source evidence."),
    ("normative", "normative-agent", "normative-check", "Verify applicability and traceability of normative requirements."),
    ("calculation", "calculation-agent", "calculation-review", "Verify calculation model, inputs, solver output and interpretation."),
    ("final_audit", "final-audit-agent", "final-audit", "Perform the final evidence, consistency and status audit."),
]
FINAL_CHECK = "final_audit"
DATA_CLASSES = ["PROJECT", "ACTUAL", "MEASURED", "TESTED", "CALCULATED", "ASSUMED", "INTERPRETED", "UNKNOWN"]
SOFT_CLASSES = ["ASSUMED", "INTERPRETED", "UNKNOWN"]
RESULT_KEYS = ["evidence_ids", "findings", "message", "status"]
SECRET_NAME, ENV_PREFIX, ENV_EXAMPLE = ".env", ".env.", ".env.example"
SECRET_PARTS = ["client_secret", "credentials.json", "token.json", "refresh_token", "service-account"]
KEY_NAMES = [".npmrc", ".pypirc", ".netrc"]
KEY_SUFFIXES = [".pem", ".key", ".p12", ".pfx"]
KEY_PREFIXES = ["id_rsa", "id_ed25519"]
BINARY_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".lir", ".zip"]
CONFLICT_TOKENS = ["<<<<<<< ", "=======", ">>>>>>> "]
# What rejected tasks, results and files are told.
TASK_REASONS = ["task_id is required", "ТЗ is required", "At least one material is required", "At least one requested check is required"]
UNKNOWN_CHECK = "Unknown requested check: "
UNPLANNED_AGENT = "Result from unplanned agent: "
OTHER_TASK = "Result task_id does not match core task"
WRONG_OWNER = "Runtime handler returned a result for the wrong task or agent"
NO_HANDLER = "No runtime handler registered for "
NOT_JSON = "Output is not JSON."
NOT_OBJECT = "Result must be a JSON object."
BAD_STATUS = "Result has an invalid status."
BAD_FINDINGS = "findings must be a JSON array of objects."
BAD_EVIDENCE = "evidence_ids must be a JSON array of strings."
BAD_MESSAGE = "message must be a string or null."
NO_THREAD, NO_TURN, FAILED_TURN, INTERRUPTED_TURN, LATE_TURN = "No thread id.", "No turn id.", "Turn failed.", "Turn was interrupted.", "Turn did not complete in time."
SECRET_FILE, ENV_FILE, CREDENTIAL_PATH, KEY_FILE = "tracked secret-like file", "tracked environment file", "tracked credential-like path", "tracked private credential/key file"
MERGE_MARKERS, FILE_MISSING, OWNER_MISSING = "unresolved merge markers", "required file missing", "required owner missing"

REGISTRY = "check string, agent string, skill string, purpose string"
TASKS = "task_id string, project_id long, tz string, requested_checks array<string>, created_at timestamp"
MATERIALS = "task_id string, pos int, id string, kind string, name string, uri string"
PLANNED = "task_id string, plan_pos int, agent string, skill string, purpose string, tz string"
RESULTS = "task_id string, pos int, agent string, status string, findings array<string>, evidence_ids array<string>, message string"
RAW_OUTPUTS = "task_id string, agent string, raw_text string, thread_id string, turn_id string"
MESSAGES = "connection string, seq long, ts timestamp, method string, thread_id string, turn_id string, delta string, item_type string, item_text string, turn_status string, turn_error string"

TURN_TIMEOUT_S = 900
#: How long a stream remembers that a turn has ended, since its last message.
TURN_HORIZON_S = 86_400
LEASE_MINUTES = 10
COOLDOWN_S = 60
COUNT_CAP = 1000
LATEST = {"runs": 20, "jobs": 50, "executions": 50, "recoveries": 10, "audit": 50, "list": 100, "dashboard": 5}
PREVIEW = 8
