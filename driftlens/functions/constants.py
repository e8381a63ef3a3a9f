"""Thresholds, key names and word lists that results depend on."""

# Stability bands, and the floor under every share.
PSI_STABLE = 0.10
PSI_WATCH = 0.25
PSI_FLOOR = 0.001

# Profile shape.
TOP_VALUES = 20
QUANTILE_PERCENTS = (1, 25, 50, 75, 99)
NULL_KEY = "__null__"
BASELINE_SYNCS = 7
RISK_SYNCS = 15
LISTING_SYNCS = 10

# Loader bookkeeping columns that are never profiled, and the soft-delete flag among them.
LOADER_COLUMNS = (
    "_fivetran_synced",
    "_fivetran_deleted",
    "_fivetran_id",
    "_fivetran_start",
    "_fivetran_end",
    "_fivetran_active",
)
DELETED_FLAG = "_fivetran_deleted"

# Drift limits.
NUMERIC_Z_LIMIT = 3.0
NUMERIC_SCORE_CAP = 2.0
ROW_COUNT_Z_LIMIT = 3.0
NULL_SHIFT_REPORTED = 0.05
NULL_SHIFT_ANOMALOUS = 0.10

# Monitoring.
STALE_AFTER_SECONDS = 21_600
DRIFT_LOG_SIZE = 200
ACTIVITY_LOG_SIZE = 100
ACTIVITY_PAGE = 50
MANUAL_DETECTION_SECONDS = 11_520.0

# Sync events.
SYNC_END = "sync_end"
DEFAULT_SCHEMA = "hubspot"
DEFAULT_TABLE = "deal_pipeline_stage"

# Drift classes and incident states.
SILENT_SEMANTIC_FAILURE = "SILENT_SEMANTIC_FAILURE"
UPSTREAM_DATA_QUALITY = "UPSTREAM_DATA_QUALITY"
BENIGN_GROWTH = "BENIGN_GROWTH"
NORMAL_SEASONAL = "NORMAL_SEASONAL"
PENDING = "pending"
QUARANTINED = "quarantined"
DISMISSED = "dismissed"
REENABLED = "reenabled"
