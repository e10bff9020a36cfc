from failcast.sources.standins import (  # noqa: F401
    EVENT_METRICS, EVENTS_SPEC, device_day, event_fault_tags, load_table,
)
from failcast.scratch import materialize, shared_dir  # noqa: F401
from failcast.sources.telemetry import (  # noqa: F401
    count_rejected_days, read_faults, read_features, read_telemetry, write_alerts,
    write_daily_csv, write_features, write_importance,
)
