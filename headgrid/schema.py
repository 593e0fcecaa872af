"""Tables, their columns, rules and seed rows."""

from __future__ import annotations

from pyspark.sql import types as T

# Column types per table (fixed values). `!` marks columns that must not be NULL.
_COLUMNS = {
    "costcenters": "id string!, code string!, name string!, level short!, parent_id string, is_active boolean!, created_at timestamp!, updated_at timestamp!",
    "employee_groups": "id string!, code string!, label string!, sort_order short!, is_active boolean!",
    "classification_types": "id string!, code string!, label string!, sort_order short!, is_active boolean!",
    "users": "id string!, email string!, display_name string!, is_active boolean!, created_at timestamp!, updated_at timestamp!",
    "system_config": "key string!, value string!, description string, updated_at timestamp!, updated_by string",
    "employees": "id string!, employee_id string!, created_at timestamp!",
    "planning_containers": "id string!, empl_plan_no string!, costcenter_id string!, label string!, notes string, is_active boolean!, created_by string!, created_at timestamp!, updated_at timestamp!",
    "import_runs": "id string!, period_year short!, period_month short!, status string!, row_count int, source_file string, imported_by string!, imported_at timestamp!",
    "employee_actuals": "id string!, import_run_id string!, employee_id string!, first_name string!, last_name string!, costcenter_id string!, classification_id string, employee_group_id string, job_description string, fte decimal(6,4)!, created_at timestamp!",
    "forecast_versions": "id string!, label string!, status string!, period_year short!, period_month short!, fc_horizon_months short!, source_version_id string, archived_at timestamp, archived_by string, created_by string!, created_at timestamp!",
    "forecast_entries": "id string!, version_id string!, employee_id string, container_id string, first_name string!, last_name string!, costcenter_id string!, classification_id string, employee_group_id string, job_description string, fte decimal(6,4)!, valid_from date!, valid_to date, is_deleted boolean!, deleted_at timestamp, deleted_by string, created_by string!, created_at timestamp!",
    "forecast_entry_audit": "id string!, forecast_entry_id string!, version_id string!, action string!, changed_fields map<string,struct<old:string,new:string>>, changed_by string!, changed_at timestamp!, client_ip string, user_agent string",
}


def _split(columns: str) -> list[tuple[str, str, bool]]:
    parts = [c.split(" ") for c in columns.split(", ")]
    return [(name, kind.rstrip("!"), kind.endswith("!")) for name, kind in parts]


_TYPES = {
    "string": T.StringType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal(6,4)": T.DecimalType(6, 4),
    "map<string,struct<old:string,new:string>>": T.MapType(
        T.StringType(), T.StructType().add("old", T.StringType()).add("new", T.StringType())
    ),
}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind, _ in _split(columns)])


TABLES: dict[str, T.StructType] = {name: _struct(columns) for name, columns in _COLUMNS.items()}
NOT_NULL: dict[str, list[str]] = {name: [n for n, _, need in _split(c) if need] for name, c in _COLUMNS.items()}

# Tables that grow with time are partitioned by the column every query filters on.
PARTITION_BY = {
    "employee_actuals": ["import_run_id"],
    "forecast_entries": ["version_id"],
    "forecast_entry_audit": ["version_id"],
}

# One row of an import file.
IMPORT_ROW = _struct(
    "employee_id string, first_name string, last_name string, costcenter_id string, classification_id string, "
    "employee_group_id string, job_description string, fte decimal(6,4)"
)

# Unique keys beside the primary keys (fixed values).
UNIQUE_KEYS = {
    "costcenters": [["code"]],
    "employee_groups": [["code"]],
    "classification_types": [["code"]],
    "users": [["email"]],
    "employees": [["employee_id"]],
    "planning_containers": [["empl_plan_no"]],
    "import_runs": [["period_year", "period_month"]],
    "employee_actuals": [["import_run_id", "employee_id"]],
}
PRIMARY_KEY = {name: ("key" if name == "system_config" else "id") for name in TABLES}

# Row rules (fixed values): the condition must not be false.
CHECKS = {
    "costcenters": {"level_range": "level between 1 and 10"},
    "import_runs": {
        "month_range": "period_month between 1 and 12",
        "year_range": "period_year between 2000 and 2100",
        "run_status": "status in ('completed', 'failed', 'partial')",
    },
    "employee_actuals": {"actual_fte_range": "fte > 0 and fte <= 10"},
    "forecast_versions": {
        "version_status": "status in ('working', 'archived')",
        "month_range": "period_month between 1 and 12",
        "year_range": "period_year between 2000 and 2100",
        "horizon_range": "fc_horizon_months between 1 and 60",
        "archive_fields": "(status = 'archived') = (archived_at is not null) and (archived_at is null) = (archived_by is null)",
    },
    "forecast_entries": {
        "one_subject": "(employee_id is null) <> (container_id is null)",
        "end_after_start": "valid_to is null or valid_to > valid_from",
        "start_on_first": "dayofmonth(valid_from) = 1",
        "delete_fields": "is_deleted = (deleted_at is not null) and is_deleted = (deleted_by is not null)",
    },
    "forecast_entry_audit": {"audit_action": "action in ('INSERT', 'UPDATE', 'DELETE', 'RESTORE')"},
}

# Longest text per column (fixed values).
TEXT_LIMITS = {
    "costcenters": {"code": 50, "name": 255},
    "employee_groups": {"code": 50, "label": 255},
    "classification_types": {"code": 50, "label": 255},
    "users": {"email": 255, "display_name": 255},
    "system_config": {"key": 100},
    "employees": {"employee_id": 50},
    "planning_containers": {"empl_plan_no": 50, "label": 255},
    "import_runs": {"status": 50, "source_file": 500},
    "employee_actuals": {"first_name": 255, "last_name": 255, "job_description": 500},
    "forecast_versions": {"label": 255, "status": 20},
    "forecast_entries": {"first_name": 255, "last_name": 255, "job_description": 500},
    "forecast_entry_audit": {"action": 20, "client_ip": 45},
}

# Child table, column, parent table (fixed values). The parent column is the primary key.
FOREIGN_KEYS = [
    ("costcenters", "parent_id", "costcenters"),
    ("system_config", "updated_by", "users"),
    ("planning_containers", "costcenter_id", "costcenters"),
    ("planning_containers", "created_by", "users"),
    ("import_runs", "imported_by", "users"),
    ("employee_actuals", "import_run_id", "import_runs"),
    ("employee_actuals", "employee_id", "employees"),
    ("employee_actuals", "costcenter_id", "costcenters"),
    ("employee_actuals", "classification_id", "classification_types"),
    ("employee_actuals", "employee_group_id", "employee_groups"),
    ("forecast_versions", "source_version_id", "forecast_versions"),
    ("forecast_versions", "archived_by", "users"),
    ("forecast_versions", "created_by", "users"),
    ("forecast_entries", "version_id", "forecast_versions"),
    ("forecast_entries", "employee_id", "employees"),
    ("forecast_entries", "container_id", "planning_containers"),
    ("forecast_entries", "costcenter_id", "costcenters"),
    ("forecast_entries", "classification_id", "classification_types"),
    ("forecast_entries", "employee_group_id", "employee_groups"),
    ("forecast_entries", "deleted_by", "users"),
    ("forecast_entries", "created_by", "users"),
    ("forecast_entry_audit", "forecast_entry_id", "forecast_entries"),
    ("forecast_entry_audit", "version_id", "forecast_versions"),
    ("forecast_entry_audit", "changed_by", "users"),
]

# Seed rows (fixed values): code, label, sort order; and key, value, description.
SEED_CLASSIFICATIONS = [("direct", "Direct", 1), ("indirect", "Indirect", 2), ("overhead", "Overhead", 3), ("contractor", "Contractor", 4)]
SEED_GROUPS = [("EG_EXEC", "Executive", 1), ("EG_MGR", "Manager", 2), ("EG_ENG", "Engineer", 3), ("EG_SUPPORT", "Support", 4), ("EG_OPS", "Operator", 5)]
SEED_CONFIG = [
    ("fc_horizon_months", "18", "How many months forward the rolling forecast extends. Integer. Can be changed at runtime via UPDATE."),
    ("fc_lock_day", "1", "Day of month (1–28) on which the working forecast is archived and a new one is opened. Integer."),
    ("import_source_label", "SAP HCM Export", "Cosmetic label for the SAP import source displayed in the UI. String."),
]
