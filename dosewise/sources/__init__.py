from dosewise.sources.tables import (
    code_list_filter,
    export_csv,
    persist_stage,
    scan_csv,
    scan_table,
)

__all__ = ["code_list_filter", "export_csv", "persist_stage", "scan_csv", "scan_table"]
