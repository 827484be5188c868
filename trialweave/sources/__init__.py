"""Reading trial logs and lookups, writing results."""

from .logs import headers, read_intermediate, read_log, read_logs, read_lookup, read_mixed, union_logs
from .sinks import pseudonymise, write_csv, write_numbered_csv, write_table
from .work import checkpointed, work_folder
