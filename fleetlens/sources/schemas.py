"""Schemas of the landed telemetry tables, as DDL.

Every table also carries ``server`` and ``snapshot_ts`` (see :func:`schema_of`).
"""

from __future__ import annotations

from pyspark.sql import types as T

KEYS_DDL = "server string, snapshot_ts timestamp"

SCHEMAS = {
    "file_io": """database_id smallint, file_id smallint, sample_ms int, num_of_reads bigint,
        num_of_bytes_read bigint, io_stall_read_ms bigint, num_of_writes bigint,
        num_of_bytes_written bigint, io_stall_write_ms bigint, io_stall bigint,
        size_on_disk_bytes bigint, file_handle binary""",
    "master_files": """database_id smallint, file_id smallint, name string, physical_name string,
        type int, type_desc string, size int, growth int, is_percent_growth boolean, max_size int""",
    "databases": """database_id smallint, name string, state_desc string, user_access_desc string,
        is_read_only boolean, is_in_standby boolean, recovery_model_desc string,
        is_encrypted boolean""",
    "wait_stats": """wait_type string, waiting_tasks_count bigint, wait_time_ms bigint,
        max_wait_time_ms bigint, signal_wait_time_ms bigint""",
    "perf_counters": """collected_time timestamp, object_name string, counter_name string,
        instance_name string, cntr_value bigint, cntr_type int""",
    "file_space": """db_name string, file_name string, type int, type_desc string, size bigint,
        space_used bigint, physical_name string""",
    "file_growth": """database_name string, file_id int, name string, physical_name string,
        type_desc string, state_desc string, is_percent_growth boolean, growth int, size int,
        max_size bigint, data_space_id int""",
    "filegroups": "database_name string, data_space_id int, name string, type_desc string, "
    "is_read_only boolean",
    "trace_events": """database_id int, database_name string, file_name string, event_class int,
        integer_data int, start_time timestamp, duration bigint""",
    "buffer_pages": "database_id int, allocation_unit_id bigint, is_modified boolean",
    "cached_plans": """objtype string, cacheobjtype string, usecounts int, refcounts int,
        size_in_bytes int""",
    "query_stats": """query_hash binary, query_plan_hash binary, sql_handle binary,
        plan_handle binary, creation_time timestamp, last_execution_time timestamp,
        execution_count bigint, total_worker_time bigint, max_worker_time bigint,
        max_grant_kb bigint, max_used_grant_kb bigint, total_spills bigint,
        statement_start_offset int, statement_end_offset int""",
    "missing_index_query": """query_hash binary, query_plan_hash binary, last_sql_handle binary,
        last_user_seek timestamp, last_user_scan timestamp""",
    "qs_runtime": """plan_id bigint, first_execution_time timestamp, last_execution_time timestamp,
        count_executions bigint, avg_duration double, avg_cpu_time double""",
    "qs_plan": """plan_id bigint, query_id bigint, query_plan string, query_plan_hash binary,
        is_online_index_plan boolean""",
    "qs_query": """query_id bigint, query_text_id bigint, query_hash binary, object_name string,
        is_internal_query boolean""",
    "qs_text": "query_text_id bigint, query_sql_text string",
    "tuning_recs": "reason string, score int, details string",
    "requests": """session_id int, command string, start_time timestamp, percent_complete double,
        estimated_completion_time bigint, sql_handle binary""",
    "seeding": """local_database_name string, remote_machine_name string, role_desc string,
        transfer_rate_bytes_per_second bigint, transferred_size_bytes bigint,
        database_size_bytes bigint, start_time_utc timestamp, estimate_time_complete_utc timestamp,
        total_disk_io_wait_time_ms bigint, total_network_wait_time_ms bigint,
        is_compression_enabled boolean""",
    "xml_events": "session string, target string, target_data string",
    "event_files": "file_name string, object_name string, event_data string",
    "dbinfo_eav": """database_name string, parent_object string, object string, field string,
        value string""",
    "command_log": """id int, database_name string, schema_name string, object_name string,
        object_type string, index_name string, index_type smallint, statistics_name string,
        partition_number int, extended_info string, command string, command_type string,
        start_time timestamp, end_time timestamp, error_number int, error_message string""",
    "compression_estimates": """object_name string, schema_name string, index_id int,
        partition_number int, size_with_current_kb bigint, size_with_requested_kb bigint,
        sample_size_with_current_kb bigint, sample_size_with_requested_kb bigint""",
    "backupset": """database_name string, type string, backup_start_date timestamp,
        last_lsn decimal(25,0), checkpoint_lsn decimal(25,0), is_damaged boolean,
        is_snapshot boolean""",
    "principals": """principal_id int, name string, type string, sid binary,
        default_schema_name string, authentication_type int, login_name string,
        is_fixed_role boolean""",
    "permissions": """class int, class_desc string, major_id int, minor_id int,
        grantee_principal_id int, state string, state_desc string, permission_name string""",
    "role_members": "role_principal_id int, member_principal_id int",
    "objects": "object_id int, schema_id int, name string, type string, is_ms_shipped boolean",
    "indexes": """object_id int, index_id int, name string, type int, type_desc string,
        allow_page_locks boolean, is_disabled boolean, is_hypothetical boolean,
        data_space_id int""",
    "partitions": """partition_id bigint, object_id int, index_id int, partition_number int,
        data_compression int, data_compression_desc string""",
    "partition_stats": """partition_id bigint, row_count bigint, used_page_count bigint,
        reserved_page_count bigint""",
    "allocation_units": "allocation_unit_id bigint, container_id bigint, type_desc string",
    "index_op_stats": """object_id int, index_id int, partition_number int,
        page_compression_attempt_count bigint, page_compression_success_count bigint""",
    "index_physical_stats": """object_id int, index_id int, partition_number int,
        alloc_unit_type_desc string, index_level int, avg_fragmentation_in_percent double,
        page_count bigint""",
    "stats_properties": """object_id int, stats_id int, partition_number int, rows bigint,
        modification_counter bigint""",
    "log_space": """total_log_size_in_bytes bigint, used_log_space_in_bytes bigint,
        used_log_space_in_percent float""",
    "backup_state": """database_name string, state_desc string, user_access_desc string,
        is_accessible boolean, is_in_standby boolean, is_read_only boolean, recovery_model string,
        availability_group string, role string, is_preferred_replica boolean,
        log_shipping_role string, differential_base_lsn decimal(25,0),
        last_log_backup_lsn decimal(25,0), allocated_extent_page_count bigint,
        modified_extent_page_count bigint, database_size bigint,
        log_since_last_log_backup_mb double, log_backup_time timestamp""",
    "jobs": "job_id string, name string",
    "job_schedules": "job_id string, schedule_id int",
    "replicas": "name string, role string, seeding_mode string, version_major int",
    "replica_databases": "replica string, database_name string, recovery_model string",
    "config_facts": "resource string, name string, value string",
    "history_tables": "table_name string, row_count bigint, data_space_used double",
    "metric_stream": """object string, counter string, instance string, value double,
        event_ts timestamp""",
    "work_items": """id int, database_name string, table_name string, index_name string,
        completed boolean""",
}


def schema_of(table: str, keyed: bool = True) -> T.StructType:
    """Schema of a landed table."""
    ddl = SCHEMAS[table]
    return T.StructType.fromDDL(f"{KEYS_DDL}, {ddl}" if keyed else ddl)
