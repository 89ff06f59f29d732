"""Schemas of the relations, as DDL."""

DOCUMENTS = (
    "doc_id string, file_path string, file_hash string, file_size long, page_count int, indexed_at string, last_modified string, "
    "cached_size long, cached_mtime string, object_code string, discipline_code string, document_type_code string, unmatched_flag int"
)
PAGES = "doc_id string, page_number int, text string, normalized_text string, tokens array<string>, dl int"
REFERENCE = "code string, description string"
ALIAS = "alias string, code string, lang string"
SCAN_STATE = "scan_id long, phase string, status string, started_at timestamp, completed_at timestamp, total_files long, processed_files long, current_file string, errors long"
MODULE = "module_name string, version string, api_version string, status string, scan_phase string, description string, managed_tables string, data_version int, error_message string, initialized_at string"
WORD_BOXES = (
    "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double, original string, normalized string, "
    "block_no int, line_no int, word_no int, page_width double, page_height double"
)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Version of these schemas and what earlier ones lacked: (version, column, type, default).
VERSION = 6
MIGRATIONS = ((3, "cached_size", "long", None), (3, "cached_mtime", "string", None), (4, "object_code", "string", None), (4, "discipline_code", "string", None), (4, "document_type_code", "string", None), (5, "unmatched_flag", "int", 0))
