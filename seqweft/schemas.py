"""Declared schemas of the tables; no reader infers one."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string

_DDL = {
    "protein_corpus": "assembly_id string, sequence_id string, ambiguous_residues string, functional_annotations string, raw_header string, sequence_length bigint, sequence string",
    "parse_issues": "file_path string, assembly_id string, issue_type string, issue_message string, record_identifier string",
    "bacteria_directory": "bacteria_name string, source_url string, is_dir boolean",
    "bacteria_tree": "bacteria_name string, source_url string, is_dir boolean, sub_dirs array<struct<bacteria_name:string,source_url:string,is_dir:boolean>>, status string",
    "latest_assembly_versions": "bacteria_name string, source_url string, is_dir boolean, folder_name string",
    "latest_assembly_tree": "bacteria_name string, dir_name string, source_url string, is_dir boolean, status string",
    "assembly_version_tree": "bacteria_name string, source_url string, status string, sub_dirs array<struct<dir_name:string,source_url:string,is_dir:boolean>>",
    "files_warning": "bacteria_name string, source_url string, status string, http_status int, error_code string, error_message string",
    "bacteria_links": "source_url string, text string, href string, abs_url string, name string",
    "latest_listing": "base_url string, latest_url string, ok boolean, error string, assemblies array<string>",
    "column_profile": "column string, dtype string, null_count bigint, non_null_count bigint, null_fraction double",
    "length_histogram": "sequence_length bigint, count bigint",
    "bacteria_input": "bacteria_name string, url string",
    "crawl_summary": "bacteria_name string, source_url string, latest_assembly_versions_available boolean, discovered_version_count bigint, downloaded_file_count bigint, download_completed boolean, versions array<struct<version_url:string,version_label:string>>, status string, error_message string",
    "duplicate_summary": "view_name string, duplicate_scope string, duplicate_group_count bigint, duplicate_sequence_count bigint, duplicate_rate double",
    "saved_artifact": "artifact_name string, artifact_role string, storage_format string, path string, analysis_scope string, source_view string, is_preview boolean",
    "pages": "url string, html string",
}


def ddl(name: str) -> str:
    return _DDL[name]


def schema(name: str) -> StructType:
    """Needs an active session."""
    return _parse_datatype_string(_DDL[name])
