"""Schemas of the collections and records. `_pos` is a row's place in insertion order, which Spark does not keep."""

from __future__ import annotations

DOCUMENT = "_pos BIGINT, _id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
DISH = "name STRING, description STRING, price DOUBLE, category STRING, confidence DOUBLE"
#: The words of a reading as its reader tells them.
TOLD = "array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>"
WORD = "text STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, confidence DOUBLE"

COLLECTIONS: dict[str, str] = {
    "users": "_pos BIGINT, _id STRING, email STRING, name STRING, password STRING, isAdmin BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "scans": f"_pos BIGINT, _id STRING, user_id STRING, image_path STRING, raw_text STRING, items_count INT, status STRING, enriched BOOLEAN, agent_summary STRING, menu_name STRING, error STRING, dishes ARRAY<STRUCT<{DISH.replace(' ', ':').replace(',:', ',')}>>, created_at TIMESTAMP, updated_at TIMESTAMP",
    "dishes": "_pos BIGINT, _id STRING, scan_id STRING, name STRING, description STRING, price DOUBLE, category STRING, confidence DOUBLE, ai_description STRING, origin STRING, dietary_tags ARRAY<STRING>, image_url STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "agent_log": "_pos BIGINT, _id STRING, id STRING, scan_id STRING, status STRING, items_count INT, started_at TIMESTAMP, completed_at TIMESTAMP, error STRING, retries INT, max_retries INT, last_attempt_at TIMESTAMP, retry_at TIMESTAMP, dish_errors MAP<STRING,STRING>, dlq_at TIMESTAMP, dlq_reason STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "agent_log_dlq": "_pos BIGINT, _id STRING, scan_id STRING, job_id STRING, status STRING, items_count INT, error STRING, error_stack STRING, dish_names ARRAY<STRING>, dish_errors MAP<STRING,STRING>, retries INT, max_retries INT, job_created_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
    "cache": "_pos BIGINT, _id STRING, key STRING, value VARIANT",
}
