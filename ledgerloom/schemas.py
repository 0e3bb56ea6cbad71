"""Table schemas of the work-item, page, span and evaluation data."""

from __future__ import annotations

CITATION = "struct<source_type: string, source_id: string, url: string, excerpt: string>"
FINDING = f"struct<rule_ordinal: int, rule_id: string, level: string, detail: string, citations: array<{CITATION}>>"
COMMENT = "struct<id: string, body: string, author_id: string, created_at: timestamp>"
CHANGE = "struct<field: string, from_value: string, to_value: string, at: timestamp, author_id: string>"
LINK = "struct<target_key: string, target_summary: string, target_status_category: string, link_type: string, target_blocks_this: boolean>"
ISSUE = (
    "key string, project_key string, summary string, status_name string, status_category string, assignee_id string, "
    "story_points double, sprint_name string, target_release string, created_at timestamp, updated_at timestamp, due_date timestamp, "
    f"comments array<{COMMENT}>, changelog array<{CHANGE}>, links array<{LINK}>"
)
SPAN = "trace_id string, span_id string, parent_id string, name string, kind string, started_at timestamp, ended_at timestamp, input_tokens long, output_tokens long, model string, error string"
CHUNK = "chunk_id string, page_id string, page_title string, page_url string, heading_path array<string>, text string, end_heading string, space_key string, labels array<string>"
SECTION = "page_id string, ordinal int, heading string, level int, text string"
GAP = "reason string, scope string, detail string, at timestamp"

LEVELS = ("high", "medium", "low")
