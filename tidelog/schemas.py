"""Declared schemas of the archive's tables (Spark DDL); nothing is inferred."""

SCHEMAS = {
    "raw_payloads": "id BIGINT, captured_at TIMESTAMP, request_type STRING, status_code INT, payload_hash BINARY, body STRING, uncompressed_size BIGINT",
    "raw_page_observations": "id BIGINT, raw_payload_id BIGINT, captured_at TIMESTAMP, request_type STRING, target_type STRING, target_id STRING, page_number INT, cursor STRING, sort_mode STRING, status STRING, item_count INT, extra STRING",
    "comment_entities": "rpid BIGINT, oid BIGINT, bvid STRING, root_rpid BIGINT, parent_rpid BIGINT, author_mid BIGINT, author_name STRING, platform_created_at TIMESTAMP, first_content STRING, first_content_hash BINARY, first_seen_at TIMESTAMP, first_raw_payload_id BIGINT",
    "comment_observations": "id BIGINT, rpid BIGINT, bvid STRING, oid BIGINT, captured_at TIMESTAMP, raw_payload_id BIGINT, raw_page_observation_id BIGINT, sort_mode STRING, page_number INT, position INT, content STRING, content_hash BINARY, like_count BIGINT, reply_count BIGINT, author_mid BIGINT, author_name STRING, is_deleted BOOLEAN, visibility STRING",
    "comment_visibility_events": "rpid BIGINT, bvid STRING, previous_comment_observation_id BIGINT, current_comment_observation_id BIGINT, event_type STRING, old_visibility STRING, new_visibility STRING, created_at TIMESTAMP",
    "video_metric_snapshots": "bvid STRING, captured_at TIMESTAMP, view_count BIGINT, like_count BIGINT, coin_count BIGINT, favorite_count BIGINT, share_count BIGINT, reply_count BIGINT, danmaku_count BIGINT, raw_payload_id BIGINT",
    "video_info_snapshots": "bvid STRING, captured_at TIMESTAMP, title STRING, description STRING, owner_mid BIGINT, owner_name STRING, tags STRUCT<names:ARRAY<STRING>,source_fields:ARRAY<STRING>>, raw_payload_id BIGINT",
    "video_availability_snapshots": "bvid STRING, captured_at TIMESTAMP, status STRING, raw_payload_id BIGINT",
    "collection_coverage_stats": "id BIGINT, task_kind STRING, target_type STRING, target_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, pages_requested INT, pages_succeeded INT, items_observed INT, raw_payloads_saved BIGINT, parse_errors INT, request_errors INT, truncated BOOLEAN, corrupted BOOLEAN, reason STRING",
    "event_targets": "id BIGINT, event_id BIGINT, target_type STRING, normalized_value STRING, priority INT, active BOOLEAN, extra STRING",
    "event_videos": "event_id BIGINT, bvid STRING, source_target_id BIGINT, association_reason STRING, confidence DOUBLE, active BOOLEAN, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP",
    "event_keywords": "id BIGINT, event_id BIGINT, keyword STRING, normalized_keyword STRING, version INT, active BOOLEAN",
    "comment_analysis_flags": "stable_key STRING, event_id BIGINT, flag_type STRING, subject_rpid BIGINT, related_rpid BIGINT, confidence DOUBLE, algorithm STRING, algorithm_version STRING, evidence STRING, detected_at TIMESTAMP",
    "media_assets": "id BIGINT, blob_sha256 BINARY, mime_type STRING, size_bytes BIGINT, phash BIGINT, first_seen_at TIMESTAMP",
}
