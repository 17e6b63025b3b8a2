"""Typed tables of the catalogue.  Times are UTC timestamps, vectors arrays, nested values structs."""

from __future__ import annotations

from pyspark.sql.types import StructType

# The catalogue's tables with their columns, and below the values that columns may have.
_DDL = {
    "root_folder": "id string, path string, drive_id string, is_online boolean, managed_by_other_app boolean, naming_template string",
    "media_item": "id string, root_id string, source_ref string, media_type string, created_at timestamp, date_uncertain boolean, gps_lat double, gps_lng double, place_name string, width int, height int, duration_ms long, orientation int, content_hash string, perceptual_hash string, thumb_path string, preview_path string, analysis_status string, video_proxy_path string",
    "face": "id string, media_id string, bbox array<double>, embedding array<float>, quality double, eyes_open boolean, cluster_id string",
    "person": "id string, cluster_id string, display_name string, cover_face_id string, is_favorite boolean, confirmed boolean, merged_into string, person_key string",
    "face_feedback": "id string, face_id string, person_id string, verdict string, created_at timestamp",
    "cluster_merge_log": "id string, from_cluster string, into_cluster string, created_at timestamp",
    "quality_score": "media_id string, sharpness double, exposure double, composition double, eyes_open double, composite double",
    "scene_label": "media_id string, label string, confidence double",
    "duplicate_group": "id string, created_at timestamp",
    "duplicate_member": "group_id string, media_id string, is_representative boolean",
    "job": "id string, kind string, status string, progress int, total int, resumable boolean, created_at timestamp, updated_at timestamp, error string",
    "restructure_plan": "id string, job_id string, status string, target_root string, space_required long",
    "restructure_item": "plan_id string, media_id string, from_path string, to_path string, same_drive boolean, checksum string, state string, error string",
    "operation_journal": "id string, ref_type string, ref_id string, op string, from_path string, to_path string, executed_at timestamp, reversible boolean, undo_ref string",
    "story": "id string, title string, kind string, start_at timestamp, end_at timestamp, place_name string, cover_media_id string",
    "story_item": "story_id string, media_id string, ord int, role string",
    "timeline": "id string, story_id string, generated_at timestamp, music_track_id string, config struct<base_ms:int,transition:string,transition_ms:int,ken_burns:boolean>",
    "timeline_clip": "timeline_id string, media_id string, ord int, start_ms long, duration_ms long, kb_start array<double>, kb_end array<double>, transition_in string",
    "music_track": "id string, source string, title string, path string, bpm double",
    "app_settings": "key string, value string",
    "device": "id string, name string, token string, created_at timestamp, last_seen timestamp, revoked boolean",
}

#: The columns that tell a table's rows apart; a later row replaces an earlier one with the same key.
KEYS: dict[str, tuple[str, ...]] = {name: ("id",) for name in _DDL} | {
    "quality_score": ("media_id",), "scene_label": ("media_id", "label"), "duplicate_member": ("group_id", "media_id"), "restructure_item": ("plan_id", "media_id"),
    "story_item": ("story_id", "media_id"), "timeline_clip": ("timeline_id", "ord"), "app_settings": ("key",),
}

#: Values a column may have.
ALLOWED: dict[tuple[str, str], tuple[str, ...]] = {
    ("media_item", "media_type"): ("photo", "video"),
    ("media_item", "analysis_status"): ("pending", "partial", "done", "failed"),
    ("face_feedback", "verdict"): ("confirm", "reject"),
    ("job", "kind"): ("index", "analyze", "dedup", "restructure", "proxy"),
    ("job", "status"): ("queued", "running", "paused", "done", "failed"),
    ("restructure_plan", "status"): ("preview", "approved", "running", "done", "reverted", "failed"),
    ("restructure_item", "state"): ("pending", "renamed", "copied", "verified", "source_trashed", "done", "failed"),
    ("operation_journal", "op"): ("move", "trash", "restructure"),
    ("story", "kind"): ("event", "person", "period", "theme"),
    ("story_item", "role"): ("hero", "support"),
    ("timeline_clip", "transition_in"): ("none", "crossfade", "fade-black", "slide"),
}

#: Tables added by each version of the schema, in order.
VERSIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("0001", tuple(n for n in _DDL if n not in ("face_feedback", "cluster_merge_log", "device"))),
    ("0002", ("face_feedback", "cluster_merge_log", "device")),
)


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])


def tables() -> list[str]:
    return list(_DDL)
