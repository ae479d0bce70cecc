"""Schemas of the files that are read, as DDL. Nothing is inferred."""

from __future__ import annotations

# Column names of the channel files, and their names here.
VIDEO_COLUMNS = {
    "Index": "index",
    "Title": "title",
    "URL": "url",
    "Uploader": "uploader",
    "Views": "views",
    "Upload Date": "upload_date",
    "Duration (sec)": "duration_sec",
    "Description": "description",
    "Transcript": "transcript",
}

RAW_VIDEO = (
    "index int, video_id string, webpage_url string, title string, uploader string, "
    "view_count string, upload_date string, duration string, description string"
)

SEGMENTS = "array<struct<start string, text string, voice int>>"
SPEAKERS = (
    "array<struct<voice int, name string, company string, position string, "
    "role_in_video string>>"
)
TRANSCRIPTION = f"task1_transcripts {SEGMENTS}, task2_speakers {SPEAKERS}"

TURN_COLUMNS = ["start_time", "speaker_label", "transcript"]

MESSAGES = "array<struct<role string, content string>>"

JUDGE_CASE = (
    "case_id string, scenario_context string, profile string, ground_truth string, "
    "model_outputs map<string, struct<target_conversation string, "
    "conversation_transcript string>>"
)

GENERATED_TURNS = "array<struct<turn_index int, police string, civilian_generated string>>"
