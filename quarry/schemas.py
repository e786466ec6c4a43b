"""Declared schemas of the tables the jobs exchange."""

from __future__ import annotations

FILES = (
    "path string, name string, extension string, size bigint, mtime timestamp, is_placeholder boolean"
)
FILE_BYTES = FILES + ", content binary, error_type string"
ENTRIES = (
    "text string, entry_type string, source string, file_path string, file_name string, folder string, "
    "chunk_index int, content_hash string, extra_metadata map<string,string>"
)
CONTENT = "content_hash string, embedding array<float>, first_line string, size_bytes bigint, indexed_at timestamp"
PATHS = (
    "path string, content_hash string, file_name string, extension string, source string, folder string, "
    "sync_status string, mtime timestamp, last_verified timestamp"
)
CHUNKS = "content_hash string, chunk_index int, text string, embedding array<float>"
CHANGES = "root string, seq bigint, ts timestamp, path string, old_path string, change_type string"
PHOTOS = (
    "file_path string, file_name string, keywords array<string>, persons array<string>, location string, "
    "date timestamp, uuid string, is_favorite boolean, is_hidden boolean, album_names array<string>"
)
CHATS = "id bigint, title string, status string, created_at timestamp, updated_at timestamp"
MESSAGES = "id bigint, chat_id bigint, role string, content string, created_at timestamp"
EXAMPLES = "input string, output string, source string, layer int"
QA_NESTED = (
    "data array<struct<title:string, paragraphs:array<struct<context:string, qas:array<struct<id:string, "
    "question:string, answers:array<struct<text:string>>, is_impossible:boolean>>>>>>"
)
TOKENS = "chat_id bigint, reply_id bigint, seq bigint, kind string, token string"
INDEX_ROWS = (
    "row_id string, type string, source string, file_path string, file_name string, folder string, "
    "chunk_index int, content_hash string, text string, embedding array<float>"
)
