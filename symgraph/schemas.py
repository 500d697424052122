"""Fixed record types of the engine."""

from __future__ import annotations

#: A symbol as a parser emits it. Its identity within a repository is (file_path, qualified_name).
CHUNK = (
    "name string, qualified_name string, type string, file_path string, language string, start_line int, end_line int, "
    "docstring string, source_code string, calls array<string>, bases array<string>"
)
CHUNK_FIELDS = [c.split()[0] for c in CHUNK.split(", ")]
CHUNK_TYPES = ("function", "method", "class", "module")
#: A typed, directed pair of symbols.
EDGE = "repo_url string, type string, src_file string, src_name string, dst_file string, dst_name string"
EDGE_TYPES = ("CALLS", "INHERITS", "HAS_METHOD")
#: A file as it was indexed.
FILE_STATE = "repo_url string, path string, sha string"
REPOSITORY = "url string, created_at bigint, last_indexed bigint, commit string, index_version int"
#: Another version of stored tables is rebuilt in full.
INDEX_VERSION = 2
