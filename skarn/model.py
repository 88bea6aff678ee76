"""Constants and schemas of the data model."""

from __future__ import annotations

#: Fixed values.
CHUNK_LINES, CHUNK_BYTES, CHUNK_OVERLAP = 160, 8192, 20
MAX_FILE_BYTES = 4 << 20
LANE_K, FAMILY_K = 60, 10
EXTRACTOR_WEIGHT, GRAPH_WEIGHT, EDGE_WEIGHT = 0.5, 0.20, 0.6
GRAPH_SEEDS, PATH_TERMS, ANCHORS, OVERFLOW = 20, 6, 4, 20
EXCERPT_MAX, EXCERPT_MIN, EXCERPT_SHARED = 280, 120, 2400
MAX_RESULTS, MAX_QUERY_BYTES, MAX_QUERY_TERMS = 100, 16_384, 256
COLUMN_WEIGHTS = {"path": 8.0, "title": 4.0, "text": 1.0}
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
MAX_RECORDS, MAX_RECORD_TEXT, MAX_METADATA = 257, 64 << 10, 16 << 10
SECRET_EXTENSIONS = ["key", "pem", "crt", "cer", "cert"]

RECORD = "path string, start_line int, end_line int, kind string, title string, text string, metadata string, source string, ordinal int"
EDGE = "source_path string, relation string, target string, target_path string, record_id long"
LANE = "lane_id int, lane string, rank int, record_id long, path string, start_line int, kind string"
