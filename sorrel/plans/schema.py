"""Schemas of the property graph, its side tables and the captured facts, as Spark DDL."""

POSITION = "struct<line: bigint, character: bigint>"
RANGE = f"struct<start: {POSITION}, end: {POSITION}>"

NODES = (
    "id bigint, fqn string, uri string, name string, language string, kind bigint, node_kind string, construct string, container_id bigint, "
    "range_start_line bigint, range_start_col bigint, range_end_line bigint, range_end_col bigint, sel_start_line bigint, sel_start_col bigint, "
    "sel_end_line bigint, sel_end_col bigint, signature string, documentation string, detail string, signature_hash string, valid boolean, "
    "orphan boolean, generation bigint, is_external boolean"
)
EDGES = (
    "id bigint, src_id bigint, dst_id bigint, edge_type string, site_uri string, site_start_line bigint, site_start_col bigint, "
    "site_end_line bigint, site_end_col bigint, valid boolean"
)
EDGE_TYPES = ("contains", "calls", "references", "type_of", "implements", "defines", "inherits", "imports")
CALLEES_CACHE = "anchor_id bigint, content_hash string"
MATERIALIZED = "anchor_id bigint, edge_type string"
META = "key string, value string"
FILES = "uri string, text string"
DOCUMENT_SYMBOLS = "uri string, symbols string"
LOCATIONS = "op string, uri string, line bigint, character bigint, target_uri string, target_line bigint, target_character bigint, rank bigint"
CALLS = (
    "direction string, anchor_uri string, anchor_line bigint, anchor_character bigint, item_uri string, item_line bigint, item_character bigint, "
    f"item_rank bigint, from_ranges array<{RANGE}>"
)
HOVER = "uri string, line bigint, character bigint, contents string"
FLAT_SYMBOL = "uri string, pos bigint, parent_pos bigint, fqn string, name string, kind bigint, detail string, range_start_line bigint, range_start_col bigint, range_end_line bigint, range_end_col bigint, sel_start_line bigint, sel_start_col bigint, sel_end_line bigint, sel_end_col bigint"

#: A module root spans its file: this line and column stand for the end.
END = 9223372036854775807
#: The end as results show it.
MAX_SHOWN = 4294967295

SORT_KEY = ["fqn", "uri", "range_start_line", "range_start_col"]
EDGE_KEY = ["src_id", "dst_id", "edge_type", "site_uri", "site_start_line", "site_start_col"]
