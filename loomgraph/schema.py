"""Fixed schemas and domains of the property graph."""

from __future__ import annotations

NODES_DDL = (
    "id STRING, type STRING, name STRING, qualified_name STRING, file_path STRING, start_line INT, end_line INT, start_byte INT, end_byte INT, language STRING, visibility STRING,"
    " signature STRING, doc_comment STRING, complexity INT, in_degree INT, out_degree INT, pagerank DOUBLE, usage_score DOUBLE, confidence STRING, sub_kind STRING"
)
EDGES_DDL = "id BIGINT, src STRING, dst STRING, type STRING, file_path STRING, line INT, count INT, confidence STRING"
PENDING_DDL = "src_id STRING, edge_type STRING, target_qname STRING, hint_file STRING, line INT, file_ord BIGINT, ord BIGINT"
PKG_TREE_DDL = "parent_id STRING, child_id STRING, level INT"
TOPIC_TREE_DDL = "parent_id STRING, child_id STRING, resolution INT, topic_label STRING"
BLOBS_DDL = "node_id STRING, source BINARY"

NODE_COLS = [c.split()[0] for c in NODES_DDL.split(", ")]
EDGE_COLS = [c.split()[0] for c in EDGES_DDL.split(", ")]

# Kinds of nodes and edges, and confidence labels.
NODE_TYPES = (
    "Package File Struct Interface Class TypeAlias Enum Contract Mapping Event Function Method Modifier Constructor Constant Variable Field Parameter LocalVariable"
    " Import Export Decorator Goroutine Channel IfStmt LoopStmt CallSite ReturnStmt SwitchStmt"
).split()
EDGE_TYPES = (
    "contains defines calls invokes uses_type instantiates references reads_field writes_field imports exports implements extends has_modifier emits_event"
    " reads_mapping writes_mapping has_decorator spawns sends_to recvs_from binds_to"
).split()
CONFIDENCES = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]

#: Edges that count as calls, and edges that tie a community together.
CALL_TYPES = ["calls", "invokes"]
COMMUNITY_TYPES = ["calls", "invokes", "references", "uses_type", "implements", "extends"]
#: Nodes that hang below a file, and those that hang below a function, in the package tree.
DECLARATION_TYPES = [t for t in NODE_TYPES if t not in ("Package", "File", "Modifier", "IfStmt", "LoopStmt", "CallSite", "ReturnStmt", "SwitchStmt")]
BLOCK_TYPES = ["IfStmt", "LoopStmt", "CallSite", "ReturnStmt", "SwitchStmt"]

#: Keys of the manifest, and those whose values are JSON.
MANIFEST_KEYS = (
    "schema_version ckg_version build_timestamp src_root src_commit staleness_method staleness_files staleness_mtime_sum languages stats"
    " parse_errors_count unresolved_refs_count clustering_status ckgignore"
).split()
