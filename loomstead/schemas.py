"""Explicit schemas: the 19 tables of the project-evidence domain, and the columns of the benchmark tables.

Nullability is advisory in Spark, so NOT NULL columns are also listed for the data-quality checks.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

#: "name type" with "!" after what must not be null.
_TABLES = {
    "users": "id string!, email string!, created_at timestamp!",
    "github_connections": "id string!, user_id string!, github_user_id int!, github_username string!, access_token_encrypted string!, scopes array<string>!, created_at timestamp!",
    "projects": "id string!, user_id string!, repo_owner string!, repo_name string!, branch string!, status string!, created_at timestamp!, last_analyzed_at timestamp",
    "project_members": "project_id string!, user_id string!, permission_tier string!, developer_role string!, joined_at timestamp!",
    "project_invitations": "id string!, project_id string!, email string!, permission_tier string!, developer_role string, invited_by string!, accepted_by string, status string!, created_at timestamp!, expires_at timestamp, accepted_at timestamp",
    "project_settings": "project_id string!, ignored_paths array<string>!, ai_enabled boolean!, default_developer_role string!, file_limit int!, loc_limit int!",
    "analysis_snapshots": "id string!, project_id string!, commit_hash string!, branch string!, file_count int!, symbol_count int!, workflow_count int!, status string!, warnings array<string>!, created_at timestamp!",
    "analysis_jobs": "id string!, project_id string!, snapshot_id string, requested_by string!, job_type string!, role string, status string!, progress_pct int!, current_step string, error_message string, created_at timestamp!, started_at timestamp, finished_at timestamp",
    "graph_nodes": "id string!, snapshot_id string!, stable_key string!, type string!, name string!, file_path string!, line_start int, line_end int, hash string!, metadata variant!",
    "graph_edges": "id string!, snapshot_id string!, source_node_id string!, target_node_id string!, type string!, metadata variant!",
    "workflows": "id string!, snapshot_id string!, title string!, trigger_type string!, purpose string!, importance_score decimal(6,3)!, confidence string!, metadata variant!",
    "workflow_steps": "id string!, workflow_id string!, step_order int!, node_id string, file_path string!, symbol_name string, line_start int, line_end int, explanation string, role_relevance map<string,string>!",
    "workflow_scores": "workflow_id string!, entrypoint_exposure decimal(6,3)!, downstream_impact decimal(6,3)!, structural_centrality decimal(6,3)!, external_side_effects decimal(6,3)!, documentation_gap decimal(6,3)!, test_coverage_signal decimal(6,3)!, git_churn_recency decimal(6,3)!, composite_score decimal(6,3)!, ranking_reasons array<string>!",
    "onboarding_packages": "id string!, snapshot_id string!, project_id string!, role string!, status string!, generated_by string!, analyzed_commit string!, created_at timestamp!, updated_at timestamp!",
    "package_sections": "id string!, package_id string!, snapshot_id string!, type string!, title string!, content string!, confidence string!, review_status string!, analyzed_commit string!, role string, generation_context variant!, created_at timestamp!, reviewed_at timestamp, reviewed_by string",
    "source_receipts": "id string!, section_id string!, node_id string, node_stable_key string, node_hash string, file_path string!, symbol_name string, line_start int, line_end int, snippet string, commit_hash string!",
    "doc_links": "id string!, snapshot_id string!, doc_path string!, linked_node_id string, linked_workflow_id string, doc_hash string!",
    "stale_flags": "id string!, snapshot_id string!, target_type string!, target_id string!, reason string!, changed_files array<string>!, created_at timestamp!",
    "role_paths": "id string!, snapshot_id string!, package_id string!, role string!, step_order int!, workflow_id string, section_id string, title string!, reason string!",
}

#: Columns of the benchmark tables.
BENCH = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

#: Unique keys; nullable members don't collide.
UNIQUE = {
    "users": [["id"], ["email"]],
    "github_connections": [["id"], ["user_id", "github_user_id"]],
    "projects": [["id"], ["user_id", "repo_owner", "repo_name", "branch"]],
    "project_members": [["project_id", "user_id"]],
    "project_invitations": [["id"]],
    "project_settings": [["project_id"]],
    "analysis_snapshots": [["id"], ["project_id", "commit_hash"]],
    "graph_nodes": [["id"], ["snapshot_id", "stable_key"]],
    "workflow_steps": [["id"], ["workflow_id", "step_order"]],
    "workflow_scores": [["workflow_id"]],
    "onboarding_packages": [["id"], ["project_id", "role", "analyzed_commit"]],
    "role_paths": [["id"], ["package_id", "step_order"]],
}

#: Foreign keys: (child, column, parent, what a delete of the parent does).
FOREIGN = [
    ("github_connections", "user_id", "users", "cascade"),
    ("projects", "user_id", "users", "cascade"),
    ("project_members", "project_id", "projects", "cascade"),
    ("project_members", "user_id", "users", "cascade"),
    ("project_invitations", "project_id", "projects", "cascade"),
    ("project_invitations", "invited_by", "users", "restrict"),
    ("project_invitations", "accepted_by", "users", "set null"),
    ("project_settings", "project_id", "projects", "cascade"),
    ("analysis_snapshots", "project_id", "projects", "cascade"),
    ("analysis_jobs", "project_id", "projects", "cascade"),
    ("analysis_jobs", "snapshot_id", "analysis_snapshots", "set null"),
    ("analysis_jobs", "requested_by", "users", "restrict"),
    ("graph_nodes", "snapshot_id", "analysis_snapshots", "cascade"),
    ("graph_edges", "snapshot_id", "analysis_snapshots", "cascade"),
    ("graph_edges", "source_node_id", "graph_nodes", "cascade"),
    ("graph_edges", "target_node_id", "graph_nodes", "cascade"),
    ("workflows", "snapshot_id", "analysis_snapshots", "cascade"),
    ("workflow_steps", "workflow_id", "workflows", "cascade"),
    ("workflow_steps", "node_id", "graph_nodes", "set null"),
    ("workflow_scores", "workflow_id", "workflows", "cascade"),
    ("onboarding_packages", "snapshot_id", "analysis_snapshots", "cascade"),
    ("onboarding_packages", "project_id", "projects", "cascade"),
    ("onboarding_packages", "generated_by", "users", "restrict"),
    ("package_sections", "package_id", "onboarding_packages", "cascade"),
    ("package_sections", "snapshot_id", "analysis_snapshots", "cascade"),
    ("package_sections", "reviewed_by", "users", "set null"),
    ("source_receipts", "section_id", "package_sections", "cascade"),
    ("source_receipts", "node_id", "graph_nodes", "set null"),
    ("doc_links", "snapshot_id", "analysis_snapshots", "cascade"),
    ("doc_links", "linked_node_id", "graph_nodes", "set null"),
    ("doc_links", "linked_workflow_id", "workflows", "set null"),
    ("stale_flags", "snapshot_id", "analysis_snapshots", "cascade"),
    ("role_paths", "snapshot_id", "analysis_snapshots", "cascade"),
    ("role_paths", "package_id", "onboarding_packages", "cascade"),
    ("role_paths", "workflow_id", "workflows", "set null"),
    ("role_paths", "section_id", "package_sections", "set null"),
]

#: What new rows get where a column isn't given; timestamps default to the write's time.
DEFAULTS = {
    "projects": {"status": "idle"},
    "project_invitations": {"status": "pending"},
    "project_settings": {"ignored_paths": ["node_modules", "dist", ".git", ".env"], "ai_enabled": True, "file_limit": 5000, "loc_limit": 250_000},
    "analysis_jobs": {"status": "queued", "progress_pct": 0},
}


def domain_schema(table: str) -> StructType:
    return StructType.fromDDL(_TABLES[table].replace("!", ""))


def required_columns(table: str) -> list[str]:
    """The columns that must not be null."""
    parts = _TABLES[table].split(", ")
    return [p.split(" ")[0] for p in parts if p.endswith("!")]


DOMAIN_TABLES = tuple(_TABLES)
