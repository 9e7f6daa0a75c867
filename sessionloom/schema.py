"""Column layouts shared by every source and operator."""

from __future__ import annotations

# Token counters. The first five are always present in a usage value, the last
# four only where the log reports them.
CORE = ["input", "cached", "output", "reasoning", "total"]
OPTIONAL = ["cache_write", "cache_write_1h", "cache_write_5m", "cache_read"]
COUNTERS = CORE + OPTIONAL
USAGE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"

# Provider ids as they occur in stored snapshots (fixed values).
COUNTER_PROVIDER = "codex"
RESPONSE_PROVIDER = "claude-code"
BLOB_PROVIDER = "cursor"
DETECT_ONLY_PROVIDER = "gemini-antigravity"

# One record of a log with cumulative token counters.
COUNTER_RECORDS = f"""
    source_id string, source_kind string, ordinal bigint, ts timestamp, meta_ts timestamp, ts_invalid boolean,
    rec_type string, payload_type string, cwd string, default_cwd string, raw_session_id string,
    model_provider string, meta_model string, ctx_model string, role string, tool_raw string, text string,
    cum {USAGE}, direct {USAGE}
"""

# One record of a log with one usage value per response; child logs carry
# ``child_id`` and the parent's ``source_id``.
RESPONSE_RECORDS = f"""
    source_id string, source_kind string, child_id string, agent_type string, ordinal bigint, ts timestamp,
    ts_invalid boolean, rec_type string, cwd string, raw_session_id string, permission_mode string,
    is_sidechain boolean, is_tool_result boolean, has_message boolean, response_id string, model string,
    stop_reason string, has_text boolean, text string, title string, tools array<string>, usage {USAGE},
    advisors array<struct<idx:int,model:string,usage:{USAGE}>>
"""

# One chat message found in a key/value blob store.
BLOB_MESSAGES = "workspace string, pos bigint, role string, text string"

# A repository the logs are scoped to.
REPOSITORIES = "repo_id bigint, root string, fingerprint string"
