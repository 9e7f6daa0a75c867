"""Oracle SQL of the raw-log queries: what lines hold, straight from the events they were rendered from."""

from __future__ import annotations

from oracles.base import CTES, iso, sid

_READ = "NOT (event_id % 37 = 5 OR event_id % 41 = 3 OR event_id % 61 = 2)"
_TS = "CASE WHEN event_id % 43 <> 1 THEN ts END"
_CHILD = "concat(regexp_replace(source_id, '\\.jsonl$', ''), '/subagents/agent-', k % 3, '.jsonl')"

CTES.update(
    {
        "lc0": f"""
SELECT *, {_TS} AS t_at, rec_type = 'session_meta' AS meta, CASE WHEN payload_type IN ('user_message', 'agent_message', 'message') THEN concat('said ', event_id) END AS text
FROM c1 WHERE {_READ}""",
        "lr0": f"""
SELECT * EXCLUDE (child_id), {_TS} AS t_at, CASE WHEN child_id IS NOT NULL THEN {_CHILD} END AS child_id,
  CASE WHEN rec_type = 'user' AND NOT is_tool_result THEN concat('asked ', event_id) WHEN rec_type = 'assistant' AND has_text THEN concat('replied ', event_id) END AS text,
  CASE WHEN rec_type = 'ai-title' THEN concat('title ', event_id) END AS title, list_filter([tool_1, tool_2], lambda x: x IS NOT NULL) AS tools,
  rec_type = 'assistant' AND (use_input IS NOT NULL OR adv_input IS NOT NULL) AS used, coalesce(use_input, 0) AS ui, coalesce(use_output, 0) AS uo,
  coalesce(use_write, 0) AS uw, CASE WHEN event_id % 53 = 7 THEN 0 ELSE coalesce(use_read, 0) END AS ur, rec_type = 'assistant' AND adv_input IS NOT NULL AS advised
FROM r1 WHERE {_READ}""",
        "le_c": """
SELECT s.repo_id, 'codex' AS provider, s.session_ref, ordinal, 0 AS slot, t_at, coalesce(says, reply, CASE WHEN tool IS NOT NULL THEN 'assistant' END) AS role,
  CASE WHEN tool IS NULL THEN text END AS text, CASE WHEN tool IS NULL THEN 'message' ELSE 'tool-call' END AS event_kind, CAST(NULL AS VARCHAR) AS permission_mode, tool AS tool_name,
  CASE WHEN says IS NOT NULL THEN 'event' WHEN reply IS NOT NULL THEN 'response' END AS copy
FROM (
  SELECT *, last_value(CASE WHEN rec_type IN ('session_meta', 'turn_context') THEN cwd END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS here,
    CASE WHEN rec_type = 'event_msg' THEN CASE payload_type WHEN 'user_message' THEN 'user' WHEN 'agent_message' THEN 'assistant' END END AS says,
    CASE WHEN rec_type = 'response_item' AND payload_type = 'message' THEN role END AS reply,
    CASE WHEN rec_type = 'response_item' THEN CASE WHEN payload_type IN ('function_call', 'custom_tool_call') THEN coalesce(tool_raw, 'unknown-tool')
      WHEN payload_type = 'web_search_call' THEN 'web_search' WHEN payload_type = 'local_shell_call' THEN 'local_shell' END END AS tool
  FROM lc0
) l JOIN s_dedup s ON s.source_id = l.source_id AND s.provider = 'codex' AND starts_with(here, '/repo/') AND split_part(here, '/', 3) = CAST(s.repo_id AS VARCHAR)
WHERE says IS NOT NULL OR reply IS NOT NULL OR tool IS NOT NULL""",
        "le_r": """
SELECT s.repo_id, 'claude-code' AS provider, s.session_ref, ordinal, slot, t_at, role, e.text, event_kind, mode AS permission_mode, tool_name, CAST(NULL AS VARCHAR) AS copy
FROM (
  SELECT source_id, ordinal, 0 AS slot, t_at, 'system' AS role, title AS text, 'title' AS event_kind, NULL AS mode, NULL AS tool_name FROM lr0
  WHERE child_id IS NULL AND NOT is_sidechain AND title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ordinal) = 1
  UNION ALL SELECT source_id, ordinal, 0, t_at, rec_type, text, 'message', CASE WHEN rec_type = 'user' THEN permission_mode END, NULL FROM lr0 WHERE child_id IS NULL AND NOT is_sidechain AND text IS NOT NULL
  UNION ALL SELECT source_id, ordinal, i, t_at, 'assistant', NULL, 'tool-call', NULL, tools[i] FROM (SELECT *, unnest(range(1, len(tools) + 1)) AS i FROM lr0 WHERE child_id IS NULL AND NOT is_sidechain AND rec_type = 'assistant')
) e JOIN s_dedup s ON s.source_id = e.source_id AND s.provider = 'claude-code'""",
        "ws": """
SELECT CAST(conv_id AS VARCHAR) AS workspace, TIMESTAMP '2026-01-01' + to_minutes(conv_id) AS at_,
  CASE conv_id % 8 WHEN 0 THEN concat('/repo/', conv_id % 7) WHEN 1 THEN concat('/repo/', conv_id % 7, '/sub dir+x') WHEN 2 THEN concat('/C:/repo/', conv_id % 7)
    WHEN 3 THEN concat('/repo/', conv_id % 7, '/only') WHEN 5 THEN concat('/repo/', conv_id % 7, '/./x/../y') END AS folder
FROM (SELECT DISTINCT conv_id FROM conversations)""",
        "le": "SELECT *, row_number() OVER (PARTITION BY repo_id, provider, session_ref ORDER BY ordinal, slot) AS number FROM (SELECT * FROM le_c UNION ALL SELECT * FROM le_r)",
    }
)

_N = ("input", "cached", "output", "reasoning", "total", "write")


def _cum(name: str) -> str:
    value = "CASE WHEN event_id % 53 = 7 THEN 0 ELSE cu_reasoning END" if name == "reasoning" else f"cu_{name}"
    return f"CASE WHEN cum_reported IS NOT NULL THEN {value} END AS cum_{'cache_write' if name == 'write' else name}"


def _direct(name: str) -> str:
    value = "CASE WHEN event_id % 53 = 7 THEN 0 ELSE dir_reasoning END" if name == "reasoning" else "CAST(NULL AS BIGINT)" if name == "write" else f"dir_{name}"
    return f"CASE WHEN dir_input IS NOT NULL THEN {value} END AS direct_{'cache_write' if name == 'write' else name}"


_USAGE = {"input": "ui", "cached": "0", "output": "uo", "reasoning": "0", "total": "ui + uo + uw + ur", "cache_write": "uw", "cache_write_1h": "coalesce(use_write_1h, 0)", "cache_write_5m": "coalesce(use_write_5m, 0)", "cache_read": "ur"}

SQL = {
    "parsed_counter_records": f"""
SELECT source_id, source_kind, ordinal, {iso('t_at')} AS ts, {iso('meta_ts')} AS meta_ts, t_at IS NULL AS ts_invalid, rec_type, payload_type, cwd,
  CASE WHEN meta THEN raw_session_id END AS raw_session_id, model_provider, meta_model, ctx_model, role, tool_raw, text, {', '.join(map(_cum, _N))}, {', '.join(map(_direct, _N))} FROM lc0""",
    "parsed_response_records": f"""
SELECT source_id, source_kind, child_id, agent_type, ordinal, {iso('t_at')} AS ts, t_at IS NULL AS ts_invalid, rec_type, cwd, raw_session_id, permission_mode, is_sidechain, is_tool_result,
  has_message, CASE WHEN rec_type = 'assistant' THEN response_id END AS response_id, model, stop_reason, has_text, text, title, array_to_string(tools, '|') AS tools,
  {', '.join(f"CAST(CASE WHEN used THEN {v} END AS BIGINT) AS usage_{n}" for n, v in _USAGE.items())}, CAST(advised AS INTEGER) AS advisors,
  CASE WHEN advised THEN adv_model END AS advisor_model, CASE WHEN advised THEN adv_input + adv_output END AS advisor_total FROM lr0""",
    "scan_audit": f"""
SELECT source_id, count(*) FILTER (big) AS oversized, count(*) FILTER (bad) AS invalid_json FROM (
  SELECT source_id, event_id % 37 = 5 OR event_id % 41 = 3 AS bad, event_id % 61 = 2 AND NOT (event_id % 37 = 5 OR event_id % 41 = 3) AS big FROM c1
  UNION ALL SELECT CASE WHEN child_id IS NOT NULL THEN {_CHILD} ELSE source_id END, event_id % 37 = 5 OR event_id % 41 = 3,
    event_id % 61 = 2 AND NOT (event_id % 37 = 5 OR event_id % 41 = 3) FROM r1) GROUP BY 1""",
    "workspace_folders": f"SELECT workspace, folder, {iso('at_')} AS modified_at FROM ws WHERE folder IS NOT NULL",
    "every_session": f"""
SELECT repo_id, session_ref, provider, source_kind, {iso('started_at')} AS started_at, {iso('ended_at')} AS ended_at, relation, turns, assistant_messages, status FROM s_dedup
UNION ALL
SELECT r.repo_id, {sid('ses_', 20, "'cursor'", 'r.fingerprint', 'workspace')}, 'cursor', 'active', {iso('at_')}, {iso('at_')},
  CASE WHEN folder = r.root THEN 'repository-root' ELSE 'subdirectory' END, u, a, 'unknown'
FROM ws JOIN repos r ON starts_with(concat(folder, '/'), concat(r.root, '/'))
JOIN (SELECT CAST(conv_id AS VARCHAR) AS workspace, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations
  WHERE role IN ('user', 'assistant') AND text <> '' AND conv_id % 4 <> 3 GROUP BY 1) m USING (workspace)""",
    "log_events": f"""
SELECT repo_id, provider, session_ref, number, {iso("coalesce(t_at, TIMESTAMP '1970-01-01')")} AS occurred_at, role, text, event_kind, permission_mode, tool_name FROM le
WHERE copy IS NULL OR copy = 'event' OR NOT EXISTS (SELECT 1 FROM le e WHERE e.copy = 'event' AND e.repo_id = le.repo_id AND e.provider = le.provider AND e.session_ref = le.session_ref)""",
}
