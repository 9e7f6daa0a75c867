"""Oracle SQL of the ledger, session and usage queries."""

from __future__ import annotations

from oracles.base import T, iso, sid

NAMES = dict(zip(T, ["input", "cached", "output", "reasoning", "total", "cache_write", "cache_write_1h", "cache_write_5m", "cache_read"]))


def tok(prefix: str = "", only: list[str] | None = None) -> str:
    return ", ".join(f"{prefix}{t} AS {NAMES[t]}_tokens" for t in T if only is None or t in only)


LABEL = "CASE provider WHEN 'claude-code' THEN 'Claude Code' ELSE 'Codex' END"


def s(n: str, noun: str) -> str:
    return f"{n} || ' {noun}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


SQL = {
    "model_usage": f"SELECT repo_id, model_provider, model, calls, sessions, {tok()}, cost_micro, repriced FROM mu",
    "token_deltas": f"SELECT source_id, ordinal, cwd_now, model, provider_now, {tok('a_', T[:6])} FROM c_rows WHERE a_total IS NOT NULL",
    "segment_scope": """
SELECT repo AS repo_id, source_id, CASE WHEN at_root THEN 'repository-root' ELSE 'subdirectory' END AS relation,
  count(*) AS records, count(a_total) AS responses, CAST(sum(a_total) AS BIGINT) AS total_tokens FROM c_in GROUP BY ALL""",
    "response_ledger": f"SELECT source_id, key, copy_ordinal, model, side AS is_sidechain, is_advisor, stop_reason, CAST(len(tools) AS INTEGER) AS tool_blocks, {tok('a_')} FROM r_ledger",
    "child_fold": """
SELECT source_id, 'agent' AS cell, coalesce(agent_type, 'unknown') AS name, count(*) AS calls FROM r_children GROUP BY ALL
UNION ALL
SELECT source_id, 'child_tool', name, count(*) FROM (
  SELECT source_id, unnest(tools) AS name FROM (SELECT * FROM r_copies WHERE child_id IS NOT NULL AND NOT is_advisor AND len(tools) > 0
    QUALIFY row_number() OVER (PARTITION BY source_id, child_id, key ORDER BY copy_ordinal DESC) = 1)
) GROUP BY ALL""",
    "price_lookup_models": f"""
SELECT DISTINCT m.model, CAST(m.epoch AS INTEGER) AS epoch, p.prefix, CAST(p.n_in AS BIGINT) AS nano_input, CAST(p.n_out AS BIGINT) AS nano_output, p.prefix IS NOT NULL AS is_priced FROM (
  SELECT DISTINCT ctx_model AS model, CASE WHEN ts >= TIMESTAMP '2026-09-01' THEN 1 ELSE 0 END AS epoch FROM c_rows WHERE ctx_model IS NOT NULL
) m LEFT JOIN LATERAL (
  SELECT * FROM prices p WHERE (m.model = p.prefix OR (starts_with(m.model, p.prefix || '-')
    AND regexp_full_match(substr(m.model, length(p.prefix) + 2), '(?:\\d+-)*(?:\\d{{8}}|\\d{{4}}-\\d{{2}}-\\d{{2}})')))
    AND (m.epoch = 1 OR p.valid_from IS NULL) AND (m.epoch = 0 OR p.valid_to IS NULL)
  ORDER BY length(p.prefix) DESC LIMIT 1
) p ON TRUE""",
    "response_costs": """
SELECT source_id, key, model, CAST(nano AS BIGINT) AS cost_nano, CAST((nano + 999) // 1000 AS BIGINT) AS cost_micro, n_in IS NOT NULL AS is_priced
FROM r_priced WHERE a_total IS NOT NULL""",
    "priced_split": """
SELECT repo_id, session_ref, provider, model_provider, model, calls, total AS total_tokens, p_total AS priced_tokens, u_total AS unpriced_tokens,
  CAST(nano AS BIGINT) AS cost_nano FROM m_all""",
    "fallback_reprice": "SELECT repo_id, model_provider, model, p_total AS priced_tokens, u_total AS unpriced_tokens, cost_micro, repriced FROM mu",
    "sessions_table": f"""
SELECT repo_id, session_ref, provider, source_kind, {iso('started_at')} AS started_at, {iso('ended_at')} AS ended_at, start_ordinal, end_ordinal, relation,
  turns, assistant_messages, CAST(tool_calls AS BIGINT) AS tool_calls, plan_turns, subagents,
  coalesce((SELECT string_agg(DISTINCT model, '|' ORDER BY model) FROM m_all m WHERE m.repo_id = s.repo_id AND m.session_ref = s.session_ref), '') AS model_refs,
  coalesce((SELECT string_agg(DISTINCT tool, '|' ORDER BY tool) FROM t_all t WHERE t.repo_id = s.repo_id AND t.session_ref = s.session_ref), '') AS tool_refs,
  {LABEL} || ' session with ' || {s('turns', 'user turn')} || ', ' || {s('assistant_messages', 'assistant message')} || ', and '
  || {s('CAST(tool_calls AS BIGINT)', 'tool call')} || '.' AS summary, {tok()}
FROM s_dedup s""",
    "session_status": "SELECT repo_id, provider, status, count(*) AS sessions FROM s_dedup GROUP BY ALL",
    "session_tools": "SELECT repo_id, session_ref, provider, tool, calls FROM t_all",
    "session_dedupe": "SELECT repo_id, session_ref, source_id, source_kind FROM s_dedup",
    "evidence_refs": f"""
SELECT repo_id, session_ref, provider AS source, kind, event_ordinal, observed_at,
  {sid('ev_', 20, 'session_ref', 'kind', 'event_ordinal', 'observed_at')} AS evidence_id,
  concat('sha256:', sha256(concat(session_ref, chr(0), kind, chr(0), event_ordinal, chr(0), observed_at))) AS digest
FROM (
  SELECT repo_id, session_ref, provider, 'session-boundary' AS kind, start_ordinal AS event_ordinal, {iso('started_at')} AS observed_at FROM s_in
  UNION ALL SELECT repo_id, session_ref, provider, 'session-boundary', end_ordinal, {iso('ended_at')} FROM s_in WHERE end_ordinal <> start_ordinal
  UNION ALL SELECT repo_id, session_ref, provider, 'tool-activity', tool_ordinal, {iso('tool_at')} FROM s_in WHERE tool_ordinal IS NOT NULL AND provider = 'codex'
)""",
    "tool_usage": "SELECT repo_id, tool, calls, sessions FROM tu",
    "usage_totals": f"SELECT repo_id, sessions, turns, tool_calls, assistant_messages, plan_turns, subagents, completed, active_days, {tok()} FROM tot",
    "cost_rollup": "SELECT repo_id, total_micro, priced_tokens, unpriced_tokens, partially_priced_models, '2026-08-08.1-api-equivalent' AS pricing_table_version FROM cr",
    "coverage": """
SELECT repo_id, discovered, included, discovered - included AS skipped, CASE WHEN discovered > included THEN 'outside-window' END AS reason FROM (
  SELECT s.repo_id, count(*) AS discovered, count(*) FILTER (ended_at >= window_start + INTERVAL 7 DAY AND started_at <= window_end) AS included
  FROM s_dedup s JOIN w_all USING (repo_id) GROUP BY 1)""",
    "time_window": f"SELECT repo_id, {iso('window_start')} AS window_start, {iso('window_end')} AS window_end, start_basis, end_basis FROM w_all",
    "window_overlap": """
SELECT s.repo_id, session_ref FROM s_dedup s JOIN w_all USING (repo_id)
WHERE ended_at >= window_start + INTERVAL 7 DAY AND started_at <= window_start + INTERVAL 14 DAY""",
    "git_metrics": "SELECT * FROM gm",
    "status_counts": """
SELECT *, staged + modified + untracked + conflicted > 0 AS is_dirty FROM (
  SELECT repo_id, count(*) FILTER (code NOT IN ('??', '!!') AND code[1] <> ' ') AS staged,
    count(*) FILTER (code NOT IN ('??', '!!') AND code[2] <> ' ') AS modified, count(*) FILTER (code = '??') AS untracked,
    count(*) FILTER (code IN ('DD', 'AU', 'UD', 'UA', 'DU', 'AA', 'UU')) AS conflicted FROM st GROUP BY 1)""",
    "reconcile_sessions": f"""
SELECT repo_id, {iso('started_at')} AS started_at, session_ref, provider, turns, coalesce(total, 0) AS tokens,
  coalesce((SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM m_all m WHERE m.repo_id = s.repo_id AND m.session_ref = s.session_ref), '(none)') AS models
FROM s_in s""",
    "reconcile_models": """
SELECT repo_id, model_provider, model, calls, coalesce(total, 0) AS tokens, cost_micro,
  EXISTS (SELECT 1 FROM prices p WHERE (model = p.prefix OR (starts_with(model, p.prefix || '-')
    AND regexp_full_match(substr(model, length(p.prefix) + 2), '(?:\\d+-)*(?:\\d{8}|\\d{4}-\\d{2}-\\d{2})'))) AND p.valid_from IS NULL) AS is_priced FROM mu""",
}
