"""Common table expressions: the driver tables as logs, then the middle layer."""

from __future__ import annotations

from sessionloom.operators.pricing import PRICE_TABLE
from sessionloom.views.shapes import CHANGES, COMMITS, COMMON, COUNTER, RESPONSE, SHIFT_DAYS, STATUS_CODES, pick, spell



def _columns(mapping: dict[str, str]) -> str:
    return ",\n  ".join(f"{spell(sql, 'duckdb')} AS {name}" for name, sql in mapping.items())


def _prices() -> str:
    rows = []
    for prefix, inp, out, read, w5, w1, long_in, long_out, start, end in PRICE_TABLE:
        nano = [round(v * 1000) for v in (inp, out, read)]
        five = round(w5 * 1000) if w5 is not None else nano[0]
        one = round(w1 * 1000) if w1 is not None else five
        text = lambda v: "NULL" if v is None else f"'{v}'"
        rows.append(f"('{prefix}', {nano[0]}, {nano[1]}, {nano[2]}, {five}, {one}, {long_in or 1}, {round(out * 1000 * (long_out or 1))}, {text(start)}, {text(end)})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(prefix, n_in, n_out, n_read, n_5m, n_1h, long_in, n_out_long, valid_from, valid_to)"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def price_join(rows: str, key: str, model: str, at: str) -> str:
    """Best price of every row: longest prefix, then latest start."""
    return f"""
SELECT r.*, p.* EXCLUDE (pk) FROM {rows} r LEFT JOIN (
  SELECT r.{key} AS pk, p.prefix, p.n_in, p.n_out, p.n_read, p.n_5m, p.n_1h, p.long_in, p.n_out_long,
    starts_with(lower(trim(r.{model})), 'gpt-5.6') AS long_family
  FROM {rows} r JOIN prices p ON
    (lower(trim(r.{model})) = p.prefix OR (starts_with(lower(trim(r.{model})), p.prefix || '-') AND
      regexp_full_match(substr(lower(trim(r.{model})), length(p.prefix) + 2), '(?:\\d+-)*(?:\\d{{8}}|\\d{{4}}-\\d{{2}}-\\d{{2}})')))
    AND (p.valid_from IS NULL OR {iso('r.' + at)} >= p.valid_from) AND (p.valid_to IS NULL OR {iso('r.' + at)} < p.valid_to)
  QUALIFY row_number() OVER (PARTITION BY r.{key} ORDER BY length(p.prefix) DESC, coalesce(p.valid_from, '') DESC) = 1
) p ON p.pk = r.{key}"""


def cost(p: str) -> str:
    """Nano-USD of one usage value with columns {p}input, ... and a joined price."""
    lg = f"(long_family AND {p}input + {p}cached + coalesce({p}write, 0) > 272000)"
    return f"""CASE WHEN n_in IS NOT NULL AND {p}input IS NOT NULL THEN
  ({p}input * n_in + {p}cached * n_read + CASE WHEN {p}write_1h IS NOT NULL OR {p}write_5m IS NOT NULL
    THEN coalesce({p}write_1h, 0) * n_1h + coalesce({p}write_5m, 0) * n_5m ELSE coalesce({p}write, 0) * n_5m END)
  * CASE WHEN {lg} THEN long_in ELSE 1 END + coalesce({p}read, 0) * n_read
  + {p}output * CASE WHEN {lg} THEN n_out_long ELSE n_out END END"""


def carried(expr: str, exclusive: bool = False) -> str:
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND " + ("1 PRECEDING" if exclusive else "CURRENT ROW")
    return f"last_value({expr} IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ordinal {frame})"


def delta(name: str) -> str:
    return f"CASE WHEN cu_{name} < coalesce(pr_{name}, 0) THEN cu_{name} ELSE cu_{name} - coalesce(pr_{name}, 0) END"


# counters of a usage value and how they are spelled in the token columns
T = ["input", "cached", "output", "reasoning", "total", "write", "write_1h", "write_5m", "read"]


def sums(prefix: str, where: str = "TRUE", out: str = "") -> str:
    return ", ".join(
        f"CAST(sum({prefix}{t}) FILTER ({where}) AS BIGINT) AS {out}{t}" for t in T
    )


def ref(*parts: str) -> str:
    return "concat(" + ", chr(0), ".join(parts) + ")"


def sid(prefix: str, n: int, *parts: str) -> str:
    return f"concat('{prefix}', left(sha256({ref(*parts)}), {n}))"


CTES: dict[str, str] = {
    "prices": _prices(),
    "ev0": f"""
SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(floor(value * 100) AS BIGINT) AS tok, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week,
  date_trunc('milliseconds', ts) + INTERVAL {SHIFT_DAYS} DAY AS ts
FROM events""",
    "ev1": f"SELECT *,\n  {_columns(COMMON)}\nFROM ev0",
    "repos": "SELECT DISTINCT user_id % 7 AS repo_id, concat('/repo/', user_id % 7) AS root, "
    "concat('sha256:', sha256(concat('/repo/', user_id % 7))) AS fingerprint FROM events",
    # counter dialect
    "c0": f"SELECT *,\n  {_columns(COUNTER)}\nFROM ev1 WHERE user_id % 2 = 0",
    "c1": """
SELECT *, greatest(0, cum_reported - cum_cached - coalesce(cum_write, 0)) AS cu_input, cum_cached AS cu_cached,
  cum_output AS cu_output, cum_reasoning AS cu_reasoning, cum_reported + cum_output AS cu_total, cum_write AS cu_write,
  CASE WHEN rec_type = 'session_meta' AND k % 3 = 0 THEN ts - INTERVAL 2 MINUTE END AS meta_ts
FROM c0""",
    "c2": """
SELECT *, CASE WHEN cum_reported IS NOT NULL THEN concat_ws('/', cu_input, cu_cached, coalesce(cu_write, 0), cu_output, cu_reasoning, cu_total)
  WHEN dir_input IS NOT NULL THEN concat_ws('/', dir_input, dir_cached, 0, dir_output, dir_reasoning, dir_total) END AS fp,
  CASE WHEN cum_reported IS NOT NULL THEN {'input': cu_input, 'cached': cu_cached, 'output': cu_output,
    'reasoning': cu_reasoning, 'total': cu_total, 'write': cu_write} END AS cum
FROM c1""",
    "c3": f"""
SELECT *, coalesce({carried("CASE WHEN rec_type IN ('session_meta', 'turn_context') THEN cwd END")}, default_cwd) AS cwd_now,
  {carried("ctx_model")} AS active_model, {carried("meta_model")} AS session_model,
  coalesce({carried("model_provider")}, 'unknown') AS provider_now,
  {carried("fp", True)} AS prev_fp, {carried("cum", True)} AS prev
FROM c2""",
    "c4": """
SELECT *, prev.input AS pr_input, prev.cached AS pr_cached, prev.output AS pr_output, prev.reasoning AS pr_reasoning,
  prev.total AS pr_total, prev.write AS pr_write,
  payload_type = 'token_count' AND fp IS NOT NULL AND fp IS DISTINCT FROM prev_fp AS fresh
FROM c3""",
    "c5": "SELECT *, "
    + ", ".join(
        f"CASE WHEN fresh THEN CASE WHEN dir_input IS NOT NULL THEN dir_{n} ELSE {delta(n)} END END AS x_{n}"
        for n in ("input", "cached", "output", "reasoning", "total")
    )
    + ", CASE WHEN fresh AND dir_input IS NULL AND cu_write IS NOT NULL THEN " + delta("write") + " END AS x_write FROM c4",
    "c_rows": "SELECT * EXCLUDE (x_input, x_cached, x_output, x_reasoning, x_total, x_write), "
    + ", ".join(f"CASE WHEN x_total > 0 THEN x_{n} END AS a_{n}" for n in ("input", "cached", "output", "reasoning", "total", "write"))
    + """, CAST(NULL AS BIGINT) AS a_write_1h, CAST(NULL AS BIGINT) AS a_write_5m, CAST(NULL AS BIGINT) AS a_read,
  CASE WHEN x_total > 0 THEN coalesce(active_model, session_model, 'unknown-model') END AS model,
  CASE WHEN rec_type = 'response_item' THEN CASE
    WHEN payload_type IN ('function_call', 'custom_tool_call') THEN coalesce(tool_raw, 'unknown-tool')
    WHEN payload_type = 'web_search_call' THEN 'web_search' WHEN payload_type = 'local_shell_call' THEN 'local_shell' END END AS tool,
  coalesce(meta_ts, ts) AS seen_at
FROM c5""",
    "c_in": """
SELECT *, TRY_CAST(split_part(cwd_now, '/', 3) AS BIGINT) AS repo, cwd_now = concat('/repo/', split_part(cwd_now, '/', 3)) AS at_root
FROM c_rows WHERE starts_with(cwd_now, '/repo/')""",
    "c_tok": "SELECT *, concat(source_id, '|', ordinal) AS rid FROM c_in WHERE a_total IS NOT NULL",
    "c_priced": f"SELECT *, {cost('a_')} AS nano FROM ({price_join('c_tok', 'rid', 'model', 'ts')})",
    "c_ids": "SELECT source_id, min(source_kind) AS source_kind, arg_min(raw_session_id, ordinal) FILTER (raw_session_id IS NOT NULL) AS raw_id FROM c_rows GROUP BY 1",
    "c_usage": f"""
SELECT repo, source_id, count(*) AS n, {sums('a_')} FROM c_tok GROUP BY 1, 2""",
    "c_sess": f"""
SELECT s.repo AS repo_id, {sid('ses_', 20, 'r.fingerprint', "coalesce(i.raw_id, concat(i.source_kind, ':', split_part(s.source_id, '/', 4)))")} AS session_ref,
  'codex' AS provider, i.source_kind, s.source_id, s.* EXCLUDE (repo, source_id), CAST(NULL AS BIGINT) AS plan_turns, CAST(NULL AS BIGINT) AS subagents,
  u.input, u.cached, u.output, u.reasoning, u.total, CASE WHEN u.n > 1 THEN coalesce(u.write, 0) ELSE u.write END AS write,
  u.write_1h, u.write_5m, u.read
FROM (
  SELECT repo, source_id, min(seen_at) AS started_at, max(seen_at) AS ended_at,
    arg_min(ordinal, seen_at::VARCHAR || lpad(ordinal::VARCHAR, 20, '0')) AS start_ordinal,
    arg_max(ordinal, seen_at::VARCHAR || lpad((1000000000000 - ordinal)::VARCHAR, 20, '0')) AS end_ordinal,
    CASE WHEN bool_or(coalesce(payload_type = 'turn_aborted', FALSE)) THEN 'aborted' WHEN bool_or(coalesce(payload_type = 'task_complete', FALSE)) THEN 'completed' ELSE 'incomplete' END AS status,
    CASE WHEN bool_or(at_root) THEN 'repository-root' ELSE 'subdirectory' END AS relation,
    CASE WHEN count(*) FILTER (payload_type = 'user_message') > 0 THEN count(*) FILTER (payload_type = 'user_message')
      ELSE count(*) FILTER (payload_type = 'message' AND role = 'user') END AS turns,
    CASE WHEN count(*) FILTER (payload_type = 'agent_message') > 0 THEN count(*) FILTER (payload_type = 'agent_message')
      ELSE count(*) FILTER (payload_type = 'message' AND role = 'assistant') END AS assistant_messages,
    count(tool) AS tool_calls, min(ordinal) FILTER (tool IS NOT NULL) AS tool_ordinal, arg_min(ts, ordinal) FILTER (tool IS NOT NULL) AS tool_at
  FROM c_in GROUP BY 1, 2
) s JOIN c_ids i USING (source_id) JOIN repos r ON r.repo_id = s.repo LEFT JOIN c_usage u ON u.repo = s.repo AND u.source_id = s.source_id""",
    "c_models": f"""
SELECT coalesce(a.repo, b.repo) AS repo_id, coalesce(a.source_id, b.source_id) AS source_id, 'codex' AS provider,
  CASE WHEN coalesce(a.o, -1) > coalesce(b.o, -1) THEN a.p ELSE b.p END AS model_provider, coalesce(a.model, b.model) AS model,
  coalesce(a.calls, 0) AS calls, a.* EXCLUDE (repo, source_id, model, calls, o, p, write), CASE WHEN a.calls > 1 THEN coalesce(a.write, 0) ELSE a.write END AS write
FROM (
  SELECT repo, source_id, model, count(*) AS calls, max(ordinal) AS o, arg_max(provider_now, ordinal) AS p,
    {sums('a_')}, {sums('a_', 'nano IS NOT NULL', 'p_')}, {sums('a_', 'nano IS NULL', 'u_')}, sum(nano) AS nano
  FROM c_priced GROUP BY 1, 2, 3
) a FULL JOIN (
  SELECT repo, source_id, ctx_model AS model, max(ordinal) AS o, arg_max(provider_now, ordinal) AS p
  FROM c_in WHERE rec_type = 'turn_context' AND ctx_model IS NOT NULL GROUP BY 1, 2, 3
) b ON a.repo = b.repo AND a.source_id = b.source_id AND a.model = b.model""",
    "c_tools": "SELECT repo AS repo_id, source_id, 'codex' AS provider, tool, count(*) AS calls FROM c_in WHERE tool IS NOT NULL GROUP BY ALL",
    # response dialect
    "r0": f"SELECT *,\n  {_columns(RESPONSE)}\nFROM ev1 WHERE user_id % 2 = 1",
    "r1": """
SELECT *, CASE WHEN use_input IS NOT NULL THEN 0 END AS use_cached, CASE WHEN use_input IS NOT NULL THEN 0 END AS use_reasoning,
  use_input + use_output + use_write + use_read AS use_total FROM r0""",
    "r_logs": """
SELECT source_id, min(source_kind) AS source_kind, arg_min(cwd, ordinal) FILTER (cwd IS NOT NULL) AS cwd,
  min(ordinal) FILTER (cwd IS NOT NULL) AS scope_ordinal, arg_min(raw_session_id, ordinal) FILTER (raw_session_id IS NOT NULL) AS raw_id,
  min(ts) AS started_at, max(ts) AS ended_at, arg_min(ordinal, ordinal) AS start_ordinal, arg_max(ordinal, ordinal) AS end_ordinal
FROM r1 WHERE child_id IS NULL GROUP BY 1""",
    "r_copies": """
SELECT source_id, child_id, ordinal AS copy_ordinal, ordinal, ts, model, stop_reason, (is_sidechain OR child_id IS NOT NULL) AS side, has_text,
  list_filter([tool_1, tool_2], lambda x: x IS NOT NULL) AS tools, FALSE AS is_advisor,
  coalesce('id:' || response_id, concat('record:', coalesce(child_id, source_id), ':', ordinal)) AS key,
  use_input AS a_input, use_cached AS a_cached, use_output AS a_output, use_reasoning AS a_reasoning, use_total AS a_total,
  use_write AS a_write, use_write_1h AS a_write_1h, use_write_5m AS a_write_5m, use_read AS a_read
FROM r1 WHERE rec_type = 'assistant'
UNION ALL
SELECT source_id, child_id, ordinal, ordinal + 1, ts, coalesce(adv_model, model), NULL, TRUE, FALSE, [], TRUE,
  concat(coalesce('id:' || response_id, concat('record:', coalesce(child_id, source_id), ':', ordinal)), ':advisor:0'),
  adv_input, 0, adv_output, 0, adv_input + adv_output, 0, 0, 0, 0
FROM r1 WHERE rec_type = 'assistant' AND adv_input IS NOT NULL""",
    "r_ledger": """
SELECT c.* REPLACE (coalesce(c.model, 'unknown-model') AS model), concat(c.source_id, '|', c.key) AS rid FROM (
  SELECT * FROM r_copies
  QUALIFY row_number() OVER (PARTITION BY source_id, key ORDER BY child_id IS NOT NULL DESC, coalesce(child_id, '') DESC, copy_ordinal DESC) = 1
) c JOIN r_logs l USING (source_id)
WHERE (c.child_id IS NOT NULL OR c.copy_ordinal >= l.scope_ordinal) AND coalesce(c.model, '') <> '<synthetic>'""",
    "r_priced": f"SELECT *, {cost('a_')} AS nano FROM ({price_join('r_ledger', 'rid', 'model', 'ts')})",
    "r_place": "SELECT *, TRY_CAST(split_part(cwd, '/', 3) AS BIGINT) AS repo FROM r_logs WHERE starts_with(cwd, '/repo/')",
    "r_turns": """
SELECT source_id, count(*) FILTER (NOT is_tool_result) AS turns, count(*) FILTER (NOT is_tool_result AND permission_mode = 'plan') AS plan_turns
FROM r1 JOIN r_logs l USING (source_id) WHERE rec_type = 'user' AND child_id IS NULL AND NOT is_sidechain AND ordinal >= l.scope_ordinal GROUP BY 1""",
    "r_facts": f"""
SELECT source_id, count(*) FILTER (NOT side AND has_text) AS assistant_messages,
  arg_max(stop_reason, {iso('ts')} || lpad(ordinal::VARCHAR, 20, '0') || key) FILTER (NOT side AND stop_reason IS NOT NULL) AS last_stop,
  coalesce(sum(len(list_filter(tools, lambda t: NOT starts_with(t, 'Agent:') AND NOT ends_with(t, ' (subagent)')))) FILTER (NOT side), 0) AS tool_calls,
  arg_min(ordinal, {iso('ts')} || lpad(ordinal::VARCHAR, 20, '0')) FILTER (NOT side AND len(tools) > 0) AS tool_ordinal,
  min(ts) FILTER (NOT side AND len(tools) > 0) AS tool_at, {sums('a_')}
FROM r_ledger GROUP BY 1""",
    "r_children": "SELECT source_id, child_id, max(agent_type) AS agent_type FROM r1 WHERE child_id IS NOT NULL GROUP BY 1, 2",
    "r_sess": f"""
SELECT p.repo AS repo_id, {sid('ses_', 20, "'claude-code'", 'r.fingerprint', "coalesce(p.raw_id, concat(p.source_kind, ':', split_part(p.source_id, '/', 4)))")} AS session_ref,
  'claude-code' AS provider, p.source_kind, p.source_id, p.started_at, p.ended_at, p.start_ordinal, p.end_ordinal,
  CASE WHEN f.last_stop IS NULL THEN 'unknown' WHEN f.last_stop = 'tool_use' THEN 'incomplete' ELSE 'completed' END AS status,
  'repository-root' AS relation, coalesce(t.turns, 0) AS turns, coalesce(f.assistant_messages, 0) AS assistant_messages,
  coalesce(f.tool_calls, 0) AS tool_calls, f.tool_ordinal, f.tool_at,
  CASE WHEN t.turns > 0 THEN t.plan_turns END AS plan_turns, n.subagents, f.input, f.cached, f.output, f.reasoning, f.total, f.write, f.write_1h, f.write_5m, f.read
FROM r_place p JOIN repos r ON r.repo_id = p.repo LEFT JOIN r_facts f USING (source_id) LEFT JOIN r_turns t USING (source_id)
LEFT JOIN (SELECT source_id, count(*) AS subagents FROM r_children GROUP BY 1) n USING (source_id)""",
    "r_models": f"""
SELECT p.repo AS repo_id, c.source_id, 'claude-code' AS provider, 'anthropic' AS model_provider, c.model, count(*) AS calls,
  {sums('a_')}, {sums('a_', 'nano IS NOT NULL', 'p_')}, {sums('a_', 'nano IS NULL', 'u_')}, sum(nano) AS nano
FROM r_priced c JOIN r_place p USING (source_id) GROUP BY ALL""",
    "r_tools": """
SELECT repo_id, source_id, 'claude-code' AS provider, tool, CAST(sum(calls) AS BIGINT) AS calls FROM (
  SELECT p.repo AS repo_id, source_id, unnest(tools) AS tool, 1 AS calls FROM r_ledger JOIN r_place p USING (source_id) WHERE NOT side
  UNION ALL
  SELECT p.repo, source_id, concat(unnest(tools), ' (subagent)'), 1 FROM (
    SELECT * FROM r_copies WHERE child_id IS NOT NULL AND NOT is_advisor AND len(tools) > 0
    QUALIFY row_number() OVER (PARTITION BY source_id, child_id, key ORDER BY copy_ordinal DESC) = 1
  ) JOIN r_place p USING (source_id)
  UNION ALL
  SELECT p.repo, source_id, concat('Agent:', coalesce(agent_type, 'unknown')), 1 FROM r_children JOIN r_place p USING (source_id)
) GROUP BY ALL""",
    # across dialects
    "s_all": "SELECT * FROM c_sess UNION ALL BY NAME SELECT * FROM r_sess",
    "s_dedup": """
SELECT * FROM s_all QUALIFY row_number() OVER (PARTITION BY repo_id, session_ref ORDER BY ended_at DESC,
  (provider = 'codex' AND source_kind = 'active') DESC,
  CASE WHEN provider = 'codex' AND source_kind = 'active' THEN source_id END DESC, source_id) = 1""",
    "m_all": "SELECT m.*, s.session_ref, s.ended_at FROM (SELECT * FROM c_models UNION ALL BY NAME SELECT * FROM r_models) m JOIN s_dedup s USING (repo_id, source_id, provider)",
    "t_all": "SELECT t.*, s.session_ref FROM (SELECT * FROM c_tools UNION ALL BY NAME SELECT * FROM r_tools) t JOIN s_dedup s USING (repo_id, source_id, provider)",
    # commits
    "cm": f"""
SELECT {_columns(COMMITS)}, TIMESTAMP '2026-08-20' + to_days(CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 45 AS INTEGER))
  + to_seconds(o_orderkey % 86400) AS ts FROM orders""",
    "ch": f"SELECT {_columns(CHANGES)} FROM lineitem",
    "st": f"SELECT o_custkey % 7 AS repo_id, {pick(STATUS_CODES, 'o_orderkey % 10')} AS code FROM orders",
    "w_all": f"""
SELECT r.repo_id, coalesce(s.first_start, TIMESTAMP '1970-01-01') AS window_start, coalesce(greatest(s.last_end, h.head_at), TIMESTAMP '1970-01-01') AS window_end,
  'full-history' AS start_basis, CASE WHEN s.last_end IS NOT NULL AND (h.head_at IS NULL OR s.last_end >= h.head_at) THEN 'latest-session'
    WHEN h.head_at IS NOT NULL THEN 'head-commit' ELSE 'unix-epoch' END AS end_basis, (r.repo_id - 3) * 120 AS utc_offset
FROM repos r LEFT JOIN (SELECT repo_id, min(started_at) AS first_start, max(ended_at) AS last_end FROM s_dedup GROUP BY 1) s USING (repo_id)
LEFT JOIN (SELECT repo_id, max(ts) AS head_at FROM cm GROUP BY 1) h USING (repo_id)""",
    "s_in": "SELECT s.* FROM s_dedup s JOIN w_all w USING (repo_id) WHERE ended_at >= window_start AND started_at <= window_end",
    "m_in": "SELECT m.* FROM m_all m JOIN s_in USING (repo_id, session_ref)",
    "t_in": "SELECT t.* FROM t_all t JOIN s_in USING (repo_id, session_ref)",
    "mu0": f"""
SELECT repo_id, model_provider, model, CAST(sum(calls) AS BIGINT) AS calls, count(DISTINCT session_ref) AS sessions, max(ended_at) AS latest_end,
  {sums('m.')}, {sums('m.p_', out='p_')}, {sums('m.u_', out='u_')}, sum(nano) AS nano, concat(repo_id, '|', model_provider, '|', model) AS mid
FROM m_in m GROUP BY repo_id, model_provider, model""",
    "mu1": f"SELECT *, {cost('')} AS nano_again FROM ({price_join('mu0', 'mid', 'model', 'latest_end')})",
    "mu": """
SELECT * EXCLUDE (p_total, u_total), CASE WHEN nano IS NULL AND nano_again IS NOT NULL THEN total ELSE p_total END AS p_total,
  CASE WHEN nano IS NULL AND nano_again IS NOT NULL THEN NULL ELSE u_total END AS u_total,
  CAST(CASE WHEN nano IS NOT NULL THEN (nano + 999) // 1000 ELSE (nano_again + 999) // 1000 END AS BIGINT) AS cost_micro,
  nano IS NULL AND nano_again IS NOT NULL AS repriced
FROM mu1""",
    "tu": "SELECT repo_id, tool, CAST(sum(calls) AS BIGINT) AS calls, count(DISTINCT session_ref) AS sessions FROM t_in GROUP BY ALL",
    "tot": f"""
SELECT repo_id, count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(tool_calls) AS BIGINT) AS tool_calls,
  CAST(sum(assistant_messages) AS BIGINT) AS assistant_messages, CAST(sum(coalesce(plan_turns, 0)) AS BIGINT) AS plan_turns,
  CAST(sum(coalesce(subagents, 0)) AS BIGINT) AS subagents, count(*) FILTER (status = 'completed') AS completed,
  count(DISTINCT CAST(started_at AS DATE)) AS active_days, {sums('')} FROM s_in GROUP BY 1""",
    "cr": """
SELECT repo_id, CAST(sum(cost_micro) AS BIGINT) AS total_micro, CAST(coalesce(sum(p_total), 0) AS BIGINT) AS priced_tokens,
  CAST(coalesce(sum(u_total), 0) AS BIGINT) AS unpriced_tokens, count(*) FILTER (p_total IS NOT NULL AND u_total IS NOT NULL) AS partially_priced_models
FROM mu GROUP BY 1""",
    "gm": """
SELECT w.repo_id, coalesce(g.commits, 0) AS commits, coalesce(g.merge_commits, 0) AS merge_commits, coalesce(g.contributors, 0) AS contributors,
  coalesce(g.file_touches, 0) AS file_touches, coalesce(g.insertions, 0) AS insertions, coalesce(g.deletions, 0) AS deletions
FROM w_all w LEFT JOIN (
  SELECT repo_id, count(DISTINCT c.commit_id) AS commits, count(DISTINCT CASE WHEN is_merge THEN c.commit_id END) AS merge_commits,
    count(DISTINCT lower(trim(author))) AS contributors, count(h.commit_id) AS file_touches,
    CAST(coalesce(sum(insertions), 0) AS BIGINT) AS insertions, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deletions
  FROM cm c JOIN w_all w USING (repo_id) LEFT JOIN ch h ON h.commit_id = c.commit_id
  WHERE c.ts BETWEEN w.window_start AND w.window_end GROUP BY 1
) g USING (repo_id)""",
}
