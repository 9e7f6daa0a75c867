"""Oracle SQL of the timeline, signal, profile and receipt queries."""

from __future__ import annotations

from oracles.base import CTES, iso, sid

ARCH = ["Night Owl", "Early Bird", "Weekend Warrior", "Marathon Coder", "Architect", "Quality Guardian", "Shipping Machine", "Explorer"]


def pct(n: str, d: str) -> str:
    return f"(CASE WHEN {d} > 0 THEN CAST(floor(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 100 + 5e-1) AS BIGINT) ELSE 0 END)"


def rnd(x: str) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) + 5e-1) AS BIGINT)"


def cap(x: str) -> str:
    return f"least(100, {rnd(x)})"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST(nullif({b}, 0) AS DOUBLE))"


def tenth(x: str) -> str:
    n = f"CAST(floor({x} * 10 + 5e-1) AS BIGINT)"
    return f"(CASE WHEN {n} % 10 = 0 THEN CAST({n} // 10 AS VARCHAR) ELSE concat({n} // 10, '.', {n} % 10) END)"


def comma(n: str) -> str:
    return f"format('{{:,}}', CAST({n} AS BIGINT))"


def plural(n: str, noun: str) -> str:
    return f"{n} || ' {noun}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


CTES.update(
    {
        "ev": f"""
SELECT repo_id, session_ref, {sid('ev_', 20, 'session_ref', 'kind', 'o', 'at_')} AS evidence_id FROM (
  SELECT repo_id, session_ref, 'session-boundary' AS kind, start_ordinal AS o, {iso('started_at')} AS at_ FROM s_in
  UNION ALL SELECT repo_id, session_ref, 'session-boundary', end_ordinal, {iso('ended_at')} FROM s_in WHERE end_ordinal <> start_ordinal
  UNION ALL SELECT repo_id, session_ref, 'tool-activity', tool_ordinal, {iso('tool_at')} FROM s_in WHERE tool_ordinal IS NOT NULL AND provider = 'codex')""",
        "ev_s": "SELECT repo_id, session_ref, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS refs FROM ev GROUP BY 1, 2",
        "git_ev": f"""
SELECT repo_id, commits, at_, {sid('ev_', 20, "'git-aggregate'", 'content')} AS evidence_id, window_end FROM (
  SELECT g.repo_id, g.commits, w.window_end, {iso('w.window_end')} AS at_, concat(r.fingerprint, chr(0), {iso('w.window_start')}, chr(0), {iso('w.window_end')}, chr(0), g.commits, chr(0),
    g.merge_commits, chr(0), g.contributors, chr(0), g.file_touches, chr(0), g.insertions, chr(0), g.deletions) AS content
  FROM gm g JOIN w_all w USING (repo_id) JOIN repos r USING (repo_id) WHERE g.commits > 0)""",
        "ref_m": "SELECT repo_id, session_ref, list_sort(list(DISTINCT model)) AS models FROM m_all GROUP BY 1, 2",
        "ref_t": "SELECT repo_id, session_ref, list_sort(list(DISTINCT tool)) AS tools FROM t_all GROUP BY 1, 2",
        "tl0": """
SELECT s.*, coalesce(len(m.models), 0) AS n_models, coalesce(t.tools, []) AS tools, coalesce(e.refs, '') AS refs,
  len(list_filter(coalesce(t.tools, []), lambda x: regexp_matches(x, '(?i)(test|lint|typecheck|check|verify|build|pytest|vitest|jest|playwright|cypress)'))) AS n_ver,
  len(list_filter(coalesce(t.tools, []), lambda x: regexp_matches(x, '(?i)(edit|write|patch|apply|replace|create|delete|move|rename|format)')
    AND NOT regexp_matches(x, '(?i)(test|lint|typecheck|check|verify|build|pytest|vitest|jest|playwright|cypress)'))) AS n_mut
FROM s_in s LEFT JOIN ref_m m USING (repo_id, session_ref) LEFT JOIN ref_t t USING (repo_id, session_ref) LEFT JOIN ev_s e USING (repo_id, session_ref)""",
        "tl1": """
SELECT *, len(tools) - n_ver - n_mut AS n_exp, CASE WHEN tool_calls > 0 THEN (len(tools) - n_ver - n_mut > 0)::INT + (n_mut > 0)::INT + (n_ver > 0)::INT ELSE 0 END AS fams FROM tl0""",
        "tl2": """
SELECT repo_id, session_ref, provider, refs, started_at, ended_at, kind, magnitude, measurement, prec, pos FROM tl1, LATERAL (VALUES
  ('session-start', turns, 'turns', 'exact', 0e0),
  ('planning', CASE WHEN plan_turns > 0 THEN plan_turns END, 'turns', 'estimated', 2e-1),
  ('model-shift', CASE WHEN n_models > 1 THEN n_models END, 'models', 'estimated', 35e-2),
  ('exploration', CASE WHEN tool_calls > 0 AND n_exp > 0 THEN n_exp END, 'distinct-tools', 'estimated', 45e-2),
  ('mutation', CASE WHEN tool_calls > 0 AND n_mut > 0 THEN n_mut END, 'distinct-tools', 'estimated',
     45e-2 + (CAST((n_exp > 0)::INT AS DOUBLE) / greatest(1, fams - 1)) * 3e-1),
  ('verification', CASE WHEN tool_calls > 0 AND n_ver > 0 THEN n_ver END, 'distinct-tools', 'estimated',
     45e-2 + (CAST((n_exp > 0)::INT + (n_mut > 0)::INT AS DOUBLE) / greatest(1, fams - 1)) * 3e-1),
  ('delegation', CASE WHEN subagents > 0 THEN subagents END, 'invocations', 'estimated', 8e-1),
  ('session-outcome', CASE WHEN status = 'completed' THEN 1 ELSE 0 END, 'status', 'exact', 1e0)) v(kind, magnitude, measurement, prec, pos)
WHERE magnitude IS NOT NULL""",
        "tl": f"""
SELECT repo_id, session_ref, provider, refs, kind, CAST(magnitude AS BIGINT) AS magnitude, measurement, prec,
  CASE WHEN kind = 'session-start' OR ended_at <= started_at THEN {iso('started_at')} WHEN kind = 'session-outcome' THEN {iso('ended_at')}
  ELSE {iso("(started_at + to_milliseconds(CAST(floor((epoch_ms(ended_at) - epoch_ms(started_at)) * pos + 5e-1) AS BIGINT)))")} END AS at_ FROM tl2
UNION ALL
SELECT repo_id, NULL, 'git', evidence_id, 'repository-milestone', 1, 'milestone', 'exact', at_ FROM git_ev""",
        "ti": f"""
SELECT s.*, s.total AS tokens, greatest(0, {rnd('(epoch_ms(ended_at) - epoch_ms(started_at)) / 60000')}) AS minutes,
  hour(started_at + to_minutes(CAST(utc_offset AS INTEGER))) AS hr, dayofweek(started_at + to_minutes(CAST(utc_offset AS INTEGER))) AS wd,
  strftime(started_at + to_minutes(CAST(utc_offset AS INTEGER)), '%Y-%m-%d') AS dy
FROM s_in s JOIN w_all USING (repo_id)""",
        "med": """
SELECT repo_id, list_sort(list(minutes))[count(*) // 2 + 1] AS med_min, list_sort(list(minutes))[(count(*) + 1) // 2] AS low_min,
  list_sort(list(turns))[count(*) // 2 + 1] AS med_turns, list_sort(list(tokens) FILTER (tokens IS NOT NULL))[count(tokens) // 2 + 1] AS med_tok
FROM ti GROUP BY 1""",
        "rhy": """
SELECT repo_id, count(*) AS n, count(*) FILTER (hr IN (22, 23, 0, 1, 2, 3, 4)) AS night, count(*) FILTER (hr BETWEEN 5 AND 9) AS morning,
  count(*) FILTER (wd IN (0, 6)) AS weekend, count(*) FILTER (status = 'completed') AS completed,
  CAST(sum(coalesce(plan_turns, 0)) AS BIGINT) AS plan_turns, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(coalesce(subagents, 0)) AS BIGINT) AS subagents,
  count(tokens) AS n_tokens FROM ti GROUP BY 1""",
        "x_long": "SELECT repo_id, minutes AS longest, hr AS longest_hr, session_ref AS longest_ref FROM ti QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY minutes DESC, started_at, session_ref) = 1",
        "x_busy": "SELECT repo_id, turns AS talk, session_ref AS talk_ref FROM ti QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY turns DESC, started_at, session_ref) = 1",
        "x_heavy": "SELECT repo_id, tokens AS heavy, session_ref AS heavy_ref FROM ti WHERE tokens IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY tokens DESC, started_at, session_ref) = 1",
        "x_day": "SELECT repo_id, dy, count(*) AS day_n FROM ti GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, dy) = 1",
        "x_wd": "SELECT repo_id, wd, count(*) AS wd_n FROM ti GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, wd) = 1",
        "x_gap": "SELECT repo_id, max(g) AS gap FROM (SELECT repo_id, epoch_ms(started_at) - lag(epoch_ms(started_at)) OVER (PARTITION BY repo_id ORDER BY started_at) AS g FROM ti) GROUP BY 1",
        "x_tool": "SELECT repo_id, tool AS top_tool, calls AS top_calls FROM tu QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY calls DESC, tool) = 1",
        "x_tools": "SELECT repo_id, count(*) AS n_tools, CAST(sum(calls) AS BIGINT) AS listed FROM tu GROUP BY 1",
        "facts": """
SELECT r.*, m.* EXCLUDE (repo_id), l.* EXCLUDE (repo_id), b.* EXCLUDE (repo_id), h.* EXCLUDE (repo_id), d.* EXCLUDE (repo_id), w.* EXCLUDE (repo_id), g.gap,
  x.top_tool, x.top_calls, y.n_tools, CASE WHEN t.tool_calls > 0 THEN t.tool_calls ELSE y.listed END AS calls,
  t.input AS t_input, t.cached AS t_cached, t.reasoning AS t_reasoning, t.total AS t_total, c.* EXCLUDE (repo_id)
FROM rhy r JOIN med m USING (repo_id) JOIN x_long l USING (repo_id) JOIN x_busy b USING (repo_id) LEFT JOIN x_heavy h USING (repo_id) JOIN x_day d USING (repo_id)
JOIN x_wd w USING (repo_id) JOIN x_gap g USING (repo_id) LEFT JOIN x_tool x USING (repo_id) LEFT JOIN x_tools y USING (repo_id) JOIN tot t USING (repo_id) JOIN gm c USING (repo_id)""",
        "cat": """
SELECT repo_id, concat('S', CASE WHEN p < 10 THEN '0' ELSE '' END, p) AS ref, provider, session_ref, ended_at AS at_, turns, assistant_messages, tool_calls FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started_at, session_ref) AS p FROM s_in)
UNION ALL SELECT repo_id, 'GIT', 'git', NULL, window_end, 0, 0, 0 FROM git_ev""",
        "sig0": " UNION ALL ".join(
            f"SELECT repo_id, '{i}' AS id, '{fam}' AS family, {head} AS headline, {detail} AS detail, CAST({value} AS BIGINT) AS value, '{unit}' AS unit, CAST({note} AS BIGINT) AS notability, {ref} AS session_ref FROM facts WHERE {cond}"
            for i, fam, cond, head, detail, value, unit, note, ref in [
                ("night-owl-share", "rhythm", f"{pct('night', 'n')} >= 20", f"{pct('night', 'n')} || '% of sessions began at night (22:00 to 05:00)'", "night || ' of ' || n || ' session starts lie in these hours.'", pct("night", "n"), "%", cap(pct("night", "n") + " * 15e-1"), "NULL"),
                ("longest-session", "rhythm", "longest >= 60 AND med_min > 0 AND longest >= med_min * 2", "'Longest session: ' || longest // 60 || 'h ' || longest % 60 || 'm'",
                 f"'Begun at ' || lpad(longest_hr::VARCHAR, 2, '0') || ':00 local time, ' || {tenth(div('longest', 'med_min'))} || 'x the median session.'", "longest", "minutes", cap(div("longest", "med_min") + " * 15"), "longest_ref"),
                ("busiest-day", "rhythm", "day_n >= 3 AND day_n >= n * 25e-2", "day_n || ' sessions on one day, ' || dy", f"{pct('day_n', 'n')} || '% of all sessions shown.'", "day_n", "sessions", cap(pct("day_n", "n") + " * 15e-1"), "NULL"),
                ("weekend-share", "rhythm", f"{pct('weekend', 'n')} >= 30", f"{pct('weekend', 'n')} || '% of sessions lie on Saturdays and Sundays'", "weekend || ' weekend sessions among ' || n || '.'", pct("weekend", "n"), "%", cap(pct("weekend", "n") + " * 12e-1"), "NULL"),
                ("busiest-weekday", "rhythm", "n >= 4 AND wd_n >= 3 AND wd_n >= n * 28e-2", f"{pct('wd_n', 'n')} || '% of sessions share one weekday: ' || ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][wd + 1]", "wd_n || ' sessions on that weekday among ' || n || '.'", pct("wd_n", "n"), "%", cap(pct("wd_n", "n") + " * 14e-1"), "NULL"),
                ("longest-gap", "rhythm", "n >= 4 AND gap >= 172800000", f"'Longest pause: ' || {rnd('gap / 864e5')} || ' days'", "'Measured between the starts of neighbouring sessions.'", rnd("gap / 864e5"), "days", cap("gap / 864e5 * 8"), "NULL"),
                ("tool-dominance", "tooling", "calls > 0 AND top_calls >= 10", "'Most used tool: ' || top_tool || ' (' || top_calls || ')'", f"{pct('top_calls', 'calls')} || '% of all tool calls.'", "top_calls", "calls", cap(pct("top_calls", "calls") + " * 13e-1"), "NULL"),
                ("tool-breadth", "tooling", "n_tools >= 8", "'Tools in use: ' || n_tools", "'Counted by name, each once.'", "n_tools", "tools", cap("n_tools * 5"), "NULL"),
                ("subagent-usage", "tooling", "subagents > 0", f"'Subagents were started ' || {plural('subagents', 'time')}", "'Runs of child agents, as their logs count them.'", "subagents", "invocations", cap("subagents * 8"), "NULL"),
                ("most-talkative-session", "conversation", "talk >= 10 AND med_turns > 0 AND talk >= med_turns * 2", "'Most turns in one session: ' || talk", f"{tenth(div('talk', 'med_turns'))} || 'x the median session.'", "talk", "turns", cap(div("talk", "med_turns") + " * 15"), "talk_ref"),
                ("completion-rate", "conversation", f"n >= 3 AND {pct('completed', 'n')} <= 60", f"{pct('completed', 'n')} || '% of sessions ended as completed'", "(n - completed) || ' of ' || n || ' have another status.'", pct("completed", "n"), "%", cap("100 - " + pct("completed", "n")), "NULL"),
                ("plan-mode-discipline", "conversation", f"plan_turns > 0 AND {pct('plan_turns', 'turns')} >= 15", f"{pct('plan_turns', 'turns')} || '% of turns were made in plan mode'", "plan_turns || ' of ' || turns || ' turns carry that mode.'", pct("plan_turns", "turns"), "%", cap(pct("plan_turns", "turns") + " * 12e-1"), "NULL"),
                ("cache-hit-ratio", "spend", f"t_input > 0 AND {pct('t_cached', 't_input')} >= 20", f"{pct('t_cached', 't_input')} || '% of input tokens came out of the cache'", f"{comma('t_cached')} || ' of ' || {comma('t_input')} || ' tokens of input.'", pct("t_cached", "t_input"), "%", cap(pct("t_cached", "t_input") + " * 11e-1"), "NULL"),
                ("reasoning-share", "spend", f"t_total > 0 AND t_reasoning > 0 AND {pct('t_reasoning', 't_total')} >= 10", f"{pct('t_reasoning', 't_total')} || '% of all tokens are reasoning'", f"{comma('t_reasoning')} || ' of ' || {comma('t_total')} || ' tokens.'", pct("t_reasoning", "t_total"), "%", cap(pct("t_reasoning", "t_total") + " * 15e-1"), "NULL"),
                ("token-heaviest-session", "spend", "n_tokens >= 2 AND med_tok > 0 AND heavy >= med_tok * 2", f"'Largest session: ' || {comma('heavy')} || ' tokens'", f"{tenth(div('heavy', 'med_tok'))} || 'x the median session in tokens.'", "heavy", "tokens", cap(div("heavy", "med_tok") + " * 12"), "heavy_ref"),
                ("lines-per-commit", "output", f"commits > 0 AND {rnd(div('insertions + deletions', 'commits'))} >= 50", f"'Changed lines per commit: ' || {rnd(div('insertions + deletions', 'commits'))}", f"'+' || {comma('insertions')} || ', -' || {comma('deletions')} || ', ' || commits || ' commits.'", rnd(div("insertions + deletions", "commits")), "lines", cap(rnd(div("insertions + deletions", "commits")) + " / 3"), "NULL"),
                ("merge-ratio", "output", f"commits > 0 AND merge_commits > 0 AND {pct('merge_commits', 'commits')} >= 10", f"{pct('merge_commits', 'commits')} || '% of commits are merges'", "merge_commits || ' merges, ' || commits || ' commits.'", pct("merge_commits", "commits"), "%", cap(pct("merge_commits", "commits")), "NULL"),
            ]
        ),
        "sig": """
SELECT s.*, coalesce(c.ref, '') AS source_refs, row_number() OVER (PARTITION BY s.repo_id ORDER BY notability DESC, id) AS rank
FROM sig0 s LEFT JOIN cat c ON c.repo_id = s.repo_id AND c.session_ref = s.session_ref""",
        "fam": """
SELECT repo_id, coalesce(sum(calls) FILTER (f = 'e'), 0) AS ex, coalesce(sum(calls) FILTER (f = 'm'), 0) AS mu_calls, coalesce(sum(calls) FILTER (f = 'v'), 0) AS ve FROM (
  SELECT *, CASE WHEN regexp_matches(lower(tool), 'read|grep|glob|search|find|list') THEN 'e' WHEN regexp_matches(lower(tool), 'edit|write|applypatch|create|delete|move') THEN 'm'
    WHEN regexp_matches(lower(tool), 'test|run|shell|terminal|bash|check|lint|build|review') THEN 'v' ELSE 'o' END AS f FROM tu) GROUP BY 1""",
        "sc0": """
SELECT w.repo_id, coalesce(t.turns, 0)::DOUBLE AS turns, coalesce(t.plan_turns, 0)::DOUBLE AS plan, coalesce(t.assistant_messages, 0)::DOUBLE AS am, coalesce(t.sessions, 0)::DOUBLE AS n,
  greatest(coalesce(t.active_days, 0), 1)::DOUBLE AS days, coalesce(t.tool_calls, 0)::DOUBLE AS calls, coalesce(t.subagents, 0)::DOUBLE AS sub, coalesce(t.completed, 0)::DOUBLE AS done,
  coalesce(f.ex, 0)::DOUBLE AS ex, coalesce(f.mu_calls, 0)::DOUBLE AS mc, coalesce(f.ve, 0)::DOUBLE AS ve, coalesce(y.n_tools, 0)::DOUBLE AS refs, g.commits::DOUBLE AS commits, g.insertions::DOUBLE AS ins
FROM w_all w LEFT JOIN tot t USING (repo_id) LEFT JOIN fam f USING (repo_id) LEFT JOIN x_tools y USING (repo_id) JOIN gm g USING (repo_id)""",
        "sc": f"""
SELECT repo_id, {', '.join(f"CAST(greatest(0, least(100, floor({e} + 5e-1))) AS BIGINT) AS {n}" for n, e in [
    ("planning", "(CASE WHEN turns > 0 THEN plan / turns ELSE 0 END * 6e-1 + CASE WHEN ex + mc > 0 THEN ex / (ex + mc) ELSE 0 END * 4e-1) * 100"),
    ("steering", "least(1e0, CASE WHEN am > 0 THEN turns / am ELSE 0 END / 3) * 100"),
    ("execution", "(least(1e0, commits / days / 5) * 4e-1 + least(1e0, ins / days / 1000) * 3e-1 + least(1e0, calls / greatest(n, 1e0) / 50) * 3e-1) * 100"),
    ("engineering", "(least(1e0, refs / 12) * 4e-1 + ve / greatest(calls, 1e0) * 4e-1 + least(1e0, sub / greatest(n, 1e0) / 3) * 2e-1) * 100"),
    ("product_instinct", "CASE WHEN n > 0 THEN done / n ELSE 0 END * CASE WHEN turns > 0 THEN plan / turns ELSE 0 END * 100"),
])} FROM sc0""",
        "top_h": "SELECT repo_id, list(hr ORDER BY c DESC, hr) AS peak_hours FROM (SELECT repo_id, hr, count(*) AS c FROM ti GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, hr) <= 3) GROUP BY 1",
        "top_d": "SELECT repo_id, list(wd ORDER BY c DESC, wd) AS peak_days FROM (SELECT repo_id, wd, count(*) AS c FROM ti GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, wd) <= 3) GROUP BY 1",
        "wp": f"""
SELECT w.repo_id, h.peak_hours, list_transform(d.peak_days, lambda x: ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][x + 1]) AS preferred_days,
  {rnd('(coalesce(m.low_min, 0) + coalesce(m.med_min, 0)) / 2')} AS median_minutes, coalesce(l.longest, 0) AS longest_minutes,
  (SELECT arg_min(model_provider || ':' || model, lpad((100000000 - calls)::VARCHAR, 12, '0') || model_provider || ':' || model) FROM mu WHERE mu.repo_id = w.repo_id) AS primary_model,
  CASE WHEN w.utc_offset = 0 THEN 'UTC' ELSE concat('UTC', CASE WHEN w.utc_offset > 0 THEN '+' ELSE '-' END, lpad((abs(w.utc_offset) // 60)::VARCHAR, 2, '0'), ':', lpad((abs(w.utc_offset) % 60)::VARCHAR, 2, '0')) END AS timezone_label,
  {', '.join(f"coalesce(CAST(floor(r.{c}::DOUBLE * 100 / r.n::DOUBLE + 5e-1) AS BIGINT), 0) AS {c}_share" for c in ("night", "morning", "weekend"))},
  coalesce(y.n_tools, 0) AS distinct_tools
FROM w_all w LEFT JOIN rhy r USING (repo_id) LEFT JOIN med m USING (repo_id) LEFT JOIN x_long l USING (repo_id) LEFT JOIN x_tools y USING (repo_id) LEFT JOIN top_h h USING (repo_id) LEFT JOIN top_d d USING (repo_id)""",
        "arch": f"""
SELECT repo_id, coalesce(name, 'Shipping Machine') AS archetype, coalesce(why, 'No other rule applies; execution has ' || execution || ' points.') AS rationale FROM sc JOIN wp USING (repo_id) LEFT JOIN (
  SELECT repo_id, name, why FROM sc JOIN wp USING (repo_id), LATERAL (VALUES
    (0, 'Night Owl', CASE WHEN night_share >= 20 THEN night_share END, night_share || '% of sessions start from 22:00 to 05:00 ' || timezone_label || '.'),
    (1, 'Early Bird', CASE WHEN morning_share >= 20 THEN morning_share END, morning_share || '% of sessions start from 05:00 to 10:00 ' || timezone_label || '.'),
    (2, 'Weekend Warrior', CASE WHEN weekend_share >= 30 THEN weekend_share END, weekend_share || '% of sessions are on Saturdays and Sundays.'),
    (3, 'Marathon Coder', CASE WHEN median_minutes > 0 AND longest_minutes >= 60 AND longest_minutes >= median_minutes * 2
       THEN least(100, {rnd("floor(" + div('longest_minutes', 'median_minutes') + " * 10 + 5e-1) / 10 * 20")}) END,
       'The longest session takes ' || longest_minutes || ' minutes, ' || {tenth(div('longest_minutes', 'median_minutes'))} || ' times the median.'),
    (4, 'Architect', CASE WHEN planning >= 70 AND engineering >= 60 THEN {rnd('(planning + engineering) / 2')} END, 'Scores: planning ' || planning || ', engineering ' || engineering || '.'),
    (5, 'Quality Guardian', CASE WHEN engineering >= 70 AND planning >= 55 THEN engineering END, 'Scores: engineering ' || engineering || ', planning ' || planning || '.'),
    (7, 'Explorer', CASE WHEN distinct_tools >= 8 THEN least(100, distinct_tools * 8) END, 'Number of tools: ' || distinct_tools || '.')
  ) v(o, name, score, why) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, o) = 1
) USING (repo_id)""",
        "dn": """
SELECT s.repo_id, strftime(s.started_at, '%Y-%m-%d') AS day, coalesce(m.models[1], 'unknown') AS name, count(*) AS sessions, sum(coalesce(s.total, 0)) AS tokens
FROM s_in s LEFT JOIN ref_m m USING (repo_id, session_ref) GROUP BY ALL""",
        "rate": """
SELECT repo_id, name, cost_micro::DOUBLE AS rc, total::DOUBLE AS rt FROM (
  SELECT d.repo_id, d.name, m.cost_micro, m.total FROM (SELECT DISTINCT repo_id, name FROM dn) d JOIN mu m ON m.repo_id = d.repo_id
    AND (m.model = d.name OR starts_with(d.name, m.model) OR starts_with(m.model, d.name))
  QUALIFY row_number() OVER (PARTITION BY d.repo_id, d.name ORDER BY m.model = d.name DESC, m.model_provider, m.model) = 1
) WHERE cost_micro IS NOT NULL AND total > 0""",
        "ds0": "SELECT d.*, CASE WHEN d.tokens > 0 THEN d.tokens::DOUBLE * r.rc / r.rt END AS spend FROM dn d LEFT JOIN rate r USING (repo_id, name)",
        "ds": """
SELECT repo_id, day, CAST(sum(sessions) AS BIGINT) AS sessions, coalesce(list_reduce(list_prepend(0e0, list(spend ORDER BY name) FILTER (spend IS NOT NULL)), lambda a, b: a + b), 0e0) AS spend_micro,
  arg_max(name, spend) FILTER (spend > 0) AS top_model FROM ds0 GROUP BY 1, 2""",
    }
)

SQL = {
    "milestones": f"""
SELECT s.repo_id, {sid('mil_', 20, "'session-activity'", 's.session_ref')} AS milestone_id, 'session-activity' AS kind,
  CASE s.provider WHEN 'codex' THEN 'Codex' ELSE 'Claude Code' END || ' session activity' AS title, {iso('ended_at')} AS occurred_at, coalesce(e.refs, '') AS evidence_refs
FROM s_in s LEFT JOIN ev_s e USING (repo_id, session_ref)
UNION ALL SELECT repo_id, {sid('mil_', 20, "'repository-activity'", 'evidence_id')}, 'repository-activity', 'Repository activity', at_, evidence_id FROM git_ev""",
    "timeline": f"""
SELECT repo_id, session_ref, provider, kind, at_ AS occurred_at, magnitude, measurement, prec AS temporal_precision, refs AS source_refs,
  {sid('evt_', 20, "coalesce(session_ref, '')", 'provider', 'kind', 'at_', 'magnitude', 'measurement', 'prec', 'refs')} AS event_id,
  CASE kind WHEN 'session-start' THEN 'Session opened' WHEN 'planning' THEN 'Plan-first work' WHEN 'model-shift' THEN 'Model context changed'
    WHEN 'exploration' THEN 'Exploration tools observed' WHEN 'mutation' THEN 'Build tools observed' WHEN 'verification' THEN 'Verification tools observed'
    WHEN 'delegation' THEN 'Subagent work delegated' WHEN 'session-outcome' THEN 'Session closed' ELSE 'Repository milestone' END AS label,
  CASE WHEN kind IN ('session-start', 'exploration') THEN 'discover' WHEN kind IN ('planning', 'model-shift', 'mutation') THEN 'decide' ELSE 'deliver' END AS phase
FROM tl""",
    "timeline_coverage": """
SELECT t.repo_id, t.events, s.sessions + g.g AS milestones, s.sessions FROM (SELECT repo_id, count(*) AS events FROM tl GROUP BY 1) t
JOIN (SELECT repo_id, count(*) AS sessions FROM s_in GROUP BY 1) s USING (repo_id) JOIN (SELECT w.repo_id, count(e.repo_id) AS g FROM w_all w LEFT JOIN git_ev e USING (repo_id) GROUP BY 1) g USING (repo_id)""",
    "signals": "SELECT repo_id, id, family, headline, detail, value, unit, notability, source_refs, CAST(rank AS INTEGER) AS rank FROM sig",
    "source_catalog": f"""
SELECT c.repo_id, c.ref, c.provider, c.session_ref, {iso('c.at_')} AS occurred_at, coalesce(e.refs, g.evidence_id, '') AS evidence_refs, CAST(c.turns AS BIGINT) AS turns,
  CAST(c.assistant_messages AS BIGINT) AS assistant_messages, CAST(c.tool_calls AS BIGINT) AS tool_calls
FROM cat c LEFT JOIN ev_s e USING (repo_id, session_ref) LEFT JOIN git_ev g ON g.repo_id = c.repo_id AND c.ref = 'GIT'""",
    "profile_scores": "SELECT * FROM sc",
    "work_patterns": "SELECT * REPLACE (array_to_string(peak_hours, ',') AS peak_hours, array_to_string(preferred_days, ',') AS preferred_days) FROM wp",
    "archetype": "SELECT * FROM arch",
    "receipt_tiles": """
SELECT t.repo_id, c.total_micro AS spend_micro, coalesce(t.total, 0) AS tokens, t.sessions,
  (SELECT model FROM mu WHERE mu.repo_id = t.repo_id AND cost_micro IS NOT NULL ORDER BY cost_micro DESC, model_provider, model LIMIT 1) AS top_spend_model
FROM tot t LEFT JOIN cr c USING (repo_id)""",
    "spend_share": """
SELECT repo_id, CAST(position AS INTEGER) AS position, model, cost_micro, floor(cost_micro::DOUBLE / all_micro::DOUBLE * 1000 + 5e-1) / 10 AS percent FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY cost_micro DESC, model_provider, model) AS position, sum(cost_micro) OVER (PARTITION BY repo_id) AS all_micro
  FROM mu WHERE cost_micro > 0) WHERE position <= 8""",
    "unpriced_share": """
SELECT repo_id, CASE WHEN t.total > 0 AND unpriced_tokens > 0 THEN floor(unpriced_tokens::DOUBLE / t.total::DOUBLE * 1000 + 5e-1) / 10 END AS unpriced_percent
FROM tot t JOIN cr USING (repo_id)""",
    "daily_spend": "SELECT repo_id, day, sessions, CAST(round(spend_micro) AS BIGINT) AS spend_micro, top_model, spend_micro <= 0 AS unpriced FROM ds",
    "daily_downsample": """
SELECT repo_id, day, sessions FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY repo_id) AS n FROM ds
) WHERE n <= 10 OR list_contains(list_transform(range(10), lambda j: CAST(floor(j * (n::DOUBLE / 10)) AS BIGINT)), i)""",
    "hour_profile": """
SELECT h.repo_id, string_agg(CASE WHEN coalesce(c.n, 0) = 0 THEN '·' WHEN c.n::DOUBLE / p.peak >= 5e-1 THEN '#' ELSE '+' END, '' ORDER BY h.h) AS profile
FROM (SELECT repo_id, unnest(range(24)) AS h FROM tot) h LEFT JOIN (SELECT repo_id, hour(started_at) AS h, count(*) AS n FROM s_in GROUP BY 1, 2) c USING (repo_id, h)
JOIN (SELECT repo_id, max(n) AS peak FROM (SELECT repo_id, hour(started_at), count(*) AS n FROM s_in GROUP BY 1, 2) GROUP BY 1) p USING (repo_id) GROUP BY 1""",
    "top_sessions": f"""
SELECT repo_id, CAST(position AS INTEGER) AS position, session_ref FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, session_ref) AS position FROM s_in) WHERE position <= 16""",
    "usage_suffix": """
SELECT repo_id, CASE WHEN coalesce(t.total, 0) = 0 THEN '' ELSE ', ' || CASE WHEN t.total >= 1000000000 THEN concat((t.total * 10 + 500000000) // 1000000000 // 10, '.', (t.total * 10 + 500000000) // 1000000000 % 10, 'B')
    WHEN t.total >= 1000000 THEN concat((t.total * 10 + 500000) // 1000000 // 10, '.', (t.total * 10 + 500000) // 1000000 % 10, 'M')
    WHEN t.total >= 1000 THEN concat((t.total * 10 + 500) // 1000 // 10, '.', (t.total * 10 + 500) // 1000 % 10, 'K') ELSE t.total::VARCHAR END || ' tokens'
  || CASE WHEN total_micro IS NULL THEN '' ELSE concat(', est. $', (total_micro + 5000) // 10000 // 100, '.', lpad(((total_micro + 5000) // 10000 % 100)::VARCHAR, 2, '0')) END END AS suffix
FROM tot t LEFT JOIN cr USING (repo_id)""",
    "reasoned_narrative": """
SELECT repo_id, section, CAST(position AS INTEGER) AS position, text FROM arch JOIN sc USING (repo_id) JOIN wp USING (repo_id), LATERAL (VALUES
  ('headline', 0, archetype || ', from the numbers'),
  ('narrative', 0, concat('By its scores this repository is closest to ', archetype, '. The scores: planning ', planning, ', steering ', steering, ', execution ', execution,
    ', engineering ', engineering, ', productInstinct ', product_instinct, '. They count what the logs and commits record and say nothing about reasons.')),
  ('turningPoint', 0, 'What decided it: ' || rationale),
  ('learnings', 0, 'Model with most calls: ' || coalesce(primary_model, 'none recorded') || '.'),
  ('learnings', 1, 'Hours with most sessions: ' || array_to_string(list_transform(peak_hours, lambda h: lpad(h::VARCHAR, 2, '0') || ':00'), ', ') || ' ' || timezone_label || '.'),
  ('learnings', 2, 'Half of the sessions are shorter than ' || median_minutes || ' minutes.'),
  ('decisionPatterns', 0, 'Counts of plan turns, reading tools, writing tools and commits were set against each other.'),
  ('standoutTraits', 0, archetype || ' has the highest points of all types whose rule holds.'),
  ('standoutTraits', 1, concat('Highest of the five scores: ', CASE greatest(planning, steering, execution, engineering, product_instinct)
    WHEN planning THEN 'planning' WHEN steering THEN 'steering' WHEN execution THEN 'execution' WHEN engineering THEN 'engineering' ELSE 'productInstinct' END, '.')),
  ('growthEdge', 0, 'The scores are rough; that of product instinct rests on two counts only.')) v(section, position, text)""",
}
