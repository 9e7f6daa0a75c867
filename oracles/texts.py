"""Oracle SQL of the quality, redaction, publishing and evidence queries."""

from __future__ import annotations

from oracles.base import CTES, iso, sid
from sessionloom.functions.redaction import _B, CONTROL, LOCATION_RULES, SECRET_RULES
from sessionloom.functions.text import SPACES
from sessionloom.operators.quality import ASSUMPTIONS, PROVIDERS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The rule without look-around: RE2 has \\b for ASCII, and the rest is rewritten."""
    out = pattern.replace(_B, r"\b")
    out = out.replace("(?!git@)", "")
    out = out.replace('\\"', '"')
    for quote in "\"'`":
        out = out.replace(rf"/(?!/))[^{quote}\r\n]+{quote}", rf"/[^{quote}/\r\n])[^{quote}\r\n]*{quote}")
    out = out.replace(r"/(?!/)[^" + SPACES + "<>()\"'`]+", "/[^" + SPACES + "/<>()\"'`][^" + SPACES + "<>()\"'`]*")
    out = out.replace(r"(?=\z|[" + SPACES + ")\"'`,;])", r"(\z|[" + SPACES + ")\"'`,;])")
    assert "(?!" not in out and "(?=" not in out and "(?<" not in out, out
    return out


def pattern(rule) -> str:
    return q(("(?i)" if rule.ignore_case else "") + re2(rule.pattern))


def replaced(text: str, rule) -> str:
    target = rule.replacement.replace("$1", "\\1")
    if "(?=" in rule.pattern.replace(_B, ""):
        target += "\\2"
        once = f"regexp_replace({text}, {pattern(rule)}, {q(target)}, 'g')"
        return f"regexp_replace({once}, {pattern(rule)}, {q(target)}, 'g')"
    return f"regexp_replace({text}, {pattern(rule)}, {q(target)}, 'g')"


TOKENS = r"list_distinct(list_filter(regexp_extract_all({t}, '\b[A-Za-z0-9+/_=-]{{32,160}}\b'), lambda x: NOT regexp_full_match(x, '[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{64}}')" \
    " AND NOT contains(x, 'REDACTED') AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]') AND list_aggregate(string_split(x, ''), 'entropy') >= 43e-1))"


def hide_random(t: str) -> str:
    return f"list_reduce(list_prepend({t}, {TOKENS.format(t=t)}), lambda acc, x: replace(acc, x, '[REDACTED:high-entropy]'))"


def chain(rules, column: str, source: str, count: bool = False) -> str:
    """One nested select per rule."""
    sql = source
    for i, rule in enumerate(rules):
        extra = f", len(regexp_extract_all({column}, {pattern(rule)})) AS n{i}" if count else ""
        sql = f"SELECT * REPLACE ({replaced(column, rule)} AS {column}){extra} FROM ({sql})"
    return sql


def trimmed(t: str) -> str:
    control = q(CONTROL)
    return f"regexp_replace(regexp_replace(regexp_replace({t}, {control}, '', 'g'), {q(f'^[{SPACES}]+')}, ''), {q(f'[{SPACES}]+' + chr(92) + 'z')}, '')"


def found(rules, text: str) -> str:
    pairs = ", ".join(f"CASE WHEN regexp_matches({text}, {pattern(r)}) THEN '{r.category}' END" for r in rules)
    return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{pairs}], lambda x: x IS NOT NULL))), ','), '')"


def metadata() -> str:
    start = "SELECT doc_id, repo_id, nfc_normalize(text) AS t FROM dt"
    steps = chain(SECRET_RULES, "t", start, count=True)
    steps = f"SELECT * REPLACE ({hide_random('t')} AS t), len({TOKENS.format(t='t')}) AS ne FROM ({steps})"
    steps = f"SELECT *, len(regexp_extract_all(t, {q(CONTROL)})) AS nc, {trimmed('t')} AS shown FROM ({steps})"
    return steps


def summary() -> str:
    by_category: dict[str, list[str]] = {}
    for i, rule in enumerate(SECRET_RULES):
        by_category.setdefault(rule.category, []).append(f"n{i}")
    by_category |= {"high-entropy": ["ne"], "control-character": ["nc"]}
    rows = ", ".join(f"('{c}', {' + '.join(n)})" for c, n in by_category.items())
    return f"SELECT repo_id, category, CAST(sum(n) AS BIGINT) AS findings FROM ({metadata()}), LATERAL (VALUES {rows}) v(category, n) WHERE n > 0 GROUP BY ALL"


def excerpt(source: str, limit: int) -> str:
    """``clean`` from column ``text`` of ``source``; null if a secret is found."""
    hit = " OR ".join(f"regexp_matches(t, {pattern(r)})" for r in SECRET_RULES)
    start = f"SELECT *, nfc_normalize(text) AS t FROM {source}"
    start = f"SELECT * REPLACE (CASE WHEN NOT ({hit}) THEN {hide_random('t')} END AS t) FROM ({start})"
    steps = chain(LOCATION_RULES, "t", start)
    shown = f"SELECT *, {trimmed('t')} AS shown FROM ({steps})"
    return f"SELECT * EXCLUDE (t, shown), CASE WHEN shown = '' THEN NULL WHEN length(shown) > {limit} THEN left(shown, {limit - 1}) || '…' ELSE shown END AS clean FROM ({shown})"


EMAIL = LOCATION_RULES[0]

CTES.update(
    {
        "dt": "SELECT doc_id, doc_id % 7 AS repo_id, text FROM documents",
        "wn": """
SELECT repo_id, session_ref, code, severity, message FROM (
  SELECT s.*, coalesce(t.tools, []) AS tools, m.models, CASE provider WHEN 'codex' THEN 'Codex' ELSE 'Claude Code' END AS label FROM s_in s
  LEFT JOIN ref_m m USING (repo_id, session_ref) LEFT JOIN ref_t t USING (repo_id, session_ref)
), LATERAL (VALUES
  (models IS NULL, 'SESSION_MODEL_UNKNOWN', 'info', 'No model identifier was present in the session metadata.'),
  (provider = 'codex' AND EXISTS (SELECT 1 FROM c_tok c WHERE c.source_id = s.source_id AND c.repo = s.repo_id AND c.model = 'unknown-model'), 'SESSION_MODEL_UNKNOWN', 'info',
    'At least one token count was recorded before any model identifier was established and was billed under a placeholder model name.'),
  (status = 'incomplete' AND source_kind = 'active', 'SESSION_ACTIVE_AT_SCAN_END', 'info', 'An active ' || label || ' session had no completion marker at the observed boundary.')
) v(holds, code, severity, message) WHERE holds
UNION ALL
SELECT DISTINCT p.repo, NULL, 'SESSION_MODEL_UNKNOWN', 'info', 'No model identifier was present in an assistant message.' FROM r1 m JOIN r_place p USING (source_id) JOIN repos r ON r.repo_id = p.repo
WHERE m.child_id IS NULL AND m.rec_type = 'assistant' AND m.has_message AND NOT coalesce(m.is_sidechain, false) AND coalesce(m.model, '') = '' AND m.ordinal >= p.scope_ordinal
UNION ALL
SELECT s.repo_id, s.session_ref, v.code, 'warning', v.message FROM s_in s JOIN (
  SELECT source_id, count(*) FILTER (event_id % 37 = 5 OR event_id % 41 = 3) AS bad, count(*) FILTER (event_id % 61 = 2 AND NOT (event_id % 37 = 5 OR event_id % 41 = 3)) AS big
  FROM (SELECT source_id, event_id FROM c1 UNION ALL SELECT source_id, event_id FROM r1 WHERE child_id IS NULL) GROUP BY 1
) a USING (source_id), LATERAL (VALUES (bad > 0, 'SESSION_LINE_INVALID_JSON', 'At least one JSONL record was invalid and ignored.'),
  (big > 0, 'SESSION_LINE_TOO_LARGE', 'At least one JSONL record exceeded the 4 MiB safety limit and was ignored.')) v(holds, code, message) WHERE holds
UNION ALL
SELECT r.repo_id, NULL, 'SESSION_MISSING_METADATA', 'info', v.message FROM repos r, (VALUES
  (EXISTS (SELECT 1 FROM (SELECT source_id, bool_or(rec_type = 'session_meta') AS meta FROM c_rows GROUP BY 1) l WHERE NOT meta AND NOT EXISTS (SELECT 1 FROM c_in c WHERE c.source_id = l.source_id)),
   'A Codex JSONL file had no repository-scoping metadata in its discovery prefix.'),
  (EXISTS (SELECT 1 FROM r_logs l WHERE l.raw_id IS NULL AND l.started_at IS NULL), 'A Claude Code transcript had no repository-scoping metadata in its discovery prefix.')) v(holds, message) WHERE holds
UNION ALL
SELECT repo_id, NULL, 'CURSOR_ROOT_UNAVAILABLE', 'info', 'Cursor''s local workspace storage directory was not found; treated as not installed.' FROM repos""".replace(
            "c.source_id = s.source_id AND c.repo = s.repo_id", "c.source_id = source_id_ AND c.repo = repo_id_"
        ).replace("SELECT s.*, coalesce", "SELECT s.*, s.source_id AS source_id_, s.repo_id AS repo_id_, coalesce"),
        "cv0": """
SELECT conv_id % 7 AS repo_id, CASE conv_id % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' ELSE 'cursor' END AS provider, CAST(conv_id AS VARCHAR) AS session_ref,
  conv_id, turn, role, text, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts FROM conversations""",
        "cv1": """
SELECT repo_id, provider, session_ref, turn * 2 AS o, ts, text,
  CASE WHEN role = 'system' THEN CASE WHEN provider = 'claude-code' THEN 'title' END WHEN role = 'user' THEN 'U' WHEN length(text) <= 600 THEN 'A' END AS sig,
  CASE WHEN role = 'user' THEN CASE WHEN turn % 4 < 2 THEN 'plan' ELSE 'default' END END AS mode FROM cv0
UNION ALL
SELECT repo_id, provider, session_ref, turn * 2 + 1, ts, NULL, CASE WHEN provider <> 'claude-code' OR conv_id % 5 <> 0 THEN 'T' END, NULL
FROM cv0 WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0""",
        "cv2": """
SELECT *, lead(sig) OVER (PARTITION BY session_ref ORDER BY o) AS next_sig FROM cv1 WHERE sig IN ('U', 'A', 'T')""",
        "cv3": """
SELECT *, row_number() OVER (PARTITION BY session_ref ORDER BY o) AS u_first, row_number() OVER (PARTITION BY session_ref ORDER BY o DESC) AS u_last,
  lag(mode) OVER (PARTITION BY session_ref ORDER BY o) AS mode_before FROM cv1 WHERE sig = 'U'""",
        "cv4": """
SELECT repo_id, provider, session_ref, o, ts, text, 0 AS stage, 'session-title' AS role FROM cv1 WHERE sig = 'title' QUALIFY row_number() OVER (PARTITION BY session_ref ORDER BY o) = 1
UNION ALL SELECT repo_id, provider, session_ref, o, ts, text, 1, 'user-intent' FROM cv3 WHERE u_first = 1
UNION ALL SELECT repo_id, provider, session_ref, o, ts, text, 2, 'plan-transition' FROM cv3 WHERE provider = 'claude-code' AND mode <> mode_before
UNION ALL SELECT repo_id, provider, session_ref, o, ts, text, 2, 'assistant-decision' FROM cv2 WHERE sig = 'A' AND (provider = 'cursor' OR next_sig = 'T')""",
        "cv5": """
SELECT * FROM cv4 UNION ALL SELECT repo_id, provider, session_ref, o, ts, text, 3, 'outcome' FROM cv3 u
WHERE u_last = 1 AND NOT EXISTS (SELECT 1 FROM cv4 c WHERE c.session_ref = u.session_ref AND c.text = u.text)""",
        "cand": "SELECT *, row_number() OVER (PARTITION BY session_ref ORDER BY stage, o) - 1 AS pos FROM cv5",
    }
)


def selection(max_excerpts: int, max_chars: int, total: int, per_session: int, decisions: int, total_bytes: int = 1 << 60) -> str:
    """The greedy pass as a recursive query, one candidate per step and repository."""
    return f"""
fold_in AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pos, provider, session_ref) AS step FROM ({excerpt('cand', max_chars)})),
fold AS (
  SELECT repo_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS kept, CAST(0 AS BIGINT) AS chars, CAST(0 AS BIGINT) AS bytes, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS decided, CAST('' AS VARCHAR) AS verdict FROM fold_in GROUP BY 1
  UNION ALL
  SELECT repo_id, step, kept + (verdict = 'kept')::INT, chars + CASE WHEN verdict = 'kept' THEN size ELSE 0 END, bytes + CASE WHEN verdict = 'kept' THEN octets ELSE 0 END,
    CASE WHEN verdict = 'kept' THEN list_append(taken, session_ref) ELSE taken END,
    CASE WHEN verdict = 'kept' AND role = 'assistant-decision' THEN list_append(decided, session_ref) ELSE decided END, verdict
  FROM (
    SELECT f.repo_id, i.step, f.kept, f.chars, f.bytes, f.taken, f.decided, i.session_ref, i.role, length(i.clean) AS size, strlen(i.clean) AS octets,
      CASE WHEN f.kept >= {max_excerpts} THEN 'budget' WHEN len(list_filter(f.taken, lambda x: x = i.session_ref)) >= {per_session} THEN 'budget'
        WHEN i.role = 'assistant-decision' AND len(list_filter(f.decided, lambda x: x = i.session_ref)) >= {decisions} THEN 'budget'
        WHEN i.clean IS NULL THEN 'redaction' WHEN f.chars + length(i.clean) > {total} OR f.bytes + strlen(i.clean) > {total_bytes} THEN 'budget' ELSE 'kept' END AS verdict
    FROM fold f JOIN fold_in i ON i.repo_id = f.repo_id AND i.step = f.step + 1
  )
)"""


def recursive(sql: str, parts: str) -> str:
    """Composed statement with the recursive parts put before the final select."""
    return f"/*fold*/{parts}/*end*/{sql}"


CTES["mu_doc"] = "SELECT repo_id, model_provider, model, calls, cost_micro, repriced, p_total AS pt FROM mu"
CTES["snap"] = f"""
SELECT w_all.repo_id, {iso('window_start')} AS ws, {iso('window_end')} AS we, sessions, turns, CAST(tool_calls AS BIGINT) AS tool_calls,
  concat_ws(',' || chr(10), '      "cache_read": ' || read, '      "input": ' || input, '      "output": ' || output) AS string_agg_tokens
FROM w_all JOIN tot USING (repo_id)"""
CTES["cl"] = """
SELECT repo_id, p, concat('moments.', p, '.title') AS path, CASE WHEN p % 11 = 0 THEN '' ELSE concat('Session with ', turns, ' turns') END AS text,
  CASE WHEN p % 13 = 0 THEN [] ELSE [ref, CASE WHEN p % 5 = 0 THEN 'S999' WHEN p % 7 = 0 THEN ref ELSE 'S01' END] END AS refs
FROM (SELECT *, CAST(substr(ref, 2) AS INTEGER) AS p FROM cat WHERE ref LIKE 'S%')"""
CTES["cl_ref"] = """
SELECT *, EXISTS (SELECT 1 FROM cat WHERE cat.repo_id = x.rid AND cat.ref = x.r) AS known FROM (
  SELECT repo_id, repo_id AS rid, p, path, refs, unnest(refs) AS r, generate_subscripts(refs, 1) AS i FROM cl) x"""

_DEFAULT = selection(40, 600, 20000, 6, 3)
_CLOUD = selection(80, 800, 60000, 8, 4)
_DEEP = selection(400, 1500, 700 * 1024, 12, 6, 700 * 1024)
_TIGHT = selection(30, 300, 3000, 2, 1, 3100)

_CHOSEN = f"""
SELECT i.repo_id, {sid('exc_', 20, 'i.session_ref', 'i.role', iso('i.ts'), 'f.kept - 1')} AS excerpt_id, i.provider, i.session_ref, {iso('i.ts')} AS occurred_at, i.role, i.clean AS text, f.kept - 1 AS index
FROM fold f JOIN fold_in i USING (repo_id, step) WHERE f.verdict = 'kept'"""
_AUDITED = """
SELECT i.repo_id, i.provider, count(*) AS candidates, count(*) FILTER (verdict = 'kept') AS kept, count(*) FILTER (verdict = 'redaction') AS by_redaction,
  count(*) FILTER (verdict = 'budget') AS by_budget FROM fold f JOIN fold_in i USING (repo_id, step) GROUP BY 1, 2"""

SQL = {
    "provider_selection": f"""
SELECT r.repo_id, p.provider, CASE p.provider WHEN 'codex' THEN (SELECT count(DISTINCT source_id) FROM c0) WHEN 'claude-code' THEN (SELECT count(DISTINCT source_id) FROM r0) ELSE 0 END AS files,
  (SELECT count(*) FROM s_dedup s WHERE s.repo_id = r.repo_id AND s.provider = p.provider) AS matched, (SELECT count(*) FROM s_in s WHERE s.repo_id = r.repo_id AND s.provider = p.provider) AS included,
  CASE WHEN NOT p.metadata THEN 'format-unsupported' WHEN p.provider = 'cursor' THEN 'not-installed' ELSE 'scanned' END AS diagnostic
FROM repos r, (VALUES {', '.join(f"('{p[0]}', {p[3]})" for p in PROVIDERS)}) p(provider, metadata)""",
    "warnings": "SELECT DISTINCT repo_id, session_ref, code, severity, message FROM wn",
    "quality": """
SELECT repo_id, CASE WHEN count(w.code) FILTER (severity = 'warning') = 0 THEN 'high' WHEN count(w.code) FILTER (severity = 'warning') <= 5 THEN 'medium' ELSE 'low' END AS level,
  count(w.code) AS warning_count, CAST(0 AS INTEGER) AS skipped_files FROM repos LEFT JOIN (SELECT DISTINCT * FROM wn) w USING (repo_id) GROUP BY 1""",
    "assumptions": f"""
SELECT r.repo_id, CAST(a.position AS INTEGER) AS position, a.text FROM (SELECT DISTINCT repo_id FROM s_in) r, (VALUES {', '.join(f"({i}, {q(p) if p else 'NULL'}, {q(t)})" for i, (p, t) in enumerate(ASSUMPTIONS))}) a(position, needs, text)
WHERE a.needs IS NULL OR EXISTS (SELECT 1 FROM s_in s WHERE s.repo_id = r.repo_id AND s.provider = a.needs)""",
    "redact_metadata": f"""
SELECT doc_id, CASE WHEN shown = '' THEN 'unknown' WHEN length(shown) > 1000 THEN left(shown, 999) || '…' ELSE shown END AS clean,
  length(shown) > 1000 AS truncated FROM ({metadata()})""",
    "redaction_summary": summary(),
    "redact_excerpt": f"SELECT doc_id, clean FROM ({excerpt('dt', 2000)})",
    "known_secrets": f"SELECT doc_id, {found(SECRET_RULES, 'text')} AS categories FROM dt",
    "private_locations": f"SELECT doc_id, {found(LOCATION_RULES, 'text')} AS categories FROM dt",
    "leak_gate": f"""
SELECT repo_id, count(*) AS rows, count(*) FILTER (secret <> '' OR place <> '') AS leaking_rows, count(*) FILTER (secret <> '') AS secret_rows,
  count(*) FILTER (secret <> '' OR place <> '') = 0 AS passed
FROM (SELECT repo_id, {found(SECRET_RULES, 'text')} AS secret, {found(LOCATION_RULES, 'text')} AS place FROM dt) GROUP BY 1""",
    "nested_leaks": f"""
WITH RECURSIVE nd AS (SELECT doc_id, source, text, doc_id % 11 = 0 AS cut FROM documents),
ln AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM nd WHERE NOT cut)),
fd AS (SELECT doc_id, concat('$.body.lines[', i, ']') AS path, {found(SECRET_RULES, 'line')} AS s, {found(LOCATION_RULES, 'line')} AS l FROM ln)
SELECT doc_id, '$' AS path, 'invalid' AS kind, 'json' AS category FROM nd WHERE cut
UNION ALL SELECT doc_id, '$.body.extra[0].prompt', 'key', 'prompt' FROM nd WHERE NOT cut AND doc_id % 3 = 1
UNION ALL SELECT doc_id, path, 'secret', unnest(string_split(s, ',')) FROM fd WHERE s <> ''
UNION ALL SELECT doc_id, path, 'location', unnest(string_split(l, ',')) FROM fd WHERE l <> ''""",
    "snapshot_documents": """
SELECT repo_id, concat('{\n  "models": ', coalesce((SELECT concat('[\n    ', string_agg(concat('{\n      "calls": ', calls, ',\n      "cost_micro": ', coalesce(CAST(cost_micro AS VARCHAR), 'null'),
    ',\n      "model": "', model, '",\n      "model_provider": "', model_provider, '",\n      "priced": {\n        "second_lookup": ', repriced,
    CASE WHEN pt IS NULL THEN '' ELSE concat(',\n        "total": ', pt) END, '\n      }\n    }'), ',\n    ' ORDER BY model_provider, model), '\n  ]') FROM mu_doc m WHERE m.repo_id = w.repo_id), '[]'),
  ',\n  "notes": [],\n  "totals": {\n    "sessions": ', sessions, ',\n    "tokens": {\n', string_agg_tokens, '\n    },\n    "tool_calls": ', tool_calls, ',\n    "turns": ', turns,
  '\n  },\n  "window": {\n    "end": "', we, '",\n    "since": null,\n    "start": "', ws, '"\n  }\n}\n') AS document
FROM snap w""",
    "publish_verdicts": f"""
SELECT r.repo_id, coalesce(s.n, 0) + coalesce(p.n, 0) AS documents, coalesce(p.bad, 0) AS leaking_documents, coalesce(p.bad, 0) = 0 AS passed FROM repos r
LEFT JOIN (SELECT repo_id, count(*) AS n FROM s_dedup GROUP BY 1) s USING (repo_id)
LEFT JOIN (SELECT page_id % 4 AS repo_id, count(*) AS n, CAST(count(*) FILTER ({found(SECRET_RULES, 'url')} <> '' OR {found(LOCATION_RULES, 'url')} <> '') AS BIGINT) AS bad FROM pages GROUP BY 1) p USING (repo_id)""",
    "published_sessions": f"""
SELECT repo_id, session_ref, provider, {iso('started_at')} AS started_at, {iso('ended_at')} AS ended_at, turns, assistant_messages, CAST(tool_calls AS BIGINT) AS tool_calls,
  coalesce((SELECT string_agg(DISTINCT model, '|' ORDER BY model) FROM m_all m WHERE m.repo_id = s.repo_id AND m.session_ref = s.session_ref), '') AS models
FROM s_dedup s WHERE repo_id NOT IN (SELECT page_id % 4 FROM pages)""",
    "remote_identity": """
SELECT page_id, concat('sha256:', sha256(CASE WHEN host IS NOT NULL THEN concat(host, '/', path) ELSE concat('/repo/', page_id) END)) AS fingerprint,
  CASE WHEN host IS NOT NULL THEN 'canonical-remote' ELSE 'local-path' END AS fingerprint_basis, CASE WHEN host IS NOT NULL THEN concat('sha256:', sha256(path)) END AS path_hash
FROM (
  SELECT page_id, CASE WHEN ok THEN lower(regexp_extract(url, '^(?:[^@/\\s]+@)?([^:/\\s]+):(.+)$', 1)) END AS host,
    CASE WHEN ok THEN regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^(?:[^@/\\s]+@)?([^:/\\s]+):(.+)$', 2), '^/+', ''), '/+$', ''), '(?i)\\.git$', '') END AS path
  FROM (SELECT page_id, trim(url) AS url, regexp_matches(trim(url), '^(?:[^@/\\s]+@)?([^:/\\s]+):(.+)$') AND NOT regexp_matches(trim(url), '^[A-Za-z]:[\\\\/]') AS ok FROM pages))""",
    "blob_messages": """
SELECT CAST(conv_id AS VARCHAR) AS workspace, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text
FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' AND conv_id % 4 <> 3""",
    "excerpt_candidates": f"SELECT repo_id, provider, session_ref, pos, role, {iso('ts')} AS occurred_at, text FROM cand",
    "evidence_selection": recursive(_CHOSEN, _DEFAULT),
    "evidence_audit": recursive(_AUDITED, _CLOUD),
    "evidence_deep": recursive(_CHOSEN, _DEEP),
    "evidence_tight": recursive(_AUDITED, _TIGHT),
    "claim_errors": """
SELECT repo_id, CAST(number AS INTEGER) AS number, error FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY p, step) AS number FROM (
    SELECT repo_id, p, 0 AS step, path || ' must contain at least 1 character.' AS error FROM cl WHERE text = ''
    UNION ALL SELECT repo_id, p, 3, path || '.sourceRefs must contain at least one source reference.' FROM cl WHERE len(refs) = 0
    UNION ALL SELECT repo_id, p, 9 + i, concat(path, '.sourceRefs[', i - 1, '] references unknown source ', r, '.') FROM cl_ref WHERE NOT known
    UNION ALL SELECT repo_id, p, 9 + i, concat(path, '.sourceRefs[', i - 1, '] duplicates source ', r, '.') FROM cl_ref WHERE known AND list_position(refs, r) < i
  ))""",
    "claim_repair": """
SELECT c.repo_id, c.path, CASE WHEN c.text = '' THEN 'Observed session' ELSE c.text END AS text, coalesce(k.refs, 'S01') AS refs,
  concat_ws(',', CASE WHEN c.text = '' THEN c.path END, CASE WHEN k.refs IS NULL THEN c.path || '.sourceRefs' END) AS fallbacks
FROM cl c LEFT JOIN (
  SELECT repo_id, path, string_agg(r, ',' ORDER BY i) AS refs FROM (SELECT repo_id, path, r, min(i) AS i FROM cl_ref WHERE known GROUP BY 1, 2, 3) GROUP BY 1, 2
) k USING (repo_id, path)""",
}
