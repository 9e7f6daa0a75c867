"""Oracle SQL of default claims and of repaired reports."""

from __future__ import annotations

from oracles.base import CTES
from sessionloom.views.shapes import STORY_PLACES

_BECAUSE = "left(rationale, 300)"
_PHASES = [
    ("discover", "What was looked at", "concat(sessions, ' sessions belong to this repository.')"),
    ("decide", "What was chosen", "left(rationale, 260)"),
    ("deliver", "What came out", "concat(commits, ' commits and ', calls, ' tool calls are on record.')"),
]
_TEXTS = [
    ("hero.headline", "archetype"), ("hero.summary", "concat('Counts of ', sessions, ' sessions and ', commits, ' commits.')"),
    *[(f"buildArc.{n}.headline", f"'{h}'") for n, h, _ in _PHASES], *[(f"buildArc.{n}.summary", t) for n, _, t in _PHASES],
    *[(f"moments.{i}.title", f"'{h}'") for i, (_, h, _) in enumerate(_PHASES)], *[(f"moments.{i}.whatHappened", t) for i, (_, _, t) in enumerate(_PHASES)],
    *[(f"moments.{i}.whyItMattered", "'Written from counts; no checked text was at hand.'") for i in range(3)],
    ("turningPoint.quote", "'Reading came first, writing and commits later.'"),
    ("decisions.0.title", "'Go by the record'"), ("decisions.0.rationale", _BECAUSE), ("decisions.0.outcome", "'The same input gives the same report.'"),
    ("decisions.1.title", "'Name a source'"), ("decisions.1.rationale", "'A claim may cite sessions of the catalogue and totals of the repository.'"),
    ("decisions.1.outcome", "'Other references are exchanged for texts from counts.'"),
    ("learnings.0.title", "'Cite next to the claim'"), ("learnings.0.detail", "'Each part leads to a session or a total.'"),
    ("learnings.1.title", "'Read scores with care'"), ("learnings.1.detail", "'They are sums of counts.'"),
    ("standoutTraits.0.title", "archetype"), ("standoutTraits.0.detail", _BECAUSE),
    ("standoutTraits.1.title", "'Backed by records'"), ("standoutTraits.1.detail", "'It follows from what is recorded and how much of it was read.'"),
    ("growthEdge.title", "'Plan a step ahead'"), ("growthEdge.observation", "'The scores for planning and steering rest on turns and tool calls only.'"),
]

CTES.update(
    {
        "st_src": "SELECT repo_id, list(ref ORDER BY ref = 'GIT', length(ref), ref) AS l FROM cat GROUP BY 1",
        "st_def": f"""
SELECT repo_id, path, text, coalesce(l[CASE WHEN starts_with(path, 'moments.') THEN CAST(split_part(path, '.', 2) AS INTEGER) + 1 ELSE 1 END], l[1]) AS refs
FROM arch JOIN (SELECT repo_id, sessions, CAST(tool_calls AS BIGINT) AS calls FROM tot) USING (repo_id) JOIN (SELECT repo_id, commits FROM gm) USING (repo_id) LEFT JOIN st_src USING (repo_id),
  LATERAL (VALUES {', '.join(f"('{p}', {t})" for p, t in _TEXTS)}) v(path, text)""",
        "st_claim": f"""
SELECT repo_id, path, CASE WHEN (repo_id + i) % 5 = 2 AND field <> 'title' THEN NULL ELSE concat('Claim ', field, ' ', i, ' of ', repo_id) END AS text,
  CASE WHEN i % 3 = 2 THEN ['S01', 'GIT'] WHEN i % 2 = 0 THEN ['S01'] ELSE [] END AS cited, regexp_replace(path, '\\.[^.]*$', '') AS holder
FROM repos, (VALUES {', '.join(f"({m}, '{p}', {i}, '{f}')" for m, p, i, f in STORY_PLACES)}) v(mode, path, i, field) WHERE repo_id % 4 = mode""",
        "st_refs": """
SELECT repo_id, holder, nullif(array_to_string(list_filter(any_value(cited), lambda x: x = 'S01' OR has_git), ','), '') AS refs
FROM st_claim JOIN (SELECT repo_id, bool_or(ref = 'GIT') AS has_git FROM cat GROUP BY 1) USING (repo_id) GROUP BY repo_id, holder, has_git""",
        "st_list": """
SELECT d.repo_id, l.*, coalesce(n, 0) AS n FROM (SELECT DISTINCT repo_id FROM st_def) d,
  (VALUES ('moments', 3, 5, 3, FALSE), ('decisions', 2, 4, 2, FALSE), ('learnings', 2, 4, 2, TRUE), ('standoutTraits', 2, 4, 2, TRUE)) l(name, least_, most_, own, replaced)
LEFT JOIN (SELECT repo_id, name, count(*) AS n FROM (SELECT DISTINCT repo_id, split_part(path, '.', 1) AS name, TRY_CAST(split_part(path, '.', 2) AS INTEGER) AS i FROM st_claim)
  WHERE i < CASE name WHEN 'moments' THEN 5 ELSE 4 END GROUP BY 1, 2) c ON c.repo_id = d.repo_id AND c.name = l.name""",
        "st_slot": """
SELECT DISTINCT l.repo_id, l.name, i, i % own AS d, TRUE AS claimed, NOT (replaced AND n < least_) AS shown FROM st_list l
  JOIN (SELECT repo_id, split_part(path, '.', 1) AS name, TRY_CAST(split_part(path, '.', 2) AS INTEGER) AS i FROM st_claim) c ON c.repo_id = l.repo_id AND c.name = l.name AND c.i < l.most_
UNION ALL SELECT repo_id, name, i, i, FALSE, TRUE FROM (SELECT *, unnest(range(CASE WHEN replaced THEN 0 ELSE n END, least_)) AS i FROM st_list WHERE n < least_)""",
        "st_all": """
SELECT s.repo_id, concat(s.name, '.', s.i) AS holder, concat(s.name, '.', s.i, '.', split_part(f.path, '.', 3)) AS path, f.text AS dt, f.refs AS dr, claimed, shown
FROM st_slot s JOIN st_def f ON f.repo_id = s.repo_id AND split_part(f.path, '.', 1) = s.name AND split_part(f.path, '.', 2) = CAST(s.d AS VARCHAR)
UNION ALL SELECT repo_id, regexp_replace(path, '\\.[^.]*$', ''), path, text, refs, TRUE, TRUE FROM st_def WHERE split_part(path, '.', 1) NOT IN ('moments', 'decisions', 'learnings', 'standoutTraits')""",
        "st_join": """
SELECT a.*, CASE WHEN claimed THEN c.text END AS own_text, CASE WHEN claimed THEN r.refs END AS own_refs FROM st_all a
LEFT JOIN st_claim c ON c.repo_id = a.repo_id AND c.path = a.path LEFT JOIN st_refs r ON r.repo_id = a.repo_id AND r.holder = a.holder""",
    }
)

SQL = {
    "default_claims": "SELECT repo_id, path, text, coalesce(refs, '') AS refs FROM st_def",
    "story_repair": "SELECT repo_id, path, coalesce(own_text, dt) AS text, coalesce(own_refs, dr, '') AS refs FROM st_join WHERE shown",
    "story_fallbacks": """
SELECT DISTINCT repo_id, path AS fallback FROM st_join WHERE claimed AND own_text IS NULL
UNION SELECT repo_id, concat(holder, '.sourceRefs') FROM st_join WHERE claimed AND own_refs IS NULL AND holder <> 'hero'
UNION SELECT repo_id, name FROM st_list WHERE n < least_""",
}
