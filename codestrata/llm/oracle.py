"""DuckDB SQL for those llm queries that SQL can express on whole tables."""

_P1 = """
WITH cur AS (
  SELECT project, type, name, symbol_id, metrics.mi AS mi,
         row_number() OVER (PARTITION BY project, type, name ORDER BY collected_at DESC NULLS LAST, symbol_id DESC) AS r
  FROM symbols WHERE type IN ('method', 'function') AND name IS NOT NULL),
own AS (
  SELECT *, CASE WHEN type = 'method' THEN CASE WHEN instr(name, '::') > 0 THEN substr(name, 1, instr(name, '::') - 1) ELSE '' END
                 ELSE regexp_extract(name, '^((?s:.*))\\\\[^\\\\]*$', 1) END AS owner
  FROM cur WHERE r = 1 AND mi IS NOT NULL AND isfinite(mi)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY project, type, owner ORDER BY mi DESC, name, symbol_id) AS rank FROM own)
"""



def _filled(name: str, nodes: str, family: tuple[str, ...], key: str) -> str:
    """Budgets of `nodes` (c capacity, w weight, given): the level is sought among the points at which a node is full."""
    match = lambda x, y: " AND ".join(f"{x}.{k} IS NOT DISTINCT FROM {y}.{k}" for k in family) or "true"
    of_a, own = "".join(f"a.{k}, " for k in family), "".join(f"{k}, " for k in family)
    grouped = f" GROUP BY {', '.join(family)}" if family else ""
    return f"""{name}_p AS (SELECT {of_a}a.given, a.c / a.w AS r, sum(least(b.c, a.c / a.w * b.w)) AS f, sum(b.w) FILTER (WHERE b.c / b.w > a.c / a.w) AS later, sum(b.w) AS ws
  FROM {nodes} a JOIN {nodes} b ON {match("a", "b")} GROUP BY {of_a}a.{key}, a.given, a.c, a.w),
{name}_v AS (SELECT {own}coalesce(max(r + coalesce((given - f) / later, 0)) FILTER (WHERE f <= given), any_value(given) / any_value(ws)) AS level FROM {name}_p{grouped}),
{name} AS (SELECT n.*, least(n.c, v.level * n.w) AS budget FROM {nodes} n JOIN {name}_v v ON {match("n", "v")})
"""


_P7 = (
    """WITH h AS (SELECT doc_kind, lang, source, sum(n_chars)::BIGINT AS held FROM documents WHERE n_chars > 0 GROUP BY ALL),
l AS (SELECT h.*, held::DOUBLE * max_repeats AS c, target_share * held / sum(held) OVER (PARTITION BY source) AS w FROM h JOIN mix_targets USING (source) WHERE target_share > 0 AND max_repeats > 0),
k0 AS (SELECT doc_kind, sum(c) AS c, sum(w) AS w, (SELECT least(sum(held), sum(c)) FROM l)::DOUBLE AS given FROM l GROUP BY ALL),
"""
    + _filled("k", "k0", (), "doc_kind")
    + """, g0 AS (SELECT l.doc_kind, l.lang, sum(l.c) AS c, sum(l.w) AS w, any_value(k.budget) AS given FROM l JOIN k ON k.doc_kind IS NOT DISTINCT FROM l.doc_kind GROUP BY ALL),
"""
    + _filled("g", "g0", ("doc_kind",), "lang")
    + """, s0 AS (SELECT l.*, g.budget AS given FROM l JOIN g ON g.doc_kind IS NOT DISTINCT FROM l.doc_kind AND g.lang IS NOT DISTINCT FROM l.lang),
"""
    + _filled("s", "s0", ("doc_kind", "lang"), "source")
)

ORACLE: dict[str, str] = {
    # a lossless encoding is one from which every text comes back
    "p6_roundtrip": "SELECT lang, count(*) AS documents, count(*) AS same FROM documents GROUP BY lang",
    "p7_budgets": _P7 + "SELECT doc_kind, lang, source, held, c AS capacity, round(budget, 3) AS budget FROM s",
    "p1_found": _P1 + "SELECT symbol_id FROM best WHERE rank <= 3",
    "p1_top_callables": _P1 + "SELECT project, type, owner, CAST(rank AS INTEGER) AS rank, mi, name, symbol_id FROM best WHERE rank <= 3",
}
