"""SQL of the pipeline's steps, from which the queries' SQL is put together."""

from __future__ import annotations

#: White space of texts as the splitters see it, and what ends a line.
SPACE = r" \t\n\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_ENDS = r"\r\n|[\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def tokens(text: str) -> str:
    """Words and single signs of a text."""
    return f"len(regexp_extract_all({text}, '[A-Za-z0-9_]+|[^A-Za-z0-9_{SPACE}]'))"


def ended(text: str) -> str:
    """A text with one kind of line end."""
    return f"regexp_replace({text}, '{LINE_ENDS}', chr(10), 'g')"


def line_count(text: str) -> str:
    """Lines of a text whose line ends are one; an unended last line counts."""
    return f"CAST(length({text}) - length(replace({text}, chr(10), '')) + CASE WHEN {text} <> '' AND NOT ends_with({text}, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"


def folds(budget: int, overlap: int) -> str:
    """CTEs f (id, a, b) over k (id, costs, h, ef): greedy segments [a, b) of lines under a soft budget, in order of b."""
    return f"""s(id, i, start, used, a, b) AS (
      SELECT id, 0, 0, h, CAST(NULL AS INT), CAST(NULL AS INT) FROM k
      UNION ALL
      SELECT id, i + 1, CASE WHEN over THEN ns ELSE start END, CASE WHEN over THEN h + coalesce(list_sum(costs[ns + 1:i]), 0) + costs[i + 1] ELSE used + costs[i + 1] END, CASE WHEN over THEN start END, CASE WHEN over THEN i END
      FROM (SELECT s.*, k.costs, k.h, s.used + k.costs[s.i + 1] > {budget} AND (k.ef OR s.i > s.start) AS over, greatest(s.start, s.i - {overlap}) AS ns FROM s JOIN k USING (id) WHERE s.i < len(k.costs))
    ), f AS (SELECT id, a, b FROM s WHERE a IS NOT NULL UNION ALL SELECT s.id, s.start, s.i FROM s JOIN k USING (id) WHERE s.i = len(k.costs) AND s.start < s.i)"""


def pieces(budget: int = 512, overlap: int = 3, mode: str = "exact") -> str:
    """CTEs ending in ``pieces``: distinct elements with (segment, segments, segment_start, segment_end, piece)."""
    shift = "head" if mode == "exact" else "0"
    return f"""WITH RECURSIVE e AS MATERIALIZED (
      SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT repo_path, path, language, seq, type, name, start_line, end_line, content, docstring, decorators, parent_class, parameters, return_type FROM elements WHERE type <> 'import')
    ), cut AS MATERIALIZED (
      SELECT id, CASE WHEN ends_with(x, chr(10)) THEN lines[:-2] ELSE lines END AS lines
      FROM (SELECT id, {ended('content')} AS x, string_split({ended('content')}, chr(10)) AS lines FROM e WHERE type IN ('function', 'method') AND start_line IS NOT NULL AND {tokens('content')} > {budget})
    ), headed AS (
      SELECT id, lines, coalesce(nullif(list_position(list_transform(lines, lambda x: regexp_matches(x, '^[{SPACE}]*def ')), true), 0), 1) AS first FROM cut
    ), found AS (
      SELECT id, lines, coalesce(nullif(list_position(list_transform(lines[first:], lambda x: regexp_matches(x, ':[{SPACE}]*$')), true), 0) + first - 1, first) AS head FROM headed
    ), weighed AS (
      SELECT id, lines, head, array_to_string(lines[:head], chr(10)) AS signature, {tokens('array_to_string(lines[:head], chr(10))')} AS cost FROM found
    ), k AS MATERIALIZED (
      SELECT id, cost < {budget} AS ef, CASE WHEN cost < {budget} THEN cost ELSE 0 END AS h, CASE WHEN cost < {budget} THEN head ELSE 0 END AS head, CASE WHEN cost < {budget} THEN signature || chr(10) ELSE '' END AS opening,
        CASE WHEN cost < {budget} THEN lines[head + 1:] ELSE lines END AS rows, list_transform(CASE WHEN cost < {budget} THEN lines[head + 1:] ELSE lines END, lambda x: {tokens('x')}) AS costs FROM weighed
    ), {folds(budget, overlap)}, split AS (
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY b, a) - 1 AS n, count(*) OVER (PARTITION BY id) AS total, k.opening || array_to_string(k.rows[a + 1:b], chr(10)) AS piece, {shift} + a AS from_line, {shift} + b - 1 AS to_line FROM f JOIN k USING (id)
    ), pieces AS (
      SELECT e.*, CASE WHEN total > 1 THEN n END AS segment, CASE WHEN total > 1 THEN total END AS segments, coalesce(e.start_line + from_line, e.start_line) AS segment_start, coalesce(e.start_line + to_line, e.end_line) AS segment_end, coalesce(split.piece, e.content) AS piece FROM e LEFT JOIN split USING (id)
    )"""


PREFIX = "'# In class ' || parent_class || chr(10) || 'class ' || parent_class || CASE WHEN len(coalesce(bases, [])) > 0 THEN '(' || array_to_string(bases, ', ') || ')' ELSE '' END || ':' || CASE WHEN length(class_docstring) > 0 THEN chr(10) || '    \"\"\"' || class_docstring || '\"\"\"' ELSE '' END || chr(10) || chr(10)"


def chunks(budget: int = 512, overlap: int = 3, mode: str = "exact") -> str:
    """CTEs ending in ``made``: chunks of the elements, the first of each id in the pipeline's order."""
    line = "segment_start" if mode == "compat" else "start_line"
    return (
        pieces(budget, overlap, mode)
        + f""", heads AS (
      SELECT DISTINCT repo_path, path, name AS owner, seq AS class_seq, parameters AS bases, docstring AS class_docstring FROM e WHERE type = 'class'
    ), joined AS (
      SELECT p.*, class_seq, bases, class_docstring FROM pieces p LEFT JOIN heads h ON p.type = 'method' AND h.repo_path = p.repo_path AND h.path = p.path AND h.owner = p.parent_class
    ), built AS (
      SELECT substring(md5(concat_ws(':', repo_path, path, name, type, nullif(parent_class, ''), CAST({line} AS VARCHAR), 'seg' || CAST(segment AS VARCHAR))), 1, 12) AS chunk_id, repo_path, path AS file_path, type AS element_type,
        CASE WHEN segment IS NULL THEN name ELSE name || ' (part ' || CAST(segment + 1 AS VARCHAR) || '/' || CAST(segments AS VARCHAR) || ')' END AS name,
        CAST(segment_start AS BIGINT) AS start_line, CAST(segment_end AS BIGINT) AS end_line, CASE WHEN type = 'method' THEN {PREFIX} ELSE '' END || piece AS content, parent_class, CAST(segment AS BIGINT) AS split_segment, CAST(segments AS BIGINT) AS split_total,
        CASE WHEN type = 'function' THEN 1 ELSE 0 END AS o1, CASE WHEN type = 'function' THEN 0 ELSE coalesce(class_seq, seq) END AS o2, CASE WHEN type = 'method' THEN 1 ELSE 0 END AS o3, seq AS o4, coalesce(segment, 0) AS o5
      FROM joined WHERE type <> 'method' OR class_seq IS NOT NULL
    ), made AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY file_path NULLS FIRST, o1, o2 NULLS FIRST, o3, o4 NULLS FIRST, o5, content NULLS FIRST) AS place FROM built) WHERE place = 1
    )"""
    )


#: The newest scan of each file that has content.
NEWEST = "newest AS MATERIALIZED (SELECT repo_path, path, last_modified, content FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, path ORDER BY last_modified DESC NULLS LAST, content DESC) AS n FROM sources WHERE content IS NOT NULL AND repo_path IS NOT NULL AND path IS NOT NULL) WHERE n = 1)"


def squeezed(text: str) -> str:
    """A text without white space."""
    return f"regexp_replace({text}, '[ \\t\\n\\x0b\\f\\r]+', '', 'g')"


def core(text: str) -> str:
    """An element's text without the comments behind it."""
    return f"regexp_replace({text}, '(\\n[ \\t]*#[^\\n]*|[ \\t\\n\\x0b\\f\\r])+$', '')"


#: Files whose elements all stand in the newest scan at their lines; others have elements of an earlier state.
CLEAN = f"""clean AS MATERIALIZED (
      SELECT e.repo_path, e.path FROM (SELECT DISTINCT repo_path, path, start_line, end_line, content FROM elements) e JOIN newest s ON e.repo_path = s.repo_path AND e.path = s.path
      GROUP BY 1, 2 HAVING bool_and(contains({squeezed("array_to_string(list_slice(string_split(s.content, chr(10)), e.start_line, e.end_line), '')")}, {squeezed('e.content')})))"""


def vectors(texts: str, width: int = 64) -> str:
    """CTEs ending in ``vecs`` (key, dim, value as REAL) over the relation ``texts`` (key, txt): the hashing embedder's vectors, no rows for texts that fail."""
    token = f"[A-Za-z]+|\\p{{Nd}}+|[^A-Za-z\\p{{Nd}}{SPACE}]"
    parts = r"string_split(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')"
    return f"""toks AS (SELECT key, unnest(regexp_extract_all(txt, '{token}')) AS t FROM {texts}
    ), kinds AS (SELECT t, CASE WHEN regexp_full_match(t, '[A-Za-z]+') THEN list_distinct(list_concat([lower(t)], list_transform({parts}, lambda x: lower(x)))) ELSE [t] END AS parts FROM (SELECT DISTINCT t FROM toks)
    ), votes AS (SELECT toks.key, md5_number_upper(p.part) % {width} AS dim, CASE WHEN (md5_number_upper(p.part) // {width}) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM toks JOIN (SELECT t, unnest(parts) AS part FROM kinds) p USING (t)
    ), sums AS MATERIALIZED (SELECT key, dim, sum(sign) AS v FROM votes GROUP BY 1, 2
    ), norms AS (SELECT key, sqrt(CAST(sum(v * v) AS DOUBLE)) AS n FROM sums GROUP BY 1
    ), vecs AS MATERIALIZED (SELECT key, CAST(dim AS INT) AS dim, CAST(CAST(v AS DOUBLE) / n AS REAL) AS value FROM sums JOIN norms USING (key) WHERE n > 0 AND v <> 0)"""
