"""DuckDB SQL for the queries that plain SQL can express on whole tables."""

from __future__ import annotations

from obligor.llm.license_texts import LICENCES, SPELLINGS


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """The canonical form of a licence text, as an expression."""
    lines = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^[ \t#*/;%-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$', ' ', 'g')"
    held = rf"(' ' || regexp_replace({lines}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ')"
    for old, new in SPELLINGS:
        held = f"replace({held}, ' {old} ', ' {new} ')"
    return f"sha256(trim({held}))"


_TEXTS = ", ".join(f"({_literal(name)}, {_literal(text)})" for name, text in LICENCES)

ORACLES: dict[str, str] = {
    "op5_license_scan": f"""
WITH texts(license_id, text) AS (VALUES {_TEXTS}),
known AS (
  SELECT {_canonical("text")} AS digest, min(license_id) AS license_id FROM texts GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
named AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM lines JOIN known ON {_canonical("line")} = digest GROUP BY doc_id),
docs AS (SELECT doc_id, {_canonical("text")} AS digest FROM documents)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known USING (digest) LEFT JOIN named USING (doc_id)
""",
    "op10_nearest": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
      FROM scored)
WHERE place <= 5
""",
    "op13_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 100,
          100 * len(list_distinct(words)) < 80 * len(words),
          100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM texts LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM docs GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
judged AS (
  SELECT part, filter_order, step, n, n_good, n_toxic,
         fails[ascii(filter_order[step]) - 64] AS own,
         len(list_filter(range(1, step), lambda s: fails[ascii(filter_order[s]) - 64])) AS earlier,
         len(list_filter(fails, lambda f: f)) AS failed
  FROM counts, steps),
audited AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (earlier = 0 AND NOT own), 0) AS kept,
         coalesce(sum(n) FILTER (earlier = 0 AND own), 0) AS removed,
         coalesce(sum(n) FILTER (earlier > 0 AND own), 0) AS redundant,
         coalesce(sum(n) FILTER (own AND failed = 1), 0) AS unique_fails,
         coalesce(sum(n_good) FILTER (earlier = 0 AND own), 0) AS good_lost,
         coalesce(sum(n_toxic) FILTER (earlier = 0 AND own), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM audited
""",
}
