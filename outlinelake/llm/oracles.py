"""DuckDB SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from outlinelake.llm.licenses import DIGESTS, KNOWN, PUNCTUATION, SPELLINGS, STEPS

#: Distinct shingles by document, pairs by counting what they share, and classes by following links from every document.
NGRAM_JOIN = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), counted AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM counted JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)
), reached AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT reached.doc_id, links.y FROM reached JOIN links ON links.x = reached.root
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(root) AS least_id FROM reached GROUP BY doc_id) USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses(known: dict[str, str] = KNOWN, digests: dict[str, list[str]] = DIGESTS) -> str:
    """Canonical texts, their digests, and the ids of the known ones."""
    plain = "text"
    for pattern, new in STEPS:
        plain = f"regexp_replace({plain}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    one = "words"
    for other, word in SPELLINGS.items():
        one = rf"regexp_replace({one}, '\b{other}\b', '{word}', 'g')"
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known.items())
    more = ", ".join(f"('{d}', {_quoted(k)})" for k, some in digests.items() for d in some)
    return rf"""
WITH texts AS (
  SELECT doc_id, NULL AS license_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT NULL, * FROM (VALUES {rows})
), plain AS (
  SELECT doc_id, license_id, trim(regexp_replace(lower({plain}), {_quoted(PUNCTUATION)}, ' ', 'g')) AS words
  FROM texts
), digests AS (
  SELECT doc_id, license_id, sha256({one}) AS digest FROM plain
), known AS (
  SELECT digest, min(license_id) AS license_id FROM (SELECT digest, license_id FROM digests WHERE license_id IS NOT NULL UNION ALL SELECT * FROM (VALUES {more})) GROUP BY digest
)
SELECT d.doc_id, d.digest, known.license_id FROM digests d LEFT JOIN known USING (digest) WHERE d.license_id IS NULL
"""
