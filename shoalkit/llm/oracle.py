"""DuckDB SQL for the queries that SQL can express.

The fingerprints need XXH64, which DuckDB lacks; classifiers, the field over spans and
licence expressions are not SQL. Those queries are tested against plain versions.
"""

from shoalkit.llm.rules import RATIOS, STOP_WORDS, THRESHOLDS
from shoalkit.llm.substrings import WINDOW_WORDS as PASSAGE_WORDS

BLANK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NORMAL_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

PASSAGES = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, {BLANK_WORDS} AS w FROM documents),
starts AS (
  SELECT row_id, w, unnest(range(1, len(w) - {PASSAGE_WORDS - 2})) AS s FROM docs WHERE len(w) >= {PASSAGE_WORDS}),
windows AS (SELECT row_id, s, array_to_string(w[s:s + {PASSAGE_WORDS - 1}], ' ') AS window_text FROM starts),
found AS (SELECT row_id, s, count(*) OVER (PARTITION BY window_text) AS n FROM windows),
gone AS (
  SELECT row_id, list(DISTINCT p) AS gone
  FROM (SELECT row_id, unnest(range(s, s + {PASSAGE_WORDS})) AS p FROM found WHERE n > 1) GROUP BY row_id),
words AS (
  SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
kept AS (
  SELECT words.row_id, string_agg(word, ' ' ORDER BY p) AS kept_text
  FROM words LEFT JOIN (SELECT row_id, unnest(gone) AS p, 1 AS hit FROM gone) USING (row_id, p)
  WHERE hit IS NULL GROUP BY words.row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(kept_text, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (row_id) LEFT JOIN kept USING (row_id)
"""

CONTAMINATION = f"""
WITH items AS (SELECT item_id, {NORMAL_WORDS} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS window_text
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
        FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, {NORMAL_WORDS} AS w FROM documents),
starts AS (
  SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
  FROM docs, (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n),
found AS (
  SELECT row_id, s, starts.n, item_id
  FROM starts JOIN patterns ON starts.n = patterns.n AND array_to_string(w[s:s + starts.n - 1], ' ') = window_text),
hits AS (
  SELECT row_id, count(DISTINCT p) AS n_hit
  FROM (SELECT row_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY row_id),
named AS (
  SELECT row_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT item_id::VARCHAR) FILTER (WHERE item_id IS NOT NULL)), ',') AS names
  FROM found GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)
"""


def _rules():
    def measure(name):
        if name not in RATIOS:
            return name
        above, below = RATIOS[name]
        return f"coalesce({above}::DOUBLE / nullif({below}, 0), 0.0)"

    bounds = [f"{measure(n)} >= {low}" for n, low, _ in THRESHOLDS if low is not None]
    bounds += [f"{measure(n)} <= {high}" for n, _, high in THRESHOLDS if high is not None]
    stop_words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {BLANK_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT row_id, s, array_to_string(w[s:s + 2], ' ') AS window_text
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS s FROM docs WHERE len(w) >= 3)),
repeated AS (
  SELECT row_id, count(DISTINCT p) AS n
  FROM (SELECT row_id, unnest([s, s + 1, s + 2]) AS p
        FROM (SELECT row_id, s, count(*) OVER (PARTITION BY row_id, window_text) AS n FROM windows) WHERE n > 1)
  GROUP BY row_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(lines, lambda x: contains(x, '|'))) AS n_pipe_lines,
    len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    greatest(len(list_filter(w, lambda x: x IN ({stop_words}))), len(w) - len(list_distinct(w))) AS n_stop_words
  FROM docs LEFT JOIN repeated USING (row_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(bounds)} AS kept
FROM judged
"""


def oracle_sql():
    return {"op5_substrings": PASSAGES, "op6_decontamination": CONTAMINATION, "op9_rules": _rules()}
