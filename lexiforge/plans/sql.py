"""The derived tables of the queries, as common table expressions of the SQL side."""

TOKENS = "tok AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"
COUNTS = f"{TOKENS}, lexc AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word)"
LEX = f"{COUNTS}, lex AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS frequency FROM lexc)"
INDEX = (
    f"{LEX}, idx AS (SELECT frequency AS row_id, CASE WHEN frequency % 7 = 0 THEN upper(substr(word, 1, 1)) || substr(word, 2) ELSE word END AS word, "
    "word AS word_lower, cnt FROM lex)"
)
DERIV = (
    "deriv AS (SELECT lower(trim(word)) AS word, lower(trim(base)) AS base, lower(trim(affix)) AS affix, "
    "CASE WHEN lower(trim(affix_type)) LIKE 's%' THEN 's' WHEN lower(trim(affix_type)) LIKE 'p%' THEN 'p' END AS kind, ord FROM derivations "
    "WHERE word IS NOT NULL AND base IS NOT NULL AND affix IS NOT NULL AND ord IS NOT NULL "
    "AND (lower(trim(affix_type)) LIKE 's%' OR lower(trim(affix_type)) LIKE 'p%'))"
)
REVERSE = f"{DERIV}, rev AS (SELECT word, arg_max(base, ord) AS base, arg_max(affix, ord) AS affix, arg_max(kind, ord) AS kind FROM deriv GROUP BY word)"
AFFIXES = f"{DERIV}, aff AS (SELECT DISTINCT affix, kind FROM deriv WHERE length(affix) >= 2)"
STRIP_DASHES = "trim(trim({0}, '-'))"
