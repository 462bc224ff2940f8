"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

#: White space between words.
_BLANK = r"[\x20\x09-\x0D]"
#: Operator 5: the measures, the base rules and the verdict of all rules, which doesn't depend on their order.
_RULES = rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT id, doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda w: w <> '') AS w,
          list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, '{_BLANK}*')) AS lines FROM texts),
words AS (SELECT id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM split),
runs AS (SELECT id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
windows AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM runs WHERE c IS NOT NULL),
repeats AS (SELECT id, count(DISTINCT j) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE n > 1) GROUP BY id),
counted AS (SELECT doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM split LEFT JOIN repeats USING (id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR word_chars > 14 * n_words OR word_chars < 2 * n_words OR 3 * n_dup_lines > n_lines
            OR 2 * length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) > word_chars OR 3 * (length(t) - length(replace(t, '!', ''))) > n_words
            OR 5 * len(list_distinct(w)) < least(n_words, 1000)) AS kept
FROM based"""

SQL: dict[str, str] = {"op5_rule_cascade": _RULES}
