"""DuckDB SQL of the quality rules, from the same constants."""

from __future__ import annotations

from .quality_rules import COUNTS, FENCE, MAX_REPEAT_PERCENT, MEASURES, MIN_WORDS, PRIOR, within

WORD = "[^\\x20\\x09-\\x0D]"


def _value(name: str) -> str:
    over, under, *_ = MEASURES[name]
    return f"1000 * {over} // greatest({under}, 1)"


def _level(k: int) -> str:
    return f"CASE measure {' '.join(f"WHEN '{m}' THEN {spec[k]}" for m, spec in MEASURES.items())} END"


def _quantiles(name: str, keys: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    return f"""{name}_n AS (SELECT {by}, top, sum(n) AS n FROM sketch GROUP BY {by}, top),
 {name}_u AS (SELECT {by}, top, sum(n) OVER (PARTITION BY {by} ORDER BY top) AS upto, sum(n) OVER (PARTITION BY {by}) AS size FROM {name}_n),
 {name}_q AS (SELECT {by}, max(size) AS size, min(top) FILTER (WHERE upto * 100 >= size * {_level(2)}) AS low, min(top) FILTER (WHERE upto * 100 >= size * {_level(3)}) AS high FROM {name}_u GROUP BY {by}),
 {name} AS (SELECT {by}, CAST(size AS BIGINT) AS {name}_size, CAST(low AS BIGINT) AS {name}_low, CAST(high AS BIGINT) AS {name}_high FROM {name}_q)"""


def _leaning(q: str) -> str:
    wide = f"(wide_size * wide_{q} + {PRIOR} * whole_{q}) // (wide_size + {PRIOR})"
    return f"(own_size * own_{q} + {PRIOR} * ({wide})) // (own_size + {PRIOR}) AS {q}"


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '{WORD}+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
 i AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS pos FROM w),
 k AS (SELECT r, pos, count(*) OVER (PARTITION BY r, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2]) AS c FROM i),
 rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM k WHERE c > 1) GROUP BY r),
 m AS (SELECT r, doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z!]', '', 'g')) AS n_shouts FROM w LEFT JOIN rep USING (r)),
 f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
 v AS (SELECT lang, source, unnest([{", ".join(f"{{'measure': '{x}', 'value': CAST({_value(x)} AS BIGINT)}}" for x in MEASURES)}]) AS s FROM f WHERE NOT base_failed),
 b AS (SELECT lang, source, s.measure AS measure, s.value AS value, greatest(length(bin(s.value)) - 6, 0) AS p FROM v),
 sketch AS (SELECT lang, source, measure, (((value >> p) + 1) << p) - 1 AS top, count(*) AS n FROM b GROUP BY ALL),
 {_quantiles("own", "lang, source")},
 {_quantiles("wide", "lang")},
 {_quantiles("whole", "")},
 l AS (SELECT lang, source, measure, {_leaning("low")}, {_leaning("high")} FROM own JOIN wide USING (lang, measure) JOIN whole USING (measure)),
 g AS (SELECT lang, source, measure, high, high + {FENCE} * (high - low) AS cap FROM l),
 t AS (SELECT lang, source, {", ".join(f"max(cap) FILTER (WHERE measure = '{x}') AS max_{x}, max(high) FILTER (WHERE measure = '{x}') AS high_{x}" for x in MEASURES)} FROM g GROUP BY lang, source)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS[:5])}, base_failed, coalesce(NOT base_failed AND {" AND ".join(map(within, MEASURES))}, FALSE) AS kept FROM f LEFT JOIN t USING (lang, source)"""
