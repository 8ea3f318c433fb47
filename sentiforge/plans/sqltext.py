"""DuckDB spellings of the column functions, for the oracle texts only."""

from __future__ import annotations

from sentiforge.functions.text import DIGITS, PUNCT_CLASS, SPACE, STOP_WORDS, WORD, NONSPACE, unicode_regex


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules(expr: str, rule_list) -> str:
    for pattern, repl in rule_list:
        expr = f"regexp_replace({expr}, {lit(unicode_regex(pattern))}, {lit(repl)}, 'g')"
    return expr


def split_ws(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(SPACE + '+')}), lambda x: x <> '')"


def word_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {lit(WORD + '{2,}')}, 0)"


def normalise(expr: str) -> str:
    t = f"regexp_replace(regexp_replace(lower({expr}), {lit(DIGITS)}, '', 'g'), {lit(PUNCT_CLASS)}, '', 'g')"
    stop = ", ".join(lit(w) for w in STOP_WORDS)
    toks = f"list_filter(regexp_split_to_array({t}, {lit(SPACE + '+')}), lambda x: x <> '' AND x NOT IN ({stop}))"
    return f"array_to_string({toks}, ' ')"


def has_nonspace(expr: str) -> str:
    return f"regexp_matches({expr}, {lit(NONSPACE)})"


def md5_key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def hex_int(expr: str, start: int, n: int) -> str:
    return f"('0x' || substr({expr}, {start}, {n}))::BIGINT"


def uniform(*parts: str, start: int = 1) -> str:
    return f"({hex_int(md5_key(*parts), start, 8)} / 4294967296.0::DOUBLE)"
