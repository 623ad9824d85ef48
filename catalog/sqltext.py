"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from foliant import vocab

_WS = "".join(vocab.WHITESPACE)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(quote(v) for v in values)


def map_case(expr: str, table: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + " END"


def TRIM(e: str) -> str:
    return f"trim({e}, {quote(_WS)})"


def BLANK(e: str) -> str:
    return f"coalesce({TRIM(e)} = '', true)"


def NORMALIZE(e: str) -> str:
    """Up to the page clean-up; lookbehind written as two steps."""
    one = f"replace(replace(replace({e}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), '    ')"
    two = f"regexp_replace({one}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    three = f"regexp_replace({two}, '([^\\n ]) {{2,}}', '\\1 ', 'g')"
    four = f"regexp_replace({three}, '\\n {{3,}}', chr(10) || '  ', 'g')"
    return f"regexp_replace({four}, '^ {{2,}}', ' ')"


def CLEANUP(e: str) -> str:
    steps = [("([0-9])([A-Za-z])", "\\1 \\2"), ("Gbps([0-9])", "Gbps \\1"), ("Mbps([0-9])", "Mbps \\1"),
             ("([A-Za-z])([0-9])([A-Za-z])", "\\1 \\2 \\3"), (" {2,}", " ")]
    out = e
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"CASE WHEN {BLANK(e)} THEN {e} ELSE {TRIM(out)} END"


def HEADING(e: str) -> str:
    first = f"(list_filter(string_split({e}, chr(10)), lambda x: x <> ''))[1]"
    line = TRIM(first)
    caps = f"replace({line}, 'ß', '')"
    return (f"CASE WHEN coalesce({line}, '') = '' OR length({line}) > 120 THEN NULL "
            f"WHEN regexp_matches({line}, '^([0-9]+\\.)+\\s*\\S') THEN left({line}, 100) "
            f"WHEN length({line}) <= 80 AND upper({caps}) = {caps} AND regexp_matches({line}, '\\pL') THEN {line} "
            f"WHEN ends_with({line}, ':') AND length({line}) <= 80 THEN rtrim({line}, ':') END")


def any_of(e: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({e}, {quote(p)})" for p in dict.fromkeys(phrases)) + ")"
