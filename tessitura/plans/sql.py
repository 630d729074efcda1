"""SQL texts that several queries are checked against, built from the same fixed values."""

from __future__ import annotations

from tessitura.functions import text as T


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def clean(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\p{{C}}|\\p{{Z}}', ' ', 'g')"
    x = f"translate(replace({x}, '...', '…'), {q(''.join(T.SYMBOLS))}, {q(''.join(T.SYMBOLS.values()))})"
    return f"regexp_replace(regexp_replace({x}, '([,.:;!?…—])', ' \\1 ', 'g'), '\\s+', ' ', 'g')"


def divided(x: str) -> str:
    x = f"regexp_replace({x}, '[{T.NOISE}]', '', 'g')"
    for a, b in sorted(T.COMBINATIONS.items(), key=lambda p: -len(p[0])):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def single_blanks(x: str) -> str:
    return f"regexp_replace(ltrim({x}, ' '), ' +', ' ', 'g')"


def tokens_v6(x: str) -> str:
    return f"regexp_extract_all({single_blanks(divided(x))}, '[a-zA-ZÀ-ʯ]+|[^|\n]')"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
