"""String Column functions (I-01 ... I-20). All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode white space character; Spark's trim removes
# spaces only, so strip with two anchored regexes (I-01).
_WS = ("[ \\t\\n\\r\\f\\x0B\\x1C-\\x1F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029"
       "\\u202F\\u205F\\u3000]")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """I-01: strip all leading/trailing white space, like Python ``str.strip()``."""
    return F.regexp_replace(F.regexp_replace(_c(c), f"^{_WS}+", ""), f"{_WS}+$", "")


def first_index(c, sub: str) -> Column:
    """I-03: 0-based index of the first occurrence, -1 if absent (Python ``find``)."""
    return F.locate(sub, _c(c)) - 1


def last_index(c, sub: str) -> Column:
    """I-03: 0-based index of the last occurrence, -1 if absent (Python ``rfind``)."""
    s = _c(c)
    r = F.locate(sub[::-1], F.reverse(s))
    return F.when(r == 0, F.lit(-1)).otherwise(F.length(s) - r - F.lit(len(sub) - 1))


def py_slice(c, start: int, end: int) -> Column:
    """I-04: ``s[start:end]`` for 0-based non-negative bounds."""
    return F.substring(_c(c), start + 1, max(end - start, 0))


def truncate_text(c, max_len: int = 200) -> Column:
    """I-13: keep texts up to ``max_len`` chars, else first ``max_len-3`` plus '...'."""
    s = _c(c)
    return F.when(F.length(s) <= max_len, s).otherwise(
        F.concat(F.substring(s, 1, max_len - 3), F.lit("...")))


def py_list_repr(arr) -> Column:
    """I-16: render ``array<string>`` like Python ``str(list)``.

    Items are quoted with ' unless they contain ' and no ", in which case " is used.
    """
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(_c(arr), lambda x: F.when(
            F.instr(x, "'") > 0, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), x, F.lit("'")))), ", "),
        F.lit("]"))


def fill_placeholders(template, values: dict[str, Column]) -> Column:
    """I-15: literal replacement of ``{name}`` placeholders (never a format function)."""
    out = _c(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def startswith_any(c, prefixes: list[str]) -> Column:
    """I-05: true if the lower-cased string starts with any prefix."""
    low = F.lower(_c(c))
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | low.startswith(p)
    return cond


def contains_any(c, words: list[str]) -> Column:
    """I-07: true if the lower-cased string contains any word."""
    low = F.lower(_c(c))
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(low, F.lit(w))
    return cond


def word_set(c) -> Column:
    """I-19: Python ``s.split()`` (whitespace runs, no empty items) as an array."""
    s = py_strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{_WS}+"))


def zero_pad_id(prefix: str, n, width: int = 4) -> Column:
    """I-17: ``f"{prefix}_{n:0{width}d}"`` (wider numbers widen, as in Python)."""
    return F.format_string(f"{prefix}_%0{width}d", _c(n))


def type_alias(c, aliases: dict[str, str]) -> Column:
    """I-20: ``aliases.get(t.upper(), t.lower())``."""
    m = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.upper(_c(c))), F.lower(_c(c)))


def fmt_pct1(x) -> Column:
    """I-18: ``{x:.1%}`` (HALF_UP on the shortest decimal form)."""
    return F.concat(F.format_string("%.1f", _c(x) * 100), F.lit("%"))


def fmt_fixed(x, digits: int = 2) -> Column:
    """I-18: ``{x:.Nf}``."""
    return F.format_string(f"%.{digits}f", _c(x))
