"""Pieces of DuckDB SQL that several oracles share."""

from quillspan.functions.text import FOLD_FROM, FOLD_TO, STOPWORDS


def fold(expr: str) -> str:
    return f"lower(translate({expr}, '{FOLD_FROM}', '{FOLD_TO}'))"


STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
REFERENCE = r"\b(?:([123])\s*)?([a-zñ]{2,16})\.?\s*(\d{1,3}):(\d{1,3})"


def tokens(expr: str) -> str:
    low = fold(expr)
    words = rf"list_filter(regexp_extract_all({low}, '([\p{{L}}\p{{N}}]+)', 1), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))"
    part = lambda i: f"regexp_extract_all({low}, '{REFERENCE}', {i})"
    refs = f"list_transform(list_filter(list_zip({part(1)}, {part(2)}, {part(3)}, {part(4)}), lambda r: NOT list_contains({STOP}, r[2])), lambda r: concat(r[1], r[2], r[3], 'v', r[4]))"
    return f"list_concat({words}, {refs})"
