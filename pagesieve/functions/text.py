"""Text of HTML and word counts, as native column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = "\x01"
#: Patterns that both Java's and RE2's regular expressions read alike.
COMMENT = r"(?s)<!--.*?-->"
SCRIPT, STYLE, TEMPLATE = (rf"(?is)<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "template"))
TAG = r"(?s)</?[A-Za-z][^>]*>|<![^>]*>"
OPEN_TAG = r"(?s)<[A-Za-z][^>]*>"
WORD = r"[\p{L}\p{N}_]+"
EDGES = r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$"
SPACE = r"[ \t\n\r\x0B\f]+"
#: What follows an ampersand in a character reference.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def reference_names() -> dict[str, str]:
    """Characters by name: HTML's Latin, symbol and special sets, and C1 numbers as browsers read them (as Windows-1252)."""
    named = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
    return named | {f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def unescaped(t: Column) -> Column:
    """Character references (named, decimal, hexadecimal) as the characters they stand for; unknown ones stay as they are.

    Each piece's reference and number are bound, as an expression in a lambda is worked out anew wherever it is named.
    """
    table = lambda numbers: F.create_map(*[F.lit(x) for k, v in reference_names().items() if k.startswith("#") == numbers for x in (k, v)])
    names, numbers = table(False), table(True)

    def numbered(code):
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        other = F.when(bad, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(code.between(0x80, 0x9F), F.try_element_at(numbers, F.concat(F.lit("#"), code.cast("string")))).otherwise(other)

    def char(ref):
        hexadecimal = F.lower(F.substring(ref, 2, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(ref, 3, 6), 16, 10)).otherwise(F.substring(ref, 2, 7)).try_cast("int")
        return F.when(ref == "", None).when(F.startswith(ref, F.lit("#")), bound(code, numbered)).otherwise(F.try_element_at(names, ref))

    def one(x, i):
        replaced = lambda ref: bound(char(ref), lambda c: F.concat(c, F.substring(x, F.length(ref) + 2, F.length(x))))
        return F.when(i == 0, x).otherwise(bound(bound(F.regexp_extract(x, REFERENCE, 1), replaced), lambda y: F.coalesce(y, F.concat(F.lit("&"), x))))

    return bound(t, lambda whole: F.when(F.contains(whole, F.lit("&")), F.array_join(F.transform(F.split(whole, "&"), one), "")).otherwise(whole))


def html_text(html: Column) -> Column:
    """Visible text: comments, scripts, styles, templates and tags separate pieces; pieces are trimmed and joined by a space."""
    t = F.coalesce(html, F.lit(""))
    for p in (COMMENT, SCRIPT, STYLE, TEMPLATE, TAG):
        t = F.regexp_replace(t, p, BREAK)
    t = unescaped(t)
    return F.array_join(F.filter(F.transform(F.split(t, BREAK), stripped), lambda x: x != ""), " ")


def html_title(html: Column) -> Column:
    return unescaped(stripped(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def markup(html: Column) -> Column:
    """Tags without comments and without what scripts and styles hold."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), COMMENT, "")
    for tag in ("script", "style"):
        t = F.regexp_replace(t, rf"(?is)(<{tag}\b[^>]*>).*?(</{tag}\s*>|\z)", "$1$2")
    return t


def tag_count(marked: Column, tag: str | None = None) -> Column:
    return F.regexp_count(marked, F.lit(OPEN_TAG if tag is None else rf"(?is)<{tag}(?:[\s/][^>]*)?>")).cast("long")


def space_tokens(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"[^ \t\n\r\x0B\f]+")).cast("long")


def word_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))


def snippet(html: Column, size: int) -> Column:
    """The first ``size`` bytes as text; a character that the cut splits is dropped."""
    cut = F.substring(F.encode(F.coalesce(html, F.lit("")), "UTF-8"), 1, size)
    best = F.try_validate_utf8(cut.cast("string"))
    for k in (1, 2, 3):
        best = F.coalesce(best, F.try_validate_utf8(F.substring(cut, F.lit(1), F.greatest(F.length(cut) - k, F.lit(0))).cast("string")))
    return best


def first_keyword(t: Column, keywords) -> Column:
    """The first of ``keywords`` that occurs in ``t`` in any case, else null."""
    low = F.lower(t)
    return F.coalesce(F.lit(None).cast("string"), *[F.when(F.contains(low, F.lit(k.strip().lower())), F.lit(k)) for k in keywords if k.strip()])


# The same in DuckDB's SQL, for the queries' SQL.
def sql_unescaped(t: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in reference_names().items()) + "}"
    ref = f"regexp_extract(x, '{REFERENCE}', 1)"
    code = f"CASE WHEN {ref}[2:2] IN ('x', 'X') THEN TRY_CAST('0x' || {ref}[3:] AS INT) WHEN {ref}[1:1] = '#' THEN TRY_CAST({ref}[2:] AS INT) END"
    char = f"CASE WHEN ({code}) = 0 OR ({code}) > 1114111 OR ({code}) BETWEEN 55296 AND 57343 THEN chr(65533) WHEN ({code}) IS NOT NULL THEN chr({code}) END"
    found = f"coalesce({names}[coalesce('#' || CAST(({code}) AS VARCHAR), {ref})], {char})"
    one = f"CASE WHEN i = 1 THEN x WHEN {ref} = '' OR {found} IS NULL THEN '&' || x ELSE {found} || x[length({ref}) + 2:] END"
    return f"array_to_string(list_transform(string_split({t}, '&'), lambda x, i: {one}), '')"


def sql_html_text(c: str) -> str:
    t = f"coalesce({c}, '')"
    for p in (COMMENT, SCRIPT, STYLE, TEMPLATE, TAG):
        t = f"regexp_replace({t}, '{p}', chr(1), 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({sql_unescaped(t)}, chr(1)), lambda x: regexp_replace(x, '{EDGES}', '', 'g')), lambda x: x <> ''), ' ')"


def sql_tokens(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, '[^ \\t\\n\\r\\x0B\\f]+')) AS BIGINT)"


def sql_markup(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '{COMMENT}', '', 'g')"
    for tag in ("script", "style"):
        t = f"regexp_replace({t}, '(?is)(<{tag}\\b[^>]*>).*?(</{tag}\\s*>|\\z)', '\\1\\2', 'g')"
    return t


def sql_tags(c: str, tag: str | None = None) -> str:
    p = OPEN_TAG if tag is None else rf"(?is)<{tag}(?:[\s/][^>]*)?>"
    return f"CAST(len(regexp_extract_all({c}, '{p}')) AS BIGINT)"


def sql_first_keyword(c: str, keywords) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{k.lower()}') THEN '{k}'" for k in keywords) + " END"
