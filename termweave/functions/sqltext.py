"""Which tables the statements of a query log name or read, as column expressions.

For logged texts that can no longer be analysed. Where a statement can be analysed,
:func:`termweave.plans.receipts.relations_of` is exact.

:func:`tables_in_sql` is a rule on words: what follows FROM or JOIN counts as a table.
Names of WITH and an opening parenthesis count too, and tables after a comma do not.

:func:`tables_read` goes through the text once and keeps what is open in each
parenthesis. It also finds tables after a comma and names in quotes, and leaves out
comments, string literals, the FROM of functions, table functions and names that the
text defines itself (WITH), where these are known.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from termweave.functions.derive import strip_chars

# The word taken as a table, and words that are never one.
TABLE_WORD = r"(?i)\b(?:FROM|JOIN)\s+(\S+)"
NO_TABLES = ("select", "on", "where")

_NAME = r"""(?:"[^"]*"|`[^`]*`|[\w$]+)"""
_COMMENT_OR_TEXT = r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'"""
# A name, whether a parenthesis follows, or a mark; none of them in a comment or a string literal.
_TOKEN = re.compile(rf"{_COMMENT_OR_TEXT}|({_NAME}(?:\s*\.\s*{_NAME})*)(?=(\s*\()?)|([(),;])", re.DOTALL)
_PART = re.compile(_NAME)
_BEFORE_TABLE = ("lateral", "only")
_ENDS_TABLES = ("where", "group", "having", "order", "by", "limit", "union", "except", "intersect", "window", "qualify", "set")

# What is open in a parenthesis.
_START, _EXPRESSION, _WITH, _RECURSIVE, _QUERY, _TABLES = range(6)


def tables_in_sql(sql: Column) -> Column:
    """Array of the table names in a SQL text, first mention first, each once."""
    found = F.transform(F.regexp_extract_all(sql, F.lit(TABLE_WORD), 1), lambda w: strip_chars(w, ",;"))
    tables = F.filter(found, lambda w: ~F.lower(w).isin(*NO_TABLES))
    return F.array_distinct(F.transform(tables, lambda w: F.substring_index(w, ".", -1)))


def fanout(sql: Column) -> Column:
    """How many tables a SQL text names."""
    return F.size(tables_in_sql(sql))


def tables_read(sql: Column) -> Column:
    """Array of the tables that a SQL text reads, without qualifiers and quotes, first mention first, each once."""

    def found(text: str | None) -> list[str] | None:
        if text is None:
            return None
        tables, awaited, last = [], False, ""
        opened = [(_START, {})]  # per parenthesis what is open, and the names of WITH: whether they are known yet
        for token in _TOKEN.finditer(text):
            name, call, mark = token.groups()
            if not name and not mark:
                continue
            word = (name or mark).lower()
            kind, defined = opened[-1]
            if kind in (_WITH, _RECURSIVE) and name and last in ("with", "recursive", ","):
                if word == "recursive":
                    opened[-1] = (_RECURSIVE, defined)
                else:
                    defined[word.strip('"`')] = kind == _RECURSIVE
            elif word == "(":
                opened.append((_TABLES if awaited else _EXPRESSION, {}))
            elif word == ")":
                opened, awaited = opened[:-1] or opened, False
            elif word == ";":
                opened, awaited = [(_START, {})], False
            elif word == ",":
                awaited = kind == _TABLES
                if kind in (_WITH, _RECURSIVE):
                    opened[-1] = (kind, dict.fromkeys(defined, True))
            elif word == "with" and (kind == _START or awaited or last == "("):
                opened[-1], awaited = (_WITH, {}), False
            elif word in ("select", "values"):
                opened[-1], awaited = (_QUERY, dict.fromkeys(defined, True)), False
            elif word in ("from", "join") and kind != _EXPRESSION and last != "distinct":
                opened[-1], awaited = (_TABLES, dict.fromkeys(defined, True)), True
            elif kind == _TABLES and (word in _ENDS_TABLES or (last, word, awaited) == ("lateral", "view", False)):
                opened[-1], awaited = (_QUERY, defined), False
            elif awaited and word not in _BEFORE_TABLE:
                awaited = False
                *qualifiers, bare = (part.strip('"`') for part in _PART.findall(name))
                if not call and (qualifiers or not any(names.get(bare.lower()) for _, names in opened)):
                    tables.append(bare)
            last = word
        return list(dict.fromkeys(tables))

    return F.udf(found, "array<string>", useArrow=True)(sql)
