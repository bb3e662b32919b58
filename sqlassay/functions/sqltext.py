"""Column expressions over SQL text.

There is no parser here. Comments and literals are taken out first and patterns read the
rest, which covers the statements of the audited corpora; text they cannot read is
reported as unparsed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlassay.functions.rows import let

# --- fixed values ---------------------------------------------------------------------

DISALLOWED_WORDS = ["DROP", "DELETE", "TRUNCATE", "UPDATE", "INSERT", "ALTER", "CREATE", "GRANT", "REVOKE"]

# Short words an alias must not be.
RESERVED_ALIASES = [
    "abs", "all", "and", "any", "avg", "as", "at", "asc", "bit", "by", "day", "dec",
    "do", "div", "end", "for", "go", "in", "is", "not", "or", "to",
]

WRITE_WORDS = ["DROP", "DELETE", "TRUNCATE", "UPDATE", "INSERT", "ALTER"]

INNER_SEMICOLON = r";(?!\s*(--.*)?\s*$)"

# A capitalised part of every match, the pattern, and what it is; first hit wins.
DANGEROUS_PATTERNS = [
    ("GRANT", r"(?i)\bGRANT\b", "GRANT statement"),
    ("REVOKE", r"(?i)\bREVOKE\b", "REVOKE statement"),
    ("XP_CMDSHELL", r"(?i)xp_cmdshell", "xp_cmdshell execution"),
    ("SP_CONFIGURE", r"(?i)sp_configure", "sp_configure execution"),
    ("EXEC", r"(?i)exec\s*\(", "EXEC direct call"),
    (";", INNER_SEMICOLON, "Comment after semicolon (potential injection hiding)"),
    ("SHUTDOWN", r"(?i)\bSHUTDOWN\b", "SHUTDOWN command"),
    ("CREATE USER", r"(?i)\bCREATE USER\b", "CREATE USER statement"),
    ("CREATE LOGIN", r"(?i)\bCREATE LOGIN\b", "CREATE LOGIN statement"),
    ("CREATE ROLE", r"(?i)\bCREATE ROLE\b", "CREATE ROLE statement"),
]

# Reported with the text they matched and anchored at a word start; first a part of every match.
UNSAFE_PATTERNS = [
    ("XP_CMDSHELL", r"(?i)\bxp_cmdshell"),
    ("EXEC", r"(?i)\bexec(?=\s|\()"),
    ("SP_", r"(?i)\bsp_"),
    ("XP_", r"(?i)\bxp_"),
    (";", r";\s*--"),
]

# Words that are never a column.
KEYWORDS = (
    "all and any as asc between by case cast cross current current_date current_time current_timestamp "
    "desc distinct else end escape except exists false fetch following for from full group having "
    "ilike in inner intersect interval into is join lateral left like limit natural not null nulls "
    "offset on only or order outer over partition preceding range recursive right rlike row rows "
    "select set some table then true unbounded union using values when where window with"
).split()

# --- cleaning -------------------------------------------------------------------------

_LITERAL_OR_COMMENT = r"('[^']*(?:''[^']*)*')|(--[^\n]*)"
# Possessive, so that a word that leads nowhere is given up at once.
_NAME = r'(?:"[^"]++"|`[^`]++`|\[[^\]]++\]|(?<![\w$])[A-Za-z_][\w$]*+)'
_DOTTED = rf"{_NAME}(?:\s*\.\s*{_NAME})*"
_AFTER_TABLE = "on|using|where|join|inner|left|right|full|cross|natural|group|order|having|limit|offset|union|intersect|except|set|window|fetch|lateral|tablesample"
_ITEM = rf"{_DOTTED}(?:\s+(?:as\s+)?(?!(?:{_AFTER_TABLE})\b){_NAME})?"
_FROM_LIST = rf"(?i)\b(?:from|join)\s+({_ITEM}(?:\s*,\s*{_ITEM})*)"
_CTE_HEAD = rf"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)({_NAME})\s*(?:\([^()]*\))?\s+as\s*\("


def without_literals(sql: Column) -> Column:
    """String literals out, comments kept: lint patterns must not fire on quoted text."""
    return F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), _LITERAL_OR_COMMENT, "$2")


def bare(sql: Column) -> Column:
    """Comments out, literals emptied, date parts and typed literals gone: names are read from this."""
    text = F.regexp_replace(sql, r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, _LITERAL_OR_COMMENT, "''$2")
    text = F.regexp_replace(text, r"(?:'')?--[^\n]*", " ")
    text = F.regexp_replace(text, r"(?i)\b(?:date|timestamp|time|interval)\s*''(?:\s*(?:year|month|day|hour|minute|second)s?\b)?", " ")
    text = F.regexp_replace(text, r"(?i)\binterval\s+\d+\s+\w+", " ")
    # FROM inside EXTRACT(... FROM x) and IS DISTINCT FROM names no table.
    text = F.regexp_replace(text, r"(?i)\bextract\s*\(\s*\w+\s+from\b", "(")
    text = F.regexp_replace(text, r"(?i)\b(substring|trim|overlay)\s*\(([^()]*?)\bfrom\b", "$1($2,")
    return F.regexp_replace(text, r"(?i)\bdistinct\s+from\b", "=")


def plain_name(name: Column) -> Column:
    """Last part of a dotted name, quotes off, lower case."""
    quoted = name.rlike(r'["`\[]')
    last = F.regexp_replace(F.regexp_extract(name, rf"({_NAME})\s*$", 1), r'["`\[\]]', "")
    return F.lower(F.when(quoted, last).otherwise(F.trim(F.substring_index(name, ".", -1))))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


# --- ORDER BY -------------------------------------------------------------------------

_AFTER_LAST_ORDER_BY = r"(?is)^.*\border\s+by\s+(.*)$"
_AFTER_KEYS = r"(?is)\s*(?:\b(?:limit|offset|fetch)\b|;).*$"


def split_top_level(text: Column) -> Column:
    """Split at commas outside brackets, whatever their depth; a closing bracket without an opening one ends the text.

    The text is cut at every bracket and comma; a running count of brackets tells which commas stand outside.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"[(),]|[^(),]+"), F.lit(0))
    empty = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("ended")
    )

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        ended = state["ended"] | (depth < 0)
        cut = (token == ",") & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(ended, state["open"]).when(cut, F.lit("")).otherwise(F.concat(state["open"], token)).alias("open"),
            F.when(cut & ~ended, F.concat(state["items"], F.array(state["open"]))).otherwise(state["items"]).alias("items"),
            ended.alias("ended"),
        )

    folded = F.aggregate(tokens, empty, step, lambda state: F.concat(state["items"], F.array(state["open"])))
    plain = F.split(F.substring_index(text, ")", 1), ",")
    return F.transform(F.when(text.contains("("), folded).otherwise(plain), lambda item: F.trim(item))


def order_items(sql: Column) -> Column:
    """The items of the last ORDER BY; an empty array if there is none."""
    clause = F.regexp_extract(bare(sql), _AFTER_LAST_ORDER_BY, 1)
    # A bracket that nothing opened closes the query around the clause.
    items = F.transform(split_top_level(clause), lambda item: F.regexp_replace(item, _AFTER_KEYS, ""))
    return F.when(sql.rlike(r"(?i)\border\s+by\b"), F.filter(items, lambda i: i != "")).otherwise(
        F.array().cast("array<string>")
    )


def order_item_name(item: Column) -> Column:
    """Column of an ORDER BY item: direction and qualifier off."""
    name = F.regexp_replace(item, r"(?is)\s+(?:asc|desc|nulls)\b.*$", "")
    simple = name.rlike(rf"^\s*{_DOTTED}\s*$")
    unqualified = F.regexp_replace(F.regexp_extract(name, rf"({_NAME})\s*$", 1), r'["`\[\]]', "")
    return F.when(simple, unqualified).otherwise(F.trim(name))


# --- names ----------------------------------------------------------------------------


def cte_names(text: Column) -> Column:
    """Names defined by WITH, lower case."""
    names = F.transform(_all(text, _CTE_HEAD, 1), plain_name)
    return F.when(text.rlike(r"(?i)^\s*with\b"), F.array_distinct(names)).otherwise(F.array().cast("array<string>"))


def from_items(text: Column) -> Column:
    """``struct(table_name, alias)`` per FROM or JOIN item."""
    lists = _all(text, _FROM_LIST, 1)
    items = F.flatten(F.transform(lists, lambda l: F.split(l, ",")))
    dotted = rf"^\s*({_DOTTED})"
    alias = rf"(?i)^\s*{_DOTTED}\s+(?:as\s+)?({_NAME})\s*$"
    pairs = F.transform(
        items,
        lambda i: F.struct(
            plain_name(F.regexp_extract(i, dotted, 1)).alias("table_name"),
            F.lower(F.regexp_replace(F.regexp_extract(i, alias, 1), r'["`\[\]]', "")).alias("alias"),
        ),
    )
    return F.filter(pairs, lambda p: p["table_name"] != "")


def table_items(items: Column, ctes: Column) -> Column:
    """The items that are no CTE."""
    return F.filter(items, lambda p: ~F.array_contains(ctes, p["table_name"]))


def cte_aliases(items: Column, ctes: Column) -> Column:
    return F.transform(F.filter(items, lambda p: F.array_contains(ctes, p["table_name"])), lambda p: p["alias"])


_NO_NAME = rf"(?!(?:{'|'.join(KEYWORDS)}|group|order|union|fetch|tablesample)\b)"
# A word after an operand and before a comma, a bracket, FROM or the end is a name given without AS.
_QUOTED = r'(?:"[^"]++"|`[^`]++`|\[[^\]]++\])'
_OPERAND = rf"(?:\)|''|\bend\b|(?<![\w$.]){_NO_NAME}[\w$]+(?:\s*\.\s*{_NAME})*|{_QUOTED})"
_GIVEN = rf"(?i){_OPERAND}\s+{_NO_NAME}({_NAME})\s*(?=,|\)|\bfrom\b|;|$)"
# The name of a bracketed FROM item, or of a call in the select list.
_AFTER_BRACKET = rf"(?i)\)\s*(?:\bas\s+)?{_NO_NAME}({_NAME})"


def derived_names(text: Column) -> Column:
    """Names that stand after a closing bracket, lower case: what they qualify is no table of a catalog."""
    return F.transform(_all(text, _AFTER_BRACKET, 1), plain_name)


def output_names(text: Column) -> Column:
    """Names given with or without AS, lower case."""
    given = F.concat(_all(text, rf"(?i)\bas\s+({_NAME})", 1), _all(text, _GIVEN, 1), _all(text, _AFTER_BRACKET, 1))
    return F.transform(given, plain_name)


# What is not a column, each taken as a whole, then the dotted names that are left.
_COLUMN = (
    rf"{_CTE_HEAD}|{_FROM_LIST}|\bas\s+{_NAME}|{_DOTTED}\s*+\.\s*+\*|"
    rf"(?<![\w$])[A-Za-z_][\w$]*+\s*+\(|(?<![\w.])({_DOTTED})"
)
_COLUMN_GROUP = 3


def column_items(text: Column, output: Column) -> Column:
    """``struct(qualifier, column_name)`` per column read; the names in ``output`` are left out."""
    names = F.array_distinct(F.filter(_all(text, _COLUMN, _COLUMN_GROUP), lambda n: n != ""))
    pairs = F.transform(
        names,
        lambda n: F.struct(
            F.when(
                n.contains("."), plain_name(F.regexp_extract(n, rf"({_NAME})\s*\.\s*{_NAME}\s*$", 1))
            ).alias("qualifier"),
            plain_name(n).alias("column_name"),
            n.rlike('^["`\\[]').alias("quoted"),
        ),
    )
    real = F.filter(
        pairs,
        lambda p: p["qualifier"].isNotNull()
        | ((p["quoted"] | ~p["column_name"].isin(*KEYWORDS)) & ~F.array_contains(output, p["column_name"])),
    )
    return F.array_distinct(
        F.transform(real, lambda p: F.struct(p["qualifier"].alias("qualifier"), p["column_name"].alias("column_name")))
    )


def is_unparsed(text: Column) -> Column:
    """Text the patterns cannot stand for: not a query, no select list, or open brackets or quotes."""
    query = text.rlike(r"(?is)^\s*\(?\s*(select|with)\b")
    empty_list = text.rlike(r"(?i)\bselect\s+(distinct\s+)?from\b")
    opened = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    closed = F.length(text) - F.length(F.replace(text, F.lit(")"), F.lit("")))
    quotes = F.length(text) - F.length(F.replace(text, F.lit("'"), F.lit("")))
    return ~query | empty_list | (opened != closed) | (quotes % 2 != 0)


# --- DDL ------------------------------------------------------------------------------

_CREATE = (
    r'(?is)^\s*create\s+(?:or\s+replace\s+)?(?:temporary\s+|temp\s+)?(table|view)\s+(?:if\s+not\s+exists\s+)?'
    rf"({_DOTTED})"
)
_CONSTRAINT = r"(?i)^\s*(constraint|primary\s+key|foreign\s+key|unique|check|index|like)\b"


def ddl_statements(script: Column) -> Column:
    """CREATE statements of a script in order, comments out."""
    text = F.regexp_replace(script, r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, _LITERAL_OR_COMMENT, "''$2")
    text = F.regexp_replace(text, r"(?:'')?--[^\n]*", "")
    return F.filter(F.split(text, ";"), lambda s: s.rlike(_CREATE))


def ddl_table(statement: Column) -> Column:
    return plain_name(F.regexp_extract(statement, _CREATE, 2))


def ddl_columns(statement: Column) -> Column:
    """``struct(column_name, data_type)`` per column of a CREATE TABLE or VIEW, in order."""
    is_view = F.lower(F.regexp_extract(statement, _CREATE, 1)) == "view"
    body = F.regexp_extract(statement, r"(?s)\((.*)\)[^)]*$", 1)
    select_list = F.regexp_extract(statement, r"(?is)\bselect\s+(?:distinct\s+)?(.*?)\bfrom\b", 1)
    source = F.when(is_view, select_list).otherwise(body)
    parts = F.filter(split_top_level(source), lambda p: (p != "") & (is_view | ~p.rlike(_CONSTRAINT)))
    by_alias = rf"(?is)\bas\s+({_NAME})\s*$"

    def view_column(part: Column) -> Column:
        name = F.when(part.rlike(by_alias), F.regexp_extract(part, by_alias, 1)).otherwise(
            F.regexp_extract(part, rf"({_NAME})\s*$", 1)
        )
        return F.struct(plain_name(name).alias("column_name"), F.lit("").alias("data_type"))

    def table_column(part: Column) -> Column:
        return F.struct(
            plain_name(F.regexp_extract(part, rf"^\s*({_NAME})", 1)).alias("column_name"),
            F.upper(F.trim(F.regexp_extract(part, rf"(?i)^\s*{_NAME}\s+([a-z]+\s*(?:\([^()]*\))?)", 1))).alias("data_type"),
        )

    columns = F.when(is_view, F.transform(parts, view_column)).otherwise(F.transform(parts, table_column))
    return F.filter(columns, lambda c: c["column_name"] != "")
