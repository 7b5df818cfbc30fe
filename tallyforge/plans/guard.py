"""Read-only guard and plan analysis, on Spark's own parser.

A statement is read by the session's parser; the plan is walked through its children, expressions, subqueries and common table
expressions. What is allowed is listed, so a node that is not known is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Plan nodes that only read; names of aggregates; functions that reach outside the data.
QUERY_NODES = frozenset(
    "Project Filter UnresolvedHaving Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Union Intersect Except Distinct SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable UnresolvedWith WithWindowDefinition OneRowRelation$ OneRowRelation "
    "Generate UnresolvedTableValuedFunction LocalRelation Window Pivot Unpivot Sample UnresolvedHint GroupingSets ResolvedInlineTable Subquery".split()
)
AGGREGATES = frozenset("count sum avg min max total mean group_concat string_agg listagg collect_list collect_set array_agg stddev stddev_pop stddev_samp variance var_pop var_samp first last any_value median mode".split())
DENIED_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length load_extension".split())


#: Words that cannot name a column or table: where the parser takes one for a name, the statement broke off.
RESERVED = frozenset("select from where group by having order limit union intersect except join on and or not in as case when then else end".split())


class UnsafeSQL(ValueError):
    """Not exactly one statement that only reads."""


class BadSyntax(ValueError):
    """Not readable as SQL."""


def statements(sql: str) -> list[str]:
    """The statements of a text, split at semicolons outside quotes and comments."""
    out, start = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", sql, re.S):
        if m.group() == ";":
            out.append(sql[start : m.start()])
            start = m.end()
    return [s.strip() for s in [*out, sql[start:]] if s.strip()]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> Iterator:
    for i in range(seq.length()):
        yield seq.apply(i)


def walk_plan(plan) -> Iterator[tuple[str, object]]:
    """("plan", node) and ("expression", node) of a plan and all that is nested in it."""
    yield "plan", plan
    name = _name(plan)
    if name == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            yield from walk_plan(pair._2())
    for e in _items(plan.expressions()):
        yield from walk_expression(e)
    for child in _items(plan.children()):
        yield from walk_plan(child)


def walk_expression(e) -> Iterator[tuple[str, object]]:
    yield "expression", e
    try:
        inner = e.plan()
    except Exception:  # py4j: no such method, so the expression holds no query
        inner = None
    if inner is not None:
        yield from walk_plan(inner)
    for child in _items(e.children()):
        yield from walk_expression(child)


@dataclass
class Facts:
    """What a query is made of."""

    tables: set[str] = field(default_factory=set)
    columns: set[str] = field(default_factory=set)
    joins: list[str] = field(default_factory=list)
    filters: set[str] = field(default_factory=set)
    aggregates: set[str] = field(default_factory=set)
    groups: set[str] = field(default_factory=set)
    having: set[str] = field(default_factory=set)
    orders: set[str] = field(default_factory=set)
    limits: set[str] = field(default_factory=set)
    sets: list[str] = field(default_factory=list)
    selects: int = 0
    windows: int = 0
    ctes: set[str] = field(default_factory=set)


def parse(spark: SparkSession, sql: str):
    """The parsed plan of one statement."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise BadSyntax(str(e)) from e
    except Exception as e:  # py4j's own error, where it is not translated
        if "Parse" in str(e):
            raise BadSyntax(str(e)) from e
        raise


def one_query(sql: str) -> str:
    """The only statement of a text, as far as its words tell that it is a query; else UnsafeSQL or BadSyntax. Needs no session."""
    parts = statements(sql)
    if not parts:
        raise UnsafeSQL("SQL is empty")
    if len(parts) != 1:
        raise UnsafeSQL("exactly one statement is required")
    text = re.sub(r"^(?:\s|\(|--[^\n]*\n|/\*.*?\*/)+", "", parts[0], flags=re.S)
    word = re.match(r"[A-Za-z]*", text).group().upper()
    if word not in ("SELECT", "WITH"):
        raise UnsafeSQL(f"only SELECT and WITH queries are allowed, got {word or text[:10]!r}")
    if re.fullmatch(r"SELECT\s+FROM\b.*", text, re.I | re.S) or re.fullmatch(r"SELECT\s*", text, re.I):
        raise BadSyntax("nothing is selected")
    return parts[0]


def validate(spark: SparkSession, sql: str):
    """The plan of a text that is exactly one query; else UnsafeSQL or BadSyntax."""
    statement = one_query(sql)
    text = re.sub(r"^(?:\s|\(|--[^\n]*\n|/\*.*?\*/)+", "", statement, flags=re.S)
    plan = parse(spark, statement)
    for kind, node in walk_plan(plan):
        name = _name(node)
        if kind == "plan" and name not in QUERY_NODES:
            raise UnsafeSQL(f"{name} is not allowed")
        if name in ("Alias", "SubqueryAlias"):
            given = str(node.name() if name == "Alias" else node.alias()).lower()
            if given in RESERVED and f"`{given}`" not in text.lower() and f'"{given}"' not in text.lower():
                raise BadSyntax(f"nothing follows {given.upper()}")
        if kind == "expression" and name == "UnresolvedFunction":
            called = str(node.nameParts().last()).lower()
            if called in DENIED_FUNCTIONS:
                raise UnsafeSQL(f"function {called} is not allowed")
    return plan


def facts(spark: SparkSession, sql: str) -> Facts:
    """What a query is made of, names in lower case."""
    plan = validate(spark, sql)
    f = Facts()
    havings = set()
    for kind, node in walk_plan(plan):
        name = _name(node)
        if kind == "plan":
            if name == "UnresolvedWith":
                f.ctes |= {str(p._1()).lower() for p in _items(node.cteRelations())}
            elif name == "UnresolvedRelation":
                f.tables.add(".".join(str(x) for x in _items(node.multipartIdentifier())).lower())
            elif name == "Join":
                cond = node.condition()
                f.joins.append(f"{node.joinType().sql()} {cond.get().sql() if cond.isDefined() else ''}".lower())
            elif name in ("Project", "Aggregate"):
                f.selects += 1
                if name == "Aggregate":
                    f.groups |= {e.sql().lower() for e in _items(node.groupingExpressions())}
            elif name == "UnresolvedHaving":
                havings.add(node.havingCondition().sql().lower())
            elif name == "Filter":
                f.filters.add(node.condition().sql().lower())
            elif name == "Sort":
                f.orders |= {e.sql().lower() for e in _items(node.order())}
            elif name in ("GlobalLimit", "Offset"):
                f.limits.add(f"{name} {node.expressions().head().sql()}".lower())
            elif name in ("Union", "Intersect", "Except"):
                f.sets.append(name.lower())
        elif name == "UnresolvedAttribute":
            f.columns.add(node.sql().replace("`", "").lower())
        elif name == "UnresolvedFunction":
            if str(node.nameParts().last()).lower() in AGGREGATES:
                f.aggregates.add(node.sql().lower())
        elif name in ("WindowExpression", "UnresolvedWindowExpression"):
            f.windows += 1
    f.having = havings
    return f


def physical_tables(spark: SparkSession, sql: str) -> set[str]:
    """Tables that a query reads, without its common table expressions."""
    f = facts(spark, sql)
    return f.tables - f.ctes


def normalize(spark: SparkSession, sql: str) -> str:
    """A text that is equal for queries that differ in layout, comments, the case of unquoted words, or a last semicolon."""
    validate(spark, sql)
    text = re.sub(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)|--[^\n]*|/\*.*?\*/", lambda m: m.group(1) or " ", statements(sql)[0], flags=re.S)
    words = re.findall(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|[^\W\d][\w$]*|\d+(?:\.\d+)?|<>|!=|>=|<=|\|\||::|\S", text)
    return " ".join(w if w[0] in "'\"" else w.strip("`").lower() if w[0] == "`" else "<>" if w == "!=" else w.lower() for w in words)


def complexity(spark: SparkSession, sql: str) -> tuple[int, str]:
    """Score and class: joins (3 at most), nested selects and set operations twice, grouping, having, aggregates, windows twice, WITH."""
    f = facts(spark, sql)
    score = (
        min(3, len(f.joins))
        + 2 * max(0, f.selects - 1)
        + 2 * len(f.sets)
        + bool(f.groups)
        + bool(f.having)
        + bool(f.aggregates)
        + 2 * f.windows
        + bool(f.ctes)
    )
    return score, "simple" if score <= 1 else "moderate" if score <= 3 else "challenging"


#: What a failed execution says of the prediction.
STATUS_ERRORS = {"syntax_error": "syntax", "missing_table_or_column": "table_or_column", "unsupported_function": "function", "timeout": "timeout", "infrastructure_error": "infrastructure"}
LABELS = ("schema_linking", "join", "filter_value", "aggregation_grouping", "order_limit", "set_operation", "other_semantic")


def classify(spark: SparkSession, predicted: str | None, gold: str, status: str | None = None, terminal: str | None = None, fallback=None) -> str:
    """Kind of a wrong prediction: by its status, else by the first part in which the plans differ.

    ``fallback(predicted, gold)`` may name a label where no part differs; others than ``LABELS`` are not taken.
    """
    if "unsafe_sql" in (status, terminal):
        return "safety"
    if predicted is None or not predicted.strip():
        return "protocol"
    if status in STATUS_ERRORS:
        return STATUS_ERRORS[status]
    try:
        p = facts(spark, predicted)
    except UnsafeSQL:
        return "safety"
    except BadSyntax:
        return "syntax"
    try:
        g = facts(spark, gold)
    except ValueError:
        return "syntax"
    for label, parts in (
        ("schema_linking", lambda f: (f.tables, f.columns)),
        ("join", lambda f: set(f.joins)),
        ("filter_value", lambda f: f.filters),
        ("aggregation_grouping", lambda f: (f.aggregates, f.groups, f.having)),
        ("order_limit", lambda f: (f.orders, f.limits)),
        ("set_operation", lambda f: sorted(f.sets)),
    ):
        if parts(p) != parts(g):
            return label
    named = fallback(predicted, gold) if fallback else "other_semantic"
    return named if named in LABELS else "other_semantic"
