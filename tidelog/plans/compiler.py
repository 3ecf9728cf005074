"""Query to DataFrame.

Patterns become relations with one column for each variable; relations join on *all* variables
they share, multiplying weights. Patterns over one entity whose attributes are single-valued columns of one
table with a unique key become one scan (Catalyst would keep the self-joins). The order is
greedy: constants first, then whatever shares a variable; what shares none is a cartesian product at the
end. Where many rows meet many, each side is added up over the variables that are still needed before they meet, and
pairs are made in as many tasks as the sides are large. Filters are left where they are written: Catalyst pushes them into the scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnboundVariableError, UnsupportedQueryError
from ..functions.predicates import predicate
from ..operators.zframe import W, ZFrame
from ..sources.catalog import AttributeCatalog
from .ast import Attr, Blank, Clause, Const, GetElse, Not, Or, Pattern, Predicate, Query, Term, Var
from .parser import bound, parse_query

#: A side of up to so many bytes, by the plan's estimate, goes whole to every task where many rows meet many.
MAX_BROADCAST_BYTES = 2**25
#: A task gets so many bytes of the other side, or so large a part of the product of both, whichever is more; so many tasks at most.
SPREAD_BYTES, SPREAD_PRODUCT, MAX_SPREAD = 2**10, 2**28, 4096
#: An estimate above this says nothing.
UNKNOWN_BYTES = 2**50

#: Relation of one pattern by its index in the query's patterns: columns e, v0 (or e, a, v, v_type) and w; None: from the catalog.
Override = Callable[[int, Pattern], ZFrame | None]


@dataclass
class _Relation:
    """``key``: variables in which no two rows agree, None if there are none. An attribute stored on its own counts as
    single-valued unless it says otherwise; the key decides how a join is done, not what it gives."""

    frame: ZFrame
    constants: int
    key: frozenset[str] | None = None

    @property
    def variables(self) -> set[str]:
        return set(self.frame.columns)


def _literal(value: object) -> Column:
    """A constant; the grammar knows collections, but no column holds one."""
    if isinstance(value, frozenset | dict | list | tuple):
        raise UnsupportedQueryError("constant", value, "a constant is a single value")
    return F.lit(value)


def _bind(frame: ZFrame, places: list[tuple[str, Term]], key: tuple[str, ...] = ("e",)) -> _Relation:
    """Columns to variables: constants filter, a variable met again must be equal, ``_`` goes. ``key`` names unique columns."""
    first: dict[str, str] = {}
    constants = 0
    for column, term in places:
        if isinstance(term, Const):
            frame, constants = frame.where(F.col(column) == _literal(term.value)), constants + 1
        elif isinstance(term, Var):
            if term.name in first:
                frame, constants = frame.where(F.col(first[term.name]) == F.col(column)), constants + 1
            first.setdefault(term.name, column)
    terms = [term for column, term in places if column in key]
    unique = None if any(isinstance(t, Blank) for t in terms) else frozenset(t.name for t in terms if isinstance(t, Var))
    return _Relation(frame.select(*[F.col(c).alias(v) for v, c in first.items()]), constants, unique)


def _text_const(term: Term) -> Term:
    if isinstance(term, Const):
        _literal(term.value)
    return Const(str(term.value).lower() if isinstance(term.value, bool) else str(term.value)) if isinstance(term, Const) else term


def _const_type(value: object) -> str | None:
    return {bool: "boolean", int: "long", float: "double", str: "string"}.get(type(value))


def _wild(catalog: AttributeCatalog, pattern: Pattern, frame: ZFrame | None) -> _Relation:
    kind = _const_type(pattern.value.value) if isinstance(pattern.value, Const) else None
    frame = frame or catalog.wildcard(entity=pattern.entity.value if isinstance(pattern.entity, Const) else None, kind=kind)
    if kind:
        frame = frame.where(F.col("v_type") == kind)
    return _bind(frame, [("e", pattern.entity), ("a", pattern.attribute), ("v", _text_const(pattern.value))], ("e", "a", "v"))


def _relations(catalog: AttributeCatalog, patterns: list[Pattern], override: Override | None) -> list[_Relation]:
    out: list[_Relation] = []
    stars: dict[tuple[Term, str], list[Pattern]] = {}
    for i, p in enumerate(patterns):
        own = override(i, p) if override else None
        if not isinstance(p.attribute, Attr):
            out.append(_wild(catalog, p, own))
        elif own is not None:
            out.append(_bind(own, [("e", p.entity), ("v0", p.value)]))
        else:
            a = catalog.get(p.attribute.name)
            if a.table.unique and not a.many and not isinstance(p.entity, Blank):
                stars.setdefault((p.entity, a.table.name), []).append(p)
            else:
                out.append(_bind(catalog.star([a.name], *_fixed(catalog, p.entity, [p])), [("e", p.entity), ("v0", p.value)], ("e", "v0") if a.many else ("e",)))
    for (entity, _), group in stars.items():
        names = list(dict.fromkeys(p.attribute.name for p in group))
        places = [("e", entity)] + [(f"v{names.index(p.attribute.name)}", p.value) for p in group]
        out.append(_bind(catalog.star(names, *_fixed(catalog, entity, group)), places))
    return out


def _fixed(catalog: AttributeCatalog, entity: Term, patterns: list[Pattern]) -> tuple[int | None, dict[str, int]]:
    """The entity that is stated, and the targets that are stated for reference attributes."""
    refers = {p.attribute.name: p.value.value for p in patterns if isinstance(p.value, Const) and isinstance(p.value.value, int) and catalog.get(p.attribute.name).ref}
    return (entity.value if isinstance(entity, Const) else None), refers


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, mostly from file sizes; immense where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _reduced(relation: _Relation, keep: set[str], as_set: bool) -> _Relation:
    """Without variables that are not in ``keep``; rows that have become equal are one, with the sum of their weights."""
    if relation.key is not None and relation.key <= keep:
        return relation
    frame = relation.frame.select(*[F.col(f"`{c}`") for c in relation.frame.columns if c in keep])
    return _Relation(frame.support() if as_set and frame.unit else frame.consolidate(), relation.constants, frozenset(frame.columns))


def _spread(left: ZFrame, right: ZFrame, on: list[str]) -> tuple[ZFrame, ZFrame]:
    """Both sides of a join in which rows meet many: if one is small it goes to all tasks and the other is cut finely.

    The cut is by variables that stay in the result, so that an aggregate over these needs no shuffle of the pairs.
    """
    sizes = estimated_bytes(left.df), estimated_bytes(right.df)
    if min(sizes) > MAX_BROADCAST_BYTES or max(sizes) > UNKNOWN_BYTES:
        return left, right
    parts = min(max(sizes) // SPREAD_BYTES, sizes[0] * sizes[1] // SPREAD_PRODUCT, MAX_SPREAD) + 1
    cut = lambda z: ZFrame(z.df.repartition(parts, *[F.col(f"`{c}`") for c in z.columns if c not in on]), z.unit)
    small = lambda z: ZFrame(F.broadcast(z.df), z.unit)
    return (cut(left), small(right)) if sizes[0] >= sizes[1] else (small(left), cut(right))


def _met(left: _Relation, right: _Relation, keep: set[str] | None, as_set: bool) -> _Relation:
    """The join of two relations that share variables. ``keep``: what is needed after it (all if None)."""
    on = left.variables & right.variables
    many = lambda r: r.key is None or not r.key <= on
    if many(left) and many(right) and keep is not None:
        left, right = (_reduced(r, keep | on, as_set) for r in (left, right))
    key = None if left.key is None or right.key is None else left.key | right.key
    if not many(right):
        key = left.key
    elif not many(left):
        key = right.key
    a, b = left.frame, right.frame
    if many(left) and many(right) and left.variables - on and right.variables - on:
        a, b = _spread(a, b, sorted(on))
    return _Relation(a.join(b, sorted(on)), left.constants, key)


def _joined(relations: list[_Relation], needed: set[str] | None = None, as_set: bool = False) -> ZFrame:
    """Left-deep by shared variables; the most constants first.

    Parts that share no variable are multiplied. Before that each is added up over the variables that are ``needed``
    later (all if None): one that binds none of them is a single row with its total weight. With ``as_set`` only the set
    of rows counts, so rows that all have weight 1 need no sums.
    """
    as_set = as_set and all(r.frame.unit for r in relations)
    rest = sorted(relations, key=lambda r: -r.constants)
    parts: list[ZFrame] = []
    while rest:
        part = rest.pop(0)
        while near := [r for r in rest if r.variables & part.variables]:
            nearest = max(near, key=lambda r: (r.constants, len(r.variables & part.variables)))
            rest.remove(nearest)
            part = _met(part, nearest, None if needed is None else needed.union(*(r.variables for r in rest)), as_set)
        parts.append(part.frame)
    if len(parts) > 1 and needed is not None:
        parts = [p.select(*[c for c in p.columns if c in needed]).consolidate() for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.times(part)
    return out


def _used(clause: Clause) -> set[str]:
    """Variables of a clause that is no pattern."""
    if isinstance(clause, Predicate):
        return {a.name for a in clause.args if isinstance(a, Var)}
    if isinstance(clause, GetElse):
        return {clause.entity.name, clause.out}
    if isinstance(clause, Not):
        return set().union(*(bound((c,)) if isinstance(c, Pattern | Or) else _used(c) for c in clause.clauses))
    return set()


def _conditions(frame: ZFrame, predicates: list[Predicate]) -> ZFrame:
    kinds = {f.name: f.dataType for f in frame.df.schema.fields}
    for p in predicates:
        args = []
        for a in p.args:
            if isinstance(a, Var):
                if a.name not in kinds:
                    raise UnboundVariableError(f"no pattern binds ?{a.name}")
                args.append((F.col(a.name), kinds[a.name]))
            else:
                literal = _literal(a.value)
                args.append((literal, frame.df.select(literal.alias("x")).schema[0].dataType))
        frame = frame.where(predicate(p.op, args))
    return frame


def body(catalog: AttributeCatalog, clauses: tuple[Clause, ...], override: Override | None = None, given: ZFrame | None = None, needed: set[str] | None = None, as_set: bool = False) -> ZFrame:
    """The weighted relation of all variables that ``clauses`` (and ``given``) bind, or of those in ``needed`` at least.

    With ``as_set`` its weights only say which rows are there.
    """
    relations = _relations(catalog, [c for c in clauses if isinstance(c, Pattern)], override)
    if given is not None:
        relations.append(_Relation(given, 1, frozenset(given.columns)))
    for c in clauses:
        if isinstance(c, Or):
            shared = sorted(set.intersection(*(bound(b) for b in c.branches)))
            parts = [body(catalog, b, needed=set(shared), as_set=True).select(*shared) for b in c.branches]
            relations.append(_Relation(ZFrame(parts[0].union(*parts[1:]).distinct_set()), 0, frozenset(shared)))
    if not relations:
        raise UnsupportedQueryError("where", clauses, "no pattern")
    frame = _joined(relations, None if needed is None else needed.union(*(_used(c) for c in clauses)), as_set)
    for c in clauses:
        if isinstance(c, GetElse):
            values = catalog.star([c.attribute]).df.select(F.col("e").alias(c.entity.name), F.col("v0").alias(c.out))
            frame = ZFrame(frame.df.join(values, c.entity.name, "left").withColumn(c.out, F.coalesce(F.col(c.out), F.lit(c.default))))
    frame = _conditions(frame, [c for c in clauses if isinstance(c, Predicate)])
    for c in clauses:
        if isinstance(c, Not):
            inner = ZFrame(body(catalog, c.clauses, needed=set(frame.columns), as_set=True).distinct_set())
            if not (shared := sorted(set(inner.columns) & set(frame.columns))):
                raise UnboundVariableError("a not clause shares no variable with the rest")
            frame = ZFrame(frame.df.join(inner.df.select(*shared), shared, "left_anti"), frame.unit)
    return frame


def compile_query(query: Query, catalog: AttributeCatalog, override: Override | None = None, inputs: DataFrame | None = None) -> ZFrame:
    """The weighted relation that :find reads from: its variables (and :with), before aggregates or the set view; those that are only counted may be missing."""
    if query.inputs and (inputs is None or {i.strip() for i in query.inputs} - set(inputs.columns)):
        raise UnboundVariableError("inputs for " + ", ".join(f"?{i.strip()}" for i in query.inputs))
    given = ZFrame(inputs.select(*[F.col(f"`{i.strip()}`").alias(i) for i in query.inputs]).distinct()) if query.inputs else None
    # A count is a sum of weights, which hold no value of its variable.
    counted = {"count"} if not query.with_vars and not _needs_rows(query) else set()
    needed = dict.fromkeys([*query.plain, *(a.var for a in query.aggregates if a.fn not in counted), *query.with_vars])
    frame = body(catalog, query.where, override, given, set(needed), not query.aggregates or bool(query.with_vars))
    return frame.select(*needed)


def _needs_rows(query: Query) -> bool:
    return any(a.fn in ("min", "max", "count-distinct") for a in query.aggregates)


def aggregate_delta(query: Query, frame: ZFrame) -> DataFrame:
    """Linear aggregates of ``frame`` under their :find names, with the hidden ``_cnt``; deltas of it add up."""
    sums = {name: F.col(f.var) for f, name in zip(query.find, query.columns(), strict=True) if not isinstance(f, Var) and f.fn in ("sum", "avg")}
    counts = [name for f, name in zip(query.find, query.columns(), strict=True) if not isinstance(f, Var) and f.fn == "count"]
    return frame.aggregate(list(dict.fromkeys(query.plain)), sums, counts)


def read_out(query: Query, frame: ZFrame) -> DataFrame:
    """Result of :find: a set of rows, or aggregates over the bag of rows (over distinct rows where :with says so)."""
    if not query.aggregates:
        return frame.distinct_set().select(*[F.col(f.name).alias(c) for f, c in zip(query.find, query.columns(), strict=True)])
    if query.with_vars:
        frame = ZFrame(frame.distinct_set())
    if _needs_rows(query):
        frame = frame.positive()
    aggregated = []
    for f, name in zip(query.find, query.columns(), strict=True):
        if isinstance(f, Var):
            continue
        x, w = F.col(f.var), F.col(W)
        aggregated.append({"sum": F.sum(x * w), "count": F.sum(w), "avg": F.sum(x * w) / F.sum(w), "min": F.min(x), "max": F.max(x), "count-distinct": F.countDistinct(x)}[f.fn].alias(name))
    grouped = frame.df.groupBy(*dict.fromkeys(query.plain)).agg(*aggregated, F.sum(W).alias("_cnt")).where("_cnt <> 0")
    return grouped.select(*[F.col(f.name if isinstance(f, Var) else c).alias(c) for f, c in zip(query.find, query.columns(), strict=True)])


def run_query(query: str | list | Query, catalog: AttributeCatalog, extended: bool = False, inputs: DataFrame | None = None) -> DataFrame:
    """Parse, compile and read out: a DataFrame with one column for each :find element."""
    parsed = query if isinstance(query, Query) else parse_query(query, extended)
    return read_out(parsed, compile_query(parsed, catalog, inputs=inputs))
