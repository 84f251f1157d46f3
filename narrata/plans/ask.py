"""Questions over views: declared once, planned as DataFrames, and spelt as SQL for the oracle."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.plans.views import Views


@dataclass(frozen=True)
class Ask:
    """A question.

    of: 'view alias'. pick: expressions 'x AS name', parted by semicolons, or '*'. by: grouping expressions
    in the same form; pick then holds aggregates. joins: (how, 'view alias' or (Ask, alias), condition).
    among: (expression, Ask) keeps rows whose value the other question gives. one: named questions of one
    value, used as $name. order: names, with DESC; nulls count as lowest. also: questions to append.
    JOINED(x | y) is a text of x in the order of y, nulls left out.
    """

    of: str
    pick: str = "*"
    where: str = ""
    by: str = ""
    joins: tuple = ()
    among: tuple = ()
    one: dict = field(default_factory=dict)
    having: str = ""
    distinct: bool = False
    order: str = ""
    limit: int | None = None
    skip: int = 0
    also: tuple = ()


def _items(spec: str) -> list[str]:
    return [x.strip() for x in spec.split(";") if x.strip()]


def _keys(order: str) -> list[tuple[str, bool]]:
    return [(x.split()[0], x.upper().endswith(" DESC")) for x in map(str.strip, order.split(",")) if x]


_JOINED = re.compile(r"JOINED\(([^|()]*(?:\([^()]*\)[^|()]*)*)\|([^()]*)\)")


def _spark(text: str) -> str:
    return _JOINED.sub(r"listagg(\1, ', ') WITHIN GROUP (ORDER BY \2)", re.sub(r"\$(\w+)", r"_\1", text))


def plan(ask: Ask, views: Views) -> DataFrame:
    """The question as a DataFrame."""
    name, alias = ask.of.split()
    df = views[name].alias(alias)
    for how, what, on in ask.joins:
        side = plan(what[0], views).alias(what[1]) if isinstance(what, tuple) else views[what.split()[0]].alias(what.split()[1])
        df = df.join(side, F.expr(on), how)
    if ask.where:
        df = df.where(F.expr(ask.where))
    for key, other in [ask.among] if ask.among else []:
        inner = plan(other, views).toDF("_key").distinct()
        df = df.join(inner, F.expr(key) == F.col("_key"), "left_semi")
    for one, other in ask.one.items():
        df = df.crossJoin(F.broadcast(plan(other, views).toDF(f"_{one}")))
    if ask.by:
        groups = [F.expr(_spark(x)) for x in _items(ask.by)]
        keys = [f"_{n}" for n in ask.one]
        df = df.groupBy(*groups, *keys).agg(*(F.expr(_spark(x)) for x in _items(ask.pick)) or (F.count(F.lit(1)),))
        df = df.where(F.expr(ask.having)).drop(*keys) if ask.having else df.drop(*keys)
    sort: list[Column] = [F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in _keys(ask.order)]
    plain = not ask.by and ask.pick != "*"
    grand = plain and not ask.order and not ask.distinct and re.match(r"(?i)(CAST\()?(count|sum|min|max|avg|round)\(", ask.pick)
    if grand:
        df = df.agg(*(F.expr(_spark(x)) for x in _items(ask.pick)))
    elif plain and ask.distinct:
        df = df.select(*(F.expr(_spark(x)) for x in _items(ask.pick))).distinct()
    if sort:
        df = df.orderBy(*sort)
    if ask.skip:
        df = df.offset(ask.skip)
    if ask.limit is not None:
        df = df.limit(ask.limit)
    if plain and not grand and not ask.distinct:
        df = df.select(*(F.expr(_spark(x)) for x in _items(ask.pick)))
    for other in ask.also:
        df = df.unionByName(plan(other, views))
    return df


def sql(ask: Ask) -> str:
    """The question as DuckDB SQL over {views}."""
    spell = lambda t: re.sub(r"\$(\w+)", lambda m: f"({sql(ask.one[m[1]])})", _JOINED.sub(r"string_agg(\1, ', ' ORDER BY \2)", t))
    name, alias = ask.of.split()
    text = f" FROM {{{name}}} {alias}"
    for how, what, on in ask.joins:
        side = f"({sql(what[0])}) {what[1]}" if isinstance(what, tuple) else "{%s} %s" % tuple(what.split())
        text += f" {how.upper()} JOIN {side} ON {on}"
    wheres = [f"({ask.where})"] * bool(ask.where) + [f"{k} IN ({sql(o)})" for k, o in ([ask.among] if ask.among else [])]
    text += " WHERE " + " AND ".join(wheres) if wheres else ""
    groups, picks = _items(ask.by), _items(ask.pick)
    if ask.by:
        text += " GROUP BY " + ", ".join(re.sub(r"(?i) AS \w+$", "", spell(g)) for g in groups)
        text += f" HAVING {_unnamed(ask)}" if ask.having else ""
    head = "SELECT " + "DISTINCT " * ask.distinct + ", ".join(map(spell, groups + picks)) + text
    if ask.order and (ask.limit is not None or ask.skip):
        head += " ORDER BY " + ", ".join(f"{k} DESC NULLS LAST" if d else f"{k} ASC NULLS FIRST" for k, d in _keys(ask.order))
    head += f" LIMIT {ask.limit}" if ask.limit is not None else ""
    head += f" OFFSET {ask.skip}" if ask.skip else ""
    return " UNION ALL ".join([head, *map(sql, ask.also)])


def _unnamed(ask: Ask) -> str:
    """HAVING with the aggregates' names replaced by the aggregates."""
    out = ask.having
    for item in _items(ask.pick):
        expression, _, name = item.rpartition(" AS ")
        out = re.sub(rf"\b{name}\b", expression.replace("\\", "\\\\"), out)
    return out
