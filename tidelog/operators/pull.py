"""Flat result rows to nested ones.

A pattern is a list of column names (``*`` and ``ns_*`` expand against the columns) and one-entry
dicts ``{name: pattern}`` that nest. Rows that agree in a level's columns become one, with the
nested rows as an array; an absent value is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import AttributeCatalog


def _split(pattern: list) -> tuple[list[str], list[tuple[str, list]]]:
    return [p for p in pattern if isinstance(p, str)], [(k, v) for p in pattern if isinstance(p, dict) for k, v in p.items()]


def expand(keys: list[str], columns: list[str]) -> list[str]:
    """Wildcards to columns, each once, in the order asked for."""
    out: list[str] = []
    for k in keys:
        out += [c for c in columns if c.startswith(k[:-1])] if k.endswith("*") else [k]
    return list(dict.fromkeys(out))


def _names(pattern: list, columns: list[str]) -> list[str]:
    keys, links = _split(pattern)
    return list(dict.fromkeys([*expand(keys, columns), *(n for _, p in links for n in _names(p, columns))]))


def pull(df: DataFrame, pattern: list, transforms: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """``df`` nested by ``pattern``; ``transforms`` are applied to the flat rows, "" for the top and names of nested levels before they nest.

    Nested arrays are sorted sets, so the result does not hang on row order. Levels are grouped bottom-up,
    one shuffle each.
    """
    transforms = transforms or {}
    keys, links = _split(pattern)
    if "" in transforms:
        df = transforms[""](df)
    own = expand(keys, df.columns)
    if not links:
        return df.select(*own).distinct()
    out = None
    for name, inner in links:
        flat = transforms[name](df) if name in transforms else df
        nested_keys, nested_links = _split(inner)
        names = _names(inner, flat.columns)
        rows = flat.select(*dict.fromkeys([*own, *names])).distinct()
        if nested_links:
            rows = pull(rows, [*own, *expand(nested_keys, flat.columns), *[{k: v} for k, v in nested_links]], {k: v for k, v in transforms.items() if k not in ("", name)})
            names = [c for c in rows.columns if c not in own or c in expand(nested_keys, flat.columns)]
        # A level without any value is no row of its own.
        present = F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names]) if not nested_links else F.lit("x")
        grouped = rows.groupBy(*own).agg(F.array_sort(F.collect_set(F.when(present.isNotNull(), F.struct(*[F.col(f"`{n}`") for n in names])))).alias(name))
        if out is None:
            out = grouped
        else:
            same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in own]
            out = out.alias("a").join(grouped.alias("b"), same).select("a.*", F.col(f"b.`{name}`"))
    return out


def pull_entities(catalog: AttributeCatalog, entities: DataFrame, pattern: list, column: str = "e", depth: int = 0) -> DataFrame:
    """``entities`` with a struct ``pulled``: attributes of each entity by ``pattern``, and through reference attributes those of their targets.

    A pattern holds attribute names and one-entry dicts ``{reference attribute: pattern}``; fields are
    named by what follows the slash. The rows stay as they are: what an entity lacks is null, and of a many-valued
    attribute there is a sorted array.
    """
    out, fields, key, value = entities, [], f"_e{depth}", f"_v{depth}"
    for i, part in enumerate(pattern):
        name, inner = (part, None) if isinstance(part, str) else next(iter(part.items()))
        attribute, field = catalog.get(name), f"_p{depth}_{i}"
        values = catalog.star([name]).df.select(F.col("e").alias(key), F.col("v0").alias(value))
        if inner is not None:
            values = pull_entities(catalog, values, inner, value, depth + 1).select(key, F.col("pulled").alias(value))
        if attribute.many or not attribute.table.unique:
            values = values.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(value))
        out = out.join(values.withColumnRenamed(value, field), out[column] == F.col(key), "left").drop(key)
        fields.append(F.col(field).alias(name.rsplit("/", 1)[-1]))
    return out.select(*entities.columns, F.struct(*fields).alias("pulled"))
