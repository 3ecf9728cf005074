"""Tables as entity/attribute/value relations.

An entity id is ``ordinal * 2^40 + key``, so ids of different tables never meet; a reference
attribute holds the id of its target. A table whose key is unique lets several attributes of one
entity be read in one scan. Nulls are absent: a relation never holds one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownAttributeError
from ..operators.zframe import W, ZFrame

ID_SPACE = 2**40


@dataclass(frozen=True)
class Table:
    name: str
    ordinal: int
    df: DataFrame
    entity: Column
    unique: bool
    key: str | None = None
    least: int | None = None  # no entity id is smaller

    def holds(self, entity: int) -> Column:
        """Whether a row is ``entity``, as a condition on the key column itself, which reaches the scan."""
        if self.key is None:
            return self.entity == F.lit(entity)
        key = entity - self.ordinal * ID_SPACE
        return F.col(self.key) == F.lit(key) if 0 <= key < ID_SPACE else F.lit(False)

    def may_hold(self, entity: int) -> bool:
        return (self.least is None or entity >= self.least) if self.key is None else 0 <= entity - self.ordinal * ID_SPACE < ID_SPACE


@dataclass(frozen=True)
class Attribute:
    name: str
    table: Table
    value: Column
    kind: str
    many: bool = False
    ref: str | None = None
    unique: bool = False


@dataclass
class AttributeCatalog:
    """Attribute name (without colon) to where it is stored."""

    tables: dict[str, Table] = field(default_factory=dict)
    attributes: dict[str, Attribute] = field(default_factory=dict)

    def add_table(self, name: str, df: DataFrame, key: str | Column, columns: dict[str, str] | None = None, refs: dict[str, str] | None = None, unique: bool = True, many: tuple[str, ...] = (), least: int | None = None) -> AttributeCatalog:
        """``columns``: attribute to column. ``refs``: attribute to the table its column refers to. A ``w`` column holds weights.

        A key given as a Column is the entity id itself; ``least`` promises that none is smaller.
        """
        ordinal = len(self.tables) + 1
        entity = F.lit(ordinal * ID_SPACE) + F.col(key).cast("long") if isinstance(key, str) else key
        table = self.tables[name] = Table(name, ordinal, df, entity, unique, key if isinstance(key, str) else None, least)
        kinds = dict(df.dtypes)
        if isinstance(key, str):
            self._add(Attribute(f"{name}/key", table, F.col(key), kinds[key], unique=unique))
        for attr, column in (columns or {}).items():
            target = (refs or {}).get(attr)
            self._add(Attribute(f"{name}/{attr}", table, F.col(column), "long" if target else kinds[column], attr in many, target))
        return self

    def _add(self, attribute: Attribute) -> None:
        self.attributes[attribute.name] = attribute

    def add_datoms(self, name: str, df: DataFrame, kind: str | None = None, many: bool = False) -> AttributeCatalog:
        """One attribute stored as rows (e, v) and maybe w, with entity ids as they are."""
        table = Table(name, 0, df, F.col("e"), False)
        self._add(Attribute(name, table, F.col("v"), kind or dict(df.dtypes)["v"], many))
        return self

    def get(self, name: str) -> Attribute:
        if name not in self.attributes:
            raise UnknownAttributeError(f":{name} is not in the catalog")
        return self.attributes[name]

    def value(self, attribute: Attribute) -> Column:
        if attribute.ref:
            return F.lit(self.tables[attribute.ref].ordinal * ID_SPACE) + attribute.value.cast("long")
        return attribute.value

    def star(self, names: list[str], entity: int | None = None, refers: dict[str, int] | None = None) -> ZFrame:
        """One scan of a table: e and v0, v1, … for cardinality-one attributes of it; rows that lack one are absent.

        ``entity`` and what reference attributes must refer to (``refers``) become conditions on the key columns.
        """
        found = [self.get(n) for n in names]
        table = found[0].table
        weight = [F.col(W)] if W in table.df.columns else []
        df = table.df if entity is None else table.df.where(table.holds(entity))
        for name, target in (refers or {}).items():
            key = target - self.tables[self.get(name).ref].ordinal * ID_SPACE
            df = df.where(self.get(name).value == F.lit(key) if 0 <= key < ID_SPACE else F.lit(False))
        df = df.select(table.entity.alias("e"), *[self.value(a).alias(f"v{i}") for i, a in enumerate(found)], *weight)
        return ZFrame(df.where(reduce(lambda a, b: a & b, [F.col(f"v{i}").isNotNull() for i in range(len(found))]) & F.col("e").isNotNull()))

    def wildcard(self, names: list[str] | None = None, entity: int | None = None, kind: str | None = None) -> ZFrame:
        """All attributes (or ``names``) as e, a, v (text) and v_type, which keeps 1 and "1" apart: one scan for each table.

        With ``entity`` only tables that may hold it are read, by its key; with ``kind`` only columns of that v_type.
        """
        tables: dict[int, list[Attribute]] = {}
        every = [self.get(n) for n in names or list(self.attributes)]
        for a in every:
            if (entity is None or a.table.may_hold(entity)) and kind in (None, _type_name(a.kind)):
                tables.setdefault(id(a.table.df), []).append(a)
        parts = []
        for found in list(tables.values()) or [every[:1]]:
            table = found[0].table
            df = table.df if entity is None else table.df.where(table.holds(entity))
            df = df if tables else df.where(F.lit(False))
            items = F.array(*[F.struct(F.lit(a.name).alias("a"), self.value(a).cast("string").alias("v"), F.lit(_type_name(a.kind)).alias("v_type")) for a in found])
            weight = [F.col(W)] if W in df.columns else []
            parts.append(ZFrame(df.select(table.entity.alias("e"), F.explode(items).alias("_x"), *weight).select("e", "_x.a", "_x.v", "_x.v_type", *weight).where("e is not null and v is not null")))
        return parts[0].union(*parts[1:])


def _type_name(kind: str) -> str:
    return {"int": "long", "bigint": "long", "smallint": "long", "tinyint": "long", "float": "double", "timestamp_ntz": "instant", "timestamp": "instant"}.get(kind, kind)


def idents(df: DataFrame, names: DataFrame) -> DataFrame:
    """Datoms with numeric attribute ids ``attr_id`` get their names from ``names`` (attr_id, attr), a schema-sized table."""
    return df.join(names, "attr_id").withColumnRenamed("attr", "a").drop("attr_id")


SUPPLIED = {
    "region": ("r_regionkey", {"name": "r_name"}, {}),
    "nation": ("n_nationkey", {"name": "n_name", "region": "n_regionkey"}, {"region": "region"}),
    "customer": ("c_custkey", {"name": "c_name", "nation": "c_nationkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}, {"nation": "nation"}),
    "supplier": ("s_suppkey", {"name": "s_name", "nation": "s_nationkey", "acctbal": "s_acctbal"}, {"nation": "nation"}),
    "part": ("p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}, {}),
    "orders": ("o_orderkey", {"customer": "o_custkey", "orderstatus": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "orderpriority": "o_orderpriority"}, {"customer": "customer"}),
    "lineitem": (None, {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey", "linenumber": "l_linenumber", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate"}, {"order": "orders", "part": "part", "supplier": "supplier"}),
    "events": ("event_id", {"ts": "ts", "user": "user_id", "type": "event_type", "value": "value", "props": "props"}, {}),
}


def supplied_catalog(spark: SparkSession, sf_dir: str) -> AttributeCatalog:
    """The catalog of the TPC-H-like tables. A line item's entity is a 62-bit hash of its row above all other ids, as no smaller key is unique."""
    catalog = AttributeCatalog()
    for name, (key, columns, refs) in SUPPLIED.items():
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        catalog.add_table(name, df, key or F.xxhash64(*df.columns).bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62)), columns, refs, least=None if key else 2**62)
    return catalog
