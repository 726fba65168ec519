"""Schemas as tables: what differs between two, and rows brought from one to the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# Types in the order in which each holds all values of those before it.
WIDER = (("tinyint", "smallint", "int", "bigint", "decimal(38,0)"), ("float", "double"), ("tinyint", "smallint", "int", "double"), ("date", "timestamp"))


def _fields(kind: DataType, path: str = "") -> list[tuple[str, str, bool]]:
    """(path, type, nullable) of the leaves of a type; [] stands for the elements of arrays, {} for the values of maps."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in (_fields(f.dataType, f"{path}.{f.name}".lstrip(".")) if isinstance(f.dataType, (StructType, ArrayType, MapType)) else [(f"{path}.{f.name}".lstrip("."), f.dataType.simpleString(), f.nullable)])]
    if isinstance(kind, ArrayType):
        return _fields(kind.elementType, f"{path}[]")
    if isinstance(kind, MapType):
        return _fields(kind.valueType, f"{path}{{}}")
    return [(path, kind.simpleString(), True)]


def schema_rows(df: DataFrame) -> DataFrame:
    """column, seq, type, nullable of each leaf of df's schema. As many rows as the schema has; no data are read."""
    rows = [(name, k, kind, nullable) for k, (name, kind, nullable) in enumerate(_fields(df.schema))]
    return df.sparkSession.createDataFrame(rows, "column string, seq int, type string, nullable boolean")


def widens(a: str, b: str) -> bool:
    """Whether each value of type a is one of type b."""
    return a == b or any(a in w and b in w and w.index(a) < w.index(b) for w in WIDER)


def schema_diff(have: DataFrame, want: DataFrame) -> DataFrame:
    """column, have_type, want_type, change of each column that two tables do not share.

    change: add (only in want), drop (only in have), widen (want's type holds all values of have's), narrow (the other way round),
    replace (neither). Names are told apart regardless of case.
    """
    side = lambda df, name: schema_rows(df).select(F.lower("column").alias("column"), F.col("type").alias(f"{name}_type"))
    pairs = [(a, b) for w in WIDER for i, a in enumerate(w) for b in w[i + 1 :]]
    wide = F.array(*[F.lit(f"{a}>{b}") for a, b in pairs])
    both = side(have, "have").join(side(want, "want"), "column", "full_outer").filter(~F.col("have_type").eqNullSafe(F.col("want_type")))
    to, back = F.concat("have_type", F.lit(">"), "want_type"), F.concat("want_type", F.lit(">"), "have_type")
    change = F.when(F.col("have_type").isNull(), "add").when(F.col("want_type").isNull(), "drop").when(F.array_contains(wide, to), "widen").when(F.array_contains(wide, back), "narrow").otherwise("replace")
    return both.withColumn("change", change)


def evolved(have: DataFrame, want: DataFrame) -> DataFrame:
    """The rows of have with the columns of want, in its order: added ones are null, types are widened, others fail.

    Columns of have that want lacks are dropped. Narrower or other types are an error before any row is read.
    """
    own = {f.name.lower(): f for f in have.schema.fields}
    out = []
    for f in want.schema.fields:
        mine = own.get(f.name.lower())
        if mine is not None and not (mine.dataType == f.dataType or widens(mine.dataType.simpleString(), f.dataType.simpleString())):
            raise ValueError(f"column {f.name}: {mine.dataType.simpleString()} does not widen to {f.dataType.simpleString()}")
        out.append((F.lit(None) if mine is None else F.col(f"`{mine.name}`")).cast(f.dataType).alias(f.name))
    return have.select(*out)
