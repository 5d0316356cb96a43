"""Column kinds, null handling, folds and other expressions that the operators share."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, include_bool: bool = True, skip: tuple[str, ...] = ()) -> list[str]:
    kinds = (*_NUMBERS, T.BooleanType) if include_bool else _NUMBERS
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in skip]


def category_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Strings and dates: whatever isn't numeric."""
    kinds = (T.StringType, *_DATES)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in skip]


def number(name: str) -> Column:
    """The column as double; NaN is null."""
    x = quoted(name).cast("double")
    return F.when(~F.isnan(x), x)


def present(df: DataFrame, name: str) -> Column:
    """The column with one notion of null: NaN of floating columns counts as null."""
    kind = df.schema[name].dataType
    return F.when(~F.isnan(quoted(name)), quoted(name)) if isinstance(kind, (T.FloatType, T.DoubleType)) else quoted(name)


def category(name: str) -> Column:
    """The column as text; null is the category `nan`."""
    return F.coalesce(quoted(name).cast("string"), F.lit("nan"))


def md5fold(key: Column, folds: int, salt: str = "") -> Column:
    """A fold that any engine computes alike: the first 32 bits of md5(salt + key), modulo folds."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def corr(a: Column, b: Column) -> Column:
    """Pearson's correlation over complete rows; null if a side doesn't vary (where the built-in one fails in ANSI mode)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


#: A table of keys is broadcast up to this many counted rows, each with a text and a number or two.
MAP_ROWS = 100_000


def hinted(table: DataFrame) -> DataFrame:
    """table with a broadcast hint if its rows, counted up to MAP_ROWS, are few enough; as it is otherwise."""
    return F.broadcast(table) if table.limit(MAP_ROWS + 1).count() <= MAP_ROWS else table


#: Rows of a task of gathered().
TASK_ROWS = 50_000


def gathered(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, cached in tasks of about `rows` rows (TASK_ROWS), for the many small jobs of fits: a shuffle leaves as many partitions in a cached table as it has itself, however few the rows are."""
    held = df.cache()
    n, given = held.count(), held.rdd.getNumPartitions()
    most = -(-n // (rows or TASK_ROWS)) or 1
    if most >= given:
        return held
    few = held.coalesce(most).cache()
    few.count()
    held.unpersist()
    return few


@lru_cache(1)
def _accents() -> tuple[str, str]:
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFKD", chr(c))) and len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) and not unicodedata.combining(d[0])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    return F.translate(text, *_accents())
