"""Metric ids: XXH64 of the name with seed 0, as a signed long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _hashed_in_python(name: Column) -> Column:
    def hashed(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for s in names:
            yield s.map(lambda n: None if n is None else (h := xxhash.xxh64_intdigest(n.encode())) - (1 << 64) * (h >> 63)).astype("Int64")

    return F.pandas_udf(hashed, "long", F.PandasUDFType.SCALAR_ITER)(name)


def metric_id(name: Column) -> Column:
    """The id of a name; null for null.

    The SQL function xxhash64 is fixed at seed 42, so its expression is built
    with seed 0 here; it is part of the generated code like any other. A
    session without a JVM of its own takes an Arrow function.
    """
    spark = SparkSession.active()
    try:
        jvm = spark._jvm
        util = jvm.org.apache.spark.sql.classic.ExpressionUtils
        args = jvm.org.apache.spark.api.python.PythonUtils.toSeq([util.expression(name._jc)])
        hashed = Column(util.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(args, 0)))
    except (AttributeError, TypeError):
        return _hashed_in_python(name)
    return F.when(name.isNotNull(), hashed)  # the expression itself skips nulls


def unsigned_order(ident: Column) -> Column:
    """A key that sorts ids as unsigned numbers."""
    return ident.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_text(ident: Column) -> Column:
    """An id as an unsigned decimal number."""
    return F.when(ident >= 0, ident.cast("string")).otherwise((ident.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"))
