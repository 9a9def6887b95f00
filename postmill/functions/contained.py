"""Python functions of a row that can't end a job: where one fails on a row, that row has no value and a label, the others go on."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The field that names the kind of an error, never its message, which could hold content.
FAILED = "failed"
DTYPES = {"int": "Int32", "bigint": "Int64"}


def each(f: Callable, n: int, *columns: pd.Series) -> list[tuple]:
    """f of each row as a tuple of n values, and after them null or the kind of the error that it raised. Rows with a null have none."""
    out = []
    for row in zip(*columns, strict=True):
        try:
            values = (None,) * n if any(v is None or v is pd.NA or isinstance(v, float) and v != v for v in row) else f(*row)
            out.append((*values, None))
        except Exception as e:
            out.append((*(None,) * n, type(e).__name__))
    return out


def contained(f: Callable, fields: dict[str, T.DataType]):
    """A column function of f, which gets a row's values, none of them null, and gives a tuple of fields: struct(fields, failed)."""
    schema = T.StructType([*(T.StructField(k, t) for k, t in fields.items()), T.StructField(FAILED, T.StringType())])
    kinds = {k: DTYPES[t.simpleString()] for k, t in fields.items() if t.simpleString() in DTYPES}

    @F.pandas_udf(schema)
    def run(first: pd.Series, *rest: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(each(f, len(fields), first, *rest), columns=schema.fieldNames()).astype(kinds)

    return run
