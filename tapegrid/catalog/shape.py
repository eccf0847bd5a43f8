"""Output shape shared by a query and its SQL counterpart.

A spec such as ``"symbol:s session_date:d bar:i spot:6"`` fixes names, order, types
and rounding on both sides: s string, d date (as text), t timestamp (as text),
i bigint, b boolean as 0/1, a digit = double rounded to that many places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _items(spec: str):
    return [item.rsplit(":", 1) for item in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _items(spec):
        c = F.col(name)
        if kind in "sd":
            c = c.cast("string")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind in "ib":
            c = c.cast("bigint")
        else:
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(out)


def shape_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind in _items(spec):
        if kind in "sd":
            e = f"cast({name} as varchar)"
        elif kind == "t":
            e = f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"
        elif kind in "ib":
            e = f"cast({name} as bigint)"
        else:
            e = f"round(cast({name} as double), {kind}) + 0.0"
        out.append(f"{e} as {name}")
    if sql.lstrip().lower().startswith("with "):
        return f"select {', '.join(out)} from ({sql}) as shaped"
    return f"select {', '.join(out)} from ({sql}) as shaped"
