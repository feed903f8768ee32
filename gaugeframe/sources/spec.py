"""Specification tables: one wide row per unit to one row per unit and axis."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spec_axes(wide: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``x_<field>, y_<field>`` columns to ``axis, <field>``; fields an axis lacks are NULL."""

    def pick(axis: str) -> str:
        cols = [f"{axis.lower()}_{f}" if f"{axis.lower()}_{f}" in wide.columns else "null" for f in fields]
        return f"'{axis}', " + ", ".join(cols)

    names = ", ".join(["axis", *fields])
    return wide.selectExpr(*keys, f"stack(2, {pick('X')}, {pick('Y')}) as ({names})")
