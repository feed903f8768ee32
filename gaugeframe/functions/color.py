"""Hex colours, CIE Lab (D65) and the CIEDE2000 difference.

Decoding and Lab are native expressions.  The difference is a vectorised Arrow function: as one
native expression it exceeds the size the JVM compiles and measured about twenty times slower.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# --- fixed values -------------------------------------------------------------------------------
PALETTE = {"azul": "#1F4FD8", "verde": "#2E7D32", "amarelo": "#FFFB0D", "laranja": "#EF6C00", "vermelho": "#C62828", "roxo": "#6A1B9A"}
EXPECTED_COLORS = {
    "BI": ["vermelho", "verde"], "BC": ["laranja", "azul"], "LI": ["vermelho"],
    "LC": ["laranja", "azul"], "SI": ["vermelho"], "SC": ["vermelho", "azul"],
}
# sRGB to XYZ (IEC 61966-2-1) and the D65 2-degree white point
SRGB_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE_D65 = (0.95047, 1.0, 1.08883)
# ------------------------------------------------------------------------------------------------


def hex_channels(c: Column) -> tuple[Column, Column, Column]:
    """``#RRGGBB`` to three ints; NULL for anything that is not six hex digits."""
    digits = F.regexp_replace(F.trim(c), "^#+", "")
    ok = digits.rlike("^[0-9A-Fa-f]{6}$")
    return tuple(F.when(ok, F.conv(F.substring(digits, i, 2), 16, 10).cast("int")) for i in (1, 3, 5))


def with_lab(df: DataFrame, rgb: tuple[Column, Column, Column], prefix: str) -> DataFrame:
    """Add ``{prefix}_l, {prefix}_a, {prefix}_b`` for 0-255 channels."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    lin = [f"__{prefix}_{n}" for n in "rgb"]
    xyz = [f"__{prefix}_{n}" for n in "xyz"]
    out = df.withColumns({n: linear(c) for n, c in zip(lin, rgb)})
    out = out.withColumns(
        {n: (F.col(lin[0]) * m[0] + F.col(lin[1]) * m[1] + F.col(lin[2]) * m[2]) / w for n, m, w in zip(xyz, SRGB_XYZ, WHITE_D65)}
    )
    out = out.withColumns(
        {n: F.when(F.col(n) > 0.008856, F.cbrt(F.col(n))).otherwise(7.787 * F.col(n) + 16.0 / 116.0) for n in xyz}
    )
    x, y, z = (F.col(n) for n in xyz)
    return out.withColumns(
        {f"{prefix}_l": 116.0 * y - 16.0, f"{prefix}_a": 500.0 * (x - y), f"{prefix}_b": 200.0 * (y - z)}
    ).drop(*lin, *xyz)


def packed(c: Column) -> Column:
    """``#RRGGBB`` as one integer, NULL for anything else."""
    digits = F.regexp_replace(F.trim(c), "^#+", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.conv(digits, 16, 10).cast("int"))


#: linear light of each of the 256 channel values
_V = np.arange(256) / 255.0
_LINEAR = np.where(_V > 0.04045, ((_V + 0.055) / 1.055) ** 2.4, _V / 12.92)


def lab_of(colors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CIE Lab of packed colours."""
    c = np.asarray(colors).astype(np.int64)
    lin = _LINEAR[np.stack([(c >> 16) & 255, (c >> 8) & 255, c & 255])]
    xyz = np.tensordot(np.array(SRGB_XYZ), lin, axes=1) / np.array(WHITE_D65).reshape(-1, *[1] * (lin.ndim - 1))
    x, y, z = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16.0 / 116.0)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def delta_e(p: tuple, q: tuple) -> np.ndarray:
    """CIEDE2000 of two broadcastable Lab triples (Sharma, Wu, Dalal 2005)."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    mean7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    g = 1.5 - 0.5 * np.sqrt(mean7 / (mean7 + 25.0**7))
    a1, a2 = a1 * g, a2 * g
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    gray, diff, total = c1 * c2 == 0, h2 - h1, h1 + h2
    turn = np.where(gray, 0.0, diff - 360 * (diff > 180) + 360 * (diff < -180))
    mean_h = np.where(np.abs(diff) <= 180, total, np.where(total < 360, total + 360, total - 360)) / 2
    mean_h = np.where(gray, total, mean_h)
    lm, cm = (l1 + l2) / 2 - 50, (c1 + c2) / 2
    t = (
        1 - 0.17 * np.cos(np.radians(mean_h - 30)) + 0.24 * np.cos(np.radians(2 * mean_h))
        + 0.32 * np.cos(np.radians(3 * mean_h + 6)) - 0.20 * np.cos(np.radians(4 * mean_h - 63))
    )
    dl = (l2 - l1) / (1 + 0.015 * lm**2 / np.sqrt(20 + lm**2))
    dc = (c2 - c1) / (1 + 0.045 * cm)
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn) / 2) / (1 + 0.015 * cm * t)
    rt = -2 * np.sin(np.radians(60 * np.exp(-(((mean_h - 275) / 25) ** 2)))) * np.sqrt(cm**7 / (cm**7 + 25.0**7))
    return np.sqrt(np.maximum(0.0, dl**2 + dc**2 + dh**2 + rt * dc * dh))


@F.arrow_udf(DoubleType())
def delta_e_packed(first: pa.Array, second: pa.Array) -> pa.Array:
    """Row-wise CIEDE2000 of packed colours; NULL where either is NULL."""
    p, q = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (first, second))
    missing = pc.or_(first.is_null(), second.is_null()).to_numpy(zero_copy_only=False)
    return pa.array(delta_e(lab_of(p), lab_of(q)), mask=missing)
