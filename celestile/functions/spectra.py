"""Spectra and images as array columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import Value, col, let

INF, NAN = float("inf"), float("nan")


def flux_scaled(flux: Value, k: float) -> Column:
    if not k > 0:
        raise ValueError("a flux scale is above 0")
    return F.transform(col(flux), lambda x: x * F.lit(float(k)))


def ivar_scaled(ivar: Value, k: float) -> Column:
    """ivar / k^2, and 0 where it isn't above 0."""
    if not k > 0:
        raise ValueError("a flux scale is above 0")
    return F.transform(col(ivar), lambda x: F.when(x > 0, x / F.lit(float(k) ** 2)).otherwise(0.0))


def error_of_ivar(ivar: Value) -> Column:
    """1 / sqrt(ivar); infinite where ivar isn't above 0."""
    return F.transform(col(ivar), lambda x: F.when(x > 0, 1.0 / F.sqrt(x)).otherwise(F.lit(INF)).cast("float"))


def ivar_of_variance(variance: Value) -> Column:
    return F.transform(col(variance), lambda x: F.when(x > 0, 1.0 / x).otherwise(0.0).cast("float"))


def good(ivar: Value, mask: Value) -> Column:
    return F.zip_with(col(ivar), col(mask), lambda i, m: (i > 0) & (m == 0))


def rest_frame(wavelength: Value, z: Value) -> Column:
    """Wavelengths over 1 + z; a null z counts as 0."""
    return F.transform(col(wavelength), lambda w: w / (1.0 + F.coalesce(col(z).cast("double"), F.lit(0.0))))


def masked_flux(flux: Value, mask: Value) -> Column:
    """Not a number where the mask is set."""
    return F.zip_with(col(flux), col(mask), lambda f, m: F.when(m == 0, f).otherwise(F.lit(NAN)))


def masked_ivar(ivar: Value, mask: Value) -> Column:
    return F.zip_with(col(ivar), col(mask), lambda i, m: F.when(m == 0, i).otherwise(0.0))


def median(values: Value) -> Column:
    """The median of an array; null for none."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        at = lambda k: F.get(s, k.cast("int")).cast("double")
        return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)

    return let(F.array_sort(F.filter(col(values), lambda x: x.isNotNull())), middle)


def good_median(flux: Value, ivar: Value, mask: Value) -> Column:
    """The median flux of good pixels, or 1 where there is none or it is 0."""
    kept = F.filter(F.arrays_zip(col(flux).alias("f"), good(ivar, mask).alias("g")), lambda x: x["g"] & ~F.isnan(x["f"]))
    return let(median(F.transform(kept, lambda x: x["f"])), lambda m: F.when(m != 0, m).otherwise(1.0))


def normalised(flux: Value, ivar: Value, mask: Value) -> Column:
    """(flux, ivar): the flux over its good median, ivar times the median's square."""
    return let(good_median(flux, ivar, mask), lambda m: F.struct(F.transform(col(flux), lambda x: x / m).alias("flux"), F.transform(col(ivar), lambda x: x * m * m).alias("ivar")))


def log_flux(flux: Value) -> Column:
    return F.transform(col(flux), lambda f: F.log1p(F.greatest(f, F.lit(0.0))))


def padded(values: Value, n: int, fill: float) -> Column:
    """Cut or filled to n values."""
    c = col(values)
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill), n)), 1, n)


def linear_wavelengths(n: Value, crval: Value, cdelt: Value, crpix: Value = 1.0, log: Value = False) -> Column:
    """crval + cdelt * (i - (crpix - 1)) for i from 0, as a power of ten if logarithmic."""
    at = F.transform(F.sequence(F.lit(0), col(n).cast("int") - 1), lambda i: col(crval) + col(cdelt) * (i - (col(crpix) - 1)))
    flag = F.lit(log) if isinstance(log, bool) else col(log)
    return F.when(flag, F.transform(at, lambda x: F.pow(F.lit(10.0), x))).otherwise(at)


def band_scaled(image: Value, pixels_a_band: int, factors: Sequence[float], default: float = 1.0) -> Column:
    """A flattened image (bands first), each band times its factor; bands without one get the default."""
    table = F.array(*(F.lit(float(f)) for f in factors)) if factors else F.array().cast("array<double>")
    return F.transform(col(image), lambda x, i: x * F.coalesce(F.get(table, F.floor(i / pixels_a_band).cast("int")), F.lit(float(default))))


def mad_limits(values: Value, sigmas: float = 5.0, pad: float = 0.05) -> Column:
    """(low, high) of a clip at median +- sigmas * 1.4826 * MAD, the deviation where that is 0, padded."""

    def deviation(v: Column) -> Column:
        n = F.size(v)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        return let(mean, lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n))

    def spread(v: Column, m: Column) -> Column:
        return let(median(F.transform(v, lambda x: F.abs(x - m))) * 1.4826, lambda mad: F.when(mad > 0, mad).otherwise(deviation(v)))

    def limits(kept: Column) -> Column:
        low, high = F.array_min(kept), F.array_max(kept)
        extra = F.when(high > low, (high - low) * pad).otherwise(F.lit(1.0))
        return F.struct((low - extra).alias("low"), (high + extra).alias("high"))

    def clip(v: Column) -> Column:
        return let(median(v), lambda m: let(spread(v, m), lambda s: let(F.filter(v, lambda x: F.abs(x - m) <= sigmas * s), limits)))

    return let(F.filter(col(values), lambda x: x.isNotNull() & ~F.isnan(x)), clip)


def resample(df: DataFrame, wavelength: str, flux: str, ivar: str, mask: str, grid: Sequence[float]) -> DataFrame:
    """flux, ivar and mask interpolated linearly onto one grid; beyond a spectrum's ends flux and ivar are 0, mask 1.

    Interpolation has no built-in form: one Arrow batch at a time.
    """
    at = np.asarray(grid, float)

    def weighted(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Both neighbours by their weights: halfway it is exactly half of each, which a slope isn't."""
        if len(w) < 2:
            return np.full(len(at), v[0])
        j = np.clip(np.searchsorted(w, at, "right") - 1, 0, len(w) - 2)
        gap = w[j + 1] - w[j]
        t = np.where(gap > 0, (at - w[j]) / np.where(gap > 0, gap, 1.0), 0.0)
        return np.where(t == 0, v[j], np.where(t == 1, v[j + 1], (1 - t) * v[j] + t * v[j + 1]))

    def run(batches):
        for pdf in batches:
            rows = {flux: [], ivar: [], mask: []}
            for w, f, i, m in zip(pdf[wavelength], pdf[flux], pdf[ivar], pdf[mask], strict=True):
                w = np.asarray(w, float)
                out = (at < w[0]) | (at > w[-1]) if len(w) else np.ones(len(at), bool)
                interp = lambda v, w=w, out=out: np.where(out, 0.0, weighted(w, np.asarray(v, float))) if len(w) else np.zeros(len(at))
                rows[flux].append(interp(f))
                rows[ivar].append(interp(i))
                rows[mask].append(np.where(out, 1, interp(m) > 0).astype(np.int32))
            yield pdf.assign(**{wavelength: [at] * len(pdf)} | rows)

    changed = {wavelength: "array<double>", flux: "array<double>", ivar: "array<double>", mask: "array<int>"}
    schema = ", ".join(f"`{f.name}` {changed.get(f.name, f.dataType.simpleString())}" for f in df.schema)
    return df.mapInPandas(run, schema)


def resolution_applied(flux: Value, bands: Value, offsets: Sequence[int]) -> Column:
    """A banded resolution matrix times the flux: out[i] = sum over k of bands[k][i + offset k] * flux[i + offset k]."""
    f, b = col(flux), col(bands)

    def at(i):
        total = F.lit(0.0)
        for k, o in enumerate(offsets):
            j = (i + o).cast("int")
            total = total + F.when((j >= 0) & (j < F.size(f)), F.get(F.get(b, F.lit(k)), j) * F.get(f, j)).otherwise(0.0)
        return total

    return F.transform(f, lambda x, i: at(i))


def stamp(df: DataFrame, image: str, shape: tuple[int, int], x: str, y: str, size: int, out: str, fill: float = float("nan")) -> DataFrame:
    """A square cut around pixel (x, y) of a flattened image of ``shape``; what lies outside is ``fill``."""
    height, width = shape

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def cut(images: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        found = []
        for raw, cx, cy in zip(images, xs, ys, strict=True):
            own = np.full((size, size), fill)
            left, top = int(cx) - size // 2, int(cy) - size // 2
            a, b, c, d = max(0, top), min(height, top + size), max(0, left), min(width, left + size)
            if a < b and c < d:
                own[a - top : b - top, c - left : d - left] = np.asarray(raw, float).reshape(height, width)[a:b, c:d]
            found.append(own.ravel())
        return pd.Series(found)

    return df.withColumn(out, cut(image, x, y))
