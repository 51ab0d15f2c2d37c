"""The library's functions for users of SQL.

Those that are expressions become SQL functions, which Spark inlines into the plan; hashes and
pixels, which have no short SQL form, are registered as vectorized functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import healpix, ids

EXPRESSIONS = {
    "separation_deg(ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE) RETURNS DOUBLE": "degrees(2 * asin(sqrt(least(1D, pow(sin((radians(dec2) - radians(dec1)) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin((radians(ra2) - radians(ra1)) / 2), 2)))))",
    "valid_sky(ra DOUBLE, dec DOUBLE) RETURNS BOOLEAN": "coalesce(NOT isnan(ra) AND NOT isnan(dec) AND abs(ra) < double('Infinity') AND dec BETWEEN -90 AND 90 AND ra > -9000, false)",
    "pixel_parent(pix BIGINT, orders INT) RETURNS BIGINT": "shiftright(pix, 2 * orders)",
    "pixel_dir(pix BIGINT) RETURNS BIGINT": "(pix div 10000) * 10000",
    "flux_to_ab(flux DOUBLE, zero_point DOUBLE) RETURNS DOUBLE": "CASE WHEN flux > 0 AND NOT isnan(flux) THEN -2.5D * log10(flux) + zero_point END",
}


def register(spark: SparkSession) -> list[str]:
    """The names that SQL can use from now on in this session."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("long")
    def ang2pix(ra: pd.Series, dec: pd.Series, order: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(ra), dtype="Int64")
        known = ra.notna() & dec.notna() & order.notna()
        for o in order[known].unique():
            at = known & (order == o)
            out[at] = healpix.ang2pix(ra[at].to_numpy(float), dec[at].to_numpy(float), int(o))
        return out

    spark.udf.register("ang2pix", ang2pix)
    spark.udf.register("stable_hash", ids.stable_hash)
    return [*(h.partition("(")[0] for h in EXPRESSIONS), "ang2pix", "stable_hash"]
