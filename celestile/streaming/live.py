"""Live catalogs: files or streams appended as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import first_of_each
from ..plans.region import in_pixels
from ..sources.lake import Lake

MOST_TILES = 10_000


def append_live(stream: DataFrame, lake: Lake, survey: str, order: int, checkpoint: str, *, id_col: str = "_source_id", sort: tuple[str, ...] = (), available_now: bool = True) -> StreamingQuery:
    """Append a stream of prepared rows (ids and pixels made) to a catalog's tiles.

    Each batch keeps the first row of an id and leaves out ids that are there; of rows without
    an id it leaves out those that are there with equal columns.  A batch that is run again after a
    failure therefore adds nothing twice.  Only the batch's own tiles are read.  The
    descriptor is written by ``finish``.
    """

    lake.open_live(survey, order)

    def batch(df: DataFrame, number: int) -> None:
        own = first_of_each(df, id_col, sort or (id_col,))
        try:
            known = lake.catalog(survey, order=order)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            pixel = f"_healpix_order{order}"
            known = in_pixels(known, "Npix", [r[0] for r in own.select(pixel).distinct().limit(MOST_TILES).collect()]) if own.select(pixel).distinct().count() <= MOST_TILES else known
            named = own.where(F.col(id_col).isNotNull()).join(known.select(id_col, pixel), [id_col, pixel], "left_anti")
            lost = known.where(F.col(id_col).isNull()).select(F.struct(*df.columns).alias("_there"))
            bare = own.where(F.col(id_col).isNull()).join(lost, F.struct(*df.columns).eqNullSafe(F.col("_there")), "left_anti")
            own = named.select(df.columns).unionByName(bare.select(df.columns))
        lake.write_tiles(own, survey, order=order, mode="append", finalize=False)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(lake: Lake, survey: str, order: int, about: dict | None = None) -> dict:
    return lake.finalize(survey, order, about=about)


def fill_gaps(wanted: DataFrame, built: DataFrame, build: Callable[[DataFrame], DataFrame], pixel: str = "npix") -> DataFrame:
    """build() over the tiles that aren't built yet."""
    return build(wanted.join(built.select(pixel).distinct(), pixel, "left_anti"))


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows and sums by window and key of a stream or table; rows later than the watermark are left out by a stream."""
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    return own.groupBy(F.window(time, window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
