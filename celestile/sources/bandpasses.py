"""The registry of bandpasses: effective wavelengths and widths, and transmission curves."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .readers import read_delimited

SCHEMA = "band string, lambda_eff double, fwhm double, system string, curve string"
ANGSTROM_A_MICRON = 1e4


@dataclass
class Bandpasses:
    """bands: name -> lambda_eff_um, fwhm_um, system, curve; folders: where curves lie, a lake's own before the general ones."""

    spark: SparkSession
    bands: dict[str, dict]
    folders: tuple[str, ...] = ()

    @classmethod
    def load(cls, spark: SparkSession, path: str, lake_root: str | None = None) -> Bandpasses:
        """A JSON file with the bands under ``bands``; curves lie in ``bandpasses`` beside it, or in the lake's registry."""
        own = json.loads(files.read_text(spark, path)).get("bands", {})
        lake = (f"{lake_root}/shared/registry/bandpasses",) if lake_root else ()
        return cls(spark, own, (*lake, f"{path.rpartition('/')[0]}/bandpasses"))

    def meta(self, band: str) -> dict | None:
        return self.bands.get(band)

    def frame(self, prefix: str = "") -> DataFrame:
        """band (without the prefix), lambda_eff and fwhm in angstroms, system, curve: as sed_points takes it."""
        scale = lambda v: None if v is None else float(v) * ANGSTROM_A_MICRON
        rows = [(b.removeprefix(prefix), scale(m.get("lambda_eff_um")), scale(m.get("fwhm_um")), m.get("system"), m.get("curve")) for b, m in sorted(self.bands.items())]
        return self.spark.createDataFrame(rows, SCHEMA)

    def curve(self, band: str) -> DataFrame | None:
        """wavelength, throughput of a band; None where no curve is registered or none is there."""
        name = (self.meta(band) or {}).get("curve")
        for folder in self.folders if name else ():
            if files.exists(self.spark, f"{folder}/{name}"):
                own = read_delimited(self.spark, f"{folder}/{name}", " ")
                return own.select(F.col("wavelength").cast("double").alias("wavelength"), F.col("throughput").cast("double").alias("throughput"))
        return None
