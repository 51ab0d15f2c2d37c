"""One-dimensional spectra out of FITS files: decoders by layout, chosen by what the headers say.

A decoder turns the content of one file into rows of (source_file, object, wavelength, flux,
ivar, mask); others can be added to DECODERS.  Layouts are those that surveys publish.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import fits

SCHEMA = "source_file string, object string, wavelength array<double>, flux array<double>, ivar array<double>, mask array<int>"
Row = tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
BITPIX = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def image(raw: bytes, unit: fits.Unit) -> np.ndarray:
    """The array of an image unit, scaled."""
    shape = [int(unit.cards[f"NAXIS{k}"]) for k in range(int(unit.cards["NAXIS"]), 0, -1)]
    kind = np.dtype(BITPIX[int(unit.cards["BITPIX"])])
    own = np.frombuffer(raw, kind, int(np.prod(shape)), unit.start).reshape(shape).astype(float)
    return own * float(unit.cards.get("BSCALE", 1)) + float(unit.cards.get("BZERO", 0))


def grid(cards: dict, n: int) -> np.ndarray:
    """Wavelengths of an image's pixels by its header; powers of ten where it says so (DC-FLAG, LOG or log in CTYPE1)."""
    step = float(cards.get("CD1_1", cards.get("CDELT1", cards.get("COEFF1", 1.0))))
    at = float(cards.get("CRVAL1", cards.get("COEFF0", 0.0))) + step * (np.arange(n) - (float(cards.get("CRPIX1", 1.0)) - 1))
    return 10**at if int(cards.get("DC-FLAG", 0)) == 1 or "LOG" in str(cards.get("CTYPE1", "")).upper() or "COEFF0" in cards else at


def _rows(found: list[fits.Unit], raw: bytes, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {u.name().upper(): image(raw, u) for u in found if u.name().upper() in names and not u.is_table and int(u.cards.get("NAXIS", 0))}


def _whole(flux: np.ndarray, ivar: np.ndarray | None, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    good = np.isfinite(flux)
    ivar = np.where(good, 1.0, 0.0) if ivar is None else np.where(np.isfinite(ivar), ivar, 0.0)
    mask = ~good if mask is None else (mask != 0) | ~good
    return np.where(good, flux, 0.0), ivar, mask.astype(np.int32)


def coadd_table(found: list[fits.Unit], raw: bytes) -> Iterator[Row]:
    """A table of one spectrum: loglam or wavelength, flux, ivar and a mask, one row a pixel."""
    unit = next(u for u in found if u.is_table)
    own = {k.lower(): v for k, v in fits.decode(raw, unit).items()}
    column = lambda *names: next((np.asarray(own[n].to_numpy(zero_copy_only=False), float) for n in names if n in own), None)
    log = column("loglam")
    wave = 10**log if log is not None else column("wavelength", "wave", "lambda")
    flux = column("flux")
    yield str(found[0].cards.get("OBJECT", "")), wave, *_whole(flux, column("ivar", "inverse_variance"), column("and_mask", "mask"))


def plate_images(found: list[fits.Unit], raw: bytes) -> Iterator[Row]:
    """Images of many spectra, one a line: flux first, then inverse variance and mask, wavelengths by COEFF0 and COEFF1."""
    images = [u for u in found if not u.is_table and int(u.cards.get("NAXIS", 0)) == 2][:3]
    flux, *more = (image(raw, u) for u in images)
    wave = grid(found[0].cards if "COEFF0" in found[0].cards else images[0].cards, flux.shape[1])
    ivar, mask = [*more, None, None][:2]
    for i, f in enumerate(flux):
        yield str(i), wave, *_whole(f, None if ivar is None else ivar[i], None if mask is None else mask[i])


def arm_images(found: list[fits.Unit], raw: bytes) -> Iterator[Row]:
    """Spectra in arms (B, R, Z and others): ARM_WAVELENGTH, ARM_FLUX, ARM_IVAR, ARM_MASK; arms stand one after another."""
    arms = [u.name().upper()[: -len("_WAVELENGTH")] for u in found if u.name().upper().endswith("_WAVELENGTH")]
    own = _rows(found, raw, tuple(f"{a}_{k}" for a in arms for k in ("WAVELENGTH", "FLUX", "IVAR", "MASK")))
    table = next((u for u in found if u.is_table and u.name().upper() == "FIBERMAP"), None)
    ids = fits.decode(raw, table).get("TARGETID") if table else None
    for i in range(len(own[f"{arms[0]}_FLUX"])):
        parts = [(own[f"{a}_WAVELENGTH"], *_whole(own[f"{a}_FLUX"][i], own[f"{a}_IVAR"][i], own[f"{a}_MASK"][i] if f"{a}_MASK" in own else None)) for a in arms]
        wave, flux, ivar, mask = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(wave, kind="stable")
        yield str(ids[i]) if ids is not None else str(i), wave[order], flux[order], ivar[order], mask[order]


def one_image(found: list[fits.Unit], raw: bytes) -> Iterator[Row]:
    """A spectrum as a one-dimensional image; a second image, or line, named for an error or a variance, gives its weights."""
    images = [u for u in found if not u.is_table and int(u.cards.get("NAXIS", 0)) >= 1]
    flux = image(raw, images[0])
    lines = flux.reshape(-1, flux.shape[-1])
    ivar = None
    for u in images[1:]:
        other = image(raw, u).reshape(-1)
        if len(other) != lines.shape[1]:
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            name = u.name().upper()
            if "IVAR" in name:
                ivar = other
            elif "VAR" in name:
                ivar = np.where(other > 0, 1 / other, 0.0)
            elif name.startswith(("ERR", "SIG", "NOISE")):
                ivar = np.where(other > 0, 1 / other**2, 0.0)
    yield str(found[0].cards.get("OBJECT", "")), grid(images[0].cards, lines.shape[1]), *_whole(lines[0], ivar, None)


Decoder = Callable[[list[fits.Unit], bytes], Iterator[Row]]
DECODERS: dict[str, Decoder] = {"coadd": coadd_table, "plate": plate_images, "arms": arm_images, "generic": one_image}


def layout_of(found: list[fits.Unit]) -> str:
    """The layout that the headers tell."""
    if any(u.name().upper().endswith("_WAVELENGTH") for u in found):
        return "arms"
    tables = [{str(v).strip().lower() for k, v in u.cards.items() if k.startswith("TTYPE")} for u in found if u.is_table]
    if any("flux" in t and t & {"loglam", "wavelength", "wave", "lambda"} for t in tables):
        return "coadd"
    shapes = [int(u.cards.get("NAXIS", 0)) for u in found if not u.is_table]
    if shapes and shapes[0] == 2 and "COEFF0" in found[0].cards:
        return "plate"
    if any(shapes):
        return "generic"
    raise ValueError("no layout of spectra is known that has such units")


def read_spectra(spark: SparkSession, path: str, layout: str | Decoder = "auto") -> DataFrame:
    """Spectra of FITS files, one row each; layout: a name of DECODERS, a decoder, or told by each file's headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw = batch.column(0)[i].as_py(), fits.plain(batch.column(1)[i].as_py())
                found = fits.units(raw)
                decode = layout if callable(layout) else DECODERS[layout_of(found) if layout == "auto" else layout]
                for own, wave, flux, ivar, mask in decode(found, raw):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.rpartition("/")[2]]), pa.array([own]), *(pa.array([x.astype(float)], pa.list_(pa.float64())) for x in (wave, flux, ivar)), pa.array([mask.astype(np.int32)], pa.list_(pa.int32()))],
                        names=["source_file", "object", "wavelength", "flux", "ivar", "mask"],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
