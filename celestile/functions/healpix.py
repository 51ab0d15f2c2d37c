"""Equal-area pixels of the sphere in nested order, after Gorski et al. 2005 (ApJ 622:759).

``with_pixel`` is made of built-in expressions; the numpy twin serves covers of small
regions on the driver and tests.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import Value, col
from .sphere import wrap_ra

# Fixed values of the paper: ring and longitude of the southernmost corner of each base pixel.
RING_OF_FACE = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
LON_OF_FACE = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def with_pixel(df: DataFrame, ra: str, dec: str, order: int, out: str) -> DataFrame:
    """df with the pixel of each position; null where a coordinate is null or not a number.

    Every step names the one before a few times only, so that merged projections stay small.
    """
    n = 1 << order
    t = {k: f"_{out}_{k}" for k in ("z", "c", "t", "p", "m", "f", "x", "y")}
    c = lambda k: F.col(t[k])
    own = df.withColumns({t["z"]: F.sin(F.radians(F.col(dec).cast("double"))), t["c"]: F.cos(F.radians(F.col(dec).cast("double"))), t["t"]: wrap_ra(ra) / 90.0})
    flat = F.abs(c("z")) <= 2.0 / 3.0
    quarter = F.least(F.lit(3), F.floor(c("t")))
    s = n * c("c") * F.sqrt(F.lit(3.0) / (1.0 + F.abs(c("z"))))
    within = lambda x: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x)))
    own = own.withColumns(
        {
            t["p"]: F.when(flat, F.floor(n * (0.5 + c("t")) - 0.75 * n * c("z"))).otherwise(within((c("t") - quarter) * s)),
            t["m"]: F.when(flat, F.floor(n * (0.5 + c("t")) + 0.75 * n * c("z"))).otherwise(within((1.0 - (c("t") - quarter)) * s)),
        }
    )
    fp, fm = F.shiftright(c("p"), order), F.shiftright(c("m"), order)
    north = c("z") > 0
    face = F.when(flat, F.when(fp == fm, fp.bitwiseOR(F.lit(4))).when(fp < fm, fp).otherwise(fm + 8)).when(north, quarter).otherwise(quarter + 8)
    x = F.when(flat, c("m").bitwiseAND(F.lit(n - 1))).when(north, n - 1 - c("m")).otherwise(c("p"))
    y = F.when(flat, n - 1 - c("p").bitwiseAND(F.lit(n - 1))).when(north, n - 1 - c("p")).otherwise(c("m"))
    own = own.withColumns({t["f"]: face.cast("long"), t["x"]: x.cast("long"), t["y"]: y.cast("long")})
    # binary digits read in base 4 stand at every second bit
    spread = lambda k: F.conv(F.bin(c(k)), 4, 10).cast("long")
    usable = c("z").isNotNull() & c("t").isNotNull() & ~F.isnan(c("z")) & ~F.isnan(c("t"))
    # a pixel that can't be null elsewhere: the optimizer's "is not null" below a join then needs no pixel
    return own.withColumn(out, F.when(usable, F.coalesce(c("f") * (n * n) + spread("x") + 2 * spread("y"), F.lit(-1)))).drop(*t.values())


def ang2pix(ra, dec, order: int) -> np.ndarray:
    """The numpy twin of with_pixel, for finite coordinates."""
    ra, dec = np.broadcast_arrays(np.asarray(ra, float), np.asarray(dec, float))
    n = 1 << order
    z, tt = np.sin(np.radians(dec)), np.mod(ra, 360.0) / 90.0
    tt = np.where(tt >= 4, 0.0, tt)
    flat = np.abs(z) <= 2.0 / 3.0
    p, m = np.floor(n * (0.5 + tt) - 0.75 * n * z).astype(np.int64), np.floor(n * (0.5 + tt) + 0.75 * n * z).astype(np.int64)
    fp, fm = p >> order, m >> order
    face = np.where(fp == fm, fp | 4, np.where(fp < fm, fp, fm + 8))
    x, y = m & (n - 1), n - 1 - (p & (n - 1))
    quarter = np.minimum(3, np.floor(tt).astype(np.int64))
    s = n * np.cos(np.radians(dec)) * np.sqrt(3.0 / (1.0 + np.abs(z)))
    pp, pm = (np.clip(np.floor(v).astype(np.int64), 0, n - 1) for v in ((tt - quarter) * s, (1.0 - (tt - quarter)) * s))
    north = z > 0
    face = np.where(flat, face, np.where(north, quarter, quarter + 8))
    x = np.where(flat, x, np.where(north, n - 1 - pm, pp))
    y = np.where(flat, y, np.where(north, n - 1 - pp, pm))
    return face * n * n + _spread(x) + 2 * _spread(y)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for shift, mask in SPREAD:
        x = (x | (x << shift)) & mask
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    x = x & SPREAD[-1][1]
    for (shift, _), mask in zip(reversed(SPREAD), (0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF), strict=True):
        x = (x | (x >> shift)) & mask
    return x


def _place(face: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RA, Dec of places x, y in [0, 1] of a base pixel."""
    ring = RING_OF_FACE[face] - x - y
    near = np.where(ring < 1, ring, np.where(ring > 3, 4 - ring, 1.0))
    z = np.where(ring < 1, 1 - near**2 / 3, np.where(ring > 3, near**2 / 3 - 1, (2 - ring) * 2 / 3))
    lon = np.mod(LON_OF_FACE[face] * near + x - y, 8)
    ra = np.where(near < 1e-15, 0.0, 45.0 * lon / np.where(near < 1e-15, 1.0, near))
    return np.mod(ra, 360.0), np.degrees(np.arcsin(np.clip(z, -1, 1)))


def _faces(pix, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pix = np.asarray(pix, np.int64)
    inside = pix & ((1 << (2 * order)) - 1)
    return pix >> (2 * order), _gather(inside), _gather(inside >> 1)


def pix2ang(pix, order: int) -> tuple[np.ndarray, np.ndarray]:
    """RA, Dec of pixel centres."""
    n = 1 << order
    face, x, y = _faces(pix, order)
    return _place(face, (x + 0.5) / n, (y + 0.5) / n)


def corners(pix: int, order: int) -> list[tuple[float, float]]:
    """The four corners of a tile: north, west, south, east of its face's axes."""
    n = 1 << order
    face, x, y = _faces([pix] * 4, order)
    dx, dy = np.array([1, 0, 0, 1]), np.array([1, 1, 0, 0])
    ra, dec = _place(face, (x + dx) / n, (y + dy) / n)
    return list(zip(ra.tolist(), dec.tolist(), strict=True))


def max_pixel_radius(order: int) -> float:
    """The largest distance from a pixel's centre to its corners."""
    n = 1 << order
    z1, phi = 2 / 3, math.pi / (4 * n)
    z2 = 1 - (1 - 1 / n) ** 2 / 3
    s1, s2 = math.sqrt(1 - z1 * z1), math.sqrt(1 - z2 * z2)
    return math.degrees(math.acos(min(1.0, z1 * z2 + s1 * s2 * math.cos(phi))))


def distance(ra1, dec1, ra2, dec2) -> np.ndarray:
    a1, d1, a2, d2 = (np.radians(np.asarray(v, float)) for v in (ra1, dec1, ra2, dec2))
    h = np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin((a2 - a1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1, h))))


def _descend(order: int, keep) -> list[int]:
    pix = np.arange(12)
    for k in range(order + 1):
        ra, dec = pix2ang(pix, k)
        pix = pix[keep(ra, dec, max_pixel_radius(k))]
        if k < order:
            pix = (pix[:, None] * 4 + np.arange(4)).ravel()
    return pix.tolist()


def cover_cone(ra: float, dec: float, radius: float, order: int) -> list[int]:
    """Pixels that a disc may touch (a superset): centres within radius + pixel radius."""
    return _descend(order, lambda r, d, p: distance(ra, dec, r, d) <= radius + p + 1e-9)


def cover_bbox(ra_min: float, ra_max: float, dec_min: float, dec_max: float, order: int) -> list[int]:
    """Pixels that a box may touch (a superset); ra_min > ra_max wraps, a width of 360 or more is the full circle."""
    dec_min, dec_max = max(-90.0, dec_min), min(90.0, dec_max)
    full = ra_max - ra_min >= 360 or ra_min % 360 == ra_max % 360
    low, width = ra_min % 360, (ra_max - ra_min) % 360

    def keep(ra, dec, p):
        inside = (dec >= dec_min - p) & (dec <= dec_max + p)
        polar = np.abs(dec) + p >= 90
        reach = np.where(polar, 180.0, np.degrees(np.arcsin(np.minimum(1, np.sin(np.radians(p)) / np.maximum(1e-12, np.cos(np.radians(dec)))))))
        return inside & (full | polar | (np.mod(ra - low + reach, 360) <= width + 2 * reach))

    return _descend(order, keep)


def neighbours(pix: int, order: int) -> list[int]:
    """Pixels around one (a superset of the ring of eight)."""
    ra, dec = (float(v) for v in pix2ang(pix, order))
    return [p for p in cover_cone(ra, dec, max_pixel_radius(order), order) if p != pix]


def rescale(pix: Value, order: int, to: int) -> Column:
    """The parent at a coarser order, or the array of all children at a finer one."""
    p = col(pix).cast("long")
    if to <= order:
        return F.shiftright(p, 2 * (order - to))
    step = 2 * (to - order)
    return F.sequence(F.shiftleft(p, step), F.shiftleft(p + 1, step) - 1)


def rescale_set(pix: set[int], order: int, to: int) -> set[int]:
    if to <= order:
        return {p >> (2 * (order - to)) for p in pix}
    step = 2 * (to - order)
    return {c for p in pix for c in range(p << step, (p + 1) << step)}


def dir_bucket(pix: Value) -> Column:
    return (F.floor(col(pix) / 10000) * 10000).cast("long")


def tile_path(pix: Value, order: int) -> Column:
    p = col(pix).cast("long")
    return F.concat(F.lit(f"Norder={order}/Dir="), dir_bucket(p).cast("string"), F.lit("/Npix="), p.cast("string"))


def parse_pixels(text: str) -> list[int]:
    """'1,2,5-9' -> the pixels, sorted and distinct."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = part.partition("-")
        if not low.isdigit() or (dash and not high.isdigit()):
            raise ValueError(f"not a pixel or a range: {part!r}")
        out |= set(range(int(low), int(high if dash else low) + 1))
    return sorted(out)


def merge_cells(cells: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """(order, pixel) cells with every four complete siblings merged into their parent, and covered cells left out."""
    cells = {(o, p) for o, p in cells if not any((o - k, p >> (2 * k)) in cells for k in range(1, o + 1))}
    for order in range(max((o for o, _ in cells), default=0), 0, -1):
        own = {p for o, p in cells if o == order}
        for parent in {p >> 2 for p in own if p % 4 == 0}:
            if own.issuperset(range(4 * parent, 4 * parent + 4)):
                cells -= {(order, 4 * parent + k) for k in range(4)}
                cells.add((order - 1, parent))
    return cells


def moc_ascii(cells: set[tuple[int, int]]) -> str:
    """The ASCII form of a multi-order coverage map: 'order/pixel,range ...'."""
    out = []
    for order in sorted({o for o, _ in cells}):
        own, parts = sorted(p for o, p in cells if o == order), []
        while own:
            last = 0
            while last + 1 < len(own) and own[last + 1] == own[last] + 1:
                last += 1
            parts.append(str(own[0]) if not last else f"{own[0]}-{own[last]}")
            own = own[last + 1 :]
        out.append(f"{order}/{','.join(parts)}")
    return " ".join(out)


def parse_moc(text: str) -> set[tuple[int, int]]:
    """ASCII or JSON ({"order": [pixels]}) form."""
    if text.lstrip().startswith("{"):
        import json

        return {(int(o), int(p)) for o, own in json.loads(text).items() for p in own}
    out: set[tuple[int, int]] = set()
    order = None
    for token in text.replace(",", " ").split():
        if "/" in token:
            head, _, token = token.partition("/")
            order = int(head)
        if token:
            if order is None:
                raise ValueError("a coverage map begins with its order")
            out |= {(order, p) for p in parse_pixels(token)}
    return out


def moc_pixels(cells: set[tuple[int, int]], order: int) -> list[int]:
    """The map's pixels at one order: finer cells degrade, coarser ones expand."""
    return sorted({p for o, q in cells for p in rescale_set({q}, o, order)})
