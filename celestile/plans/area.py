"""Areas: named regions with blocks for discovery, crossmatch, gather and homogenize; cost and ingest advice."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.sphere import files_per_tile
from ..operators import counting, crossmatch, gather, homogenize
from .region import Region, select_region

# Order-of-magnitude seconds a tile, as planning figures.
SECONDS_A_TILE = {"crossmatch": 30, "gather": 10, "ingest": 120}
SHARD_ABOVE_FILES_A_TILE = 3
DEFAULT_RADIUS_ARCSEC = 1.0


def area_id(name: str) -> str:
    text = re.sub(r"[^a-z0-9_-]+", "_", name.strip().lower()).strip("_")
    if not text:
        raise ValueError("an area needs a name")
    return text


@dataclass
class Area:
    name: str
    region: dict
    discover: dict = field(default_factory=dict)
    crossmatch_plan: dict = field(default_factory=dict)
    gather: dict = field(default_factory=dict)
    homogenize: dict = field(default_factory=dict)

    @classmethod
    def load(cls, text: str) -> Area:
        doc = json.loads(text)
        return cls(area_id(doc["name"]), doc["region"], *(doc.get(k, {}) for k in ("discover", "crossmatch_plan", "gather", "homogenize")))

    def dump(self) -> str:
        return json.dumps(self.__dict__, indent=1)

    def updated(self, **blocks: dict) -> Area:
        return Area(**(self.__dict__ | {k: getattr(self, k) | v for k, v in blocks.items()}))

    def problems(self, surveys: Sequence[str] | None = None) -> list[tuple[str, str]]:
        """(ERROR or WARN, what)."""
        out = []
        try:
            Region.parse(self.region)
        except (ValueError, KeyError, TypeError) as e:
            out.append(("ERROR", f"region: {e}"))
        plan = self.crossmatch_plan
        if plan and not plan.get("base"):
            out.append(("ERROR", "crossmatch_plan has no base"))
        partners = []
        for spec in plan.get("partners", []):
            try:
                partners.append(parse_partner(spec).name)
            except ValueError as e:
                out.append(("ERROR", str(e)))
        if self.gather.get("multiplicity", "nearest") not in ("nearest", "all"):
            out.append(("ERROR", "gather: multiplicity is nearest or all"))
        out += [("WARN", f"gather: {p} isn't in the crossmatch plan") for p in self.gather.get("columns", {}) if p not in partners]
        known = set(surveys) if surveys is not None else None
        out += [("WARN", f"{s} isn't in the lake") for s in (plan.get("base"), *partners) if known is not None and s and s not in known]
        return out

    def is_valid(self) -> bool:
        return not any(level == "ERROR" for level, _ in self.problems())


def parse_partner(spec: str | dict) -> crossmatch.Partner:
    """'NAME', 'NAME:2.5' (arc seconds), 'NAME:a=b' (key columns), or the same as a document."""
    if isinstance(spec, dict):
        columns = tuple(spec["columns"]) if spec.get("columns") else None
        return crossmatch.Partner(spec["survey"], spec.get("radius_arcsec"), columns)
    name, colon, rest = spec.partition(":")
    if not name:
        raise ValueError(f"not a partner: {spec!r}")
    if "=" in rest:
        left, _, right = rest.partition("=")
        return crossmatch.Partner(name, None, (left.strip(), right.strip()))
    try:
        radius = float(rest) if colon else DEFAULT_RADIUS_ARCSEC
    except ValueError:
        raise ValueError(f"not a partner: {spec!r}") from None
    if radius <= 0:
        raise ValueError(f"a match radius is positive: {spec!r}")
    return crossmatch.Partner(name, radius)


def suggest_match(base: Sequence[str], partner: Sequence[str], partner_name: str) -> tuple[crossmatch.Partner, str]:
    """How to match two catalogs by their columns: a shared native id, a key named after the partner, else the sky."""
    native = lambda names: [c for c in names if not c.startswith("_") and re.search(r"(^|_)(source_?id|target_?id|object_?id|objid|id)$", c.lower())]
    own, other = native(base), native(partner)
    for a in own:
        for b in other:
            if a.lower() == b.lower() and a.lower() != "id":
                return crossmatch.Partner(partner_name, None, (a, b)), "shared id column"
    stem = re.split(r"[_\d]", partner_name.lower())[0]
    for a in own:
        if stem and a.lower().startswith(f"{stem}_") and other:
            return crossmatch.Partner(partner_name, None, (a, other[0])), "key named after the partner"
    return crossmatch.Partner(partner_name, DEFAULT_RADIUS_ARCSEC), "position"


def suggest_plan(base: str, columns: dict[str, Sequence[str]], rows: dict[str, int | None]) -> list[tuple[crossmatch.Partner, str]]:
    """Suggestions for all other catalogs, the small ones first and those of unknown size last."""
    order = sorted((s for s in columns if s != base), key=lambda s: (rows.get(s) is None, rows.get(s) or 0, s))
    return [suggest_match(columns[base], columns[s], s) for s in order]


@dataclass
class Layer:
    """A catalog of the lake as an area uses it."""

    frame: DataFrame
    sky: crossmatch.Sky
    order: int


def run_area(area: Area, layers: dict[str, Layer], recipes: Sequence[homogenize.Recipe] = ()) -> dict[str, DataFrame]:
    """discovery, association trees, product and homogenized product: one lazy frame each."""
    if wrong := [w for level, w in area.problems(list(layers)) if level == "ERROR"]:
        raise ValueError("; ".join(wrong))
    region = Region.parse(area.region)
    out: dict[str, DataFrame] = {}
    first = next(iter(layers.values())).frame.sparkSession
    for survey in area.discover.get("surveys", list(layers)):
        own = layers[survey]
        row = counting.discover({(survey, "catalog"): (own.frame, own.sky.pixel)}, region.frame(first, own.order))
        out["discovery"] = row if "discovery" not in out else out["discovery"].unionByName(row)
    if not area.crossmatch_plan:
        return out
    base = layers[area.crossmatch_plan["base"]]
    clipped = select_region(base.frame, region, base.sky.pixel, base.order, base.sky.ra, base.sky.dec, area.discover.get("exact", False))
    partners = [parse_partner(p) for p in area.crossmatch_plan.get("partners", [])]
    frames = {n: x.frame for n, x in layers.items()} | {area.crossmatch_plan["base"]: clipped}
    trees, errors = crossmatch.run_plan(frames, area.crossmatch_plan["base"], partners, {n: x.sky for n, x in layers.items()}, stop_at_error=True)
    out |= trees
    if area.gather:
        names = {p.name: crossmatch.tree_name(area.crossmatch_plan["base"], p.name, p.radius_arcsec, p.columns) for p in partners}
        asked = [gather.GatherPartner(n, layers[n].frame, trees[names[n]], cols, layers[n].sky.id) for n, cols in area.gather.get("columns", {}).items()]
        out["product"] = gather.gather(clipped, asked, id_col=base.sky.id, columns=area.gather.get("base_columns"), multiplicity=area.gather.get("multiplicity", "nearest"), keep_all=area.gather.get("keep_all", True), where_joined=area.gather.get("where"))
        if area.homogenize or recipes:
            out["homogenized"] = homogenize.homogenize_product(out["product"], recipes)
    return out


def cost(kind: str, tiles: int) -> dict:
    """Seconds, hours: an order of magnitude only."""
    seconds = SECONDS_A_TILE[kind] * tiles
    return {"operation": kind, "tiles": tiles, "seconds": seconds, "hours": round(seconds / 3600, 2)}


def ingest_advice(files: int, order: int, sky_deg2: float | None = None) -> dict:
    """Append file by file, or shards and one shuffle, by how many files share a tile."""
    each = files_per_tile(files, order) if sky_deg2 is None else files_per_tile(files, order, sky_deg2)
    return {"files_per_tile": each, "mode": "shard" if each > SHARD_ABOVE_FILES_A_TILE else "append"}
