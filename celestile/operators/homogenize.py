"""Homogenization: declarative recipes compiled to Column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import photometry as P
from ..functions import spectra as R


@dataclass(frozen=True)
class Recipe:
    """The rules of one survey towards one target schema."""

    survey: str
    name: str
    rules: tuple[P.Rule, ...]

    @classmethod
    def load(cls, text: str) -> Recipe:
        """A recipe of JSON: rules of source, target, steps (one or a list), error, error_steps, error_target, sentinels."""
        doc = json.loads(text)
        wrong: list[str] = []

        def steps(r: dict, key: str) -> tuple[P.Step, ...]:
            raw = r.get(key) or []
            out = []
            for s in [raw] if isinstance(raw, dict) else raw:
                if P.NEEDED.get(s.get("type"), "type") not in s:
                    wrong.append(f"{r['target']}: {s.get('type')} needs {P.NEEDED[s['type']] if 'type' in s else 'a type'}")
                out.append(P.Step(kind=s.get("type", ""), **{k: tuple(v) if isinstance(v, list) else v for k, v in s.items() if k != "type"}))
            return tuple(out)

        rules = tuple(P.Rule(r["source"], r["target"], steps(r, "steps"), r.get("error"), r.get("error_target"), tuple(r.get("sentinels", ())), steps(r, "error_steps")) for r in doc["rules"])
        recipe = cls(doc["survey"], doc.get("name", ""), rules)
        if wrong := wrong + recipe.problems():
            raise ValueError("; ".join(wrong))
        return recipe

    def problems(self) -> list[str]:
        out = [f"{r.target}: {p}" for r in self.rules for s in (*r.steps, *r.error_steps) for p in s.check()]
        out += [f"{r.target}: no steps" for r in self.rules if not r.steps]
        out += [f"{r.target}: error_steps without an error column" for r in self.rules if r.error_steps and not r.error]
        targets = [r.target for r in self.rules]
        return out + [f"{t}: two rules" for t in sorted({t for t in targets if targets.count(t) > 1})]

    def resolved(self, df: DataFrame, targets: Sequence[str] | None = None) -> list[P.Rule]:
        """Rules whose source df has, of the targets asked for."""
        made: set[str] = set()
        out = []
        for r in self.rules:
            if (r.source in df.columns or r.source in made) and (targets is None or r.target in targets):
                out.append(r)
                made.add(r.target)
        return out


def apply_rules(df: DataFrame, rules: Sequence[P.Rule], sql_form: bool = False) -> tuple[DataFrame, list[dict]]:
    """df with the targets and their uncertainties, and the lineage of each.

    A rule may read an earlier target.  Rules whose source is missing or not a number are
    left out and say so in the lineage.
    """
    lineage = []
    for r in rules:
        kind = next((f.dataType for f in df.schema if f.name == r.source), None)
        if kind is None or not isinstance(kind, (T.NumericType, T.NullType)):
            lineage.append({"target": r.target, "source": r.source, "skipped": "missing" if kind is None else f"of type {kind.simpleString()}"})
            continue
        new = {r.target: P.value_sql_form(r) if sql_form else P.value(r)}
        error = r.error_target or f"{r.target}_err"
        if r.error and r.error in df.columns:
            new[error] = P.uncertainty(r)
        df = df.withColumns(new)
        lineage.append({"target": r.target, "source": r.source, "steps": [s.kind for s in r.steps]} | ({"error": error} if error in new else {}))
    return df, lineage


def homogenize_catalog(df: DataFrame, recipe: Recipe, *, id_col: str = "_source_id", ra: str = "ra", dec: str = "dec", pixel: str | None = None, passthrough: Sequence[str] = (), targets: Sequence[str] | None = None) -> DataFrame:
    """Id, position, tile, passed columns as doubles, targets."""
    rules = recipe.resolved(df, targets)
    out, lineage = apply_rules(df, rules)
    made = [n for x in lineage if "skipped" not in x for n in (x["target"], x.get("error")) if n]
    fixed = [id_col, ra, dec, *([pixel] if pixel else [])]
    return out.select(*fixed, *(F.col(c).cast("double").alias(c) for c in passthrough), *made)


def homogenize_product(df: DataFrame, recipes: Sequence[Recipe]) -> DataFrame:
    """All native columns and the targets of every recipe."""
    for recipe in recipes:
        df, _ = apply_rules(df, recipe.resolved(df))
    return df


def view_expressions(rules: Sequence[P.Rule]) -> dict[str, str]:
    """target -> SQL text, for view_sql."""
    return {r.target: P.value_text(r) for r in rules}


def view_sql(view: str, expressions: dict[str, str]) -> str:
    """SELECT * and the targets over a view: nothing is copied."""
    return f"SELECT *, {', '.join(f'{e} AS `{t}`' for t, e in expressions.items())} FROM {view}"


def homogenize_spectra(df: DataFrame, factor: float, flux: str = "flux", ivar: str = "ivar") -> DataFrame:
    if factor == 1:
        return df
    return df.withColumns({flux: R.flux_scaled(flux, factor), ivar: R.ivar_scaled(ivar, factor)})


def homogenize_cutouts(df: DataFrame, factors: Sequence[float], pixels_a_band: int, image: str = "image", default: float = 1.0) -> DataFrame:
    return df.withColumn(image, R.band_scaled(image, pixels_a_band, factors, default))


def sed_points(df: DataFrame, bandpasses: DataFrame, id_col: str = "_source_id", prefix: str = "phot_ab_") -> DataFrame:
    """id, band, lambda_eff, mag, err: a row for each magnitude that is a number and whose band is known.

    bandpasses: band, lambda_eff.  Only the bands that df has columns of are read from it.  The
    points of a source stand together in the order of their wavelengths.
    """
    bands = [c[len(prefix) :] for c in df.columns if c.startswith(prefix) and not c.endswith("_err")]
    known = bandpasses.where(F.col("band").isin(bands) & F.col("lambda_eff").isNotNull()).select("band", F.col("lambda_eff").cast("double"))
    at = dict(map(tuple, known.dropDuplicates(["band"]).collect()))

    def point(band: str) -> Column:
        mag, err = f"{prefix}{band}", f"{prefix}{band}_err"
        own = (F.col(err) if err in df.columns else F.lit(None)).cast("double")
        return F.struct(F.lit(band).alias("band"), F.lit(at[band]).alias("lambda_eff"), F.col(mag).cast("double").alias("mag"), own.alias("err"))

    points = F.array(*map(point, sorted(at, key=lambda b: (at[b], b)))) if at else F.array().cast("array<struct<band:string,lambda_eff:double,mag:double,err:double>>")
    return df.select(id_col, F.explode(points).alias("p")).select(id_col, "p.*").where(F.col("mag").isNotNull() & ~F.isnan("mag"))


def golden_failures(df: DataFrame, pairs: Sequence[tuple[P.Rule, float, float, float]]) -> list[str]:
    """Rules that don't give the expected value of an input within a tolerance; df: any frame of one row."""
    out = []
    for rule, given, expected, tolerance in pairs:
        own = df.limit(1).select(F.lit(given).alias(rule.source))
        got = own.select(P.value(rule)).first()
        if got is None or got[0] is None or abs(got[0] - expected) > tolerance:
            out.append(f"{rule.source} -> {rule.target}: {given} gives {got and got[0]}, not {expected}")
    return out
