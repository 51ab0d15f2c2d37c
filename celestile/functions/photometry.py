"""Value and uncertainty steps of photometric harmonization, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Value, col

SENTINELS = (9999.0, -9999.0, 999.0, -999.0)
#: 2.5 / ln 10
MAG_PER_RELATIVE_FLUX = 1.0857362047461345
#: What a step can't do without.
NEEDED = {"scale": "factor", "mag_offset": "delta", "flux_to_ab": "zero_point"}
STEPS = ("mag_offset", "scale", "identity", "null_if_sentinel", "flux_to_ab", "inverse")


@dataclass(frozen=True)
class Step:
    kind: str
    delta: float = 0.0
    factor: float = 1.0
    zero_point: float = 0.0
    values: tuple[float, ...] = ()

    def check(self) -> list[str]:
        if self.kind not in STEPS:
            return [f"unknown step {self.kind!r}"]
        return []


@dataclass(frozen=True)
class Rule:
    """target = steps applied to source; error: the source's uncertainty column, if any; error_steps: what is done to it, if not the default."""

    source: str
    target: str
    steps: tuple[Step, ...]
    error: str | None = None
    error_target: str | None = None
    sentinels: tuple[float, ...] = field(default=())
    error_steps: tuple[Step, ...] = ()


def clean(x: Value, extra: Sequence[float] = ()) -> Column:
    """A double, null where it isn't a number or a sentinel; what the first step of a rule sees."""
    c = col(x).cast("double")
    return F.when(~F.isnan(c) & ~c.isin(*SENTINELS, *map(float, extra)), c)


def apply_step(c: Column, step: Step) -> Column:
    if step.kind == "mag_offset":
        return c + F.lit(float(step.delta))
    if step.kind == "scale":
        return c * F.lit(float(step.factor))
    if step.kind == "null_if_sentinel":
        return F.when(~c.isin(*map(float, step.values)), c) if step.values else c
    if step.kind == "flux_to_ab":
        return F.when((c > 0) & ~F.isnan(c), F.lit(-2.5) * F.log10(c) + F.lit(float(step.zero_point)))
    if step.kind == "inverse":
        return F.when(c != 0, F.lit(1.0) / c)
    return c


def value(rule: Rule) -> Column:
    """The chain; sentinels go before the first step only."""
    c = clean(rule.source, rule.sentinels + tuple(v for s in rule.steps[:1] for v in s.values))
    for step in rule.steps:
        c = apply_step(c, step)
    return c


def value_sql_form(rule: Rule) -> Column:
    """The form of a zero-copy SQL view: an offset alone leaves sentinels as they are."""
    if len(rule.steps) == 1 and rule.steps[0].kind == "mag_offset":
        return col(rule.source).cast("double") + F.lit(float(rule.steps[0].delta))
    return value(rule)


def value_text(rule: Rule) -> str:
    """value_sql_form as SQL text: for views that are defined by text."""
    number = lambda x: f"{float(x)!r}D"
    c = f"CAST(`{rule.source}` AS DOUBLE)"
    if len(rule.steps) == 1 and rule.steps[0].kind == "mag_offset":
        return f"{c} + {number(rule.steps[0].delta)}"
    gone = ", ".join(map(number, (*SENTINELS, *rule.sentinels, *(v for s in rule.steps[:1] for v in s.values))))
    c = f"CASE WHEN NOT isnan({c}) AND {c} NOT IN ({gone}) THEN {c} END"
    for step in rule.steps:
        if step.kind == "mag_offset":
            c = f"({c}) + {number(step.delta)}"
        elif step.kind == "scale":
            c = f"({c}) * {number(step.factor)}"
        elif step.kind == "null_if_sentinel" and step.values:
            c = f"CASE WHEN ({c}) NOT IN ({', '.join(map(number, step.values))}) THEN {c} END"
        elif step.kind == "flux_to_ab":
            c = f"CASE WHEN ({c}) > 0 THEN -2.5D * log10({c}) + {number(step.zero_point)} END"
        elif step.kind == "inverse":
            c = f"CASE WHEN ({c}) <> 0 THEN 1.0D / ({c}) END"
    return c


def uncertainty(rule: Rule) -> Column:
    """The uncertainty that goes with value(rule).

    By default it follows the values: a scale multiplies it, sign included, and a flux
    becomes a relative error in magnitudes; offsets, sentinels and inverses leave it.  It is null
    where the value is, but for a single scale.  A rule's own ``error_steps`` take the place of
    all this, see ``explicit_uncertainty``.
    """
    if rule.error_steps:
        return explicit_uncertainty(rule)
    flux = clean(rule.source, rule.sentinels + tuple(v for s in rule.steps[:1] for v in s.values))
    err = clean(rule.error)
    if len(rule.steps) == 1 and rule.steps[0].kind == "scale":
        return err * F.lit(float(rule.steps[0].factor))
    for step in rule.steps:
        if step.kind == "scale":
            err = err * F.lit(float(step.factor))
        elif step.kind == "flux_to_ab":
            err = F.when(flux > 0, F.lit(MAG_PER_RELATIVE_FLUX) * err / flux)
        flux = apply_step(flux, step)
    return F.when(flux.isNotNull(), err)


def explicit_uncertainty(rule: Rule) -> Column:
    """The rule's error_steps applied to its uncertainty: scale and mag_offset change it, identity and
    null_if_sentinel null it with the value, flux_to_ab relates it to the flux as far as the values' and
    its own scales bring it, inverse takes its reciprocal."""
    err, flux = clean(rule.error), clean(rule.source, rule.sentinels)
    flux = F.when(flux > 0, flux)
    for step in rule.steps:
        if step.kind == "flux_to_ab":
            break
        if step.kind == "scale":
            flux = apply_step(flux, step)
    for step in rule.error_steps:
        if step.kind == "flux_to_ab":
            err = F.lit(MAG_PER_RELATIVE_FLUX) * err / flux
        elif step.kind in ("identity", "null_if_sentinel"):
            err = F.when(value(rule).isNotNull(), err)
        else:
            err = apply_step(err, step)
        if step.kind == "scale":
            flux = apply_step(flux, step)
    return err


def vega_flux(mag: Value, zero_flux: float) -> Column:
    """zero_flux * 10^(-0.4 mag)."""
    return F.lit(float(zero_flux)) * F.pow(F.lit(10.0), F.lit(-0.4) * col(mag).cast("double"))
