"""Queries over a master association table: want list -> master -> catalogs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def alias_of(survey: str) -> str:
    """A name that SQL takes: lower case, s_ before a digit, 24 characters."""
    text = re.sub(r"\W+", "_", survey.lower()).strip("_") or "s"
    return (f"s_{text}" if text[0].isdigit() else text)[:24]


def column_picks(specs: Sequence[str]) -> dict[str, list[str]]:
    """'S:c1,c2' or 'S.c1,c2' -> columns by survey."""
    out: dict[str, list[str]] = {}
    for spec in specs:
        found = re.fullmatch(r"\s*([^:.\s]+)\s*[:.]\s*(.+)", spec)
        if not found:
            raise ValueError(f"not SURVEY:col1,col2: {spec!r}")
        out.setdefault(found[1], []).extend(c.strip() for c in found[2].split(",") if c.strip())
    return out


@dataclass(frozen=True)
class MasterPlan:
    """views: statements to run first; select: the query."""

    select: str
    views: list[str] = field(default_factory=list)

    def all_sql(self) -> str:
        return ";\n".join([*self.views, self.select])


def catalog_view(name: str, path: str) -> str:
    return f"CREATE OR REPLACE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{path}')"


def master_view(name: str, plan: MasterPlan) -> str:
    """A view of the whole master query, for further SQL."""
    return f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {plan.select}"


def build_select(master: str, want: str, primary: str, links: dict[str, str], catalogs: dict[str, tuple[str, str]], columns: dict[str, list[str]], master_columns: Sequence[str] = ()) -> MasterPlan:
    """An inner-join chain of views.

    links: the master's id column of each survey; catalogs: view and id column by survey;
    names come out as want_id, master_COLUMN and ALIAS_COLUMN.
    """
    if primary not in links:
        raise KeyError(f"the master has no ids of {primary}")
    picks = [f"w.want_id AS want_id", *(f"m.`{c}` AS master_{c}" for c in master_columns)]
    joins = [f"FROM {want} w", f"JOIN {master} m ON m.`{links[primary]}` = w.want_id"]
    for survey, names in columns.items():
        view, own = catalogs[survey]
        a = alias_of(survey)
        joins.append(f"JOIN {view} {a} ON {a}.`{own}` = m.`{links[survey]}`")
        picks += [f"{a}.`{c}` AS {a}_{c}" for c in names]
    return MasterPlan(f"SELECT {', '.join(picks)}\n" + "\n".join(joins))


def want_master_catalogs(spark: SparkSession, want: DataFrame, master: DataFrame, primary: str, links: dict[str, str], catalogs: dict[str, tuple[DataFrame, str]], columns: dict[str, list[str]], master_columns: Sequence[str] = ()) -> DataFrame:
    """The same chain on frames."""
    asked = want.select(F.col(want.columns[0]).alias("want_id"))
    out = asked.join(master, asked["want_id"] == master[links[primary]])
    kept = ["want_id", *(F.col(c).alias(f"master_{c}") for c in master_columns)]
    out = out.select(*kept, *(F.col(links[s]).alias(f"_link_{i}") for i, s in enumerate(columns)))
    for i, (survey, names) in enumerate(columns.items()):
        frame, own = catalogs[survey]
        a = alias_of(survey)
        right = frame.select(F.col(own).alias(f"_own_{i}"), *(F.col(c).alias(f"{a}_{c}") for c in names))
        out = out.join(right, F.col(f"_link_{i}") == F.col(f"_own_{i}")).drop(f"_link_{i}", f"_own_{i}")
    return out


def guess_surveys(columns: Sequence[str], surveys: Sequence[str]) -> dict[str, str]:
    """Which column of a master holds which survey's ids: NAME_source_id, NAME_targetid, NAME_id."""
    out: dict[str, str] = {}
    for survey in surveys:
        stem = alias_of(survey).split("_")[0]
        for c in columns:
            if c not in out.values() and re.fullmatch(rf"{re.escape(stem)}\w*_(source_id|targetid|target_id|id)", c.lower()):
                out[survey] = c
                break
    return out
