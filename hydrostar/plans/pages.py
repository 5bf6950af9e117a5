"""The data behind each of the dashboard's six pages.

A page names the base queries it runs and the derived results it shows.  The
base results go through a :class:`ResultStore`, so a base query shared by
several results (or several pages) runs once per store, as with the
dashboard's cache.  Only data is produced here; drawing is not rebuilt.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from hydrostar.plans import base, derived
from hydrostar.plans.reuse import ResultStore
from hydrostar.sources.tables import Tables

BASE: dict[str, Callable[..., DataFrame]] = {
    "Q1": base.filtration_share,
    "Q2": base.parameter_purpose,
    "Q3": base.state_coverage,
    "Q4": base.point_volume,
    "Q5": base.parameter_volume,
    "Q6": base.geo_activity,
    "Q7": base.institution_performance,
    "Q8": base.band_distribution,
    "Q9": base.state_ranking,
    "Q10": base.monthly_evolution,
    "Q11": base.kpi_summary,
}

# Queries on one stored grain of the fact: the first store it, as each of them
# would aggregate the whole fact; the others, which filter the fact first, read
# it if it is there.
WHOLE_FACT = ("Q6", "Q7", "Q9")
PART_OF_FACT = ("Q8", "Q10")

# page -> results shown, base query ids ("Q..") or derived ids ("P..").
PAGES: dict[str, tuple[str, ...]] = {
    "overview": ("Q11", "P1", "P2"),
    "infrastructure": ("Q1", "P3", "P26a", "Q2", "P4", "P5"),
    "territory": ("Q3", "P25", "P6", "Q4", "P7", "P8", "P26b", "Q5", "P9", "P10"),
    "institutional": ("Q6", "P11", "P24a", "Q7", "P24b", "Q8", "P12"),
    "quality": ("Q9", "P13", "P14", "P15", "P16", "Q8", "P17", "P18", "P24c"),
    "temporal": ("Q10", "P19", "P20", "P21", "P22", "P22b", "P24d", "P23"),
}


def accepted(rid: str) -> set[str]:
    """Parameter names that a base query or derived result takes."""
    fn = BASE[rid] if rid in BASE else derived.DERIVED_ON[rid][1]
    names = list(inspect.signature(fn).parameters)[1:]
    return {n for n in names if n != "ordered"}


def assign(ids: Sequence[str], params: Mapping[str, object]) -> dict[str, dict[str, object]]:
    """Give each named parameter to every result among ``ids`` (and to the
    base queries below them) that takes it; an unknown one is an error."""
    below = {derived.DERIVED_ON[i][0] for i in ids if i in derived.DERIVED_ON}
    out: dict[str, dict[str, object]] = {}
    for name, value in params.items():
        takers = [i for i in {*ids, *below} if name in accepted(i)]
        if not takers:
            raise ValueError(f"no parameter {name!r} in {', '.join(ids)}")
        for i in takers:
            out.setdefault(i, {})[name] = value
    return out


def result(
    rid: str,
    tables: Tables,
    params: Mapping[str, Mapping[str, object]] | None = None,
    store: ResultStore | None = None,
) -> DataFrame:
    """One base query or derived result by id; with a store, the base query
    is computed once and kept."""
    params = params or {}
    qid, fn = (rid, None) if rid in BASE else derived.DERIVED_ON[rid]
    kwargs = dict(params.get(qid, {}))
    if store is None:
        df = BASE[qid](tables, ordered=rid not in derived.RESORTED, **kwargs)
    else:
        key = f"{qid}:{sorted(kwargs.items())!r}"

        def build() -> DataFrame:
            shared = tables
            if qid in WHOLE_FACT or qid in PART_OF_FACT:
                shared = store.with_grain(tables, build=qid in WHOLE_FACT)
            return BASE[qid](shared, **kwargs)

        df = store.get(key, build, owner=tables)
    return df if fn is None else fn(df, **dict(params.get(rid, {})))


def page(
    name: str,
    tables: Tables,
    store: ResultStore,
    params: Mapping[str, Mapping[str, object]] | None = None,
) -> dict[str, DataFrame]:
    """Results of one page.  ``params`` maps a query id (e.g. "Q10", "P18")
    to keyword arguments of its function; omitted ones use the defaults."""
    return {rid: result(rid, tables, params, store) for rid in PAGES[name]}
