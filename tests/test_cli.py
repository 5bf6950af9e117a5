"""The command line lists the catalogue and runs a query by id."""

from __future__ import annotations

import pytest

from hydrostar.__main__ import main
from hydrostar.plans import catalog
from hydrostar.plans.derived import DERIVED_ON
from tests.conftest import SF001


def test_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "Q10_monthly_evolution" in out and "page temporal" in out


def test_run_fixture_query(spark, capsys):
    assert main(["run", "Q11_kpi_summary", "--fixture", SF001]) == 0
    out = capsys.readouterr().out
    assert "Estados Monitorados" in out and "6000" in out


def test_run_derived_on_tables(spark, capsys):
    assert main(["run", "P3", "--fixture", SF001]) == 0
    assert "plants_text" in capsys.readouterr().out


def _rows(out: str) -> int:
    return len(out.strip().splitlines()) - 1


def test_parameters_reach_derived_results_and_their_base(spark, capsys):
    args = ["--fixture", SF001]
    assert main(["run", "P1", *args, "--param", "k=2"]) == 0
    assert _rows(capsys.readouterr().out) == 2
    assert main(["run", "P20", *args, "--param", "year=1997", "--param", "min_measurements=1"]) == 0
    assert _rows(capsys.readouterr().out) == 5
    assert main(["page", "temporal", *args, "--param", "year=1997", "--param", "min_measurements=1"]) == 0
    out = capsys.readouterr().out
    assert "== P24d" in out and "== P22b" in out and "AFRICA" in out


def test_all_rows_unless_limited(spark, capsys):
    args = ["run", "Q10", "--fixture", SF001, "--param", "year=1997", "--param", "min_measurements=1"]
    assert main(args) == 0
    assert _rows(capsys.readouterr().out) == 60
    assert main([*args, "--rows", "7"]) == 0
    assert _rows(capsys.readouterr().out) == 7


def test_unknown_parameters_and_targets_are_errors(spark):
    for args in (
        ["run", "P1", "--param", "year=1997"],
        ["page", "temporal", "--param", "k=3"],
        ["run", "Q10_monthly_evolution", "--param", "year=1997"],
        ["run", "Q99"],
        ["page", "nowhere"],
    ):
        with pytest.raises(SystemExit):
            main([*args, "--fixture", SF001])


def test_every_result_is_reachable():
    for rid in [*catalog.SQ, *DERIVED_ON]:
        assert catalog.result_id(rid) == rid
