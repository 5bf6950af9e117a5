"""Parameters bound for the driver's test tables (FIXTURES.md §3).

The engine defaults are the dashboard's values; on the generated tables they
would keep no group (or every group), so the registered queries bind values
under which each HAVING keeps some groups and drops others at sf0.01.
"""

from __future__ import annotations

MIN_INSTITUTION_MEASUREMENTS = 450
MIN_BAND_RECORDS = 55
MIN_RANKED_PLANTS = 600
MONTHLY_YEAR = 1997
MIN_MONTHLY_MEASUREMENTS = 140

# Eight (parameter, band) pairs over three parameter names, as in the
# dashboard's band list.
BAND_PAIRS = (
    ("blue anvil", "A"),
    ("blue anvil", "N"),
    ("blue anvil", "R"),
    ("old bolt", "A"),
    ("old bolt", "R"),
    ("red ring", "A"),
    ("red ring", "N"),
    ("red ring", "R"),
)

# Overlapping rules in mixed case, so that first-match order and the
# case-blind match both decide rows ("red ring" matches two patterns).
PURPOSE_RULES = (
    ("%ANVIL%", "Aspecto Físico"),
    ("%red%", "Desinfecção"),
    ("%ring%", "Equilíbrio Químico"),
    ("%BOLT%", "Saúde Pública"),
)
PURPOSE_SORT_RULES = (
    ("%ring%", 1),
    ("%anvil%", 2),
    ("%Red%", 3),
)

# Choices of the interactive filter (P18): one filtration, every parameter.
CHOSEN_FILTRATION = "1-URGENT"
CHOSEN_PARAMETER = None

# Fewer than the ranked states, so that the top-k cuts some.
TOP_RANKED_STATES = 5

# A year in which, with every month counted, some region has points beyond
# its whiskers.
OUTLIER_YEAR = 1998
OUTLIER_MIN_MEASUREMENTS = 1

# Low thresholds for the smoke run at sf0.001 (defaults keep nothing there).
SMOKE_MIN_MONTHLY_MEASUREMENTS = 1
