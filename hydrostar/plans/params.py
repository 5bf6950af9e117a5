"""Default parameters of the queries.

FIXED VALUES: the constants below must equal the surveillance dashboard's
own values for results to match (defaults of the engine's functions).  They
are listed plainly, in the order the dashboard uses them.
"""

from __future__ import annotations

# --- FIXED VALUES (do not edit) -------------------------------------------

# Monitoring purpose of a parameter: LIKE pattern -> purpose; first match wins.
PURPOSE_RULES: tuple[tuple[str, str], ...] = (
    ("%Turbidez%", "Aspecto Físico"),
    ("%Cor%", "Aspecto Físico"),
    ("%Cloro%", "Desinfecção"),
    ("%pH%", "Equilíbrio Químico"),
    ("%Fluoreto%", "Saúde Pública"),
    ("%coli%", "Segurança Microbiológica"),
    ("%Coliforme%", "Segurança Microbiológica"),
)
PURPOSE_DEFAULT = "Outros Indicadores"

# Sort rank of a parameter (a different list from the purposes).
PURPOSE_SORT_RULES: tuple[tuple[str, int], ...] = (
    ("%Turbidez%", 1),
    ("%Cloro%", 2),
    ("%pH%", 3),
    ("%coli%", 4),
)
PURPOSE_SORT_DEFAULT = 5

# Value bands analysed per parameter: (parameter name, band name).
BAND_PAIRS: tuple[tuple[str, str], ...] = (
    ("Cloro Residual Livre (mg/L)", "Número de dados >= 2,0 mg/L e <= 5,0mg/L"),
    ("Cloro Residual Livre (mg/L)", "Número de dados < 0,2 mg/L"),
    ("Cloro Residual Livre (mg/L)", "Número de dados > 5,0 mg/L"),
    ("Cor (uH)", "Número de dados <= 15,0 uH"),
    ("Cor (uH)", "Número de dados > 15,0 uH"),
    ("pH", "Número de dados >= 6,0 e <= 9,0"),
    ("pH", "Número de dados < 6,0"),
    ("pH", "Número de dados > 9,0"),
)

# HAVING thresholds and the analysed year.
MIN_INSTITUTION_MEASUREMENTS = 1000  # records > this
MIN_BAND_RECORDS = 10  # records >= this
MIN_RANKED_PLANTS = 5  # plants >= this
MONTHLY_YEAR = 2025
MIN_MONTHLY_MEASUREMENTS = 100  # records >= this

# Period of the year by month: month <= 2, month <= 4, else (NULL included).
PERIOD_BOUNDS: tuple[int, ...] = (2, 4)
PERIOD_LABELS: tuple[str, ...] = ("Início do Ano", "Meio do Ano", "Segundo Semestre")

# Headline metrics, in display order.
KPI_NAMES: tuple[str, ...] = (
    "Estados Monitorados",
    "ETAs Ativas",
    "Total de Medições",
    "Parâmetros Monitorados",
    "Municípios Atendidos",
)

# Presentation: "all" entries of the two selectors, unit text for 'None',
# label widths and top-k sizes.
ALL_FILTRATIONS = "Todas"
ALL_PARAMETERS = "Todos"
UNIT_NONE_TEXT = "None"
UNIT_QUALITATIVE = "Qualitativo"
FILTRATION_LABEL_WIDTH = 20
POINT_LABEL_WIDTH = 25
TOP_STATES = 10
TOP_PARAMETERS = 10
TOP_RANKED_STATES = 15

# --- end of fixed values ----------------------------------------------------
