"""hydrostar: water-quality surveillance analytics on Spark.

A snowflake schema of ten tables (region, state, municipality, office,
institution, plant, point, parameter, band, measurement), eleven
parameterised star-join aggregates (``plans.base``) and the derived results
built on them (``plans.derived``).  Everything is expressed with the
DataFrame API and built-in functions so that Catalyst and adaptive query
execution do the planning.
"""

from hydrostar.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
