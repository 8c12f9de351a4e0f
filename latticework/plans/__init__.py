"""The registered queries of the structure and scoring operators, and their SQL."""

from . import assembly, composed, scoring, statistics, templates

QUERIES = statistics.QUERIES | scoring.QUERIES | assembly.QUERIES | composed.QUERIES | templates.QUERIES
ORACLES = statistics.ORACLES | scoring.ORACLES | assembly.ORACLES | composed.ORACLES | templates.ORACLES
