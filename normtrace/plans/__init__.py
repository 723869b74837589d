"""Whole plans: the norm side, the scenario side, the report, and the registered queries."""
