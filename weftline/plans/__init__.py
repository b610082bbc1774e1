"""Registered queries, composed of the operators."""

from . import extras, files, filings, forecasts, panels, series, verdicts, wide
