"""Panel analytics on Spark DataFrames.

A panel has one row per site, owner and fiscal quarter and holds a reported
stock.  The operators flag owner changes, compute net change per owner and per
site, attribute transfers and compute lagged coverage ratios.
"""

from panelwise.spec import DEFAULT_SPEC, EndLabels, PanelSpec

__all__ = ["DEFAULT_SPEC", "EndLabels", "PanelSpec"]
