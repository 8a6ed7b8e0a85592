"""Names and fixed values shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a panel.

    ``index`` orders the periods (``fiscal year * 4 + quarter``); ``period`` is
    the display label derived from it.
    """

    site: str = "orgunituid"
    owner: str = "mech_code"
    group: str = "fundingagency"
    unit: str = "operatingunit"
    period: str = "period"
    index: str = "period_idx"
    value: str = "value"
    stock: str = "tx_curr"
    org: tuple[str, ...] = ("operatingunit", "countryname", "snu1", "psnu", "facility")
    owner_attrs: tuple[str, ...] = ("mech_name", "primepartner")

    @property
    def key(self) -> list[str]:
        return [self.site, self.owner, self.index]

    @property
    def metadata(self) -> list[str]:
        return [*self.org, self.group, *self.owner_attrs]


@dataclass(frozen=True)
class EndLabels:
    # The four kinds of ending, as the published tables spell them.
    out: str = "Transition out of PEPFAR"
    consolidate: str = "Consolidate multi-mechanism site"
    agency: str = "Transition to other agency"
    owner: str = "Transition to other mechanism"


# Names of the net-change methods.
STANDARD = "standard"
ADJUSTED = "adjusted"
NO_STOCK = "no TX_CURR reported"

# How the wide fiscal table names stock and denominator.
STOCK_ROWS = ("TX_CURR", "Total Numerator")
DENOMINATOR_ROWS = ("TX_PVLS", "Total Denominator")

# Pseudo owners that hold de-duplication corrections, and their agency.
PSEUDO_OWNERS = ("00000", "00001")
DEDUP_AGENCY = "Dedupe adjustments Agency"

# Display names used in the reports.
UNIT_NAMES = {
    "Democratic Republic of the Congo": "DRC",
    "Western Hemisphere Region": "WHR",
}
AGENCY_NAMES = {"HHS/CDC": "CDC"}

FLAG_COLUMNS = [
    "flag_loneobs",
    "flag_multimech_site",
    "last_obs_site",
    "last_obs_sitexmech",
    "flag_end_sitexmech",
    "end_type",
    "agency_exiting",
    "agency_inheriting",
    "method",
    "vlc_valid",
]

DEFAULT_SPEC = PanelSpec()
