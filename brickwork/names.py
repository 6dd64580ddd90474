"""Fixed vocabulary of the study: segments, fuels, brackets, feature names.

Feature columns are named with double underscores (``semantic__Heating``);
:func:`dotted` gives the public ``feature.semantic.Heating`` form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Result vocabulary.
RAW_END_USES = ("Lighting", "Equipment", "DomesticHotWater", "Heating", "Cooling")
END_USES = (*RAW_END_USES, "Solar")
FUELS = ("Oil", "NaturalGas", "Electricity", "NetElectricity")
SEGMENTS = {
    "Raw": RAW_END_USES,
    "EndUse": END_USES,
    "Fuel": FUELS,
    "EndUseCost": END_USES,
    "EndUseEmissions": END_USES,
    "FuelCost": FUELS,
    "FuelEmissions": FUELS,
}
NORMALIZATIONS = ("Normalized", "Gross")
UNITS = {
    "Raw": "kWh",
    "EndUse": "kWh",
    "Fuel": "kWh",
    "EndUseCost": "USD",
    "EndUseEmissions": "tCO2e",
    "FuelCost": "USD",
    "FuelEmissions": "tCO2e",
}
UNITS_PER = {"Normalized": "/m2", "Gross": ""}
INCOME_BRACKETS = ("IncomeEligible", "AllCustomers")
GAS_HEATING = ("NaturalGasHeating", "NaturalGasCondensingHeating")
OIL_HEATING = ("OilHeating",)
COOLING_SYSTEMS = ("ACWindow", "ACCentral", "WindowASHP", "ASHPCooling", "GSHPCooling")
UPGRADED_SOLAR = ("LowSolarPV", "MedSolarPV", "MaxSolarPV")
WINDOW_UPGRADES = ("DoublePaneLowE", "TriplePaneLowE")
WALL_UPGRADES = ("FullInsulationWallsCavity", "FullInsulationWallsCavityExterior")
COUNTIES = (
    "Berkshire", "Barnstable", "Bristol", "Dukes", "Essex", "Franklin", "Hampden",
    "Hampshire", "Middlesex", "Nantucket", "Norfolk", "Plymouth", "Suffolk", "Worcester",
)
EXTRA_SPACE_STATUS = (
    "none", "unoccupied_unconditioned", "unoccupied_conditioned",
    "occupied_unconditioned", "occupied_conditioned",
)
HEATING_SIZES_KW = (5.3, 7.0, 8.8, 10.5, 12.3, 14.1, 17.6, 21.1, 24.6, 28.1, 31.6)
DAYS_PER_MONTH = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
# Options of the semantic fields.
SEMANTIC_OPTIONS = {
    "DHW": ("ElectricResistanceDHW", "HPWH", "NaturalGasDHW", "NaturalGasHeatingDHWCombo"),
    "Walls": (
        "FullInsulationWallsCavity", "FullInsulationWallsCavityExterior", "SIP",
        "SomeInsulationWalls", "UninsulatedWalls",
    ),
    "Region": ("MA",),
    "Cooling": ("ACCentral", "ACWindow", "ASHPCooling", "GSHPCooling", "WindowASHP"),
    "Heating": (
        "ASHPHeating", "ElectricResistance", "GSHPHeating", "NaturalGasCondensingHeating",
        "NaturalGasHeating", "OilHeating",
    ),
    "Windows": ("DoublePaneLowE", "SinglePane", "SinglePaneStormWindows", "TriplePaneLowE"),
    "Lighting": ("LED", "NoLED"),
    "Typology": ("MFH", "SFH"),
    "Equipment": ("HighEfficiencyEquipment", "LowEfficiencyEquipment"),
    "Thermostat": ("Controls", "NoControls"),
    "Age_bracket": ("btw_1975_2003", "post_2003", "pre_1975"),
    "Distribution": (
        "AirDuctsConditionedUninsulated", "AirDuctsInsulated", "AirDuctsUninsulated",
        "HotWaterInsulated", "HotWaterUninsulated", "Steam",
    ),
    "RoofInsulation": ("HighlyInsulatedRoof", "InsulatedRoof", "UninsulatedRoof"),
    "Weatherization": ("LeakyEnvelope", "SomewhatLeakyEnvelope", "TightEnvelope"),
    "AtticVentilation": ("UnventilatedAttic", "VentilatedAttic"),
    "AtticFloorInsulation": ("HighlyInsulated", "Insulated", "NoInsulation"),
    "GroundSlabInsulation": ("InsulatedGroundSlab", "UninsulatedGroundSlab"),
    "BasementWallsInsulation": ("InsulatedWalls", "UninsulatedWalls"),
    "BasementCeilingInsulation": ("InsulatedCeiling", "UninsulatedCeiling"),
}


def dotted(name: str) -> str:
    return "feature." + name.replace("__", ".")


def plain(name: str) -> str:
    return name.removeprefix("feature.").replace(".", "__")


def expose_dotted(df: DataFrame) -> DataFrame:
    """Feature columns under their public dotted names."""
    return df.withColumnsRenamed({c: dotted(c) for c in df.columns if "__" in c})


def feature_columns(df: DataFrame) -> DataFrame:
    """Only the feature columns, in either naming."""
    keep = [c for c in df.columns if c.startswith("feature.") or "__" in c]
    return df.select(*[F.col(f"`{c}`") for c in keep])
