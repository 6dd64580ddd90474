"""Ordered sets of draws applied to a table of rows, and their dependencies."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.functions.draws import (
    Draw, by_value, clipped_normal, copy_of, expression, fixed, power, product, times, total, uniform,
)
from brickwork.functions.rng import Keyed
from brickwork.functions.text import derive
from brickwork.session import partitions_for


@dataclass(frozen=True)
class PriorSet:
    """Features and their draws, in declaration order."""

    draws: Mapping[str, Draw] = field(default_factory=dict)

    @property
    def reads(self) -> frozenset[str]:
        return frozenset(r for d in self.draws.values() for r in d.reads)

    def graph(self) -> dict[str, set[str]]:
        """Feature -> features computed directly from it; every feature is a node."""
        edges: dict[str, set[str]] = {f: set() for f in self.draws}
        for feature, draw in self.draws.items():
            for source in draw.reads:
                edges.setdefault(source, set()).add(feature)
        return edges

    def roots(self) -> set[str]:
        """Nodes that depend on nothing."""
        return {n for n in self.graph() if n not in self.draws or not self.draws[n].reads}

    def downstream(self, changed: Iterable[str], resample_changed: bool = True) -> PriorSet:
        """The subset that must be drawn again after ``changed`` features moved."""
        edges, reached = self.graph(), set()
        frontier = [c for c in changed if c in edges]
        start = set(frontier)
        while frontier:
            for nxt in edges.get(frontier.pop(), ()):
                if nxt not in reached:
                    reached.add(nxt)
                    frontier.append(nxt)
        if resample_changed:
            reached |= start
        return PriorSet({f: d for f, d in self.draws.items() if f in reached})

    def layers(self) -> list[list[str]]:
        """Groups of features that can share one projection."""
        level: dict[str, int] = {}
        readers: dict[str, int] = {}
        for feature, draw in self.draws.items():
            own = max(
                [level[r] + 1 for r in draw.reads if r in level]
                + [readers.get(feature, 0), 0]
            )
            level[feature] = own
            for r in draw.reads:
                readers[r] = max(readers.get(r, 0), own)
        out: list[list[str]] = [[] for _ in range(max(level.values(), default=-1) + 1)]
        for feature, n in level.items():
            out[n].append(feature)
        return out

    def apply(self, df: DataFrame, keyed: Keyed) -> DataFrame:
        """Add or overwrite every feature: one projection per dependency layer."""
        missing = self.reads - set(df.columns) - set(self.draws)
        if missing:
            raise ValueError(f"features not available: {sorted(missing)}")
        for layer in self.layers():
            df = derive(df, {f: self.draws[f].sql(f, keyed) for f in layer})
        return df

    def null_report(self, df: DataFrame) -> DataFrame:
        """One row per feature that some row left unmatched."""
        counts = df.selectExpr(*[f"count_if(`{f}` IS NULL) AS `{f}`" for f in self.draws])
        pairs = ", ".join(f"struct('{f}' AS feature, `{f}` AS n_null)" for f in self.draws)
        return counts.selectExpr(f"inline(array({pairs}))").filter("n_null > 0")


DRAWS_PER_TASK = 250_000


def expand_samples(
    df: DataFrame, n: int, key: str = "building_id", name: str = "sample_id"
) -> DataFrame:
    """Repeat every row ``n`` times with its draw number.

    The small base table is hash-partitioned by ``key`` before the expansion, so
    all draws of a building are born in one partition and later aggregation by
    ``key`` finds its distribution already satisfied: n rows per building are
    never shuffled.  The number of partitions follows from the rows to be made,
    which keeps few enough buildings per task for their percentiles to be
    aggregated without sorting.
    """
    spark = df.sparkSession
    parts = max(partitions_for(spark), -(-df.count() * n // DRAWS_PER_TASK))
    return df.repartition(parts, key).withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _yes_no(yes: float, no: float, feature: str) -> Draw:
    return by_value(feature, {"Yes": fixed(yes), "No": fixed(no)})


def default_priors(area: str = "area_m2") -> PriorSet:
    """The stock prior set of a residential retrofit study."""
    short, long_, floors = "geometry__short_edge", "geometry__long_edge", "geometry__num_floors"
    attic, base = "extra_spaces__attic", "extra_spaces__basement"
    heating, cooling, dhw = "semantic__Heating", "semantic__Cooling", "semantic__DHW"
    sys_ = "factors__system"
    computed = "geometry__computed__"
    # Distribution parameters of each feature.
    heat_cop = {
        "ElectricResistance": (0.95, 0.99), "OilHeating": (0.63, 0.92),
        "NaturalGasHeating": (0.60, 0.925), "NaturalGasCondensingHeating": (0.60, 0.925),
        "ASHPHeating": (2.1, 4.2), "GSHPHeating": (2.9, 4.8),
    }
    heat_fuel = {
        "ElectricResistance": "Electricity", "OilHeating": "Oil",
        "NaturalGasHeating": "NaturalGas", "NaturalGasCondensingHeating": "NaturalGas",
        "ASHPHeating": "Electricity", "GSHPHeating": "Electricity",
    }
    distribution = {
        "Steam": (0.5, 0.8), "HotWaterUninsulated": (0.73, 0.86),
        "AirDuctsUninsulated": (0.7, 0.8), "AirDuctsConditionedUninsulated": (0.85, 0.9),
        "HotWaterInsulated": (0.86, 0.9), "AirDuctsInsulated": (0.8, 0.9),
    }
    cool_cop = {
        "ACWindow": (2.0, 3.5), "ACCentral": (2.5, 3.8), "WindowASHP": (3.0, 4.0),
        "ASHPCooling": (3.2, 4.5), "GSHPCooling": (3.8, 5.0),
    }
    cool_is_distributed = {
        "none": False, "ACWindow": False, "ACCentral": True, "WindowASHP": False,
        "ASHPCooling": True, "GSHPCooling": True,
    }
    dhw_cop = {
        "ElectricResistanceDHW": (0.95, 0.99), "NaturalGasDHW": (0.55, 0.8),
        "NaturalGasHeatingDHWCombo": (0.8, 0.95), "HPWH": (2.2, 3.5),
    }
    dhw_fuel = {
        "ElectricResistanceDHW": "Electricity", "NaturalGasDHW": "NaturalGas",
        "NaturalGasHeatingDHWCombo": "NaturalGas", "HPWH": "Electricity",
    }
    floor_height = {
        "pre_1975": (2.5001, 2.75), "btw_1975_2003": (2.6, 3.05), "post_2003": (2.6, 3.05),
    }
    solar_coverage = {
        "LowSolarPV": 0.25, "MedSolarPV": 0.5, "MaxSolarPV": 1.0, "NoSolarPV": 0.0,
        "ExistingSolarPV": 0.0,
    }
    prices = {
        "NaturalGas": (0.07, 0.011, 0.03, 0.09), "Electricity": (0.312, 0.02, 0.143, 0.4013),
        "Oil": (0.102, 0.024, 0.07, 0.13),
    }
    emissions = {
        "Electricity": (0.000298, 0.0000155, 0.0001, 0.0005),
        "NaturalGas": (0.000244, 0.0000122, 0.000176, 0.0003),
        "Oil": (0.000267, 0.000003, 0.0002, 0.0003),
    }
    no_cooling_cop = 999999999999.0

    def ranges(feature: str, table: Mapping[str, tuple[float, float]]) -> Draw:
        return by_value(feature, {k: uniform(*v) for k, v in table.items()})

    def levels(feature: str, table: Mapping[str, object]) -> Draw:
        return by_value(feature, {k: fixed(v) for k, v in table.items()})

    p: dict[str, Draw] = {
        "geometry__exposed_basement_frac": clipped_normal(0.25, 0.05, 0.1, 0.45),
        "geometry__wwr": clipped_normal(0.14, 0.0125, 0.1001, 0.2999),
        "geometry__f2f_height": ranges("semantic__Age_bracket", floor_height),
        "geometry__est_actual_footprint_area": expression(f"{area} / {floors}", area, floors),
        "geometry__est_fp_ratio": expression(
            f"{area} / {floors} / ({short} * {long_})", area, floors, short, long_
        ),
        "geometry__est_uniform_linear_scaling_factor": power("geometry__est_fp_ratio", 0.5),
        computed + "half_perimeter": total(short, long_),
        computed + "perimeter": times(computed + "half_perimeter", 2),
        computed + "single_floor_facade_area": product(computed + "perimeter", "geometry__f2f_height"),
        computed + "whole_bldg_facade_area": product(computed + "single_floor_facade_area", floors),
        computed + "total_linear_facade_distance": product(computed + "perimeter", floors),
        computed + "window_area": product(computed + "whole_bldg_facade_area", "geometry__wwr"),
        computed + "footprint_area": product(short, long_),
        "geometry__roof_is_attic__num": _yes_no(1, 0, f"{attic}__exists"),
        "geometry__roof_is_flat__num": _yes_no(0, 1, f"{attic}__exists"),
        f"{attic}__occupied__num": _yes_no(1, 0, f"{attic}__occupied"),
        f"{attic}__conditioned__num": _yes_no(1, 0, f"{attic}__conditioned"),
        f"{attic}__pitch__type__num": total(f"{attic}__occupied__num", f"{attic}__conditioned__num"),
        f"{attic}__pitch__if_exists": by_value(
            f"{attic}__pitch__type__num", {0: uniform(4 / 12, 6 / 12)}, uniform(6 / 12, 9 / 12)
        ),
        f"{attic}__pitch": by_value(
            f"{attic}__exists", {"Yes": copy_of(f"{attic}__pitch__if_exists"), "No": fixed(0)}
        ),
        f"{attic}__run": times(short, 0.5),
        "geometry__attic_height": product(f"{attic}__pitch", f"{attic}__run"),
        computed + "attic_hypotenuse_a2": power("geometry__attic_height", 2),
        computed + "attic_hypotenuse_b2": power(f"{attic}__run", 2),
        computed + "attic_hypotenuse_c2": total(
            computed + "attic_hypotenuse_a2", computed + "attic_hypotenuse_b2"
        ),
        computed + "attic_hypotenuse": power(computed + "attic_hypotenuse_c2", 0.5),
        computed + "half_roof_surface_area": product(computed + "attic_hypotenuse", long_),
        computed + "roof_surface_area": times(computed + "half_roof_surface_area", 2),
        f"{base}__exists__num": _yes_no(1, 0, f"{base}__exists"),
        f"{base}__occupied__num": _yes_no(1, 0, f"{base}__occupied"),
        f"{base}__not_occupied__num": _yes_no(0, 1, f"{base}__occupied"),
    }
    for space in (attic, base):
        p[f"{space}__use_fraction"] = by_value(
            f"{space}__occupied", {"Yes": uniform(0.2, 0.4), "No": fixed(0)}
        )
    p |= {
        f"{sys_}__heat__cop": ranges(heating, heat_cop),
        f"{sys_}__heat__distribution": ranges("semantic__Distribution", distribution),
        f"{sys_}__heat__fuel": levels(heating, heat_fuel),
        f"{sys_}__cool__cop": by_value(
            cooling,
            {"none": fixed(no_cooling_cop), **{k: uniform(*v) for k, v in cool_cop.items()}},
        ),
        f"{sys_}__cool__is_distributed": levels(cooling, cool_is_distributed),
        f"{sys_}__cool__distribution": by_value(
            f"{sys_}__cool__is_distributed",
            {True: copy_of(f"{sys_}__heat__distribution"), False: fixed(1)},
        ),
        f"{sys_}__cool__fuel": fixed("Electricity"),
        f"{sys_}__dhw__cop": ranges(dhw, dhw_cop),
        f"{sys_}__dhw__distribution": copy_of(f"{sys_}__heat__distribution"),
        f"{sys_}__dhw__fuel": levels(dhw, dhw_fuel),
    }
    for part in ("heat", "cool", "dhw"):
        p[f"{sys_}__{part}__effective_cop"] = product(
            f"{sys_}__{part}__cop", f"{sys_}__{part}__distribution"
        )
    p |= {f"fuels__price__{f}": clipped_normal(*v) for f, v in prices.items()}
    p |= {f"fuels__emissions__{f}": clipped_normal(*v) for f, v in emissions.items()}
    p |= solar_priors(solar_coverage)
    return PriorSet(p)


def solar_priors(coverage: Mapping[str, float]) -> dict[str, Draw]:
    # Photovoltaic parameters.
    return {
        "solar__yield_kWh_per_kW_year": clipped_normal(1100, 150, 800, 1400),
        "solar__panel_power_density_w_per_m2": clipped_normal(180, 50, 120, 300),
        "solar__upgraded_coverage": by_value(
            "semantic__OnsiteSolar", {k: fixed(v) for k, v in coverage.items()}
        ),
        "solar__max_roof_utilization": clipped_normal(0.75, 0.05, 0.6, 0.9),
    }


def add_solar_defaults(df: DataFrame, keyed: Keyed) -> DataFrame:
    """Solar features only where the table does not carry them yet."""
    if "semantic__OnsiteSolar" not in df.columns:
        df = df.withColumn("semantic__OnsiteSolar", F.lit("NoSolarPV"))
    pack = {f: d for f, d in default_priors().draws.items() if f.startswith("solar__")}
    absent = PriorSet({f: d for f, d in pack.items() if f not in df.columns})
    return absent.apply(df, keyed).withColumn("upgrade__solar_pv_kW", F.lit(0.0))
