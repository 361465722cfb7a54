"""Fixed values, tunables and schemas shared by all operators.

Canonical forms (a collection of tables is one DataFrame; every key begins with the table):

    cells       table_id string, row_idx int, col_idx int, value string      '' is missing, never null
    typing      value string, labels array<string>, dtypes array<string>     one row for each distinct value
    kg_edges    subject string, pid string, backward boolean, object string, tag string, ord int
    kg_nodes    entity string, labels array<string>, aliases array<string>, descriptions array<string>, num_edges long
    label_index label_id long, entity string, label string, length int, origin string, pr double
"""

from __future__ import annotations

from dataclasses import dataclass

CELLS = "table_id string, row_idx int, col_idx int, value string"

# Labels of named entities.
CONCEPTS = ["EVENT", "FAC", "GPE", "LAW", "LOC", "NORP", "ORG", "PERSON", "PRODUCT", "WORK_OF_ART", "LANGUAGE", "UNKNOWN"]

# Labels that make a column an entity column, and number labels without a unit.
ENTITY_LABELS = ["UNKNOWN", "PERSON", "ORG", "FAC", "GPE", "LANGUAGE", "LAW", "LOC", "NORP", "PRODUCT", "WORK_OF_ART", "EVENT"]
PLAIN_NUMBERS = ["CARDINAL", "QUANTITY", "ORDINAL"]

# Labels of numbers with a unit.
UNIT_LABELS = [
    "PERCENT", "DISTANCE", "MASS", "MONEY", "DURATION", "TEMPERATURE", "CHARGE", "ANGLE", "DATA STORAGE", "AMOUNT OF SUBSTANCE",
    "CATALYTIC ACTIVITY", "AREA", "VOLUME", "VOLUME (LUMBER)", "FORCE", "PRESSURE", "ENERGY", "POWER", "SPEED", "ACCELERATION",
    "FUEL ECONOMY", "FUEL CONSUMPTION", "ANGULAR SPEED", "ANGULAR ACCELERATION", "DENSITY", "SPECIFIC VOLUME", "MOMENT OF INERTIA",
    "TORQUE", "THERMAL RESISTANCE", "THERMAL CONDUCTIVITY", "SPECIFIC HEAT CAPACITY", "VOLUMETRIC FLOW", "MASS FLOW",
    "CONCENTRATION", "DYNAMIC VISCOSITY", "KINEMATIC VISCOSITY", "FLUIDITY", "SURFACE TENSION", "PERMEABILITY", "SOUND LEVEL",
    "LUMINOUS INTENSITY", "LUMINOUS FLUX", "ILLUMINANCE", "LUMINANCE", "TYPOGRAPHICAL ELEMENT", "IMAGE RESOLUTION", "FREQUENCY",
    "INSTANCE FREQUENCY", "FLUX DENSITY", "LINEAR MASS DENSITY", "LINEAR CHARGE DENSITY", "SURFACE CHARGE DENSITY", "CHARGE DENSITY",
    "CURRENT", "LINEAR CURRENT DENSITY", "SURFACE CURRENT DENSITY", "ELECTRIC POTENTIAL", "ELECTRIC FIELD", "ELECTRICAL RESISTANCE",
    "ELECTRICAL RESISTIVITY", "ELECTRICAL CONDUCTANCE", "ELECTRICAL CONDUCTIVITY", "CAPACITANCE", "INDUCTANCE", "MAGNETIC FLUX",
    "RELUCTANCE", "MAGNETOMOTIVE FORCE", "MAGNETIC FIELD", "IRRADIANCE", "RADIATION ABSORBED DOSE", "RADIOACTIVITY",
    "RADIATION EXPOSURE", "RADIATION", "DATA TRANSFER RATE",
]

# Properties of the public knowledge graph that are transitive, that type an entity, and its class tree.
TRANSITIVE = ["P131", "P276", "P279", "P361", "P403", "P460", "P527", "P706", "P927", "P1647", "P2094", "P3373", "P3403", "P5607", "P5973", "P171"]
TYPE_PROPERTIES = ["P106", "P39", "P105"]
INSTANCE_OF = "P31"
SUBCLASS_OF = "P279"
UNIT_SYMBOL = "P5061"
CURRENCY_CLASS = "Q8142"
DIFFERENT_FROM = "P1889"

# Currencies in dollars.
CURRENCIES = {
    "dollar": 1.0, "euro": 1.1, "japanese_yen": 0.0082, "chinese_yuan": 0.16, "renminbi": 0.16, "pound_sterling": 1.32,
    "south_korean_won": 0.00082, "russian_ruble": 0.01, "australian_dollar": 0.75,
}


@dataclass(frozen=True)
class LookupConfig:
    """Tunables of the lookup. The defaults are fixed values: results depend on them."""

    ratio_min: float = 0.70
    ratio_gap: float = 0.25
    main_alias: float = 0.94
    sub_alias: float = 0.88
    page_rank: float = 0.10
    bm25: float = 0.20
    length_min: float = 0.25
    length_max: float = 4.0
    length_diff: int = 4
    max_hits: int | None = None  # no cut of hits unless one is asked for
    k1: float = 1.2
    b: float = 0.75

    @property
    def fuzzy(self) -> float:
        return 1 - self.page_rank - self.bm25


@dataclass(frozen=True)
class AnnotateConfig:
    """Tunables of the annotation. The defaults are fixed values: results depend on them."""

    top_k: int = 20
    entity_weight: float = 1.0
    literal_weight: float = 0.3
    level_weights: tuple[float, float, float] = (1.0, 0.7, 0.2)
    min_coverage: float = 0.3
    soft: bool = True
