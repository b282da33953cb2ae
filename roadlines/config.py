"""Driver-side configuration: column roles, roads, bin sizes and argument checks."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from typing import Any

# They must equal the published configuration for results to match.
TARGET_ROAD = "A2"
ROADS = (
    "A1", "A2", "A4", "A5", "A6", "A7", "A8", "A9", "A10", "A12",
    "A13", "A15", "A16", "A17", "A18", "A20", "A22", "A24", "A27", "A28",
    "A29", "A30", "A31", "A32", "A35", "A37", "A38", "A44", "A50", "A58",
    "A59", "A65", "A67", "A73", "A74", "A76", "A77", "A79", "A200", "A325",
)
BIN_SIZES_KM = (1, 2, 5, 10, 20)
DEFAULT_BIN_SIZE_KM = 1
MAX_ACCIDENT_POINTS = 10_000
YEARS = (2015, 2024)
MAIN_CARRIAGEWAY = "HR"
GEOMETRY_DIRECTION = "H"
DIRECTIONS = ("H", "T")
HM_PER_KM = 10.0
RD_X_RANGE = (10_000.0, 280_000.0)
RD_Y_RANGE = (300_000.0, 620_000.0)
ALLOWED_RAW = ("A2", "002", "2", "02")
ALLOWED_TYPES = ("R", "A")
ROUTE_LETTERS = ("A",)
# End of fixed values.


class NotImplementedRoad(ValueError):
    """The road is valid text but is not in the configured list."""


@dataclass(frozen=True)
class SegmentColumns:
    id_col: str | None = "WVK_ID"
    road_number_col: str | None = "WEGNR_HMP"
    road_type_col: str | None = "WEGBEHSRT"
    road_number_alt_col: str | None = "WEGNUMMER"
    route_letter_col: str | None = "ROUTELTR"
    route_number_col: str | None = "ROUTENR"
    from_hm_col: str | None = "KLOK_BEG"
    to_hm_col: str | None = "KLOK_END"
    direction_col: str | None = "RIJRICHTNG"
    carriageway_col: str | None = "BST_CODE"
    fk_col: str | None = "FK_VELD1"
    path: str | None = None


@dataclass(frozen=True)
class GeometryColumns:
    id_col: str | None = "FK_VELD1"
    join_col: str | None = "FK_VELD1"
    geometry_col: str | None = "geom"
    path: str | None = None


@dataclass(frozen=True)
class PointColumns:
    point_id_col: str | None = "FK_VELD5"
    wegvak_id_col: str | None = None
    hm_col: str | None = None
    x_col: str | None = "X_COORD"
    y_col: str | None = "Y_COORD"
    path: str | None = None


@dataclass(frozen=True)
class MarkerColumns:
    point_id_col: str | None = "FK_VELD5"
    wegvak_id_col: str | None = "WVK_ID"
    hm_col: str | None = "HECTOMETER"
    distance_col: str | None = "AFSTAND"
    path: str | None = None


@dataclass(frozen=True)
class IntervalColumns:
    wegvak_id_col: str | None = "WVK_ID"
    beg_km_col: str | None = "BEGKM"
    end_km_col: str | None = "ENDKM"
    beg_distance_col: str | None = "BEGAFSTAND"
    end_distance_col: str | None = "ENDAFSTAND"
    path: str | None = None


@dataclass(frozen=True)
class FileOnly:
    id_col: str | None = None
    path: str | None = None


@dataclass(frozen=True)
class AccidentColumns:
    accident_id_col: str | None = "VKL_NUMMER"
    year_col: str | None = "JAAR_VKL"
    date_col: str | None = "DATUM_VKL"
    hour_col: str | None = "UUR"
    severity_col: str | None = "AP3_CODE"
    accident_type_col: str | None = "AOL_ID"
    road_number_col: str | None = None
    road_type_col: str | None = None
    wegvak_id_col: str | None = "WVK_ID"
    puntlocatie_id_col: str | None = "FK_VELD5"
    hm_col: str | None = "HECTOMETER"
    x_col: str | None = None
    y_col: str | None = None
    fatal_count_col: str | None = "ANTL_DOD"
    injury_count_col: str | None = "ANTL_GZH"
    path: str | None = None


@dataclass(frozen=True)
class TargetRules:
    canonical_road_number: str = TARGET_ROAD
    allowed_raw_road_number_values: tuple[str, ...] = ALLOWED_RAW
    allowed_road_type_values: tuple[str, ...] = ALLOWED_TYPES
    route_letter_values: tuple[str, ...] = ROUTE_LETTERS

    @property
    def letter(self) -> str:
        return self.canonical_road_number[:1]

    @property
    def number(self) -> str:
        return self.canonical_road_number[1:]


def _fill(cls: type, values: dict[str, Any] | None) -> Any:
    """Build a role group from a mapping, ignoring keys that carry no role."""
    if values is None:
        return cls()
    known = {f.name for f in fields(cls)}
    kept = {k: (tuple(map(str, v)) if isinstance(v, list) else v)
            for k, v in values.items() if k in known}
    absent = {n: None for n in known - kept.keys()} if cls is not TargetRules else {}
    return cls(**{**absent, **kept})


@dataclass(frozen=True)
class ColumnMap:
    """Which physical column plays which role; None means the role is unset."""

    wegvakken: SegmentColumns = field(default_factory=SegmentColumns)
    wegvakgeografie: GeometryColumns = field(default_factory=GeometryColumns)
    puntlocaties: PointColumns = field(default_factory=PointColumns)
    hectopunten: MarkerColumns = field(default_factory=MarkerColumns)
    hectointervallen: IntervalColumns = field(default_factory=IntervalColumns)
    juncties: FileOnly = field(default_factory=lambda: FileOnly("JTE_ID"))
    junctiehectometrering: FileOnly = field(default_factory=FileOnly)
    accidents: AccidentColumns = field(default_factory=AccidentColumns)
    target: TargetRules = field(default_factory=TargetRules)

    @classmethod
    def from_dict(cls, tree: dict[str, Any]) -> ColumnMap:
        nwb = tree.get("nwb") or {}
        bron = tree.get("bron") or {}
        return cls(
            wegvakken=_fill(SegmentColumns, nwb.get("wegvakken")),
            wegvakgeografie=_fill(GeometryColumns, nwb.get("wegvakgeografie")),
            puntlocaties=_fill(PointColumns, nwb.get("puntlocaties")),
            hectopunten=_fill(MarkerColumns, nwb.get("hectopunten")),
            hectointervallen=_fill(IntervalColumns, nwb.get("hectointervallen")),
            juncties=_fill(FileOnly, nwb.get("juncties")),
            junctiehectometrering=_fill(FileOnly, nwb.get("junctiehectometrering")),
            accidents=_fill(AccidentColumns, bron.get("accidents")),
            target=_fill(TargetRules, tree.get("a2")),
        )


def read_tree(path: str) -> dict[str, Any]:
    """Read a JSON or (when a YAML reader is installed) YAML mapping."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return json.load(handle)
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("YAML files need PyYAML; use JSON instead") from exc
        return yaml.safe_load(handle)


def load_column_map(path: str, generated: str | None = None) -> ColumnMap:
    """Column map from `path`, or from the generated one when `path` is missing."""
    if not os.path.exists(path) and generated:
        path = generated
    return ColumnMap.from_dict(read_tree(path))


@dataclass(frozen=True)
class AppConfig:
    target_road: str = TARGET_ROAD
    roads: tuple[str, ...] = ROADS
    bin_sizes_km: tuple[int, ...] = BIN_SIZES_KM
    max_accident_points: int = MAX_ACCIDENT_POINTS
    years: tuple[int, int] = YEARS
    geometry_direction: str = GEOMETRY_DIRECTION

    @classmethod
    def from_dict(cls, tree: dict[str, Any]) -> AppConfig:
        target = str(tree.get("target_road", TARGET_ROAD)).upper()
        roads = tuple(str(r).upper() for r in tree.get("implemented_roads") or [target])
        return cls(
            target_road=target,
            roads=roads,
            bin_sizes_km=tuple(tree.get("available_bin_sizes_km", BIN_SIZES_KM)),
            max_accident_points=int(tree.get("max_accident_points", MAX_ACCIDENT_POINTS)),
            years=(int(tree.get("initial_year_from", YEARS[0])),
                   int(tree.get("initial_year_to", YEARS[1]))),
            geometry_direction=str(tree.get("geometry_direction", GEOMETRY_DIRECTION)).upper(),
        )


def clean_direction(direction: str | None) -> str | None:
    """None for both directions, else H or T; anything else is an error."""
    if direction is None or direction.lower() in ("", "all"):
        return None
    if direction.upper() not in DIRECTIONS:
        raise ValueError("direction must be H, T, or all")
    return direction.upper()


def check_args(cfg: AppConfig, road: str, size: int | None = None,
               direction: str | None = None) -> tuple[str, int | None, str | None]:
    """Canonical (road, size, direction), or ValueError with the reason."""
    canonical = road.strip().upper()
    if canonical not in cfg.roads:
        raise NotImplementedRoad(
            f"road {canonical} is not implemented; available: {', '.join(cfg.roads)}")
    if size is not None and size not in cfg.bin_sizes_km:
        raise ValueError(f"bin size must be one of {list(cfg.bin_sizes_km)}")
    return canonical, size, clean_direction(direction)


def check_map(cmap: ColumnMap) -> list[str]:
    """Mandatory roles that are not mapped; an empty list means the map is usable."""
    needed = {
        "wegvakken": ("id_col", "road_number_col"),
        "accidents": ("accident_id_col", "year_col", "wegvak_id_col"),
    }
    return [f"{table}.{role} is not set"
            for table, roles in needed.items() for role in roles
            if not getattr(getattr(cmap, table), role)]


def require_map(cmap: ColumnMap) -> None:
    missing = check_map(cmap)
    if missing:
        raise ValueError("column map is incomplete: " + "; ".join(missing))
