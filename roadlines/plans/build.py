"""The batch pipeline: raw tables -> normal form -> chain bins, one table per step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from roadlines.config import BIN_SIZES_KM, ColumnMap, require_map
from roadlines.operators.accidents import locate_accidents, stage_accidents
from roadlines.operators.chain import (
    accident_chainage, build_chain, canonical_segments, chain_total,
)
from roadlines.operators.filters import target_subset
from roadlines.operators.roads import build_points, build_roads
from roadlines.plans.chain_bins import chain_bin_cube, chain_bins, grid_of
from roadlines.plans.validate import require_same_count, require_segments
from roadlines.sources.ingest import write_table


def normalize(spark: SparkSession, cmap: ColumnMap) -> None:
    """roads_norm, road_points_norm, accidents_staging, accidents_norm and the target subsets.

    Every step reads the table written before it, so that a lost executor costs one step.
    """
    require_map(cmap)
    raw = spark.table("raw_bron_accidents")
    write_table(build_roads(spark.table("raw_nwb_wegvakken"),
                            spark.table("raw_nwb_wegvakgeografie"), cmap),
                "roads_norm", ["road_number_norm", "wegvak_id"])
    roads = spark.table("roads_norm")
    write_table(target_subset(roads), "roads_a2_norm")
    write_table(build_points(spark.table("raw_nwb_puntlocaties"),
                             spark.table("raw_nwb_hectopunten"), roads, cmap), "road_points_norm")
    write_table(stage_accidents(raw, cmap), "accidents_staging")
    located = locate_accidents(spark.table("accidents_staging"), roads,
                               spark.table("road_points_norm"), casualties=True)
    write_table(located, "accidents_norm", ["road_number_norm", "accident_id"])
    accidents = spark.table("accidents_norm")
    write_table(target_subset(accidents), "accidents_a2_norm")
    require_same_count(raw, accidents)


def build_bins(spark: SparkSession, road: str | None = None,
               sizes: Sequence[int] = BIN_SIZES_KM) -> None:
    """Chain, chainage, bins and bin cube of one road, or of all roads."""
    roads: DataFrame = spark.table("roads_norm")
    if road is not None:
        roads = target_subset(roads, road)
    require_segments(roads)
    suffix = "a2" if road == "A2" else "all" if road is None else road.lower()
    write_table(build_chain(roads), f"{suffix}_chain")
    chain = spark.table(f"{suffix}_chain")
    write_table(canonical_segments(roads, chain), f"{suffix}_wegvak_map")
    write_table(chain_total(chain), f"{suffix}_total")
    accidents = spark.table("accidents_norm")
    if road is not None:
        accidents = target_subset(accidents, road)
    write_table(accident_chainage(accidents, roads, chain, spark.table(f"{suffix}_wegvak_map")),
                f"accidents_{suffix}_chainage")
    write_table(chain_bins(chain, sizes), f"road_bins_{suffix}")
    write_table(chain_bin_cube(spark.table(f"accidents_{suffix}_chainage"), grid_of(chain, sizes)),
                f"accident_bin_counts_{suffix}")
