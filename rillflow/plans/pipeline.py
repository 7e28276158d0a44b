"""The network extraction as one plan over any number of rasters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TerrainConfig
from ..functions import algebra, stats
from ..operators import flow, network, stencil
from ..operators.graph import stored


@dataclass
class Network:
    """What an extraction gives; tables are lazy over stored stages."""

    layers: DataFrame
    kappa: DataFrame
    starts: DataFrame
    heads: DataFrame
    paths: DataFrame
    reaches: DataFrame
    sections: DataFrame
    banks: DataFrame
    section_map: DataFrame


def edge_threshold(cells: DataFrame, q: float = 0.9, h: float = 1.0, c: str = "z") -> DataFrame:
    """raster_id, kappa: a quantile of the slope, by which diffusion tells edges from noise."""
    return stats.quantiles(stencil.slope(cells, c, h).withColumn("slope", F.abs("slope")), "slope", [q], "m").select("raster_id", F.col("q").alias("kappa"))


def denoise(cells: DataFrame, kappa: DataFrame, config: TerrainConfig, h: float = 1.0) -> DataFrame:
    """Diffusion of z with each raster's own kappa: z over kappa diffused at one, times kappa."""
    x = cells.join(kappa, "raster_id").withColumn("z", F.try_divide("z", "kappa"))
    scaled = x.select("raster_id", "y", "x", "z", "ny", "nx")
    done = stencil.diffuse(scaled, config.diffusion_iterations, 1.0, config.diffusion_step, h, config.diffusion_option, config.precision)
    return done.join(kappa, "raster_id").withColumn("z", F.col("z") * F.col("kappa")).drop("kappa")


def layers(cells: DataFrame, config: TerrainConfig | None = None, h: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The wide table of all layers up to the geodesic cost, and kappa. cells: dense, with ny and nx."""
    config = config or TerrainConfig()
    cells = cells.withColumn("z", algebra.mask_nodata("z", config.nodata, config.nodata_inclusive))
    kappa = stored(edge_threshold(cells, config.smoothing_quantile, h), "kappa")
    smooth = stored(denoise(cells, kappa, config, h), "filtered")
    x = stencil.slope(smooth, "z", h)
    x = stencil.curvature(x, "z", h, config.curvature_method, config.curvature_zero_fill)
    if config.flow_routing == "d8":
        x = flow.d8_direction(x)
    else:
        x = flow.priority_flood(x, accumulate_mfd=config.flow_routing == "mfd")
    x = flow.accumulation(stored(x, "directions"))
    fac = F.col("mfd") if config.flow_routing == "mfd" else F.col("fac").cast("double")
    x = x.withColumn("flow", F.when(F.col("z").isNotNull(), fac))
    x = algebra.with_stats(x, "curv", __m=F.avg("curv"), __s=F.stddev_pop("curv"))
    x = x.withColumn("flow_skel", algebra.single_threshold("flow", config.flow_threshold))
    limit = F.col("__m") + config.curvature_std_factor * F.col("__s")
    x = x.withColumn("curv_skel", algebra.single_threshold("curv", limit)).withColumn("skel", algebra.dual_threshold("curv", "flow", limit, config.flow_threshold))
    x = algebra.prepare_curvature(x.drop("__m", "__s").withColumn("curvature", F.col("curv")), config.normalize_curvature)
    return stored(algebra.local_cost(x, config.cost_expression, config.cost_floor), "layers"), kappa


def extract(cells: DataFrame, config: TerrainConfig | None = None, h: float = 1.0, heads: DataFrame | None = None) -> Network:
    """The whole network. heads: predefined channel heads (raster_id, y, x) instead of those found."""
    config = config or TerrainConfig()
    x, kappa = layers(cells, config, h)
    starts = stored(flow.start_points(x, config.min_basin_percent, config.min_basin_cells), "starts")
    x = stored(network.geodesic(x, starts), "geodesic")
    x = stored(network.label_components(x, "skel", config.connectivity), "labels")
    if heads is None:
        heads = network.channel_heads(x, config.head_box, config.head_histogram_edge, config.null_geodesic_is_head)
    heads = stored(heads, "heads")
    paths = stored(network.paths(x, heads), "paths")
    reaches = stored(network.reaches(paths), "reaches")
    line = reaches.filter("kind = 'reach'")
    sections = stored(network.cross_sections(x, line), "sections")
    banks = stored(network.bank_points(sections, config.right_bank_offset), "banks")
    return Network(x, kappa, starts, heads, paths, reaches, sections, banks, network.section_map(x, line, sections, banks))
