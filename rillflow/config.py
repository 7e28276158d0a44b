"""Parameters of a network extraction."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TerrainConfig:
    """Passed explicitly to every step; ``generation(...)`` gives the settings of older generations."""

    diffusion_iterations: int = 30
    diffusion_step: float = 0.1
    diffusion_option: int = 2
    smoothing_quantile: float = 0.9
    precision: str = "double"
    curvature_method: str = "geometric"
    curvature_std_factor: float = 1.0
    curvature_zero_fill: bool = True
    min_basin_percent: float = 0.5
    min_basin_cells: int = 6
    flow_threshold: float = 50.0
    head_box: int = 25
    head_histogram_edge: int = 2
    connectivity: int = 8
    null_geodesic_is_head: bool = False
    cost_expression: str = "flow + flow_mean * skel + flow_mean * curv"
    cost_floor: float | None = None
    normalize_curvature: bool = True
    nodata: float = -9999.0
    nodata_inclusive: bool = False
    flow_routing: str = "d8"
    right_bank_offset: int = 22

    def but(self, **changes) -> TerrainConfig:
        return replace(self, **changes)


def generation(name: str) -> TerrainConfig:
    """Settings by generation: v3 (default), v0, v1."""
    c = TerrainConfig()
    if name == "v3":
        return c
    old = c.but(diffusion_iterations=50, head_box=30, connectivity=4, min_basin_cells=2, curvature_zero_fill=False)
    if name == "v0":
        return old.but(min_basin_percent=0.01, head_histogram_edge=3)
    if name == "v1":
        return old.but(min_basin_percent=0.0)
    raise ValueError(name)
