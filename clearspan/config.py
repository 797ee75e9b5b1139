"""Parameters of the operators, with their default values."""

from __future__ import annotations

from dataclasses import dataclass


# The values of these classes and profiles are fixed: results must equal those of the system they stand for.


@dataclass(frozen=True)
class AnomalyConfig:
    """Thresholds of the low-event analysis. Metres unless named otherwise."""

    window_radius: float = 20.0
    baseline_quantile: float = 0.70
    absolute_drop: float = 0.50
    mad_multiplier: float = 6.0
    mad_scale: float = 1.4826
    min_local_samples: int = 9
    min_local_span: float = 8.0
    max_local_samples: int = 1001
    fallback_radius_rows: int = 64
    max_step: float = 10.0
    merge_gap: float = 2.0
    flank_search: float = 5.0
    normal_return: float = 0.25
    structure_min_samples: int = 3
    structure_min_length: float = 0.80
    structure_max_mad: float = 0.15
    short_length: float = 0.30
    large_drop: float = 1.00
    point_jump: float = 2.00
    point_spread: float = 1.00
    point_spread_ratio: float = 0.25
    periodic_min_events: int = 3
    periodic_min_spacing: float = 5.0
    periodic_tolerance: float = 1.50
    periodic_tolerance_ratio: float = 0.05
    periodic_height: float = 0.20
    periodic_lateral: float = 0.50
    periodic_vertical: float = 0.30
    periodic_length_ratio: float = 2.0
    #: a task of more events is searched by blocks of them, with the same result
    periodic_max_events: int = 128
    review_score: int = 2
    high_score: int = 4


@dataclass(frozen=True)
class PlaneConfig:
    """Plane search in one point-cloud frame. Metres and degrees."""

    up_min: float = 1.0
    up_max: float = 10.0
    half_angle_east: float = 60.0
    half_angle_north: float = 60.0
    min_range: float = 0.2
    max_normal_angle: float = 20.0
    distance: float = 0.04
    voxel: float = 0.04
    iterations: int = 200
    probability: float = 0.99
    max_planes: int = 4
    min_remaining: int = 100
    min_inliers: int = 60
    min_inlier_ratio: float = 0.0003
    grid: float = 0.03
    span_cells: int = 4
    cells: int = 12
    residual_p95: float = 0.05


@dataclass(frozen=True)
class SurfaceConfig:
    """Search of curved surfaces in one point-cloud frame. Metres and degrees."""

    up_min: float = 1.0
    up_max: float = 10.0
    half_angle_east: float = 60.0
    half_angle_north: float = 60.0
    min_range: float = 0.2
    voxel: float = 0.05
    neighbours: int = 20
    smoothness: float = 10.0
    curvature: float = 0.10
    min_cluster_points: int = 80
    min_span: float = 0.30
    grid: float = 0.05
    min_cells: int = 20
    max_p95: float = 0.10
    max_curvature: float = 0.10
    min_down: float = 0.05
    max_points: int = 9999
    min_confidence: float = 0.55
    margin: float = 0.02


@dataclass(frozen=True)
class HeadingConfig:
    """Gates and smoothing of the heading between local and global axes. Metres and radians."""

    min_samples: int = 3
    min_baseline: float = 50.0
    valid_baseline: float = 100.0
    ratio_min: float = 0.7
    ratio_max: float = 1.3
    max_rmse: float = 15.0
    max_p95: float = 25.0
    min_inlier_ratio: float = 0.7
    alpha: float = 0.1
    max_jump: float = 0.08726646259971647


@dataclass(frozen=True)
class RegistrationConfig:
    """Correspondences of a scan with a map and the observability of their alignment. Metres, degrees; variances in their squares."""

    max_points: int = 2500
    neighbours: int = 10
    cell: float = 0.5
    max_distance: float = 1.5
    max_variation: float = 0.20
    least_relative: float = 1.0e-4
    least_eigenvalue: float = 1.0e-5
    blind_variance: float = 1.0e6
    position_noise: float = 0.05
    attitude_noise_deg: float = 0.20


@dataclass(frozen=True)
class FusionConfig:
    """The inertial filter: limits, noise densities and first uncertainties. Metres, seconds, radians."""

    gravity: float = 9.80665
    max_step_s: float = 0.02
    max_acceleration: float = 50.0
    acceleration_noise: float = 0.20
    attitude_noise: float = 0.01
    bias_walk: float = 0.01
    position_std: float = 0.10
    velocity_std: float = 1.0
    attitude_std: float = 0.35
    bias_std: float = 0.30
    max_position_std: float = 1.0
    max_inertial_s: float = 2.0


#: Profiles of the plane search: the active one of a tunnel drive, a roof survey and a small board.
PROFILES = {
    "initial": PlaneConfig(),
    "tunnel": PlaneConfig(0.2, 15.0, 55.0, 35.0, 0.2, 15.0, 0.04, 0.04, 500, 200, 100, 50, 0.0003, 0.04, 8, 50, 0.05),
    "roof": PlaneConfig(0.2, 15.0, 55.0, 35.0, 0.2, 15.0, 0.04, 0.04, 500, 8, 500, 300, 0.005, 0.10, 9, 81, 0.05),
    "small_board": PlaneConfig(0.2, 15.0, 55.0, 35.0, 0.2, 15.0, 0.04, 0.04, 500, 2500, 100, 50, 0.0003, 0.04, 8, 50, 0.05),
}
