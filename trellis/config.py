"""Options of all steps, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """The defaults that results must agree with."""

    canal_near_m: float = 15.0
    street_near_m: float = 10.0
    forward_cos_min: float = 0.5
    photo_min_dist_m: float = 3.0
    photo_max_dist_m: float = 60.0
    perspective_max_dist_m: float = 25.0
    bearing_tol_deg: float = 25.0
    max_perpendicularity_deg: float = 20.0
    top_k: int = 5
    winter_months: tuple[int, ...] = (12, 1, 2, 3)
    winter_only: bool = False
    pano_only: bool = False
    min_quality_score: float | None = None
    max_occluder_ratio: float = 0.4
    n_bins: int = 40
    smooth_sigma: float = 1.5
    min_prominence: float = 0.2
    min_windows: int = 2
    min_mask_ratio: float = 0.02
    max_mask_ratio: float = 0.80
    grammar_prior_weight: float = 1.0
    family_depth: int = 2
    n_samples: int = 12
    rng_seed: int = 42
    max_depth: int = 20
    min_production_weight: int = 1
    dirichlet_concentration: float = 0.1
    view_width: int = 1280
    view_height: int = 960
    view_fov_deg: float = 45.0
    bbox_margin: float = 0.08
    camera_height_m: float = 2.5
    sky_margin_deg: float = 3.0
    min_front_score: float = 0.3
    min_box_overlap: float = 0.5
    min_feature_score: float = 0.3


DEFAULTS = Options()
