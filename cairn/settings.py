"""Settings of the operators, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass


def _require(fine: bool, what: str) -> None:
    if not fine:
        raise ValueError(what)


@dataclass(frozen=True)
class Extraction:
    """How frames are chosen and features kept."""

    stride: int = 1
    max_side: int = 1024
    max_keypoints: int = 2048
    detection_threshold: float = 0.0005

    def __post_init__(self) -> None:
        _require(self.stride >= 1, "stride must be 1 or more")
        _require(self.max_side >= 8, "max_side must be 8 or more")
        _require(self.max_keypoints >= 1, "max_keypoints must be 1 or more")
        _require(0 <= self.detection_threshold <= 1, "detection_threshold must be from 0 to 1")


@dataclass(frozen=True)
class Tracking:
    """Options of ``streaming.tracker``."""

    min_similarity: float = 0.8
    min_margin: float = 0.02
    max_inactive: int = 15

    def __post_init__(self) -> None:
        _require(-1 <= self.min_similarity <= 1, "min_similarity must be from -1 to 1")
        _require(0 <= self.min_margin <= 2, "min_margin must be from 0 to 2")
        _require(self.max_inactive >= 1, "max_inactive must be 1 or more")

    def options(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Verification:
    """Options of ``operators.twoview``, ``operators.epipolar`` and of the gates on what they verify."""

    threshold: float = 1.5
    reprojection: float = 3.0
    min_parallax: float = 2.0
    min_inliers: int = 30
    min_coverage: float = 0.2
    max_homography: float = 0.9
    most: int = 3000
    sure: float = 0.9999
    seed: int = 7

    def __post_init__(self) -> None:
        for name in ("threshold", "reprojection", "min_parallax"):
            _require(math.isfinite(getattr(self, name)) and getattr(self, name) > 0, f"{name} must be finite and above 0")
        _require(self.min_parallax < 90, "min_parallax must be below 90 degrees")
        _require(self.min_inliers >= 8 and self.most >= 1, "min_inliers must be 8 or more and most 1 or more")
        _require(0 < self.min_coverage <= 1 and 0 < self.sure < 1, "min_coverage must be above 0, at most 1, and sure between 0 and 1")
        _require(0 < self.max_homography <= 1 and self.seed >= 0, "max_homography must be above 0, at most 1, and seed 0 or more")

    def options(self) -> dict:
        return {"threshold": self.threshold, "most": self.most, "sure": self.sure}


@dataclass(frozen=True)
class Matching:
    """Options of the matchers of ``operators.simjoin``."""

    min_similarity: float = 0.8
    ratio: float = 0.8
    min_track_length: int = 2

    def __post_init__(self) -> None:
        _require(-1 <= self.min_similarity <= 1, "min_similarity must be from -1 to 1")
        _require(0 < self.ratio < 1, "ratio must be between 0 and 1")
        _require(self.min_track_length >= 2, "min_track_length must be 2 or more")
