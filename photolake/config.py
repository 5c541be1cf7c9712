"""Settings of an analysis, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "tif", "tiff")


# The sections and names of a settings file in sections, and the settings here.
SECTIONS = {
    "detection": {"min_confidence": "min_confidence", "min_face_size": "min_face_size", "nms_threshold": "nms_threshold", "input_size": "detector_size"},
    "clustering": {"eps": "cluster_eps", "min_samples": "cluster_min_samples"},
    "grading": {"sharpness_threshold": "sharpness_threshold", "exposure_clip_threshold": "exposure_clip_threshold", "aesthetic_good_threshold": "aesthetic_good_threshold"},
    "thumbnails": {"max_size": "thumbnail_side"},
}


# Defaults of the settings.
@dataclass(frozen=True)
class Config:
    min_confidence: float = 0.5
    min_face_size: float = 80.0
    nms_threshold: float = 0.4
    detector_size: int = 640
    max_faces: int = 30
    scores_are_logits: bool = True
    cluster_eps: float = 0.75
    cluster_min_samples: int = 2
    sharpness_threshold: float = 100.0
    exposure_clip_threshold: float = 0.3
    aesthetic_good_threshold: float = 5.0
    sharpness_side: int = 500
    grading_side: int = 800
    thumbnail_side: int = 300
    working_side: int = 1280
    hash_prefix_bytes: int = 65_536
    header_prefix_bytes: int = 131_072
    batch_photos: int = 5
    poll_seconds: int = 3
    part_photos: int = 2000
    duplicate_cosine: float = 0.95
    retry_seconds: int = 3600
    retry_longest: int = 604_800
    retry_attempts: int = 5
    sketch_parts: int = 64

    @classmethod
    def load(cls, path: str) -> Config:
        """Settings from a JSON file, flat or in sections; all defaults if it is missing or not valid.

        A file with sections must have all of :data:`SECTIONS`, and other settings keep their defaults.
        """
        try:
            with open(path) as f:
                found = json.load(f)
            if any(section in found for section in SECTIONS):
                flat = {ours: found[section][theirs] for section, names in SECTIONS.items() for theirs, ours in names.items()}
                flat["detector_size"] = int(flat["detector_size"][0])
                return cls(**{k: (int if isinstance(getattr(cls, k), int) else float)(v) for k, v in flat.items()})
            names = {f.name for f in fields(cls)}
            return cls(**{k: v for k, v in found.items() if k in names})
        except (OSError, ValueError, TypeError, AttributeError, KeyError, IndexError):
            return cls()

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)
