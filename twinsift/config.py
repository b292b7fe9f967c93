"""Settings and the constants that define the engine's meaning."""

from dataclasses import dataclass

# Fixed values.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif", ".heic", ".heif")
DEFAULT_THRESHOLD = 10  # bits of 64, inclusive
MAX_THRESHOLD = 64
CLOSE_CALL_MARGIN = 0.08  # strict
PREVIEW_MAX_SIDE = 800
SPECTRUM_MAX_SIDE = 2048
SHARPNESS_SIDE = 512
BLOCK = 8

# Fixed values.  metric: (weight, digits shown, description); a negative weight: lower is better.
IMAGE_METRICS = {
    "effective_resolution_px_equiv": (0.35, 0, "true detail amount; resistant to fake upscaling"),
    "sharpness_normalized": (0.20, 1, "edge/detail sharpness, compared at a common scale"),
    "effective_resolution_fraction": (0.15, 3, "fraction of native resolution that's real detail, not just interpolated pixels"),
    "noise_sigma": (-0.10, 3, "sensor/compression noise"),
    "blockiness": (-0.10, 3, "JPEG block-edge artifacts"),
    "brisque": (-0.10, 2, "no-reference perceptual quality score (needs optional `brisque` package)"),
    "niqe": (-0.10, 2, "no-reference perceptual quality score (needs optional `pyiqa` package)"),
}
IMAGE_WEIGHTS = {k: v[0] for k, v in IMAGE_METRICS.items()}


def threshold(value) -> int:
    """A number of bits from 0 to 64; ValueError otherwise."""
    n = int(value)
    if not 0 <= n <= MAX_THRESHOLD:
        raise ValueError(f"threshold must be between 0 and {MAX_THRESHOLD}, not {n}")
    return n


@dataclass(frozen=True)
class ScanConfig:
    directory: str
    threshold: int = DEFAULT_THRESHOLD
    recursive: bool = False
    dest_dir: str | None = None
    dry_run: bool = False

    def __post_init__(self):
        object.__setattr__(self, "threshold", threshold(self.threshold))
        object.__setattr__(self, "directory", self.directory.rstrip("/") or "/")
        object.__setattr__(self, "dest_dir", (self.dest_dir or f"{self.directory}/_duplicates").rstrip("/"))
