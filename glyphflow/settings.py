"""Limits, defaults and fixed values shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Frozen so that every value can be folded into a plan as a literal."""

    engine: str = "ocr"
    # The defaults below, and what response documents name as version and model.
    engine_version: str = "3.5.0"
    model_prefix: str = "ch_PP-OCRv4_"
    model_lang: str = "en"
    device: str = "cpu"
    min_confidence: float = 0.0
    include_polygon: bool = True
    max_image_size_mb: int = 20
    max_image_pixels: int = 16_777_216
    max_batch_size: int = 20
    job_ttl_hours: int = 24
    minutes_per_image: int = 2
    # Overrides max_image_size_mb when a limit below one MiB is wanted.
    max_image_bytes: int | None = None

    @property
    def size_limit(self) -> int:
        if self.max_image_bytes is not None:
            return self.max_image_bytes
        return self.max_image_size_mb * 1024 * 1024

    @property
    def size_limit_text(self) -> str:
        """The limit as answers name it."""
        return f"{self.max_image_size_mb}MB" if self.max_image_bytes is None else f"{self.max_image_bytes} bytes"


# First bytes and the format they announce. "RIFF" needs a second test.
SIGNATURES = [
    (b"\xff\xd8\xff", "jpeg"),
    (b"\x89PNG", "png"),
    (b"BM", "bmp"),
    (b"II*\x00", "tiff"),
    (b"MM\x00*", "tiff"),
]
RIFF_SIGNATURE = b"RIFF"
WEBP_TAG = b"WEBP"

# MIME types, their extensions, and the accepted file extensions.
MIME_TO_EXTENSION = {
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/bmp": ".bmp",
    "image/tiff": ".tiff",
    "image/webp": ".webp",
}
ALLOWED_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp"]

# Histogram bounds; every histogram also has +Inf.
REQUEST_BOUNDS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]
BATCH_SIZE_BOUNDS = [1.0, 2.0, 5.0, 10.0, 15.0, 20.0, 25.0, 50.0]
INFERENCE_BOUNDS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]

# Metric families as (name, type, help), in exposition order.
METRIC_FAMILIES = [
    ("ocr_requests_total", "counter", "Total number of OCR requests"),
    ("ocr_request_duration_seconds", "histogram", "OCR request duration in seconds"),
    ("ocr_batch_size", "histogram", "Batch size for batch OCR requests"),
    ("ocr_job_queue_depth", "gauge", "Number of pending OCR jobs"),
    ("ocr_inference_time_seconds", "histogram", "OCR inference time in seconds"),
    ("model_ready", "gauge", "Whether OCR model is ready (1=ready, 0=loading)"),
]

# Job states.
QUEUED = "queued"
RUNNING = "running"
COMPLETED = "completed"
FAILED = "failed"
CANCELLED = "cancelled"
JOB_STATES = [QUEUED, RUNNING, COMPLETED, FAILED, CANCELLED]
TERMINAL_STATES = [COMPLETED, FAILED, CANCELLED]

# Legal job transitions ("" stands for "no state yet").
LEGAL_TRANSITIONS = [
    ("", QUEUED),
    (QUEUED, RUNNING),
    (QUEUED, CANCELLED),
    (RUNNING, COMPLETED),
    (RUNNING, FAILED),
    (RUNNING, CANCELLED),
]

# Errors after which a single request is counted; size checks and failed model calls are not.
COUNTED_ERRORS = ["unsupported_format", "invalid_base64", "unreadable_image"]

# Fixed values: (endpoint, error code, HTTP status, detail). {limit}, {limit_text}, {size} and {message} are filled per row.
ERROR_RULES = [
    ("/ocr", "image_empty", 400, "Image file is empty"),
    ("/ocr", "file_too_large", 413, "Image size {size} exceeds maximum {limit}"),
    ("/ocr", "unsupported_format", 415, "Unsupported image format. Allowed: JPEG, PNG, BMP, TIFF, WebP"),
    ("/ocr", "unreadable_image", 422, "Cannot process image: {message}"),
    ("/ocr", "ocr_failed", 500, "{message}"),
    ("/ocr", "internal_error", 500, "Internal server error during OCR processing"),
    ("/ocr/json", "image_empty", 400, "Image data is empty"),
    ("/ocr/json", "invalid_base64", 400, "Invalid base64 encoded image data"),
    ("/ocr/json", "file_too_large", 413, "Image size exceeds maximum {limit_text}"),
    ("/ocr/json", "unreadable_image", 422, "Cannot process image: {message}"),
    ("/ocr/json", "ocr_failed", 500, "{message}"),
    ("/ocr/json", "internal_error", 500, "Internal server error during OCR processing"),
]
