"""Default parameters.

Fixed values: limits, bands and thresholds that must equal the published
defaults for results to agree. Every operator takes them as arguments.
"""

from __future__ import annotations

SEED = 42

CLASSES = ("ok", "defect")  # the last class is the positive one
SPLITS = ("train", "val", "test")

CLASS_MAP = {"ok_front": "ok", "def_front": "defect"}
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp")

FEATURE_NAMES = (
    "mean_intensity",
    "std_intensity",
    "p05_intensity",
    "p95_intensity",
    "edge_density",
    "laplacian_var",
    "entropy",
)

SPLIT = {"val_size": 0.15, "test_size": 0.20, "stratify": True, "group_by_hash": True}

FILE_RULES = {
    "allowed_formats": IMAGE_SUFFIXES,
    "max_file_bytes": 10_485_760,
    "min_width": 32,
    "min_height": 32,
    "max_width": 4096,
    "max_height": 4096,
    "min_mean_intensity": 3.0,
    "max_mean_intensity": 252.0,
    "min_std_intensity": 2.0,
}

CORPUS_RULES = {
    "max_corrupt_ratio": 0.02,
    "min_images_per_class": 100,
    "max_class_imbalance_ratio": 5.0,
    "max_duplicate_ratio": 0.10,
    "leakage_effect_size": 2.0,
    "leakage_min_rows": 20,
}

PREPROCESS = {"resize": 128, "mean": 0.485, "std": 0.229}

THRESHOLD_GRID = 501
TARGET_RECALL = 0.98
BOOTSTRAP_SAMPLES = 500

GATES = {"min_test_f1": 0.85, "min_test_recall": 0.85, "max_latency_p95_ms": 250.0}

REVIEW_BAND = (0.35, 0.65)
MAX_UPLOAD_BYTES = 5_242_880
MAX_BATCH_SIZE = 16
CONTENT_TYPES = (
    "image/jpeg",
    "image/jpg",
    "image/png",
    "image/bmp",
    "image/x-ms-bmp",
    "application/octet-stream",
)
UPLOAD_FORMATS = ("JPEG", "PNG", "BMP", "MPO")

PSI_BINS = 10
PSI_FLOOR = 1e-6
REFERENCE_PERCENTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)

MONITORING = {
    "psi_warn": 0.10,
    "psi_alert": 0.25,
    "ks_pvalue_alert": 0.01,
    "confidence_drop_alert": 0.08,
    "accuracy_drop_alert": 0.05,
    "review_rate_alert": 0.20,
    "min_samples": 100,
    "min_labeled": 20,
    "window_size": 200,
}

RULES = (
    ("data_drift_psi", "psi_max", ">=", 0.25, "high"),
    ("confidence_collapse", "mean_confidence_drop", ">=", 0.08, "medium"),
    ("accuracy_degradation", "accuracy_drop", ">=", 0.05, "high"),
    ("review_queue_overflow", "review_rate", ">=", 0.20, "medium"),
)

RETRAINING = {
    "consecutive_windows": 2,
    "cooldown_hours": 24.0,
    "min_new_labeled_samples": 300,
    "history_rows": 50,
}

RECENT_LATENCY_ROWS = 2000
QUARANTINE_REPORT_ROWS = 200
SCORE_HISTOGRAM_BINS = 40
