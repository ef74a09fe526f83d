"""Imports every query module so that the registry is complete."""

from wheeltrace.plans import q_align, q_detect, q_drives, q_image, q_monitor, q_path, q_scene, q_source, q_time  # noqa: F401
from wheeltrace.plans.registry import ORACLES, QUERIES  # noqa: F401
