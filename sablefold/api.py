"""What callers import: detect, process, restore, and the pieces behind them."""

from __future__ import annotations

from .config import Config, with_user_columns
from .functions.names import gazetteer
from .operators.gateway import Gateway, Policy
from .operators.mapping import MappingError
from .operators.process import Run, process, process_frames, restore_frames
from .operators.restore import restore, restore_messages, restore_string, restore_text, restore_tokens, restore_values
from .operators.scrub import scrub, scrub_messages, scrub_string
from .plans.planner import Plan, Target, detection_frame, plan

detect = detection_frame

__all__ = [
    "Config", "Gateway", "MappingError", "Plan", "Policy", "Run", "Target", "detect", "gazetteer", "plan", "process", "process_frames", "restore",
    "restore_frames", "restore_messages", "restore_string", "restore_text", "restore_tokens", "restore_values", "scrub", "scrub_messages", "scrub_string", "with_user_columns",
]
