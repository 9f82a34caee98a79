"""Configuration and command-line arguments, checked where they are made."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

from ..sources.envelope import ALERT_TOPIC, INPUT_TOPIC, INVALID_TOPIC


@dataclass(frozen=True)
class WindowPolicy:
    """Sliding windows and lateness, in seconds; with early panes or without."""

    size_seconds: int = 60
    period_seconds: int = 10
    allowed_lateness_seconds: int = 30
    early_firing_delay_seconds: int = 10
    enable_early: bool = True

    def __post_init__(self) -> None:
        checks = (
            (self.size_seconds > 0, "window_size_seconds must be positive"),
            (self.period_seconds > 0, "window_period_seconds must be positive"),
            (self.period_seconds <= self.size_seconds, "window_period_seconds must not exceed window_size_seconds"),
            (self.allowed_lateness_seconds >= 0, "allowed_lateness_seconds must not be negative"),
            (self.early_firing_delay_seconds > 0, "early_firing_delay_seconds must be positive"),
        )
        for holds, text in checks:
            if not holds:
                raise ValueError(text)
        if not isinstance(self.enable_early, bool):
            raise TypeError("enable_processing_time_early_firings must be a boolean")


@dataclass(frozen=True)
class PipelineConfig:
    """Where the pipeline reads and writes. mode: bounded (a batch query, one pane a window) or event_time (a stream of panes with revisions)."""

    bootstrap_servers: str = "localhost:9092"
    input_topic: str = INPUT_TOPIC
    alert_topic: str = ALERT_TOPIC
    invalid_topic: str = INVALID_TOPIC
    consumer_group: str = "velocity-spark-v1"
    max_num_records: int | None = None
    mode: str = "event_time"
    smoke_mode: bool = False

    def __post_init__(self) -> None:
        for name in ("bootstrap_servers", "input_topic", "alert_topic", "invalid_topic", "consumer_group"):
            value = getattr(self, name)
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"{name} must be a non-empty string")
        if self.mode not in ("bounded", "event_time"):
            raise ValueError("mode must be one of: bounded, event_time")
        if not isinstance(self.smoke_mode, bool):
            raise TypeError("smoke_mode must be a boolean")
        n = self.max_num_records
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n <= 0):
            raise ValueError("max_num_records must be a positive integer")


def parse_args(argv: Sequence[str] | None = None) -> tuple[argparse.Namespace, dict[str, str]]:
    """The pipeline's arguments; what is left over are Spark settings, as --key=value or --key value."""
    parser = argparse.ArgumentParser(prog="tidegauge-pipeline", description="Velocity alerts over keyed transactions.")
    d = PipelineConfig()
    for name in ("bootstrap_servers", "input_topic", "alert_topic", "invalid_topic", "consumer_group"):
        parser.add_argument("--" + name.replace("_", "-"), default=getattr(d, name))
    parser.add_argument("--max-num-records", type=int)
    parser.add_argument("--mode", default=d.mode, choices=("bounded", "event_time"))
    parser.add_argument("--smoke-mode", action="store_true")
    args, rest = parser.parse_known_args(argv)
    settings: dict[str, str] = {}
    name = None
    for word in rest:
        if word.startswith("--"):
            name, _, value = word[2:].partition("=")
            settings[name] = value or "true"
        elif name:
            settings[name] = word
    return args, settings


def config_of(args: argparse.Namespace) -> PipelineConfig:
    return PipelineConfig(**vars(args))
