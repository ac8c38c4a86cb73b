"""Named queries over the given tables."""

from importlib import import_module

MODULES = ("q_evidence", "q_calibrate", "q_passage", "q_returns", "q_diagnostics", "q_contrast", "q_resample", "q_walkforward", "q_sources")


def load_all() -> None:
    for m in MODULES:
        import_module(f"tidewatch.plans.{m}")
