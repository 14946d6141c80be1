"""Imports every module that registers queries."""

from chartloom.plans import (  # noqa: F401
    q_geometry,
    q_labels,
    q_metrics,
    q_models,
    q_profile,
    q_quality,
    q_resolve,
    q_rules,
    q_sampling,
    q_sources,
    q_tokens,
)
