"""railguard: a causal guard for prediction trajectories and its honest evaluation, on Spark.

The public calls take and return DataFrames; names are loaded on first use.
"""

from __future__ import annotations

from importlib import import_module

_PUBLIC = {
    "Keys": "operators.layout",
    "Trajectories": "operators.layout",
    "guard": "operators.guard",
    "recover": "operators.guard",
    "causal_state": "operators.guard",
    "project": "operators.guard",
    "unit_metrics": "operators.metrics",
    "domain_summary": "operators.metrics",
    "overall_summary": "operators.metrics",
    "certificate": "operators.metrics",
    "cluster_bootstrap": "operators.inference",
    "two_stage_bootstrap": "operators.inference",
    "sign_flip": "operators.inference",
    "mechanism_decision": "plans.workflows",
    "guard_stream": "streaming.guard_stream",
}

__all__ = sorted([*_PUBLIC, "guard_frame"])


def guard_frame(df, *, alpha, budget, keys=None, **kw):
    """The guard for a plain DataFrame: state and output columns are added to its rows."""
    layout = import_module("railguard.operators.layout")
    done = import_module("railguard.operators.guard").guard(
        layout.Trajectories.plan(df, keys or layout.Keys()), alpha=alpha, budget=budget, **kw
    )
    added = [kw.get("state", "protected_state"), kw.get("out", "guarded")]
    return done.frame.select(*df.columns, *added)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"railguard has no {name}")
    return getattr(import_module(f"railguard.{_PUBLIC[name]}"), name)
