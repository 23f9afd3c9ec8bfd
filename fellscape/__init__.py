"""Landscape analysis of sampled black-box functions as PySpark DataFrame jobs."""

from fellscape.plans.study import Study

__all__ = ["Study"]
