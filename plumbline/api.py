"""The library's entry points under one roof."""

from plumbline.functions.stats import bootstrap, cluster_bootstrap, cluster_mean_ci, mean_ci
from plumbline.plans.audit import audit, run_audit
from plumbline.plans.audit import summary as audit_summary
from plumbline.plans.benchmark import build_benchmark, export_crops
from plumbline.plans.metrics import image_metrics, summarize
from plumbline.sources.package import attach, read_sample

__all__ = [
    "attach", "audit", "audit_summary", "bootstrap", "build_benchmark", "cluster_bootstrap", "cluster_mean_ci",
    "export_crops", "image_metrics", "mean_ci", "read_sample", "run_audit", "summarize",
]
