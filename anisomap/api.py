"""One entry to all optimizers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from anisomap.functions.metrics import Metric, Randers
from anisomap.operators import optimizers as opt
from anisomap.operators.frozen import path_frozen


def _smacof(dissim, metric, **options):
    if not isinstance(metric, Randers):
        raise TypeError("majorization is for Randers metrics only")
    return opt.smacof_randers(dissim, metric.alpha, **options)


def _soft(method):
    return lambda dissim, metric, **options: opt.soft_path_fit(dissim, metric, method, **options)


OPTIMIZERS: dict[str, Callable] = {
    "smacof": _smacof,
    "smacof_randers": _smacof,
    "optimize_smacof_randers": _smacof,
    "gd": opt.gradient_descent,
    "gradient_descent": opt.gradient_descent,
    "optimize_gradient_descent": opt.gradient_descent,
    "path_frozen": path_frozen,
    "optimize_path_frozen": path_frozen,
    "soft_bellman_ford": _soft("bellman_ford"),
    "relaxed_bellman_ford": _soft("bellman_ford"),
    "optimize_soft_bellman_ford": _soft("bellman_ford"),
    "datasp": _soft("floyd_warshall"),
    "optimize_datasp": _soft("floyd_warshall"),
    "finsler_umap": opt.finsler_umap,
    "umap": opt.finsler_umap,
    "optimize_finsler_umap": opt.finsler_umap,
}


def fit(dissim: DataFrame, metric: Metric | None = None, optimizer: str | Callable = "smacof_randers", print_time: bool = False, **options) -> opt.Result:
    """Embedding of ``dissim(src, dst, d)`` whose directed lengths or geodesics reproduce it; a callable is used as it is."""
    run = optimizer
    if not callable(optimizer):
        run = OPTIMIZERS.get(optimizer.lower())
        if run is None:
            raise ValueError(f"unknown optimizer {optimizer!r}; known are {', '.join(sorted(OPTIMIZERS))}")
    began = time.monotonic()
    got = run(dissim, metric if metric is not None else Randers(0.0), **options)
    if print_time:
        print(f"fitted in {time.monotonic() - began:.2f} s")
    return got
