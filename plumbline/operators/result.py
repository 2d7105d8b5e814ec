"""What estimators return."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Result:
    """Estimates and bootstrap standard errors by name, bands, diagnostics; no p-values, no analytic covariances."""

    spark: SparkSession
    params: dict[str, float]
    se: dict[str, float] = field(default_factory=dict)
    bands: list[tuple] = field(default_factory=list)
    n_obs: int = 0
    diagnostics: dict[str, float] = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def coef(self) -> DataFrame:
        """(param, estimate, se)."""
        rows = [(k, None if v is None or np.isnan(v) else float(v), None if (s := self.se.get(k)) is None else float(s)) for k, v in self.params.items()]
        return self.spark.createDataFrame(rows, "param string, estimate double, se double")

    def band(self) -> DataFrame:
        """(side, tau, estimate, se, lower, upper)."""
        return self.spark.createDataFrame([(s, int(t), float(e), float(d), float(lo), float(hi)) for s, t, e, d, lo, hi in self.bands], "side string, tau int, estimate double, se double, lower double, upper double")

    def facts(self) -> DataFrame:
        """(metric, value)."""
        rows = [("n_obs", float(self.n_obs)), *((k, float(v)) for k, v in self.diagnostics.items())]
        return self.spark.createDataFrame(rows, "metric string, value double")
