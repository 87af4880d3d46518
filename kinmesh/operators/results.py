"""What linking and clustering return."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fixed columns of decided pairs.
DECISION = ["left_id", "right_id", "similarity", "match", "confidence", "reason"]


@dataclass(frozen=True)
class LinkageResult:
    """One table of outcomes; a row is an error if it has one, else a decision."""

    outcomes: DataFrame

    @property
    def decisions(self) -> DataFrame:
        return self.outcomes.where(F.col("error").isNull()).select(DECISION)

    @property
    def errors(self) -> DataFrame:
        return self.outcomes.where(F.col("error").isNotNull()).select("left_id", "right_id", "similarity", "error")

    def to_frame(self) -> DataFrame:
        return self.decisions


@dataclass(frozen=True)
class ClusteringResult:
    """record_id and cluster_id; clusters are numbered from 0 by their smallest record id."""

    labels: DataFrame

    @property
    def n_clusters(self) -> int:
        return self.labels.select("cluster_id").distinct().count()

    def to_frame(self) -> DataFrame:
        return self.labels.orderBy("cluster_id", "record_id")
