"""kinmesh: record linkage and deduplication as Spark plans."""

from kinmesh.operators.clustering import connected_components
from kinmesh.operators.linker import DenseLinker, LinkageIndex
from kinmesh.operators.metrics import BlockingMetrics, ClusteringMetrics, LinkageMetrics
from kinmesh.operators.results import ClusteringResult, LinkageResult
from kinmesh.functions.text import FieldwiseSerializer, TemplateSerializer, WholeRowSerializer
from kinmesh.sources.records import LabeledPairs, Source, candidate_pairs_from_frame

__all__ = [
    "BlockingMetrics",
    "ClusteringMetrics",
    "ClusteringResult",
    "DenseLinker",
    "FieldwiseSerializer",
    "LabeledPairs",
    "LinkageIndex",
    "LinkageMetrics",
    "LinkageResult",
    "Source",
    "TemplateSerializer",
    "WholeRowSerializer",
    "candidate_pairs_from_frame",
    "connected_components",
]
