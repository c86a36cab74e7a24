"""Table profiling on Spark: exact column metrics, overall and by dimension, stored and browsed."""

from colmetry.errors import AmbiguousError, NotFoundError, ProfileError, StorageError
from colmetry.operators import catalog, views
from colmetry.operators.aggregate import profile_columns
from colmetry.operators.metrics import Metric, StringMetric
from colmetry.operators.validate import validate
from colmetry.plans.profile import Profile, guard_dimensions, profile
from colmetry.plans.run import import_relations, run, run_results
from colmetry.plans.tasks import relation_costs, run_summary, tasks
from colmetry.sources.artifacts import ingest_artifacts
from colmetry.sources.json_catalog import read_json_catalog
from colmetry.sources.snapshots import Snapshot, SnapshotStore, read_tables as read_snapshot

__all__ = [
    "AmbiguousError", "Metric", "NotFoundError", "Profile", "ProfileError", "Snapshot", "SnapshotStore",
    "StorageError", "StringMetric", "catalog", "guard_dimensions", "import_relations", "ingest_artifacts", "profile", "profile_columns",
    "read_json_catalog", "read_snapshot", "relation_costs", "run", "run_results", "run_summary", "tasks", "validate", "views",
]
