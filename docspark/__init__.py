"""A PySpark engine for typed, schemaless document collections."""

from .engine import Engine, Outcome, QueryBuilder
from .errors import DocsparkError
from .sources.backup import restore_backup, verify_backup
from .sources.storage import inspect_storage
from .streaming.results import Signal
from .types import BigInt

__all__ = ["BigInt", "DocsparkError", "Engine", "Outcome", "QueryBuilder", "Signal", "inspect_storage", "restore_backup", "verify_backup"]
