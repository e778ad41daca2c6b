"""All registered queries: name → (query, SQL or None)."""

from __future__ import annotations

from tidewatch.workload.corpus_queries import QUERIES as CORPUS
from tidewatch.workload.ledger_queries import QUERIES as LEDGER
from tidewatch.workload.path_queries import QUERIES as PATHS
from tidewatch.workload.scan_queries import QUERIES as SCANS
from tidewatch.workload.text_queries import QUERIES as TEXT

REGISTRY = {**TEXT, **PATHS, **CORPUS, **LEDGER, **SCANS}
