"""All registered queries and oracles."""

from . import queries_blocks, queries_more, queries_reports, queries_rest, queries_segments, queries_tools

PARTS = (queries_blocks, queries_rest, queries_more, queries_segments, queries_tools, queries_reports)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in PARTS for k, v in part.ORACLES.items()}
