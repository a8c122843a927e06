"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from . import fingerprints, jaccard_join, language_id, licenses, line_dedup, mixing, nearest, pieces, substring_dedup, toxicity

MODULES = (licenses, jaccard_join, pieces, substring_dedup, line_dedup, mixing, nearest, toxicity, fingerprints, language_id)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in getattr(m, "SQL", {}).items()}
