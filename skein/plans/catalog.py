"""All registered queries outside the training-data subpackage."""

from . import arrays, corpus, decoding, files, star, streams

MODULES = (corpus, arrays, decoding, streams, files, star)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
