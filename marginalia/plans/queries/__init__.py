"""Registered queries: every job of the package over the driver tables, most with an oracle in plain SQL."""

from . import feeds as _feeds
from . import files as _files
from . import graph as _graph
from . import migration as _migration
from . import notes as _notes
from . import works as _works

ALL = {**_notes.QUERIES, **_graph.QUERIES, **_works.QUERIES, **_feeds.QUERIES, **_migration.QUERIES, **_files.QUERIES}
