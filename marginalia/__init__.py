"""marginalia: note-corpus analytics as Spark DataFrame jobs.

Every public function takes DataFrames (and plain parameters) and returns a DataFrame; nothing keeps a global session.
"""
