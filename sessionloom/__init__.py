"""Session-log analytics as Spark DataFrame transformations.

Every operator is a plain function ``DataFrame -> DataFrame`` over many
repositories and many logs at once; a repository is a ``repo_id`` column.
"""
