"""Registered queries over the test tables, each with the SQL that gives the same rows where there is one."""

from runlore.queries import documents, vectors, retrieval, diagnosis, indexing, streams, files, stored  # noqa: F401
from runlore.queries.base import QUERIES, SQL  # noqa: F401
