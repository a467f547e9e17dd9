"""runlore: operational knowledge bases and incident retrieval as Spark jobs.

Tables in, tables out: tickets, runbooks, wiki pages and alerts become one documents table, then chunks,
vectors, retrieval results, prompts, diagnoses and evaluation metrics, for many queries at once.
"""

__version__ = "0.1.0"
