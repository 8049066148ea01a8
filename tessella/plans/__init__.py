"""Queries: a build function over (spark, folder), and the same in SQL for another engine."""
