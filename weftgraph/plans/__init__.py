"""Queries over the project's tables, each with the SQL that checks it where SQL can express it."""

from weftgraph.plans import changes, inventory, knowledge, problems, relational, registry  # noqa: F401, I001

CORE_QUERIES = {**registry.QUERIES, **problems.QUERIES}
CORE_SQL = {**registry.SQL, **problems.SQL}
