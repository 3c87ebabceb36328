"""Readers, writers and schema adapters."""

from berth.sources.commit import commit, committed  # noqa: F401
from berth.sources.ledger import read_ledger, write_ledger  # noqa: F401
from berth.sources.tables import TABLES, application_tables, read_fixture, tables  # noqa: F401
