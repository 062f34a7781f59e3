"""Queries over the operators that need more than one table or a longer SQL; importing a module registers its queries."""

from . import documents, evidence, ledgers, markup, prototypes, sheets, tables  # noqa: F401
