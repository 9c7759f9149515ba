"""Incremental versions of import and ledger."""
