"""Readers for bank, ledger and settlement files."""
