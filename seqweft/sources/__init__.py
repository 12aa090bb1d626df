"""Readers: FASTA, JSON Lines, CSV, listing pages, fetching."""
