"""Parsers: files to rows of symbols, calls, imports, UI nodes and warnings."""
