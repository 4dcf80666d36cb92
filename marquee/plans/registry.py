"""Registered queries of the library itself and the SQL that states their results."""

from . import announce, board, crawl, files, flows, pages, resolve, store, stream, text

QUERIES: dict = {}
SQL: dict = {}
for _part in (board, store, text, announce, resolve, flows, stream, crawl, pages, files):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
FLAGSHIP = "board_active"
