"""Registered queries with their SQL."""

from . import anchors, checks, citations, dense, events, files, listing, packages, records, retrieval, rules, search, text, vectors, windows

MODULES = (search, retrieval, dense, vectors, windows, events, listing, text, rules, files, packages, records, checks, citations, anchors)
