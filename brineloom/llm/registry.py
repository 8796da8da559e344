"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from brineloom.llm import ann, chat, decontam, html, langid, neardup, packing, substrings, toxicity, urls

_MODULES = (ann, chat, decontam, html, langid, neardup, packing, substrings, toxicity, urls)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
