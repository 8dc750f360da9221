"""Registered queries of the reference's operators: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from paperloom.plans import q_extract, q_layout, q_more, q_rules, q_search, q_service, q_stream

QUERIES: dict[str, tuple] = {**q_search.Q, **q_rules.Q, **q_extract.Q, **q_stream.Q, **q_more.Q, **q_layout.Q, **q_service.Q}
