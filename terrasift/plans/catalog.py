"""The registry of queries outside the subpackage llm."""

from __future__ import annotations

from terrasift.plans import dealt, dealt_sql, reference, reference_sql, rules


def queries() -> dict:
    return dict(dealt.QUERIES) | dict(reference.QUERIES) | dict(rules.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(dealt_sql.SQL) | dict(reference_sql.SQL) | dict(rules.SQL)
