"""Query plans: fixtures, the registry of checkable queries, the audit run."""
