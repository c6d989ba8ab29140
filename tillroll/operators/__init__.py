"""DataFrame → DataFrame operators: reconciliation, quality checks, marts, rankings, top-k."""
