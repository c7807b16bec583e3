"""DataFrame operators: scans, windows, outcomes, sweeps, statistics, reconciliation, ledgers."""
