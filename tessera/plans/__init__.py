"""Query plans: relational shapes, workloads and their registration."""
