"""Run planning: engines, thread budgets, index formats."""
