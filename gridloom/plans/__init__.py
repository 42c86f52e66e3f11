"""Partition plans, memory budgets and execution plans."""
