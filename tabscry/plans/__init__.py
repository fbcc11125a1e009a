"""Repair plans, approvals and quality reports built from scan results."""
