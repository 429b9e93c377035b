"""End-to-end plans: configurations, assembly, landscape summaries, the raw database."""
