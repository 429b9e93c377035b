"""Operators over frames of rows (see ``veldspan.schema``)."""
