"""Structured Streaming entry points.

The original tool is batch-only (no windows, watermarks or state).  The one
streaming use that maps onto its operators is incremental ingestion of VCF
text files as they land, which reuses the batch parser unchanged.
"""
