"""Structured Streaming entry points.

The source application has no stream processing; its only continuously
arriving input is action requests (one per HTTP call).  ``actions`` replays
that path as micro-batches: the same batch operator validates each batch,
attaches the latest prediction and appends to the action log.
"""
