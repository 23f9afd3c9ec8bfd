"""Landscape features.

Every family takes the wide table of sample points: ``rep``, ``sample_id``, one column per input
and one per response (a response's column is its label). It returns long rows
``(rep, label, feature, value)``; NULL marks a feature that cannot be computed.
"""

ROWS = "rep int, label string, feature string, value double"
