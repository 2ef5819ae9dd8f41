"""claimscope: medical-claims analytics as Spark DataFrame jobs.

Every operator takes a DataFrame (the claims table or a result derived from
it) plus keyword parameters and returns a lazy DataFrame.  Nothing collects to
the driver; small one-row aggregates are joined back with explicit broadcast
hints because their size is fixed at one row.
"""

__version__ = "0.1.0"
