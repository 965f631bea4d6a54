"""svcseam — service-boundary feature extraction as Spark jobs.

Every operator is a DataFrame-in, DataFrame-out function keyed by
``project_id``; see ``svcseam.operators``.
"""

__version__ = "0.1.0"
