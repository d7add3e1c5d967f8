"""trialframe: statistics of repeated-measurement trials as Spark DataFrame jobs.

Raw observations are reduced in one distributed pass to group-by-time cell
statistics; models, contrasts, letters, curves and rates are then DataFrame
operations on those far smaller tables, keyed by ``family`` so that thousands
of responses are fitted in one job.

Canonical column names used by the operators:

* ``family``    one fitted model (a response, or response x segment)
* ``treatment`` the group factor
* ``x``         the time-like variable (number, or factor level)
"""

__version__ = "0.1.0"
