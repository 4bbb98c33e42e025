"""siteaudit: web-site audits over crawl snapshots, as Spark DataFrame jobs.

Everything is keyed by ``site``; any number of sites is audited in one job.
"""

from siteaudit.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
