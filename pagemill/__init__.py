"""pagemill: web pages to publish-ready articles as Spark DataFrame jobs.

Every public step is ``DataFrame -> DataFrame`` (chain with
``df.transform``)::

    from pagemill import crawl, analyze, write, publish
    articles = (pages.transform(crawl)
                     .transform(lambda d: analyze(d, replies, key="page_id"))
                     .transform(lambda d: write(d, None, key="page_id"))
                     .transform(publish))
"""

from .operators.analyze import analyze
from .operators.crawl import crawl
from .operators.publish import publish
from .operators.tasks import create_events, latest_state, outcome_events, result_view, status_view
from .operators.write import write
from .plans.workflow import result_preview, step_envelope, url_to_article, url_to_publication
from .sources.requests import validate_requests
from .sources.sinks import list_items, read_outbox, write_outbox, write_results

__version__ = "0.1.0"

__all__ = ["analyze", "crawl", "create_events", "latest_state", "list_items", "outcome_events", "publish",
           "read_outbox", "result_preview", "result_view", "status_view", "step_envelope", "url_to_article",
           "url_to_publication", "validate_requests", "write", "write_outbox", "write_results"]
