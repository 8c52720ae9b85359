"""DataFrame -> DataFrame pipeline steps: crawl, analyze, write, publish, tasks."""
