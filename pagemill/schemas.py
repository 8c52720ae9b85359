"""Target schemas of the pipeline (DDL strings, usable with from_json and
readStream.schema)."""

PAGE_IN = "page_id BIGINT, url STRING, html STRING"

STRUCTURE = "type STRING, sections ARRAY<STRING>, flow STRING"

ANALYSIS = ("summary STRING, key_points ARRAY<STRING>, themes ARRAY<STRING>, "
            f"sentiment STRING, structure STRUCT<{STRUCTURE}>, recommendations ARRAY<STRING>")

ARTICLE = ("title STRING, content STRING, summary STRING, tags ARRAY<STRING>, "
           "word_count BIGINT, style STRING")

PUBLISH = ("success BOOLEAN, platform STRING, article_id STRING, article_url STRING, "
           "draft_id STRING, message STRING")

# Enumerations of the request models.
STYLES = ["professional", "casual", "news"]
AUDIENCES = ["general", "technical", "business"]
