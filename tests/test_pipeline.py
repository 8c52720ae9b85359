import json

import pytest

from pagemill.operators.analyze import analyze
from pagemill.operators.publish import publish, to_html_sql
from pagemill.operators.tasks import latest_state
from pagemill.operators.write import write
from pagemill.sources import sinks
from pagemill.sources.sinks import list_items, read_outbox, write_outbox


def _docs(spark, rows):
    return spark.createDataFrame(rows, "key bigint, title string, content string")


def _replies(spark, rows):
    return spark.createDataFrame(rows, "key bigint, response_text string, status string")


def test_analysis_branches(spark):
    docs = _docs(spark, [(1, "T1", "c"), (2, "T2", "c"), (3, "T3", "c"), (4, "T4", "c"), (5, "T5", ""),
                         (6, "T6", "c")])
    replies = _replies(spark, [(1, 'x {"summary": "s", "themes": ["a"]} y', "ok"),
                               (2, "First. Second. Third", "ok"), (3, "{bad json}", "ok"),
                               (4, "anything", "error")])
    out = {r.key: r for r in analyze(docs, replies).collect()}
    assert out[1].analysis_branch == "parsed" and json.loads(out[1].analysis_json) == {"summary": "s", "themes": ["a"]}
    assert out[2].analysis.summary == "First" and out[2].analysis.key_points == ["Second", "Third"]
    assert out[3].analysis.summary == "Analysis of: T3"            # invalid JSON ignores the text
    assert out[4].analysis.key_points == ["Main content focus", "Supporting details", "Key takeaways"]
    assert out[5].analysis_error == "No content provided"
    assert out[6].analysis_branch == "fallback_empty"                # no reply row = no model
    assert "Title: T1\n\nContent:\nc\n\n" in out[1].analysis_prompt


def test_write_defaults_and_errors(spark):
    a = spark.createDataFrame([
        (1, '{"summary": "S", "themes": ["a", "b", "c", "d", "e", "f"]}'),
        (2, '{"summary": null, "key_points": ["k"]}'),
        (3, '{"summary": "S", "key_points": [1, "x"]}'),
        (4, "{}"),
        (5, '{"summary": "S"}')], "key bigint, analysis_json string")
    replies = _replies(spark, [(1, '{"title": "T"}', "ok"), (5, '{"title": "T", "content": null}', "ok")])
    out = {r.key: r for r in write(a, replies, style=None).collect()}
    art = json.loads(out[1].article_json)
    assert art["title"] == "T" and art["content"] == "Content not generated" and art["word_count"] == 3
    assert art["tags"] == ["a", "b", "c", "d", "e", "f"] and art["summary"] == "S" and art["style"] == "professional"
    assert out[2].article_error == "'NoneType' object is not subscriptable"
    assert out[3].article_error == "sequence item 0: expected str instance, int found"
    assert out[4].article_error == "No analysis result provided"
    assert out[5].article_error == "'NoneType' object has no attribute 'split'"


def test_fallback_article_title_rules(spark):
    a = spark.createDataFrame([(1, '{"summary": "Sum", "themes": ["a", "b", "c", "d", "e", "f", "g"]}')],
                              "key bigint, analysis_json string")
    r = write(a, _replies(spark, [(1, "\n  Title:   Big news \nbody", "ok")])).collect()[0]
    art = json.loads(r.article_json)
    assert art["title"] == "Big news" and art["tags"] == ["a", "b", "c", "d", "e"] and art["word_count"] == len("\n  Title:   Big news \nbody".split())
    r = write(a, None).collect()[0]
    assert json.loads(r.article_json)["title"] == "No model available"


def test_html_rendering(spark):
    df = spark.createDataFrame([("# H\n\n## Sub\n\npara\nline\n\n#### four\n\n  \n\n### t",)], "c string")
    html = df.selectExpr(f"{to_html_sql('c')} AS h").collect()[0].h
    assert "<h1>H</h1>\n<h2>Sub</h2>\n<p>para<br>line</p>\n<p>#### four</p>\n<h3>t</h3>" in html
    assert html.startswith("\n<div style=") and html.endswith("\n</div>\n")


def test_publish_routes(spark):
    arts = spark.createDataFrame([
        (1, '{"title": "T", "content": "C", "summary": ""}', "wechat", True),
        (2, '{"title": "T", "content": "C", "summary": "S"}', "medium", False),
        (3, '{"title": "", "content": "C"}', "wechat", False),
        (4, None, "wechat", False)], "key bigint, article_json string, platform string, draft boolean")
    out = {r.key: r for r in publish(arts, author=None, draft_only="draft", platform="platform").collect()}
    assert out[1].publish_result.draft_id and out[1].payload.digest == "T"
    assert out[1].publish_result.message == "Article saved as draft successfully"
    assert out[2].publish_result.message == "Platform 'medium' not supported yet"
    assert out[3].publish_error == "Article missing required fields"
    assert out[4].publish_error == "No article provided"


def test_task_state_explicit_none_and_unknown_ids(spark):
    from datetime import datetime as dt
    allf = ["type", "status", "message", "progress", "data", "error", "completed_at", "created_at"]
    ev = spark.createDataFrame([
        ("a", 1, dt(2024, 1, 1, 0, 0, 1), "t", "processing", "early", None, None, None, None, ["status", "message"]),
        ("a", 2, dt(2024, 1, 1, 0, 0, 2), "t", "pending", "created", None, None, None, None, allf),
        ("a", 3, dt(2024, 1, 1, 0, 0, 3), None, "failed", "boom", None, "E", None, dt(2024, 1, 1, 0, 0, 3),
         ["status", "message", "error", "completed_at"]),
        ("a", 4, dt(2024, 1, 1, 0, 0, 4), None, "processing", "retry", None, None, None, None,
         ["status", "message", "error"]),
        ("b", 5, dt(2024, 1, 1, 0, 0, 5), None, "processing", "orphan", None, None, None, None, ["status"])],
        "task_id string, seq bigint, ts timestamp_ntz, type string, status string, message string, "
        "progress string, error string, data string, completed_at timestamp_ntz, set_fields array<string>")
    rows = latest_state(ev).collect()
    assert [r.task_id for r in rows] == ["a"]
    r = rows[0]
    assert (r.status, r.message, r.error, r.type) == ("processing", "retry", None, "t")  # explicit None wins
    assert r.completed_at == dt(2024, 1, 1, 0, 0, 3) and r.created_at == dt(2024, 1, 1, 0, 0, 2)


def test_html_escape_option(spark):
    df = spark.createDataFrame([("a <b> & 'c'",)], "c string")
    plain = df.selectExpr(f"{to_html_sql('c')} AS h").collect()[0].h
    esc = df.selectExpr(f"{to_html_sql('c', escape=True)} AS h").collect()[0].h
    assert "<p>a <b> & 'c'</p>" in plain and "<p>a &lt;b&gt; &amp; &#x27;c&#x27;</p>" in esc


def test_envelope_has_publish_step(spark):
    from pagemill.plans.workflow import step_envelope, url_to_publication
    req = spark.createDataFrame([(1, "http://a.com/x", "<html><body><article><p>Hello.</p></article></body></html>")],
                                "key bigint, url string, html string")
    steps = step_envelope(url_to_publication(req, author="me")).collect()
    assert [s.step for s in steps] == ["crawl", "analyze", "write", "publish"]
    assert steps[-1].status == "success" and steps[-1].metadata == {"platform": "wechat"}


def test_staged_workflow_equals_unstaged(spark):
    from pagemill.plans.workflow import url_to_article
    from pagemill.sources.tables import read_pages
    pages = read_pages(spark, "/root/testdata/sf0.001").withColumnRenamed("page_id", "key")
    cols = ["key", "success", "error", "article_json"]
    a = sorted(url_to_article(pages).select(*cols).collect())
    b = sorted(url_to_article(pages, stage=True).select(*cols).collect())
    assert a == b and len(a) == 50


def test_outcome_messages_for_publication_workflow(spark):
    from pagemill.operators.tasks import outcome_events
    res = spark.createDataFrame([("t1", 1, True, True, None, "{}"), ("t2", 2, True, False, None, "{}"),
                                 ("t3", 3, False, None, None, None), ("t4", 4, False, None, "boom", None)],
                                "task_id string, seq bigint, success boolean, publish_success boolean, "
                                "error string, workflow_json string")
    out = {r.task_id: r for r in outcome_events(res, workflow="url_to_wechat").collect()}
    assert out["t1"].message == "Article created and published successfully" and out["t1"].status == "completed"
    assert out["t2"].message == "Article created, but publishing failed" and out["t2"].data == "{}"
    assert (out["t3"].status, out["t3"].message, out["t3"].error) == ("failed", "Failed to process workflow",
                                                                      "Unknown error")
    assert out["t4"].error == "boom" and out["t4"].data is None


def test_request_validation_split(spark):
    from pagemill.sources.requests import accepted, rejected, validate_requests
    req = spark.createDataFrame([(1, "https://a.com/x", None, None, None), (2, "ftp://a.com", "news", "general", 400),
                                 (3, "http://a.com", "poetic", "kids", 100), (4, None, None, None, 6000)],
                                "id bigint, url string, article_style string, target_audience string, word_count bigint")
    v = validate_requests(req)
    ok = {r.id: r for r in accepted(v).collect()}
    bad = {r.id: r.errors for r in rejected(v).collect()}
    assert list(ok) == [1] and (ok[1].article_style, ok[1].target_audience, ok[1].word_count) == ("professional", "general", 1000)
    assert bad[2] == ["url: URL scheme should be 'http' or 'https'"]
    assert len(bad[3]) == 3 and bad[4] == ["url: Field required", "word_count: Input should be less than or equal to 5000"]


def test_hot_key_is_split_with_both_replies(spark):
    """90% of the requests on one key, replies of both steps: one join, its hot partition split."""
    from pagemill.operators.responses import PAIR, attach_reply_pair
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(0, 60_000, 1, 8).selectExpr("IF(id % 10 < 9, 0L, id) AS key", "CAST(id AS STRING) AS title", "sha2(CAST(id AS STRING), 512) AS content")
        first, second = (docs.where("CAST(title AS LONG) % 3 = 1").selectExpr("key", f"concat('{x} ', title, '. b') AS response_text", "'ok' AS status") for x in "ab")
        a = analyze(attach_reply_pair(docs, first, second, "key"), PAIR[0], with_prompt=False)
        w = write(a, PAIR[1], with_prompt=False).select("key", "article_json")
        assert w.count() == 60_000
        w.write.format("noop").mode("overwrite").save()
        w.collect()
        plan = w._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("SortMergeJoin(skew=true)") == 1 and final.count("SortMergeJoin") == 1
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_listing_by_key(spark):
    from pagemill.sources.sinks import list_items
    box = spark.createDataFrame([(f"i{k}", "news", k % 7 > 0, None if k % 5 == 0 else k // 3) for k in range(60)],
                                "item_id string, kind string, success boolean, seq bigint")
    whole = [(r.seq, r.item_id) for r in list_items(box, count=60).collect()]
    got, last = [], None
    while page := [(r.seq, r.item_id) for r in list_items(box, count=7, after=last).collect()]:
        got += page
        last = page[-1]
    assert got == whole and len(whole) == 51


def test_cluster_needs_a_shared_folder(tmp_path):
    import pytest
    from pagemill.session import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_outbox_keeps_batches(spark, tmp_path, fmt):
    def published(*titles):
        rows = [(i, json.dumps({"title": t, "content": "C"}) if t else None) for i, t in enumerate(titles)]
        return publish(spark.createDataFrame(rows, "key int, article_json string"))

    path = str(tmp_path / "box")
    assert write_outbox(published("T1", None), path, fmt, "key") == 2
    assert write_outbox(published("T2", "T2"), path, fmt, "key", batch="two") == 2
    assert write_outbox(published("T2", "T3"), path, fmt, batch="two") == 0  # committed under this name
    assert write_outbox(published("T1", None), path, fmt, "key") == 0  # known rows, under a new name
    assert sorted(str(r.title) for r in read_outbox(spark, path, fmt).collect()) == ["None", "T1", "T2", "T2"]
    # a batch that broke off before its commit is not seen, and can be done again
    sinks.outbox_rows(published("T9")).selectExpr("*", "'x' AS row_id").write.partitionBy("draft_only").format(fmt).save(f"{path}/items/batch=b-late")
    assert read_outbox(spark, path, fmt).count() == 4
    assert write_outbox(published("T9"), path, fmt, batch="late") == 1
    assert sorted(r["items"] for r in sinks.committed_batches(spark, path).collect()) == [0, 1, 2, 2]
    assert [r.title for r in list_items(read_outbox(spark, path, fmt)).collect()].count("T9") == 1
