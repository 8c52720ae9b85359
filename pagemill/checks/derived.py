"""Derived check inputs (FIXTURES.md section C).

The driver tables do not reach every branch (no <img>, no <meta> beyond
charset, links only in <nav>, no JSON replies). Each derived input is one
SQL expression over a driver table that both Spark SQL and DuckDB accept
verbatim, so the Spark query and its oracle see identical strings.
"""

ID = "CAST(page_id AS STRING)"

# page_id % 8 -> one image shape inside the article
IMG_HTML = (
    "replace(html, '</article>', CASE page_id % 8 "
    f"WHEN 0 THEN '<img src=\"img/p' || {ID} || '.png\">' "
    f"WHEN 1 THEN '<img alt=\"x\" src=\"https://cdn.example.com/a/' || {ID} || '.JPG\">' "
    f"WHEN 2 THEN '<img src=\"\" data-src=\"/media/' || {ID} || '.webp\">' "
    f"WHEN 3 THEN '<img data-original=' || chr(39) || '../pics/' || {ID} || '.jpeg' || chr(39) || '>' "
    f"WHEN 4 THEN '<img src=\"/t/pixel.gif?id=' || {ID} || '\">' "
    "WHEN 5 THEN '<img src=\"/shop/catalogo.jpg\">' "
    f"WHEN 6 THEN '<img src=\"/render?id=' || {ID} || '&amp;w=300\">' "
    f"ELSE '<img src=\"a/' || {ID} || '.gif\"><p>x</p><img src=\"./a/' || {ID} || '.gif\">' END "
    "|| '</article>')")

# page_id % 14 -> one reference from the URL-resolution vectors, outside nav,
# plus one absolute link every page has
_LINK_REFS = ["#top", "?z=2", "z", "../z", "//b.com/k", "HTTP://B.com/k", "HTTPS://B.com/k",
              "/a/./b/../c", "../../../z", "http:foo", " /sp ", "javascript:void(0)",
              "mailto:a@b", "http://[bad/"]
LINK_HTML = (
    "replace(html, '</article>', '<p><a href=\"' || CASE page_id % 14 "
    + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_LINK_REFS))
    + f" END || '\">ref</a> <a href=\"https://ext.example.com/p/' || {ID} || '\">ext</a></p></article>')")

# bits of page_id % 16 choose description / author / keywords / published
# time; page_id % 5 = 0 puts an empty description first (the key is then
# absent even though a later tag has a value)
META_HTML = (
    "replace(html, '</head>', "
    "CASE WHEN page_id % 5 = 0 THEN '<meta name=\"description\" content=\"\">' ELSE '' END || "
    f"CASE WHEN page_id % 2 = 1 THEN '<meta name=\"description\" content=\"About ' || {ID} || ' &amp; more\">' ELSE '' END || "
    f"CASE WHEN page_id % 4 >= 2 THEN '<meta content=' || chr(39) || 'Author ' || {ID} || chr(39) || ' name=' || chr(39) || 'author' || chr(39) || '>' ELSE '' END || "
    f"CASE WHEN page_id % 8 >= 4 THEN '<meta name=\"keywords\" content=\" k' || {ID} || ', news \">' ELSE '' END || "
    f"CASE WHEN page_id % 16 >= 8 THEN '<meta property=\"article:published_time\" content=\"2024-01-' || {ID} || '\">' ELSE '' END || "
    "'</head>')")

# page_id % 5: normal / og:title only / h1 inside <header> / blank title / none
TITLE_HTML = (
    "CASE page_id % 5 WHEN 0 THEN html "
    f"WHEN 1 THEN regexp_replace(html, '<title>[^<]*</title>', '<meta property=\"og:title\" content=\" OG ' || {ID} || ' \">') "
    f"WHEN 2 THEN replace(regexp_replace(html, '<title>[^<]*</title>', ''), '<body>', '<body><header><h1>Head <b>' || {ID} || '</b></h1></header>') "
    "WHEN 3 THEN regexp_replace(html, '<title>[^<]*</title>', '<title>   </title>') "
    "ELSE replace(replace(regexp_replace(html, '<title>[^<]*</title>', ''), '<h1>', '<h2>'), '</h1>', '</h2>') END")

# page_id % 6: article / main / body only / main before article /
# empty article first / no body element
CONTAINER_HTML = (
    "CASE page_id % 6 WHEN 0 THEN html "
    "WHEN 1 THEN replace(replace(html, '<article>', '<main>'), '</article>', '</main>') "
    "WHEN 2 THEN replace(replace(html, '<article>', ''), '</article>', '') "
    f"WHEN 3 THEN replace(html, '<article>', '<main><p>Main ' || {ID} || '</p></main><article>') "
    "WHEN 4 THEN replace(html, '<body>', '<body><article></article>') "
    "ELSE replace(replace(replace(replace(html, '<body>', ''), '</body>', ''), '<article>', ''), '</article>', '') END")

DOC = "CAST(doc_id AS STRING)"

# documents.doc_id % 7 -> an analysis reply: valid object inside prose,
# missing keys, null values, two objects, invalid JSON, '}' before '{',
# no braces at all
ANALYSIS_REPLY = (
    "CASE doc_id % 7 "
    f"WHEN 0 THEN 'Here is my analysis: {{\"summary\": \"Summary of document ' || {DOC} || '\", "
    "\"key_points\": [\"Point A\", \"Point B\"], \"themes\": [\"Theme ' || " + DOC + " || '\", \"Data\"], "
    "\"sentiment\": \"positive\", \"structure\": {\"type\": \"report\", \"sections\": [\"intro\", \"end\"], "
    "\"flow\": \"linear\"}, \"recommendations\": [\"Add data\"]} Hope it helps.' "
    f"WHEN 1 THEN '{{\"summary\": \"Only a summary ' || {DOC} || '\"}}' "
    "WHEN 2 THEN '{\"summary\": null, \"key_points\": [\"k\"], \"themes\": null}' "
    "WHEN 3 THEN '{\"summary\": \"a\"} and {\"summary\": \"b\"}' "
    f"WHEN 4 THEN '{{summary: ' || {DOC} || '}}' "
    f"WHEN 5 THEN 'Closing }} first. Then an opening {{ brace. Reply ' || {DOC} "
    f"ELSE 'First sentence ' || {DOC} || '. Second one. Third. Fourth. Fifth' END")

# documents.doc_id % 7 -> an article reply of the same shapes
ARTICLE_REPLY = (
    "CASE doc_id % 7 "
    f"WHEN 0 THEN 'Sure! {{\"title\": \"Title ' || {DOC} || '\", \"content\": \"Body of article ' || {DOC} || "
    "' in six words\", \"summary\": \"Short\", \"tags\": [\"t1\", \"t2\"], \"word_count\": 6} Done.' "
    f"WHEN 1 THEN '{{\"title\": \"Only a title ' || {DOC} || '\"}}' "
    "WHEN 2 THEN '{\"title\": \"T\", \"content\": null}' "
    "WHEN 3 THEN '{\"title\": \"a\"} and {\"title\": \"b\"}' "
    f"WHEN 4 THEN '{{title: ' || {DOC} || '}}' "
    f"WHEN 5 THEN 'Title: Reply ' || {DOC} || ' }} then {{' "
    f"ELSE '  ' || chr(10) || 'TITLE:  Headline ' || {DOC} || chr(10) || 'Body line one.' || chr(10) || chr(10) "
    "|| '  Body line two. ' END")

REPLY_STATUS = "CASE WHEN doc_id % 13 = 5 THEN 'error' ELSE 'ok' END"

# per-row writing options; 'poetic' and 'children' are unknown names
STYLE = "CASE doc_id % 4 WHEN 0 THEN 'professional' WHEN 1 THEN 'casual' WHEN 2 THEN 'news' ELSE 'poetic' END"
AUDIENCE = "CASE doc_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'technical' WHEN 2 THEN 'business' ELSE 'children' END"
WORDS = "CAST(300 + (doc_id % 10) * 500 AS BIGINT)"

# markdown-ish article text: paragraphs split by blank lines and a heading
# level chosen by doc_id % 5 (level 4 is not a heading)
MD_TEXT = ("concat(CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '# ' WHEN 2 THEN '## ' WHEN 3 THEN '### ' "
           "ELSE '#### ' END, replace(text, chr(10), chr(10) || chr(10)))")

# per-row publishing options
AUTHOR = "concat('Desk ', CAST(doc_id % 3 AS STRING))"
DRAFT = "(doc_id % 2 = 0)"
PLATFORM = "CASE WHEN doc_id % 5 = 4 THEN 'medium' ELSE 'wechat' END"

# the task log with the signups of users where user_id % 7 = 0 turned into
# plain updates: those ids are never created, so all their updates must be
# ignored (every event row is kept)
TASK_LOG_EVENT_TYPE = "CASE WHEN event_type = 'signup' AND user_id % 7 = 0 THEN 'view' ELSE event_type END"

# url-to-article requests from pages: options by page_id, some missing
# (-> defaults), some out of range or unknown, some URLs non-http or absent
REQ_URL = ("CASE WHEN page_id % 9 = 4 THEN replace(url, 'http', 'ftp') WHEN page_id % 9 = 8 THEN NULL "
           "ELSE url END")
REQ_STYLE = ("CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'casual' WHEN 2 THEN 'news' "
             "WHEN 3 THEN 'professional' ELSE 'poetic' END")
REQ_AUDIENCE = "CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'technical' WHEN 2 THEN 'business' ELSE 'general' END"
REQ_WORDS = ("CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 250 WHEN 2 THEN 5001 "
             "ELSE 300 + (page_id * 7) % 4701 END")
REQ_IMAGES = "CASE WHEN page_id % 3 = 1 THEN false END"
REQ_LINKS = "CASE WHEN page_id % 3 = 2 THEN false END"

# page_id % 4: the article becomes a [role="main"] div, a ".content"
# section (class token among others), a ".post-content" div (single
# quotes), or a "#content" div
CONTAINER_ATTR_HTML = (
    "CASE page_id % 4 "
    "WHEN 0 THEN replace(replace(html, '<article>', '<div role=\"main\">'), '</article>', '</div>') "
    "WHEN 1 THEN replace(replace(html, '<article>', '<section class=\"post content wide\">'), '</article>', '</section>') "
    "WHEN 2 THEN replace(replace(html, '<article>', '<div class=' || chr(39) || 'post-content' || chr(39) || '>'), "
    "'</article>', '</div>') "
    "ELSE replace(replace(html, '<article>', '<div id=\"content\">'), '</article>', '</div>') END")
