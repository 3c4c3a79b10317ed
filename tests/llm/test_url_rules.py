"""The explicit URL rules are those of the contract."""

from quantloom.llm import url_filter

WANT = [("http://a.net/de/8", "net/de/", "allow"), ("http://example.net/de/88", "example.net/de/8", "block"), ("http://com/en/1", "com/en/", "block"), ("http://m.example.com/en/70", "example.com/en/7", "allow"), ("http://x.org/es/1", "org/es/", "block")]


def test_words_of_the_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(WANT)], "page_id long, url string")
    got = sorted(url_filter.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect(), key=lambda r: r.page_id)
    assert [(r.rule, r.verdict) for r in got] == [(rule, verdict) for _, rule, verdict in WANT]
