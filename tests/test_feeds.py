from dossier.sources import files

RSS = "<rss><channel><item><title>Prize for Dr. Ann Lee</title><link>L</link><description>A <![CDATA[b]]></description><pubDate>Mon, 02 Jan 2023 10:00:00 GMT</pubDate></item><item><link>x</link></item><item><title>two</title></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>one</title><link href="http://h/1"/><summary>met Prof. Bo Chen</summary><updated>2024-05-06T07:08:09Z</updated></entry></feed>'


def test_feeds_of_both_kinds(spark):
    feeds = spark.createDataFrame([("r", RSS), ("a", ATOM), ("no", "<rss><item>"), ("null", None)], "k string, xml string")
    got = {(r.k, r.position): (r.title, r.link, r.summary, str(r.published), r.names) for r in files.feed_items(feeds, "k", "xml").collect()}
    assert got == {
        ("r", 0): ("Prize for Dr. Ann Lee", "L", "A b", "2023-01-02 10:00:00", ["Ann Lee"]), ("r", 1): ("two", None, None, "None", []),
        ("a", 0): ("one", "http://h/1", "met Prof. Bo Chen", "2024-05-06 07:08:09", ["Bo Chen"]),
    }
    assert files.feed_items(feeds.where("k = 'r'"), "k", "xml", 1).count() == 1


MEDIA = '<rss xmlns:media="http://m"><channel><item><media:title>M</media:title><title>T & U&nbsp;V &amp; &#65;</title><media:content>c</media:content><link>L</link></item></channel></rss>'
BROKEN = "<rss><channel><item><title>whole</title></item><item><title>brok"


def test_feeds_that_are_no_clean_xml(spark):
    feeds = spark.createDataFrame([("m", MEDIA), ("b", BROKEN), ("h", "<html><p>no feed"), ("ok", RSS), ("none", None)], "k string, xml string")
    got = {(r.k, r.position): (r.title, r.link, r.summary) for r in files.feed_items(feeds, "k", "xml").where("k <> 'ok'").collect()}
    assert got == {("m", 0): ("T & U&nbsp;V & A", "L", None), ("b", 0): ("whole", None, None)}
    assert sorted(r.k for r in files.unread_feeds(feeds, "k", "xml").collect()) == ["b", "h"]
