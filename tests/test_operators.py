"""Known answers and cases that the tables can't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybreak.functions import category, text, times, urls
from daybreak.operators import cluster, dedupe, dwell, score, state
from daybreak.sources import html, items


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scores_kinds_and_sections(spark):
    schema = "id string, kind string, tier string, saved boolean, unresolved boolean, future boolean"
    data = [("a", "document", None, False, False, True), ("b", "document", None, False, True, False), ("c", "feed_item", "primary", False, False, False), ("d", "note", None, True, False, False), ("e", "feed_item", "trusted_secondary", False, False, False), ("f", "note", None, False, False, False)]
    out = {r.id: (r.score, r.section) for r in score.scored(spark.createDataFrame(data, schema)).collect()}
    assert out == {"a": (4.0, "today"), "b": (3.0, "followup"), "c": (2.0, "feed_updates"), "d": (1.5, "resurface"), "e": (1.0, "feed_updates"), "f": (0.0, "incoming")}


def test_classifier_precedence(spark):
    df = spark.createDataFrame([("tesla", "Photo", "ev", True, ["llm"]), ("tesla", "nonsense", "ev", True, ["llm"]), ("tesla", None, None, True, ["llm"]), ("tesla", None, None, False, ["x", "llm"]), ("my tesla", None, None, False, []), ("every", None, None, False, None), ("none", None, None, None, None)], "t string, e string, h string, s boolean, c array<string>")
    got = [r.x for r in df.select(category.classify(F.col("t"), F.col("e"), F.col("h"), F.col("s"), F.col("c")).alias("x")).collect()]
    assert got == ["camera", "car", "schedule", "ai", "car", "car", "it"]
    word = df.where("t = 'every'").select(category.classify(F.col("t"), whole_words=True).alias("x")).first().x
    assert word == "it"


def test_ledger_is_idempotent(spark):
    batch = spark.createDataFrame([("s", "u1", "f1", 1, "a"), ("s", "u1", "f2", 2, "b"), ("s", "u2", "f3", 3, "c")], "source string, identity string, fingerprint string, pos long, id string")
    first = dedupe.ledger_diff(batch, dedupe.ledger_state(batch.limit(0).withColumn("seq", F.col("pos"))))
    assert [r.id for r in first.orderBy("pos").collect()] == ["a", "c"]
    assert dedupe.ledger_diff(batch, dedupe.ledger_state(first.withColumn("seq", F.col("pos")))).count() == 0


def test_heaviest_wins_keeps_first_of_ties(spark):
    df = spark.createDataFrame([(1, "u", 5), (2, "u", 9), (3, "u", 9), (4, None, 1)], "pos int, url string, w int")
    out = dedupe.heaviest_wins(df, "url", F.col("w"), "pos").orderBy("keyed", "first_pos").collect()
    assert [(r.pos, r.first_pos) for r in out] == [(4, 4), (2, 1)]


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "9", "conv-10", "conv-2", "abc")], "raw string")
    assert [r.raw for r in df.orderBy(times.natural_key(F.col("raw"))).collect()] == ["abc", "conv-2", "conv-10", "9", "10"]


def test_cooldown_is_inclusive(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate((0, 1800, 3600, 3661))], "k string, sec long, event_id long")
    assert rows(state.greedy_cooldown(df, ["k"], "sec", "event_id", 60)) == [("k", 0), ("k", 3)]
    assert spark.range(1).select(times.cooldown_expiry(F.lit(5), F.lit(0))).first()[0] == 5


def test_suppression_boundary(spark):
    h = spark.createDataFrame([("f", "a", "active", False, 10), ("f", "b", "active", False, 9), ("f", "c", "active", True, None), ("f", "d", "dismissed", False, None), ("g", "e", "active", False, None), ("f", "g", "active", False, None)], "family string, subject string, status string, superseded boolean, expires_at int")
    assert rows(state.active_suppressions(h, "f", F.lit(10))) == [("a",), ("g",)]


def test_state_machines_reject(spark):
    df = spark.createDataFrame([("pending", "approve"), ("approved", "complete"), ("approved", "fail"), ("pending", "complete"), ("executed", "approve")], "s string, c string")
    assert [r[0] for r in df.select(state.transition(F.col("s"), F.col("c"), state.APPROVAL)).collect()] == ["approved", "executed", "failed", None, None]


def test_balanced_chunks_of_equal_items(spark):
    df = spark.range(101).select(F.lit("g").alias("g"), F.col("id").alias("pos"), F.lit(7).alias("tokens"))
    sizes = [r["count"] for r in cluster.balanced_chunks(df, "g", "pos", "tokens", 50).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [34, 34, 33]


def test_greedy_clusters_grow_but_never_merge(spark):
    df = spark.createDataFrame([("g", 1, ["a"]), ("g", 2, ["b"]), ("g", 3, ["a", "b", "c"]), ("g", 4, ["c"]), ("g", 5, ["b"]), ("g", 6, [])], "g string, pos long, tokens array<string>")
    assert [(r.pos, r.cluster) for r in cluster.greedy_clusters(df, "g", "pos", "tokens").orderBy("pos").collect()] == [(1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (6, 2)]


def test_message_split_prefers_late_markers():
    assert cluster.message_chunks("a" * 10, 20) == ["a" * 10]
    assert cluster.message_chunks("a" * 12 + "\n\n" + "b" * 12, 16) == ["a" * 12, "b" * 12]
    assert cluster.message_chunks("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]


def test_text_kernels(spark):
    df = spark.createDataFrame([("Key: a\nno\n key : b:c",)], "t string")
    assert df.select(text.key_values(F.col("t"))).first()[0] == {"key": "b:c"}
    assert spark.range(1).select(text.truncate(F.lit("ab  cdefgh"), 5)).first()[0] == "ab c…"
    assert spark.range(1).select(text.slug_title(F.lit("https://x.example/a/big-news_item/?q=1"))).first()[0] == "Big news item"
    assert spark.range(1).select(text.reset_date(F.lit("until 2024-05-06, ok"))).first()[0] == "2024-05-06"
    assert spark.range(1).select(urls.on_domain(F.lit("https://A.Example.com/x"), F.lit("example.com")), urls.on_domain(F.lit("nourl"), F.lit("x"))).first()[:] == (True, False)


RSS = """<rss><channel><item><guid>g1</guid><title>One</title><link>https://a.example/1</link><pubDate>p</pubDate></item><item><title>Two</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e</id><title>T</title><link href="https://a.example/t"/><updated>u</updated></entry></feed>"""


def test_feeds_isolate_broken_payloads(spark):
    registry = spark.createDataFrame([("r", "a.example"), ("t", "a.example"), ("x", "a.example")], "source string, domain string")
    payloads = spark.createDataFrame([("r", RSS), ("t", ATOM), ("x", "<broken")], "source string, payload string")
    assert [(r.source, r.rank, r.item_id, r.url) for r in items.feed_items(registry, payloads).orderBy("source", "rank").collect()] == [("r", 1, "r:g1", "https://a.example/1"), ("r", 2, "r:Two", None), ("t", 1, "t:e", "https://a.example/t")]
    assert [r.source for r in items.feed_errors(payloads).collect()] == ["x"]


def _sitemap(kind, locs):
    inner = "url" if kind == "urlset" else "sitemap"
    return f"<{kind} xmlns='s'>" + "".join(f"<{inner}><loc>{x}</loc></{inner}>" for x in locs) + f"</{kind}>"


def test_sitemap_ranks_have_gaps(spark):
    registry = spark.createDataFrame([("s", "a.example")], "source string, domain string")
    payloads = spark.createDataFrame([("s", _sitemap("urlset", ["https://b.example/x", "https://a.example/my-page"]))], "source string, payload string")
    assert [tuple(r) for r in items.sitemap_items(registry, payloads).collect()] == [("s", 2, "https://a.example/my-page", "My page")]


def test_nested_sitemaps_share_one_budget(spark):
    urls_of = lambda k: [f"https://a.example/{k}/{i}" for i in range(15)]
    payloads = spark.createDataFrame([("root", _sitemap("sitemapindex", ["one", "two", "root"])), ("one", _sitemap("urlset", urls_of(1))), ("two", _sitemap("urlset", urls_of(2)))], "url string, payload string")
    out = items.sitemap_index(spark.createDataFrame([("s", "root")], "source string, url string"), payloads, rounds=3).orderBy("pos").collect()
    assert len(out) == 20 and out[0].url == "https://a.example/1/0" and out[-1].url == "https://a.example/2/4"


def test_search_results_are_unwrapped_and_ranked_densely(spark):
    page = '<a class="result__a" href="//other.example/x">Off</a><a class="result__a" href="//search.example.com/l/?uddg=https%3A%2F%2Fa.example%2Fp">On <b>it</b></a><span class="result__snippet">S</span>'
    registry = spark.createDataFrame([("s", "a.example")], "source string, domain string")
    out = items.search_items(registry, spark.createDataFrame([("s", page)], "source string, html string")).collect()
    assert [tuple(r) for r in out] == [("s", 1, "On it", "https://a.example/p", "S")]


def test_news_json_skips_what_is_broken(spark):
    payload = '[{"u":"https://a.example/x-y","t":"","c":["a",null]},3,{"t":"no address"}]'
    out = items.news_items(spark.createDataFrame([("s", payload)], "source string, payload string")).collect()
    assert [(r.rank, r.title, r.categories) for r in out] == [(1, "X y", ["a"])]


def test_article_text_hides_scripts_and_is_cut():
    assert html.article_text("<head><title>T</title></head><p>One &amp;amp; two</p><script>x</script><p>Three</p>") == "One & two Three"
    assert html.article_text("<p>one <b>two</b>three</p><p>four\u3000five</p>") == "one two three four five"
    assert len(html.article_text("<p>" + "a" * 2000 + "</p>")) == 1200
    assert html.article_text(None) is None and html.page_links(None, None) == []


def test_walking_and_standing(spark):
    schema = "user_id long, event_id long, sec long, lat double, lon double, accuracy double, velocity double"
    walk = [(1, i, 1000 + 180 * i, 35 + 0.001 * i, 139.0, None, v) for i, v in enumerate((1.3, 1.4, 1.5))]
    out = dwell.walking_segments(spark.createDataFrame(walk, schema)).collect()
    assert [(r.user_id, r.minutes) for r in out] == [(1, 6)]
    fast = [(2, i, 1000 + 180 * i, 35 + 0.01 * i, 139.0, None, None) for i in range(3)]
    assert dwell.walking_segments(spark.createDataFrame(fast, schema)).count() == 0
    coarse = [(3, i, 1000 + 330 * i, 35 + 0.005 * (i % 2), 139.0, 1000.0, None) for i in range(3)]
    assert [r.minutes for r in dwell.stationary_clusters(spark.createDataFrame(coarse, schema)).collect()] == [11]


def test_upsert_keeps_old_cursor_where_new_is_null(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "id string, cursor int, polled int")
    new = spark.createDataFrame([("a", None, 30), ("c", 5, None)], "id string, cursor int, polled int")
    assert rows(state.upsert(old, new, "id", ("cursor",))) == [("a", 1, 30), ("b", 2, 20), ("c", 5, None)]
