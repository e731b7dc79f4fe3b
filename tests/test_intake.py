"""Readers of exports, registries and ledgers, pages by HTTP, summaries, and the whole run loop."""

from __future__ import annotations

import gzip
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from daybreak import engine, profiles, store, summary
from daybreak.functions import text, times
from daybreak.operators import cluster
from daybreak.sources import exports, fetch, html
from daybreak.sources import items as sources


def node(role, content, at=None):
    return {"message": {"author": {"role": role}, "content": content, **({"create_time": at} if at is not None else {})}}


def test_conversation_export(spark, tmp_path):
    mapping = {
        "a": node("User", {"parts": [" one ", "", 3, "two"]}, 5),
        "b": {**node("assistant", {"text": {"value": " v "}}), "create_time": 4.5},
        "c": node("tool", "plain", "9"),
        "d": node("", "no role", 1),
        "e": node("user", {"parts": ["  "], "text": " t "}),
        "f": None,
        "g": {"message": None},
        "h": node("user", {"parts": []}, 2),
    }
    rows = [{"id": "c1", "title": "T", "create_time": 1700000000, "mapping": mapping}, {"conversation_id": "c2", "mapping": []}, {"title": "no id"}]
    folder = tmp_path / "export" / "deep"
    folder.mkdir(parents=True)
    (folder / "conversations.json").write_text(json.dumps(rows))
    got = {r.id: r for r in exports.read_conversations(spark, f"file://{tmp_path}/export").collect()}
    assert set(got) == {"c1", "c2"} and got["c2"].body is None and got["c2"].message_count == 0
    assert got["c1"].body == "\n\n".join(["assistant: v", "user: one\n\ntwo", "tool: plain", "user: t"]) and got["c1"].created_at == "2023-11-14T22:13:20Z"


def test_response_export(spark, tmp_path):
    (tmp_path / "responses").mkdir()
    (tmp_path / "conversations.index.json").write_text(json.dumps({"conversations": [{"conversationId": "x", "title": "T", "modifyTime": "m"}, {"id": "y"}, {"title": "none"}]}))
    (tmp_path / "responses" / "x.responses.json").write_text(json.dumps({"responses": [{"sender": "Human", "message": " hi "}, {"message": "  "}, {"message": "yo"}]}))
    got = {r.id: r for r in exports.read_responses(spark, f"file://{tmp_path}").collect()}
    assert got["x"].body == "human: hi\n\nunknown: yo" and got["x"].response_count == 3 and got["y"].body is None and got["y"].response_count == 0
    assert got["x"].acquisition_mode == "browser_automation_experimental"
    (tmp_path / "manifest.json").write_text(json.dumps({"acquisition_mode": "local_browser_history"}))
    assert exports.read_responses(spark, f"file://{tmp_path}").first().acquisition_mode == "local_browser_history"


def test_session_items(spark):
    rows = spark.createDataFrame([('{"id":"s","title":"T","summary":"B"}',), ("not json",)], "payload string")
    assert [tuple(r)[:3] for r in exports.session_items(rows).collect()] == [("s", "T", "B")]


def test_registry_with_include_and_only_ids(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("sources:\n- {id: a, title: A}\n- {id: b, title: B, topical_scopes: car}\n")
    (tmp_path / "own.yaml").write_text("include: base.yaml\nsources:\n- {id: c, title: C, category_hint: ai}\n- {id: a, title: A2}\n")
    rows = exports.load_registry(spark, f"file://{tmp_path}/own.yaml")
    assert [(r.id, r.title) for r in rows.collect()] == [("a", "A2"), ("b", "B"), ("c", "C")]
    (tmp_path / "only.yaml").write_text("include: [base.yaml, own.yaml]\nonly_ids: [c, a]\n")
    rows = exports.load_registry(spark, f"file://{tmp_path}/only.yaml")
    assert [(r.id, r.title) for r in rows.collect()] == [("c", "C"), ("a", "A2")]
    assert {r.id: r.m for r in exports.load_registry(spark, f"file://{tmp_path}/own.yaml").select("id", exports.category_metadata().alias("m")).collect()} == {"a": {}, "b": {"topical_scopes": "car"}, "c": {"category_hint": "ai"}}


def test_ledger_round_trip(spark, tmp_path):
    rows = [("1", "s", "k", "a\u2028b\nc", "2024-01-02T00:00:00Z"), ("2", "s", "k", "d", "2024-01-01T00:00:00Z"), ("3", "t", "k", "e", "2024-01-03T00:00:00Z")]
    exports.write_ledger(spark.createDataFrame(rows, "id string, source string, source_kind string, title string, retrieved_at string"), f"file://{tmp_path}/ledger")
    (tmp_path / "ledger" / "broken.txt").write_text('{"id": \n\n{"id": "4", "source": "s", "source_kind": "k"}\n')
    got = exports.read_ledger(spark, f"file://{tmp_path}/ledger", end="2024-01-03").collect()
    assert [(r.id, r.title) for r in got] == [("2", "d"), ("1", "a\u2028b\nc")]
    assert [r.id for r in exports.read_ledger(spark, f"file://{tmp_path}/ledger", "2024-01-01T12:00:00Z").collect()] == ["1", "3"]


def test_newest_export_archive_and_its_guard(spark, tmp_path):
    def archive(rows):
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("x/conversations.json", json.dumps(rows))
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("deep/Conversations__1.zip", inner.getvalue())
        return outer.getvalue()

    files = spark.createDataFrame([("/d/ChatGPT-1.zip", 1), ("/d/chatgpt-2.zip", 2), ("/d/other.zip", 9), ("/d/chatgpt-3.txt", 9), ("/d/chatgpt-1b.zip", 2)], "path string, modificationTime long")
    assert exports.latest_export(files).first().path == "/d/chatgpt-2.zip"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my-chatgpt.zip").write_bytes(archive([{"id": "a"}, {"id": "b"}]))
    out = f"file://{tmp_path}/out"
    assert exports.prepare_export(spark, f"file://{tmp_path}/in", out)["conversation_count"] == 2
    (tmp_path / "in" / "my-chatgpt.zip").write_bytes(archive([]))
    again = exports.prepare_export(spark, f"file://{tmp_path}/in", out)
    assert again["import_status"] == "skipped_empty_export" and again["conversation_count"] == 2
    assert exports.read_conversations(spark, out).count() == 2


def test_signals(spark):
    with pytest.raises(ValueError, match="unknown post signal: stars"):
        exports.signal_posts({"stars": spark.createDataFrame([], "payload string")})


def test_pages_by_http(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if self.path == "/none" else 200)
            self.end_headers()
            body = f"page {self.path}".encode()
            self.wfile.write(gzip.compress(body) if "zip" in self.path else body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = {r.url: r for r in fetch.fetched(spark.createDataFrame([(f"{base}/a",), (f"{base}/zip",), (f"{base}/é",), (f"{base}/none",)], "url string")).collect()}
    server.shutdown()
    assert got[f"{base}/a"].payload == "page /a" and got[f"{base}/zip"].payload == "page /zip" and got[f"{base}/é"].payload == "page /%C3%A9"
    assert got[f"{base}/none"].payload is None and "404" in got[f"{base}/none"].error


def test_links_below_a_prefix():
    page = '<a href="/news/1">x</a><a href="/about">y</a><a href="/news/1">z</a><a href="http://[bad">b</a>'
    assert html.page_links(page, "https://a.example/", "/news/") == ["https://a.example/news/1"]


def test_enriched_and_direct_items(spark):
    items = spark.createDataFrame([("u1", "old"), ("u2", "kept")], "url string, body string")
    pages = spark.createDataFrame([("u1", "<head><title>t</title></head><p>Article</p>")], "url string, html string")
    assert sorted(tuple(r) for r in sources.enriched(items, pages).select("url", "body").collect()) == [("u1", "Article"), ("u2", "kept")]
    rows = spark.createDataFrame([("s", "a.example", ["https://b.example/x", "https://www.a.example/some-page"])], "source string, domain string, urls array<string>")
    assert [tuple(r) for r in sources.direct_items(rows).collect()] == [("s", 2, "https://www.a.example/some-page", "Some page")]


def test_greedy_clusters_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", F.split(F.substring("text", 1, 40), " ").alias("tokens"))
    got = {(r.source, r.doc_id): (r.cluster, r.place) for r in cluster.greedy_clusters(docs, "source", "doc_id", "tokens").collect()}
    by = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        by.setdefault(r.source, []).append((r.doc_id, set(r.tokens or ())))
    for source, rows in by.items():
        clusters = []
        for doc, tokens in rows:
            at = next((k for k, (_, known) in enumerate(clusters) if known & tokens), None)
            if at is None:
                clusters.append(([doc], set(tokens)))
            else:
                clusters[at][0].append(doc)
                clusters[at][1].update(tokens)
        place = 0
        for k, (members, _) in enumerate(clusters):
            for doc in members:
                assert got[source, doc] == (k, place)
                place += 1


def test_message_chunks_by_definition():
    import random

    rng = random.Random(5)
    for _ in range(2000):
        body = "".join(rng.choice(["word", " ", "\n", "\n\n", "\n- ", "\n# "]) for _ in range(rng.randrange(40)))
        limit = rng.randrange(6, 40)
        parts = cluster.message_chunks(body, limit)
        assert all(len(p) <= limit for p in parts) and "".join("".join(parts).split()) == "".join(body.split())


def test_signature_takes_host_path_and_texts(spark):
    row = spark.createDataFrame([("Launch of GPT 2024 news", "https://A.example/first/Model-x9?q=zzz")], "t string, u string")
    assert row.select(cluster.signature(F.col("t"), url=F.col("u")).alias("s")).first().s == ["gpt", "host:a.example", "path:model"]


def test_titles_and_subjects(spark):
    row = spark.range(1).select(text.clean_title(F.lit(" A - Grok "), "Grok").alias("a"), text.clean_title(F.lit("  "), "Grok").alias("b"), text.subject_key(F.lit("s"), F.lit('q"')).alias("c"))
    assert tuple(row.first()) == ("A", None, '["s","q\\""]')
    assert times.default_occurrence("x") == "x" and times.default_occurrence().endswith("Z") and times.archive_label(None, "2024-01-02T03:04:05Z") == "2024-01-02"


def test_summaries_keep_links(spark):
    rows = [(k, "s", "feed_item", f"OpenAI model {k}", "about gpt", f"https://a.example/{k}") for k in range(5)] + [(9, "s", "feed_item", "BMW", "a car", "https://b.example/9")]
    items = spark.createDataFrame(rows, "pos long, source string, kind string, title string, body string, url string")

    def run(prompt):
        if "category car" in prompt:
            return "no link"
        return "\n".join(x for x in prompt.split("\n") if x.startswith("- "))

    out = summary.summarise(items, run, size=3)
    assert list(out) == ["ai", "car"] and "[BMW](https://b.example/9)" in out["car"] and all(f"https://a.example/{k}" in out["ai"] for k in range(5))
    calls = {r.category: r.calls for r in summary.summary_tree(items, run, size=3).collect()}
    assert calls == {"ai": 3, "car": 2}  # two parts and a merge; one part, asked for twice
    deep = summary.summary_tree(items, run, size=1, fan=2).collect()
    assert {r.category: r.calls for r in deep} == {"ai": 5 + 2 + 1 + 1, "car": 2} and all(f"https://a.example/{k}" in deep[0].text + deep[1].text for k in range(5))
    texts = spark.createDataFrame([(1, "[x](https://a.example/1)", ["https://a.example/1"]), (2, "x", ["https://a.example/1"]), (3, "x", [])], "id int, text string, expected array<string>")
    assert [r.id for r in summary.missing_links(texts).collect()] == [2]
    assert summary.with_notice("d", {"b": "2", "a": "1"}, True).startswith("> Some sources failed:\n- a: 1\n- b: 2\n")


def test_a_run_keeps_ledger_cursors_and_archive(spark, tmp_path):
    state, sent, told = store.Store(spark, f"file://{tmp_path}/state"), [], []
    schema = f"{engine.ITEM}, {engine.OPTIONAL}"
    first = [("i1", "feed", "feed_item", "One", "b", "https://a.example/1", "primary", False, False, False, 1, "9", "2024-01-01T00:00:00Z")]
    second = [*first, ("i2", "feed", "feed_item", "Two", "b", "https://a.example/2", "primary", False, False, False, 2, "10", "2024-01-01T00:00:00Z")]
    third = [*second[:1], (*second[1][:3], "Two, changed", *second[1][4:12], "2024-01-05T00:00:00Z")]
    more = {"keep_ledger": True, "archive": True, "cooldown_minutes": 0, "told": told.append}
    for day, rows, want in ((2, first, ["i1"]), (3, second, ["i2"]), (4, second, []), (6, third, ["i2"])):
        given = {"feed_registry": lambda rows=rows: spark.createDataFrame(rows, schema)}
        status = engine.run("feed-update", given, state, f"2024-01-0{day}T12:00:00Z", sent.append, errors={"other": "boom"}, **more)
        assert (status, told) == ("completed", [])
        assert [r["id"] for r in sent[-1]] == want
    cursors = {r.connector_id: r for r in state.read("connector_cursors").collect()}
    assert cursors["feed"].cursor == "10" and cursors["other"].last_error == "boom" and cursors["other"].last_success_at is None
    assert engine.read_ledger(state).count() == 3
    assert state.read("archive/2024-01-02").count() == 1
    assert engine.run("feed-update", given, state, "2024-01-07T00:00:00Z", lambda rows: 1 / 0, **more) == "failed" and "ZeroDivisionError" in told[0]


def test_suppression_is_by_event_type_source_and_id(spark, tmp_path):
    state, sent = store.Store(spark, f"file://{tmp_path}"), []
    rows = [("i1", "a", "feed_item", "One", "b", None, "primary", False, True, False, 1), ("i1", "b", "feed_item", "Other", "b", None, "primary", False, True, False, 2)]
    given = {"feed_registry": lambda: spark.createDataFrame(rows[:1], engine.ITEM)}
    both = {"feed_registry": lambda: spark.createDataFrame(rows, engine.ITEM)}
    engine.run("morning-digest", given, state, "2024-01-01T00:00:00Z", sent.append)
    engine.run("morning-digest", both, state, "2024-01-01T01:00:00Z", sent.append)
    engine.run("evening-digest", given, state, "2024-01-01T02:00:00Z", sent.append)
    assert [[r["source"] for r in rows] for rows in sent] == [["a"], ["b"], ["a"]]
    key = state.read("suppression_history").where("subject like '%\"a\"%' and trigger_family = 'digest.morning'").first().suppression_id
    state.commit({"suppression_history": state.updated("suppression_history", key, dismissal_status="dismissed")})
    engine.run("morning-digest", given, state, "2024-01-01T03:00:00Z", sent.append)
    assert [r["source"] for r in sent[-1]] == ["a"]


def test_approval_is_asked_for(spark, tmp_path):
    state = store.Store(spark, f"file://{tmp_path}")
    rows = [("n1", "notes", "note", "Milk", "Preferred store: Shop\nlink: https://s.example", None, None, False, True, False, 1)]
    assert engine.run("shopping-replenishment", {"notes": lambda: spark.createDataFrame(rows, engine.ITEM)}, state, "2024-01-01T00:00:00Z") == "completed"
    row = state.read("approval_action_log").first()
    assert json.loads(row.subject) == {"buy": "Milk", "preferred_store": "Shop", "link": "https://s.example"} and row.user_decision == "pending"


def test_a_broken_pointer_leaves_the_state_before_it(spark, tmp_path):
    state = store.Store(spark, f"file://{tmp_path}")
    state.commit({"feedback_log": state.record("feedback_log", [{"category": "c"}])})
    state.commit({"feedback_log": state.record("feedback_log", [{"category": "d"}])})
    assert state.read("feedback_log").count() == 2
    (tmp_path / "state-000000000003.json").write_text('{"feedback_log": [')
    assert state.read("feedback_log").count() == 2
    state.commit({"feedback_log": state.record("feedback_log", [{"category": "e"}])})
    assert state.read("feedback_log").count() == 3


def test_commands_and_profiles():
    assert len(profiles.COMMANDS) == 12 and set(profiles.COMMANDS.values()) == set(profiles.PROFILES)
    assert profiles.profile("morning-digest").family == "scheduled" and profiles.profile("feed.update.default").family == "event"
    with pytest.raises(ValueError, match="unknown profile"):
        profiles.profile("nothing")
