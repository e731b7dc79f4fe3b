"""JSON arrays cut into elements by byte ranges, and export archives unpacked as streams."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest

from daybreak.sources import archives, arrays, exports

WORDS = ["a", "}", "{", "]", "[", '"', "\\", '\\"', "\n", ",", "é}", "𝄞", "", " ", '"}', "\\\\"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return "".join(rng.choice(WORDS) for _ in range(rng.randrange(6)))
    if kind < 4:
        return rng.choice([None, True, 7, -2.5])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{rng.choice(WORDS)}{k}": value(rng, depth + 1) for k in range(rng.randrange(4))}


def as_row(element):
    """What an element is compared by: strings are given as their value, null as null."""
    return element if element is None or isinstance(element, str) else ("json", json.dumps(element))


@pytest.fixture
def narrow(spark):
    """Byte ranges of 96 bytes, so that they end anywhere in a record."""
    settings = {"spark.sql.files.maxPartitionBytes": "96", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_elements_of_any_kind_across_byte_ranges(narrow, tmp_path):
    rng = random.Random(5)
    for k in range(3):
        rows = [value(rng) for _ in range(18)] + [{"last": "}"}][: k % 2]
        (tmp_path / f"{k}.json").write_text(("﻿" if k == 2 else " ") + json.dumps(rows, ensure_ascii=k == 0, indent=k or None) + "\n")
    (tmp_path / "empty.json").write_text(" [ ] ")
    (tmp_path / "nothing.json").write_text("")
    found = arrays.read_array(narrow, *(f"file://{p}" for p in sorted(tmp_path.glob("*.json"))))
    got: dict[str, list] = {}
    for r in found.orderBy("file", "record", "spot").collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append(r.payload)
    assert set(got) == {"0.json", "1.json", "2.json"}
    for name, payloads in got.items():
        told = json.loads((tmp_path / name).read_text().lstrip("﻿"))
        assert len(told) == len(payloads)
        assert [as_row(x) for x in told] == [p if isinstance(as_row(x), str | None) else ("json", json.dumps(json.loads(p))) for x, p in zip(told, payloads)]


@pytest.mark.parametrize("text", ['[{"a":1}', '[{"a":1},{"b":"}', '{"a":[1]}', '[{"a":1}]]', "5", '[{"a":1}]{}'])
def test_what_is_no_whole_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError, match="is not a JSON array"):
        arrays.read_array(spark, f"file://{tmp_path}/x.json")


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def test_members_of_nested_archives_by_path(spark, tmp_path):
    deep = zipped(a__user_dot_json="deep", **{"z": "x"})
    mid = zipped(m_dot_zip=deep, b__user_dot_json="mid")
    (tmp_path / "my chat.zip").write_bytes(zipped(c_dot_zip=mid, d__user_dot_json="top", d__other_dot_json="o" * 3_000_000))
    got = archives.unpacked(spark, f"file:{tmp_path}/my chat.zip", ["user.json", "other.json", "none.json"], f"file://{tmp_path}/out")
    assert set(got) == {"user.json", "other.json"}
    assert (tmp_path / "out" / "user.json").read_text() == "mid"  # c/b/user.json comes before c/m/a/user.json and d/user.json
    assert (tmp_path / "out" / "other.json").stat().st_size == 3_000_000
    assert not list(tmp_path.glob("*.attempts-*"))


def test_prepared_export_keeps_user_and_manifests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda rows, **more: (tmp_path / "in" / "chatgpt.zip").write_bytes(zipped(x__conversations_dot_json=json.dumps(rows), **more))
    out = f"file://{tmp_path}/out"
    put([{"id": "a", "title": "", "mapping": {}}, 5, {"title": "no id"}], user_dot_json='{"email": "me@example.com"}', export_manifest_dot_json='{"v": 2}')
    made = exports.prepare_export(spark, f"file://{tmp_path}/in", out)
    assert made == json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert (made["conversation_count"], made["account"], made["export_manifest"], made["import_status"]) == (3, "me@example.com", {"v": 2}, "prepared")
    row = exports.read_conversations(spark, out).collect()
    assert [(r.id, r.title, r.url, r.account) for r in row] == [("a", "ChatGPT conversation", "https://chatgpt.com/c/a", "me@example.com")]
    put([])
    again = exports.prepare_export(spark, f"file://{tmp_path}/in", out)
    assert (again["conversation_count"], again["latest_export_conversation_count"], again["account"], again["export_manifest"]) == (3, 0, "me@example.com", {"v": 2})
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["import_status"] == "skipped_empty_export"
    put({"no": "list"})
    with pytest.raises(ValueError, match="is not a JSON array"):
        exports.prepare_export(spark, f"file://{tmp_path}/in", out)
    put([{"id": "b"}])
    assert exports.prepare_export(spark, f"file://{tmp_path}/in", out)["account"] is None and exports.read_conversations(spark, out).first().account is None
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]


def test_account_of_an_export(spark, tmp_path):
    where = f"file://{tmp_path}"
    assert exports.account(spark, where) is None
    (tmp_path / "extracted").mkdir()
    (tmp_path / "extracted" / "user.json").write_text('{"email": "u@example.com"}')
    for manifest in ("not json", "[]", '{"account": ""}', '{"account": 5}'):
        (tmp_path / "manifest.json").write_text(manifest)
        assert exports.account(spark, where) == "u@example.com"
    (tmp_path / "manifest.json").write_text('{"account": "m"}')
    assert exports.account(spark, where) == "m"
    (tmp_path / "manifest.json").unlink()
    (tmp_path / "extracted" / "user.json").write_text('["x"]')
    assert exports.account(spark, where) is None
