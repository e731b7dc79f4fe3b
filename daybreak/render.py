"""Texts from small results; the queries do the choosing, these format what they return."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Protocol

SECTION_TITLES = {"today": "Today", "followup": "Follow up", "resurface": "Worth another look", "incoming": "Incoming", "feed_updates": "Feed updates"}
OPTIONAL = {"feed_updates"}


class Summarizer(Protocol):
    def summarize(self, rows: list[Mapping]) -> str: ...


def digest(rows: Iterable[Mapping]) -> str:
    """Sections in their fixed order with `- None.` where one is empty; (section, place, title, url, reasons) rows."""
    by: dict[str, list[Mapping]] = {}
    for row in sorted(rows, key=lambda r: r["place"]):
        by.setdefault(row["section"], []).append(row)
    out = ["# Briefing"]
    for name, title in SECTION_TITLES.items():
        own = by.get(name, [])
        if not own and name in OPTIONAL:
            continue
        out += ["", f"## {title}", *(item_line(r) for r in own)] if own else ["", f"## {title}", "- None."]
    return "\n".join(out) + "\n"


def item_line(row: Mapping) -> str:
    title = row.get("title") or "Untitled"
    head = f"[{title}]({row['url']})" if row.get("url") else title
    return f"- {head}" + (f" — {row['reasons']}" if row.get("reasons") else "")


def briefing(mode: str, rows: list[Mapping], subject: str | None = None) -> str:
    """The text of a run in its profile's form; (section, place, title, url, reasons) rows, and for an action its subject as JSON."""
    ordered = sorted(rows, key=lambda r: (r["section"] not in OPTIONAL, r["place"]))
    if mode == "action_prep":
        wanted = json.loads(subject) if subject else {}
        values = {k: v for k, v in {"item": wanted.get("buy"), "store": wanted.get("preferred_store"), "link": wanted.get("link")}.items() if v}
        return action_prep(values) or "Nothing to order."
    if mode == "nudge":
        return feed_nudge(*ordered[:2]) if ordered else "Nothing new."
    if mode == "warning":
        return "\n".join(["# Warning", *(item_line(r) for r in ordered[:1])]) if ordered else "Nothing to warn of."
    return digest(rows)


def leave_now(row: Mapping | None) -> str | None:
    return None if row is None else f"Leave now for {row['title']}: departure {row['departure']}, starts {row['start']}."


def mail_warning(row: Mapping | None) -> str | None:
    return None if row is None else f"Unread mail: {row['title']} ({', '.join(row.get('people') or ())})"


def gap_digest(row: Mapping | None) -> str | None:
    return None if row is None else f"You have {row['minutes']} free minutes until {row['starts']}."


def location(row: Mapping | None) -> str | None:
    return None if row is None else f"At {row['place']}: {row['reason'].replace('_', ' ')} ({row['minutes']} min)."


def feed_nudge(primary: Mapping | None, secondary: Mapping | None = None) -> str | None:
    if primary is None:
        return None
    out = f"New: {item_line(primary)[2:]}"
    return out if secondary is None else f"{out}\nAlso: {item_line(secondary)[2:]}"


def action_prep(values: Mapping[str, str] | None) -> str | None:
    return None if not values or "item" not in values else "Ready to order: " + ", ".join(f"{k} {v}" for k, v in values.items())


def quality_review(body: str | None) -> str | None:
    return None if body is None else "# Trigger review\n" + "\n".join(f"- {x}" for x in body.split("\n"))


def state_summary(cursors: list[Mapping], actions: list[Mapping], feedback: list[Mapping]) -> str:
    """Connectors with their cursors, actions with the details of their execution, and totals of feedback; `- none` where there are none."""

    def details(text: str | None) -> str:
        try:
            found = json.loads(text) if text else {}
        except ValueError:
            return text
        return ", ".join(f"{k}={v}" for k, v in sorted(found.items())) or "-" if isinstance(found, dict) else "-"

    parts = {
        "Connector cursors": [f"{r['connector_id']}: cursor={r['cursor'] or '-'}, last_success_at={r['last_success_at'] or '-'}, last_error={r['last_error'] or '-'}" for r in cursors],
        "Approval actions": [f"{r['action_id']}: {r['action_kind']} / {r['user_decision']} / {r['execution_result']} / details={details(r['execution_details'])} / recorded_at={r['recorded_at']}" for r in actions],
        "Feedback signal totals": [f"{r['category']} / {r['subject']} / {r['signal']}: {r['n']}" for r in feedback],
    }
    return "# State summary\n\n" + "\n\n".join("\n".join([f"## {title}", *(f"- {x}" for x in lines or ["none"])]) for title, lines in parts.items()) + "\n"


def blocks(markdown: str) -> list[dict]:
    """Rich-text blocks: headings, texts, and neighbouring bullets as one list, each with link and bold segments."""
    out: list[dict] = []
    for line in markdown.split("\n"):
        if not line.strip():
            continue
        kind = "heading" if line.startswith("#") else "list" if re.match(r"\s*[-*] ", line) else "text"
        body = segments(re.sub(r"^\s*(?:#+|[-*]) ", "", line))
        if kind == "list" and out and out[-1]["kind"] == "list":
            out[-1]["items"].append(body)
        else:
            out.append({"kind": kind, "items": [body]})
    return out


def segments(text: str) -> list[dict]:
    found = []
    for m in re.finditer(r"\[([^\]]+)\]\((https?://[^)]+)\)|\*\*([^*]+)\*\*|((?:(?!\[[^\]]+\]\(https?://|\*\*).)+|.)", text):
        found.append({"link": m[2], "text": m[1]} if m[2] else {"bold": m[3]} if m[3] else {"text": m[4]})
    return found


def extractive_summary(asked: str) -> str:
    """The stand-in for a language model: the item lines of a prompt, or the parts that a prompt asks to merge."""
    return "\n".join(x for x in asked.split("\n") if x.startswith("- "))


FORM = "Write a Markdown list; every line names one item with its link. Keep every link."


def prompt(category: str, part: int, parts: int, lines: list[str]) -> str:
    return f"Summarise part {part} of {parts} of the category {category}. {FORM}\n\n" + "\n".join(lines)


def merge_prompt(category: str, texts: list[str]) -> str:
    return f"Merge these {len(texts)} summaries of the category {category} into one without repeating an item. {FORM}\n\n" + "\n\n".join(texts)


def repair_prompt(asked: str, made: str, lost: list[str]) -> str:
    return f"This summary has lost its links; write it again with these links: {' '.join(lost)}\n\nSummary:\n{made}\n\nIt answered:\n{asked}"


def with_retries(run: Callable[[], str], delays: tuple[float, ...] = (300, 300), wait: Callable[[float], None] | None = None) -> tuple[str, list[dict]]:
    """The run's result and a log of its attempts; the last failure is raised."""
    import time

    log: list[dict] = []
    for attempt in range(len(delays) + 1):
        try:
            out = run()
            log.append({"attempt": attempt + 1, "status": "completed", "error": None})
            return out, log
        except Exception as failure:
            log.append({"attempt": attempt + 1, "status": "failed", "error": str(failure)})
            if attempt == len(delays):
                raise
            (wait or time.sleep)(delays[attempt])
    raise AssertionError


def deliver(markdown: str, path: str) -> None:
    """Writes a finished text to a local file, making its folder."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(markdown, encoding="utf-8")
