"""Trigger profiles and collection presets, as data."""

from __future__ import annotations

from typing import NamedTuple


class Profile(NamedTuple):
    id: str
    event: str
    preset: str
    mode: str
    ceiling: int
    cooldown_minutes: int
    family: str = "event"
    quotas: dict[str, int] = {}  # noqa: RUF012


_DIGEST_QUOTAS = {"feed_items": 3, "resurface_items": 3, "people_bundles": 2}


# Profiles and presets that results depend on.
PROFILES = {
    p.id: p
    for p in (
        Profile("digest.morning.default", "digest.morning", "broad_day_start", "digest", 1, 360, "scheduled", _DIGEST_QUOTAS),
        Profile("digest.evening.default", "digest.evening", "broad_day_end", "digest", 1, 360, "scheduled", _DIGEST_QUOTAS),
        Profile("calendar.leave_now.default", "calendar.leave_now", "calendar_leave_now", "warning", 1, 15),
        Profile("mail.operational.default", "mail.operational", "mail_operational", "warning", 2, 30),
        Profile("shopping.replenishment.default", "shopping.replenishment", "shopping_replenishment", "action_prep", 2, 720),
        Profile("feed.update.default", "feed.update", "known_source_delta", "nudge", 1, 60),
        Profile("feed.update.expert_depth", "feed.update", "known_source_deep_dive", "deep_brief", 1, 240),
        Profile("feed.update.source_audit", "feed.update", "known_source_delta", "source_audit", 1, 120),
        Profile("location.arrival.default", "location.arrival", "location_arrival", "mini_digest", 1, 30),
        Profile("location.walk.default", "location.walk", "location_walk", "nudge", 1, 60),
        Profile("calendar.gap_window.default", "calendar.gap_window", "calendar_gap_window", "mini_digest", 1, 30),
        Profile("review.trigger_quality.default", "review.trigger_quality", "trigger_quality_audit", "source_audit", 0, 1440, "review"),
    )
}
_BROAD = ("feed_registry", "known_source_search", "x_signals", "google_calendar", "gmail", "chatgpt_history", "grok_history")
PRESETS = {
    "broad_day_start": _BROAD,
    "broad_day_end": _BROAD,
    "known_source_delta": ("feed_registry", "known_source_search"),
    "known_source_deep_dive": ("feed_registry", "known_source_search"),
    "calendar_leave_now": ("google_calendar",),
    "calendar_gap_window": ("google_calendar",),
    "mail_operational": ("gmail",),
    "shopping_replenishment": ("notes",),
    "location_arrival": ("location_context",),
    "location_walk": ("location_context",),
    "trigger_quality_audit": ("audit_context",),
}

# Run commands and their profiles, and the commands that maintain state.
COMMANDS = {
    "morning-digest": "digest.morning.default",
    "evening-digest": "digest.evening.default",
    "leave-now-warning": "calendar.leave_now.default",
    "mail-operational": "mail.operational.default",
    "shopping-replenishment": "shopping.replenishment.default",
    "feed-update": "feed.update.default",
    "location-arrival": "location.arrival.default",
    "location-walk": "location.walk.default",
    "review-trigger-quality": "review.trigger_quality.default",
    "gap-window-mini-digest": "calendar.gap_window.default",
    "feed-update-deep-brief": "feed.update.expert_depth",
    "feed-update-source-audit": "feed.update.source_audit",
}


def profile(name: str) -> Profile:
    """A profile by its id or by its run command; an unknown one is an error."""
    found = PROFILES.get(COMMANDS.get(name, name))
    if found is None:
        raise ValueError(f"unknown profile or command: {name}")
    return found
