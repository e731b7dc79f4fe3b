"""The digest's category classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: category order, aliases and keywords.
ORDER = ("ai", "it", "finance", "camera", "car", "schedule")
ALIASES = {
    "ai": ("ai", "人工知能", "llm"),
    "it": ("it", "tech", "technology", "developer", "developer-tools", "security"),
    "finance": ("finance", "financial", "fintech", "markets", "market", "金融"),
    "camera": ("camera", "cameras", "photography", "photo", "lenses", "lens", "cine", "cinema"),
    "car": ("car", "cars", "automotive", "ev", "vehicle", "vehicles"),
    "schedule": ("schedule", "calendar", "event", "events", "スケジュール"),
}
KEYWORDS = {
    "ai": ("openai", "anthropic", "claude", "gemini", "deepmind", "meta ai", "xai", "x.ai", "gpt", "llm", "langchain", "codex"),
    "finance": ("nikkei", "bloomberg", "reuters", "market", "markets", "finance", "bank", "boj", "日銀", "金利", "金融", "株", "為替", "円", "ドル"),
    "camera": ("camera", "cameras", "dpreview", "petapixel", "デジカメ", "lens", "lenses", "leica", "canon", "nikon", "sony alpha", "fujifilm", "sigma", "tamron", "viltrox", "laowa", "ttartisan", "7artisans", "blackmagic", "cine", "cinema"),
    "car": ("tesla", "electrek", "insideevs", "car-watch", "car watch", "mini", "bmw", "byd", "hyundai", "kia", "nio", "polestar", "automotive", "vehicle", "vehicles", "ev", "自動車", "車", "電気自動車"),
    "it": ("apple", "microsoft", "google", "software", "cloud", "security", "vulnerability", "cve", "redis", "oracle", "pan-os", "iphone", "ipad", "mac", "ios", "android", "developer"),
}


def normalized(value: Column) -> Column:
    """A category's name from one of its aliases; others are null."""
    key = F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))
    cases = reduce(lambda acc, item: acc.when(key.isin(*item[1]), item[0]), ALIASES.items(), F)
    return cases.otherwise(None)


def by_keyword(text: Column, whole_words: bool = False) -> Column:
    """The first category, in the keywords' order, one of whose keywords the lower-cased text contains."""

    def any_of(low: Column, words: tuple[str, ...]) -> Column:
        if whole_words:
            return low.rlike("|".join(rf"\b{w.replace('.', chr(92) + '.')}\b" for w in words))
        least = [w for w in words if not any(o != w and o in w for o in words)]  # a word that holds another adds nothing
        return reduce(lambda acc, w: acc | low.contains(w), least[1:], low.contains(least[0]))

    def cases(low: Column) -> Column:
        return reduce(lambda acc, item: acc.when(any_of(low, item[1]), item[0]), KEYWORDS.items(), F).otherwise(None)

    return F.transform(F.array(F.lower(text)), cases)[0]  # lower-cased once


def haystack(*parts: Column) -> Column:
    """What keywords are looked for in: source, kind, title, excerpt, body and address, those there are."""
    return F.concat_ws(" ", *parts)


def has_schedule(start_at: Column, end_at: Column) -> Column:
    return (F.coalesce(start_at, F.lit("")) != "") | (F.coalesce(end_at, F.lit("")) != "")


def classify(text: Column, explicit: Column | tuple[Column, ...] = (), hint: Column | tuple[Column, ...] = (), scheduled: Column | None = None, scopes: Column | None = None, whole_words: bool = False) -> Column:
    """The first explicit category, then hints, schedule, scopes, keywords, and `it` for the rest."""
    steps = [normalized(c) for given in (explicit, hint) for c in (given if isinstance(given, tuple) else (given,))]
    if scheduled is not None:
        steps.append(F.when(scheduled, "schedule"))
    if scopes is not None:
        steps.append(F.try_element_at(F.filter(F.transform(scopes, normalized), lambda x: x.isNotNull()), F.lit(1)))
    return F.coalesce(*steps, by_keyword(text, whole_words), F.lit("it"))
