"""Labels, timestamps and selections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import finite

MAX_TOKENS, MAX_TOKEN_CHARS = 32, 64


def token_symbol(slug: Column) -> Column:
    return F.upper(F.split(slug, "-up-or-down-")[0])


def safe_slug(slug: Column) -> Column:
    return F.regexp_replace(slug, r"[^A-Za-z0-9_\-]", "_")


def sane_epoch(epoch: Column) -> Column:
    """Epoch seconds that fit a timestamp; anything else is unknown, so one absurd stamp can't fail a job."""
    return F.when(F.abs(epoch) < 1e11, epoch)


def day_key(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(sane_epoch(epoch)), "yyyy-MM-dd")


def iso_epoch(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("double")


def parse_print_ts(raw: Column) -> Column:
    """Epoch seconds from s / ms / µs numbers, numeric strings or ISO text; naive text is UTC."""
    n = finite(raw.try_cast("double"))
    scaled = F.when(n > 1e15, n / 1e6).when(n > 1e12, n / 1e3).otherwise(n)
    return F.when(n.isNotNull(), scaled).otherwise(iso_epoch(raw))


def selection_filter(series: Column, slug: Column, duration: Column, tokens: Sequence[str] = (), durations: Iterable[int] = ()) -> Column:
    keep = F.lit(True)
    if tokens:
        hay = F.lower(F.concat_ws(" ", series, slug))
        hit = F.lit(False)
        for t in tokens:
            hit = hit | hay.contains(t.lower())
        keep = keep & hit
    durations = list(durations)
    if durations:
        keep = keep & F.coalesce(duration.try_cast("int").isin(durations), F.lit(False))
    return keep


def validate_selection(tokens: Sequence[str], durations: Sequence, known_slugs: Sequence[str], known_durations: Sequence[int]) -> tuple[list[str], list[int]]:
    """Reject typos before any job starts."""
    if len(tokens) > MAX_TOKENS:
        raise ValueError(f"at most {MAX_TOKENS} tokens")
    clean = []
    for t in tokens:
        t = str(t).strip().lower()
        if not t:
            continue
        if len(t) > MAX_TOKEN_CHARS:
            raise ValueError(f"token longer than {MAX_TOKEN_CHARS}: {t[:20]}…")
        if not any(t in s.lower() for s in known_slugs):
            raise ValueError(f"token matches no known series: {t}")
        clean.append(t)
    out = []
    for d in durations:
        try:
            n = int(d)
        except (TypeError, ValueError) as exc:
            raise ValueError(f"bad duration: {d!r}") from exc
        if n not in known_durations:
            raise ValueError(f"unknown duration: {n}")
        out.append(n)
    return clean, out


def stable_seed(name: Column) -> Column:
    return F.crc32(name.cast("binary")).bitwiseAND(F.lit(0xFFFF))
