"""Numbers and times as people read them, for the command line."""

from __future__ import annotations


def num(n: float) -> str:
    """Thousands set off by commas."""
    return f"{n:,}"


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{num(n)} {one if n == 1 else many or one + 's'}"


def duration(ms: float) -> str:
    """Milliseconds below a second, seconds with one digit below ten, then whole seconds, minutes, hours."""
    if ms < 1_000:
        return f"{round(ms)} ms"
    s = ms / 1_000
    if s < 60:
        return f"{s:.1f} s" if s < 9.95 else f"{round(s)} s"
    minutes = round(s / 60)
    return f"{int(s // 60)} min {int(s % 60)} s" if s < 600 else f"{minutes} min" if minutes < 120 else f"{minutes // 60} h {minutes % 60} min"


def eta(done: int, total: int, ms: float) -> str | None:
    """How long the rest takes at the rate so far; nothing before there is a rate."""
    return duration(ms * (total - done) / done) if 0 < done <= total else None
