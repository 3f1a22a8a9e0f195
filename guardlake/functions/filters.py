"""Row filters of the dashboards as conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows in hours, prefixes of synthetic sessions, path extensions and names.
WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720}
CLI_SYNTHETIC, DASHBOARD_SYNTHETIC = ("fixture-", "test-"), ("self-test-",)
EXTENSIONS = ("py", "pyi", "js", "jsx", "ts", "tsx", "json", "md", "sh", "yml", "yaml", "toml", "rs", "go", "java", "c", "h", "cpp", "css", "html", "txt", "diff", "patch", "lock")
BARE_NAMES = ("makefile", "license", "readme", "dockerfile")


def in_window(ts: Column, asof: Column, window: str = "7d") -> Column:
    """At most a window before ``asof``, which is passed and never the clock."""
    return F.unix_micros(ts.cast("timestamp")) >= F.unix_micros(asof.cast("timestamp")) - WINDOWS.get(window, WINDOWS["7d"]) * 3_600_000_000


def on_platforms(platform: Column, names: tuple[str, ...]) -> Column:
    """No names mean all rows; with names a null platform is out."""
    return F.coalesce(platform.isin(*names), F.lit(False)) if names else F.lit(True)


def real_session(session: Column, synthetic: tuple[str, ...] = CLI_SYNTHETIC) -> Column:
    out = F.lit(True)
    for p in synthetic:
        out = out & ~session.startswith(p)
    return F.coalesce(out, F.lit(True))


def valid_path(path: Column) -> Column:
    """A plausible file path: plain characters, a known extension, or a well-known or lower-case bare name."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    name = F.element_at(parts, -1)
    bare = (F.size(parts) == 1) & ~name.contains(".")
    odd = bare & (name.rlike(r"^\d+$") | (~F.lower(name).isin(*BARE_NAMES) & (name != F.lower(name))))
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*EXTENSIONS)).otherwise(True)
    return F.coalesce(F.when(path.rlike(r"^[A-Za-z0-9_./\-@]+$") & (F.size(parts) > 0), ~odd & extension), F.lit(False))


def context_kind(value: Column) -> Column:
    """Whether a candidate path is an address, a file or text about a tool."""
    v = F.trim(value)
    return F.when(v.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), "url").when(v.rlike(r"^[^\s()]+(/[^\s()]+|\.[A-Za-z0-9]{1,5})$"), "file").when(v != "", "tool")


def facets(outcome: Column, outcomes: tuple[str, ...], day: Column, first: str | None, last: str | None) -> Column:
    """Outcome and date range; an absent bound does not restrict."""
    out = outcome.isin(*outcomes) if outcomes else F.lit(True)
    out = out & (day >= first) if first else out
    return out & (day <= last) if last else out
