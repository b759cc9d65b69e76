"""Preferences of a library: defaults, bounds, partial changes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

LEVELS = ("debug", "info", "warn", "error")


@dataclass(frozen=True)
class Preferences:
    log_level: str = "info"
    last_folder: str = ""
    recursive: bool = True
    include_hidden: bool = False
    inspect_content: bool = True
    ocr: bool = True
    google_books: bool = True
    open_library: bool = True
    internet_archive: bool = True
    google_books_api_key: str = ""
    max_candidates: int = 12
    cache_days: int = 7
    background_delay_seconds: int = 10

    def __post_init__(self):
        wrong = [
            what
            for what, fine in (
                ("log_level", self.log_level in LEVELS),
                ("last_folder", len(self.last_folder.encode()) <= 4096 and "\0" not in self.last_folder),
                ("max_candidates", 1 <= self.max_candidates <= 50),
                ("cache_days", 0 <= self.cache_days <= 365),
                ("background_delay_seconds", 1 <= self.background_delay_seconds <= 300),
                ("google_books_api_key", len(self.google_books_api_key.encode()) <= 512 and not set(self.google_books_api_key) & {"\r", "\n"}),
            )
            if not fine
        ]
        if wrong:
            raise ValueError(f"out of bounds: {', '.join(wrong)}")

    def changed(self, patch: dict) -> Preferences:
        """These preferences with some fields replaced; unknown fields are refused."""
        if unknown := set(patch) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
        return replace(self, **patch)

    def shown(self) -> dict:
        """What may be shown: the key only as whether there is one."""
        return asdict(self) | {"google_books_api_key": "set" if self.google_books_api_key else ""}

    def sources(self) -> list[str]:
        """The enabled catalogs in their order of arrival."""
        return [name for name, on in (("Google Books", self.google_books), ("Open Library", self.open_library), ("Internet Archive", self.internet_archive)) if on]


def load(stored: str | None, older: dict[str, str] | None = None) -> Preferences:
    """Stored fields over the defaults; fields of no meaning now are passed over. Before any are stored, those that ``older``
    settings hold under their own keys count."""
    if not stored:
        return Preferences().changed({k: v for k, v in (older or {}).items() if k in ("google_books_api_key", "last_folder") and v})
    known = {f.name for f in fields(Preferences)}
    return Preferences().changed({k: v for k, v in json.loads(stored).items() if k in known})


def dump(preferences: Preferences) -> str:
    return json.dumps(asdict(preferences), sort_keys=True)
