"""File names and object keys of exports."""

from __future__ import annotations

import re
from datetime import datetime, timezone

# Default file name and the placeholders a key may use.
DEFAULT_NAME = "query-result"
PLACEHOLDERS = ("workflow_id", "workflow_name", "run_id", "yyyy", "mm", "dd", "hh", "ts")


def export_name(name: str, extension: str, moment: datetime | None = None) -> str:
    """A safe file name with a time stamp: `my_table-2024-01-31T08-05-09-123Z.csv`."""
    base = re.sub(r"[^A-Za-z0-9_-]+", "_", name) if name else DEFAULT_NAME
    now = (moment or datetime.now(timezone.utc)).astimezone(timezone.utc)
    stamp = f"{now:%Y-%m-%dT%H-%M-%S}-{now.microsecond // 1000:03d}Z"
    return f"{base}-{stamp}.{extension}"


def render_key(
    template: str, workflow_id: str = "", workflow_name: str = "", run_id: str = "", moment: datetime | None = None
) -> str:
    """Fill the `{{placeholders}}` of an object key; unknown ones are an error."""
    now = (moment or datetime.now(timezone.utc)).astimezone(timezone.utc)
    values = {
        "workflow_id": workflow_id, "workflow_name": workflow_name, "run_id": run_id, "yyyy": f"{now:%Y}",
        "mm": f"{now:%m}", "dd": f"{now:%d}", "hh": f"{now:%H}", "ts": f"{now:%Y-%m-%dT%H:%M:%SZ}",
    }

    def fill(match: re.Match[str]) -> str:
        name = match.group(1).strip()
        if name not in PLACEHOLDERS:
            raise ValueError(f"unknown placeholder {{{{{name}}}}}; known: {', '.join(PLACEHOLDERS)}")
        return values[name]

    return re.sub(r"\{\{(.*?)\}\}", fill, template)
