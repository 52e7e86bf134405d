"""Runs: folders with status and manifest, skipped when completed, and Markdown reports of small results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from driftloom.sources import files


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def load_config(path: str) -> dict:
    """A JSON or YAML file that must be a mapping."""
    text = files.read_text(path)
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    return found


def status_of(folder: object) -> str | None:
    at = f"{folder}/meta/status.json"
    return json.loads(files.read_text(at))["status"] if files.exists(at) else None


def _note(folder: object, name: str, value: dict) -> None:
    files.write_text(f"{folder}/meta/{name}.json", json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def run(folder: object, stage: str, make: Callable[[], DataFrame | dict[str, DataFrame]], settings: dict | None = None, force: bool = False) -> str:
    """Runs a stage into ``folder/results`` unless it is completed: 'completed', 'skipped' or, if it raises, 'failed' before the error goes on.

    ``folder`` may lie in any file system of the session. A stage that makes several tables writes each beneath its own name."""
    if status_of(folder) == "completed" and not force:
        return "skipped"
    began, started = time.time(), now()
    _note(folder, "status", {"status": "running", "stage": stage, "started_at": started})
    done = []
    try:
        made = make()
        for name, rows in (made if isinstance(made, dict) else {stage: made}).items():
            out = f"{folder}/results/{name}"
            rows.write.mode("overwrite").parquet(out)
            done.append({"name": name, "rows": rows.sparkSession.read.parquet(out).count(), "columns": rows.dtypes, "output": out})
            _note(folder, "progress", {"stage": stage, "completed": [d["name"] for d in done]})
    except Exception as e:
        _note(folder, "status", {"status": "failed", "stage": stage, "started_at": started, "error": str(e)[:2000]})
        raise
    whole = {"stage": stage, "rows": sum(d["rows"] for d in done), "outputs": done, "settings": settings or {}, "seconds": round(time.time() - began, 3)}
    _note(folder, "manifest", whole)
    _note(folder, "status", {"status": "completed", "stage": stage, "started_at": started, "ended_at": now()})
    return "completed"


def markdown(df: DataFrame, title: str, limit: int = 50) -> str:
    """A table of a small result, such as a top-k report: the first ``limit`` rows in the frame's own order."""
    rows = df.limit(limit).collect()

    def cell(v) -> str:
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")

    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
