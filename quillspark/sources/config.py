"""Settings from the command line, the environment and a .env file, in this order; a value that is missing, invalid or below its minimum gives the default."""

from __future__ import annotations

import argparse
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields


def _setting(default: int | bool | str | None, name: str, least: int | None = None):
    from dataclasses import field

    return field(default=default, metadata={"name": name, "least": least})


@dataclass(frozen=True)
class Settings:
    max_concurrent_tasks: int = _setting(3, "DOC_MAX_CONCURRENT_TASKS", 1)
    upload_limit_mib: int = _setting(256, "DOC_UPLOAD_LIMIT_MIB", 1)
    page_window: int = _setting(8, "DOC_PAGE_WINDOW", 1)
    model_requests: int = _setting(50, "DOC_MODEL_REQUESTS", 1)
    retention_seconds: int = _setting(24 * 3600, "DOC_RETENTION_SECONDS", 0)
    sweep_seconds: int = _setting(300, "DOC_SWEEP_SECONDS", 1)
    allow_public_inference: bool = _setting(False, "DOC_ALLOW_PUBLIC_INFERENCE")
    bind: str = _setting("127.0.0.1", "DOC_BIND")
    model_server: str = _setting("", "DOC_MODEL_SERVER")
    port: int = _setting(8000, "DOC_PORT", 1)
    output_root: str = _setting("./output", "DOC_OUTPUT_ROOT")
    in_flight: int | None = _setting(None, "DOC_IN_FLIGHT_TASKS", 1)
    queue: int | None = _setting(None, "DOC_MODEL_QUEUE", 1)
    task_requests: int | None = _setting(None, "DOC_MODEL_REQUESTS_PER_TASK", 1)

    @property
    def task_limit(self) -> int:
        """Requests in flight for one task."""
        return self.task_requests or min(8, self.model_requests)

    @property
    def in_flight_tasks(self) -> int:
        """Tasks that are admitted at once."""
        return self.in_flight or 2 * self.max_concurrent_tasks

    @property
    def queue_size(self) -> int:
        return self.queue or 4 * self.model_requests

    def remote_inference_allowed(self) -> bool:
        """A server that everybody reaches does not forward to a model server of the caller's choice, unless that is wanted."""
        return self.allow_public_inference or self.bind in ("127.0.0.1", "localhost", "::1")


def parse_bool(raw: str) -> bool | None:
    v = raw.strip().lower()
    return True if v in ("true", "1", "yes", "on") else False if v in ("false", "0", "no", "off") else None


def dotenv(text: str) -> dict[str, str]:
    """Names and values of a .env file: NAME=value lines, `export` before them, quotes around values, and comments."""
    found = {}
    for line in text.splitlines():
        m = re.match(r"""\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|([^#\n]*?))\s*(?:#.*)?$""", line)
        if m:
            name, double, single, bare = m.groups()
            found[name] = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), double) if double is not None else single if single is not None else bare
    return found


def arguments(argv: Sequence[str]) -> dict[str, str]:
    """The settings that a command line gives, by their names in the environment."""
    parser = argparse.ArgumentParser(prog="quillspark", description="Documents as tables")
    parser.add_argument("--host", help="address that a server in front binds to")
    parser.add_argument("--port", type=int)
    parser.add_argument("--allow-public-http-client", action="store_true", default=None, help="forward to model servers of the caller's choice also when bound publicly")
    given = parser.parse_args(argv)
    found = {"DOC_BIND": given.host, "DOC_PORT": given.port, "DOC_ALLOW_PUBLIC_INFERENCE": given.allow_public_http_client}
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in found.items() if v is not None}


def load(env: Mapping[str, str] = os.environ, file: str | None = None, argv: Sequence[str] = ()) -> Settings:
    """Settings of an environment; file: a .env file, which may be absent; argv: a command line without the program's name."""
    if file and os.path.isfile(file):
        with open(file, encoding="utf-8") as f:
            env = dotenv(f.read()) | dict(env)
    env = dict(env) | arguments(argv)
    found = {}
    for f in fields(Settings):
        raw = env.get(f.metadata["name"], "").strip()
        if isinstance(f.default, bool):
            value = parse_bool(raw)
        elif f.metadata["least"] is not None:
            value = int(raw) if raw.isascii() and raw.removeprefix("+").isdigit() else None
            value = None if value is not None and value < f.metadata["least"] else value
        else:
            value = raw or None
        if value is not None:
            found[f.name] = value
    return Settings(**found)
