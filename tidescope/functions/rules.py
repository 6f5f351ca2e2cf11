"""Small decision rules: conflicts, page limits, client versions, error codes and scope cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a client is told about each outcome.
REASONS = {
    "ahead": "client base version is ahead of server version",
    "newer_base": "client timestamp newer (LWW with base)",
    "server": "server version is newer",
    "unchanged": "server unchanged since base version",
    "newer": "client timestamp newer (LWW)",
}
#: HTTP status and whether a retry helps, by error code.
ERRORS = {
    "invalid_request": (400, False), "auth_required": (401, False), "upgrade_required": (426, False), "schema_mismatch": (422, False),
    "table_not_synced": (400, False), "retry_later": (503, True), "temporary_unavailable": (503, True), "sync_error": (500, True),
}
DEFAULT_LIMIT, MAX_LIMIT, TOLERANCE_MS = 100, 1000, 500


def clamp(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)


def last_write(client: Column, server: Column, base: Column, tolerance: int = TOLERANCE_MS, now: Column | None = None) -> tuple[Column, Column]:
    """(winner, reason) for client and server times and an optional base version, all in milliseconds; no client time means ``now``."""
    client = F.coalesce(client, F.unix_millis(F.current_timestamp()) if now is None else now)
    newer = client + tolerance > server
    key = (
        F.when(base > server, "ahead").when(base == server, "unchanged")
        .when(newer & base.isNotNull(), "newer_base").when(newer, "newer").otherwise("server")
    )
    winner = F.when(key.isin("newer_base", "newer", "unchanged"), "client").otherwise("server")
    return winner, F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[key]


def server_wins() -> tuple[Column, Column]:
    """The other rule for conflicts: the server's row stays, whatever the times."""
    return F.lit("server"), F.lit("server wins policy")


def error_envelope(code: str, message: str, retryable: bool | None = None) -> dict:
    """What a client gets in place of a response."""
    return {"error": {"code": code, "message": message, "retryable": ERRORS[code][1] if retryable is None else retryable}}


def version_parts(version: Column) -> Column:
    """struct(major, minor, patch) of ``[v]a.b.c[-x|+x]``, null for anything else."""
    found = r"^v?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$"
    parts = [F.regexp_extract(version, found, i).try_cast("long").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]
    return F.when(version.rlike(found), F.struct(*parts))


def issue_cursor(scope_id: str, generation: str, checkpoint: int, secret: bytes) -> str:
    """An opaque, signed position in a scope's change log."""
    encode = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=").decode()
    payload = json.dumps({"checkpoint": checkpoint, "scope_id": scope_id, "stream_generation": generation}, sort_keys=True, separators=(",", ":")).encode()
    return f"v2.{encode(payload)}.{encode(hmac.new(secret, payload, hashlib.sha256).digest())}"


def parse_cursor(token: str | None, scope_id: str, generation: str, secret: bytes) -> tuple[str, int | None]:
    """('none' | 'ok' | 'stale', checkpoint); a malformed v2 token, or one of another scope, is an error."""
    if token is None:
        return "none", None
    if not token.startswith("v2."):
        return "stale", None
    parts = token.split(".")
    if len(parts) != 3:
        raise ValueError("malformed cursor")
    try:
        payload, signature = (base64.urlsafe_b64decode(p + "=" * (-len(p) % 4)) for p in parts[1:])
        fields = json.loads(payload)
        given = fields["scope_id"], fields["stream_generation"], int(fields["checkpoint"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed cursor") from e
    if not hmac.compare_digest(signature, hmac.new(secret, payload, hashlib.sha256).digest()):
        return "stale", None
    if given[0] != scope_id:
        raise ValueError("cursor of another scope")
    return ("stale", None) if given[1] != generation else ("ok", given[2])
