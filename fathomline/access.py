"""Users, roles and permissions on event types."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import secrets

from .errors import CommandError
from .storage import Store

#: What each role may do with all types.
ROLES = {"admin": ("read", "write", "admin"), "read-only": ("read",), "viewer": ("read",), "editor": ("read", "write"), "write-only": ("write",)}


class Access:
    """Admins may do all. A type's own entry decides WRITE; it decides READ too, but for one that gives only WRITE, where roles may still give READ."""

    NAME = "users.json"

    def __init__(self, store: Store | None = None):
        self.store = store
        self.users: dict[str, dict] = json.loads((store.read(self.NAME) if store else None) or "{}")

    def save(self) -> None:
        if self.store:
            self.store.write(self.NAME, json.dumps(self.users))

    def user(self, name: str) -> dict:
        if name not in self.users:
            raise CommandError(f"no user {name}", 404)
        return self.users[name]

    def create(self, name: str, key: str | None = None, roles: tuple[str, ...] = ()) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise CommandError(f"not a name of a user: {name!r}")
        if name in self.users:
            raise CommandError(f"user {name} exists", 409)
        unknown = [r for r in roles if r.lower() not in ROLES]
        if unknown:
            raise CommandError(f"unknown roles: {', '.join(unknown)}")
        key = key or secrets.token_hex(32)
        self.users[name] = {"key": key, "active": True, "roles": [r.lower() for r in roles], "grants": {}}
        self.save()
        return key

    def revoke_key(self, name: str) -> None:
        self.user(name)["active"] = False
        self.save()

    def signed(self, name: str, message: str, signature: str) -> bool:
        """Whether an HMAC-SHA256 of the message is by this user's key."""
        user = self.users.get(name)
        if not user or not user["active"]:
            return False
        return hmac.compare_digest(hmac.new(user["key"].encode(), message.encode(), hashlib.sha256).hexdigest(), signature)

    def grant(self, name: str, event_types: tuple[str, ...], permissions: tuple[str, ...], value: bool = True) -> None:
        grants = self.user(name)["grants"]
        for t in event_types:
            entry = grants.setdefault(t, {"read": False, "write": False})
            for p in permissions or ("read", "write"):
                entry[p] = value
        self.save()

    def roles_allow(self, user: dict, what: str) -> bool:
        return any(what in ROLES[r] for r in user["roles"])

    def allowed(self, name: str, what: str, event_type: str) -> bool:
        user = self.users.get(name)
        if not user or not user["active"]:
            return False
        if "admin" in user["roles"]:
            return True
        entry = user["grants"].get(event_type)
        if entry is None:
            return self.roles_allow(user, what)
        if what == "read" and not entry["read"] and entry["write"]:
            return self.roles_allow(user, "read")
        return entry[what]

    def need(self, name: str | None, what: str, event_type: str) -> None:
        if name is not None and not self.allowed(name, what, event_type):
            raise CommandError(f"{name} may not {what} {event_type}", 403)

    def need_admin(self, name: str | None) -> None:
        user = self.users.get(name, {"roles": (), "active": False})
        if name is not None and not (user["active"] and "admin" in user["roles"]):
            raise CommandError(f"{name} is no admin", 403)
