"""Applications, keys and indexes, and the API's routes as one function."""

from __future__ import annotations

import json
import re
import secrets as _random
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import __version__
from .errors import Forbidden, NotFound, QueryError, SearchError
from .index import SearchIndex
from .plans.settings import Settings

PERMISSIONS = ("listIndex", "addIndex", "delIndex", "queryIndex", "browseDoc", "addDoc", "delDoc", "updateDoc", "getConfig", "setConfig", "analytics")


@dataclass
class Key:
    value: str
    description: str = ""
    permissions: tuple[str, ...] = PERMISSIONS
    indexes: tuple[str, ...] = ("*",)

    def allows(self, permission: str, index: str | None = None) -> bool:
        return permission in self.permissions and (index is None or "*" in self.indexes or index in self.indexes)

    def as_dict(self) -> dict:
        return {"apiKey": self.value, "description": self.description, "permissions": list(self.permissions), "indexes": list(self.indexes)}


@dataclass
class App:
    spark: SparkSession
    name: str
    app_id: str
    api_key: str
    indexes: dict[str, SearchIndex] = field(default_factory=dict)
    keys: dict[str, Key] = field(default_factory=dict)

    def create_index(self, name: str, settings: dict | None = None, shards: int = 1) -> SearchIndex:
        if name in self.indexes:
            raise QueryError("Index already exists")
        self.indexes[name] = SearchIndex(self.spark, name, settings, shards)
        return self.indexes[name]

    def index(self, name: str) -> SearchIndex:
        if name not in self.indexes:
            raise NotFound("Index not found")
        return self.indexes[name]

    def list_indexes(self) -> list[dict]:
        return [{"name": n, "numShards": i.shards} for n, i in self.indexes.items()]

    def drop_index(self, name: str) -> None:
        self.index(name).clear()
        del self.indexes[name]

    def search(self, query: dict):
        """A query, or several, each naming its index."""
        requests = query.get("requests") if isinstance(query, dict) else None
        if requests is None:
            return self._one(query)
        out = []
        for r in requests:
            try:
                out.append(self._one(r))
            except SearchError as e:
                out.append(e.as_dict())
        return out

    def _one(self, query: dict) -> dict:
        name = query.get("indexName") if isinstance(query, dict) else None
        if name not in self.indexes:
            raise QueryError("Invalid index name")
        return self.indexes[name].search(query)

    def add_key(self, body: dict, value: str | None = None) -> Key:
        permissions = body.get("permissions", list(PERMISSIONS))
        if not isinstance(permissions, list) or any(p not in PERMISSIONS for p in permissions):
            raise QueryError("Invalid permissions")
        key = Key(value or _random.token_hex(16), str(body.get("description", "")), tuple(permissions), tuple(body.get("indexes", ["*"])))
        self.keys[key.value] = key
        return key

    def key(self, value: str) -> Key:
        if value == self.api_key:
            return Key(value, "application key")
        if value not in self.keys:
            raise NotFound("Key not found")
        return self.keys[value]

    def info(self) -> dict:
        return {"name": self.name, "appId": self.app_id, "apiKey": self.api_key}


_ROUTES = [
    ("GET", "indexes", "listIndex", lambda a, m, b: a.list_indexes()),
    ("POST", "indexes", "addIndex", lambda a, m, b: {"success": True, "name": a.create_index(b.get("name"), b.get("settings"), b.get("numShards", 1)).name}),
    ("POST", "query", "queryIndex", lambda a, m, b: a.search(b)),
    ("GET", "indexes/{i}/settings", "getConfig", lambda a, m, b: a.index(m["i"]).settings.as_dict()),
    ("POST", "indexes/{i}/settings", "setConfig", lambda a, m, b: a.index(m["i"]).configure(b)),
    ("GET", "indexes/{i}/info", "queryIndex|browseDoc", lambda a, m, b: a.index(m["i"]).info()),
    ("GET", "indexes/{i}/stats", "queryIndex|browseDoc", lambda a, m, b: a.index(m["i"]).stats()),
    ("GET", "indexes/{i}/mapping", "getConfig", lambda a, m, b: a.index(m["i"]).mapping.as_dict()),
    ("POST", "indexes/{i}/clear", "delDoc", lambda a, m, b: a.index(m["i"]).clear()),
    ("POST", "indexes/{i}/query", "queryIndex", lambda a, m, b: a.index(m["i"]).search(b)),
    ("POST", "indexes/{i}", "addDoc", lambda a, m, b: {"success": True, "ids": a.index(m["i"]).add(b)}),
    ("DELETE", "indexes/{i}", "delDoc|delIndex", lambda a, m, b: a.drop_index(m["i"])),
    ("GET", "indexes/{i}/{d}", "browseDoc", lambda a, m, b: a.index(m["i"]).get(m["d"])),
    ("PUT", "indexes/{i}/{d}", "updateDoc", lambda a, m, b: a.index(m["i"]).replace(m["d"], b)),
    ("PATCH", "indexes/{i}/{d}", "updateDoc", lambda a, m, b: a.index(m["i"]).patch(m["d"], b)),
    ("DELETE", "indexes/{i}/{d}", "delDoc", lambda a, m, b: a.index(m["i"]).delete(m["d"])),
    ("GET", "keys", None, lambda a, m, b: [k.as_dict() for k in a.keys.values()]),
    ("POST", "keys", None, lambda a, m, b: a.add_key(b).as_dict()),
    ("GET", "keys/{k}", None, lambda a, m, b: a.key(m["k"]).as_dict()),
    ("POST", "keys/{k}", None, lambda a, m, b: a.add_key(b, a.key(m["k"]).value).as_dict()),
    ("DELETE", "keys/{k}", None, lambda a, m, b: a.keys.pop(a.key(m["k"]).value, None) and None),
]
_COMPILED = [(method, re.compile("^" + re.sub(r"\{(\w)\}", r"(?P<\1>[^/]+)", path) + "$"), permission, run) for method, path, permission, run in _ROUTES]


class Engine:
    """All applications of a session."""

    def __init__(self, spark: SparkSession, master_id: str | None = None, master_key: str | None = None):
        self.spark, self.apps = spark, {}
        self.master = (master_id or _random.token_hex(4), master_key or _random.token_hex(16))

    def create_app(self, name: str) -> App:
        if not name or name in self.apps:
            raise QueryError("Invalid application name")
        self.apps[name] = App(self.spark, name, _random.token_hex(4), _random.token_hex(16))
        return self.apps[name]

    def get_app(self, name: str) -> App:
        if name not in self.apps:
            raise NotFound("Application not found")
        return self.apps[name]

    def list_apps(self) -> list[dict]:
        return [a.info() for a in self.apps.values()]

    def drop_app(self, name: str) -> None:
        for index in list(self.get_app(name).indexes):
            self.apps[name].drop_index(index)
        del self.apps[name]

    def save(self, folder: str) -> None:
        """Applications, keys and settings as one JSON line, and each index's documents as a table, under a folder of any file system."""
        apps = []
        for a in self.apps.values():
            indexes = [{"name": n, "shards": i.shards, "analyzer": i.analyzer, "settings": i.settings.as_dict()} for n, i in a.indexes.items()]
            apps.append(a.info() | {"keys": [k.as_dict() for k in a.keys.values()], "indexes": indexes})
            for n, i in a.indexes.items():
                i.documents.write.mode("overwrite").parquet(f"{folder}/{a.app_id}/{n}")
        line = json.dumps({"master": self.master, "apps": apps})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/engine")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Engine:
        """The engine as saved; its indexes are over the saved tables."""
        saved = json.loads(spark.read.text(f"{folder}/engine").first()[0])
        engine = cls(spark, *saved["master"])
        for a in saved["apps"]:
            app = engine.apps[a["name"]] = App(spark, a["name"], a["appId"], a["apiKey"])
            for k in a["keys"]:
                app.keys[k["apiKey"]] = Key(k["apiKey"], k["description"], tuple(k["permissions"]), tuple(k["indexes"]))
            for i in a["indexes"]:
                index = app.create_index(i["name"], None, i["shards"])
                index.analyzer, index.settings = i["analyzer"], Settings(**i["settings"])
                index.use_table(spark.read.parquet(f"{folder}/{a['appId']}/{i['name']}"))
        return engine

    def request(self, method: str, path: str, body=None, app_id: str | None = None, api_key: str | None = None) -> tuple[int, object]:
        """(status, answer) of an API call; paths as in /1/indexes/books/query, or /ping."""
        try:
            return 200, self._route(method.upper(), path.strip("/"), body if body is not None else {}, app_id, api_key)
        except SearchError as e:
            return e.status, e.as_dict()

    def _route(self, method: str, path: str, body, app_id, api_key):
        if path == "ping":
            return {"success": True}
        if not app_id or not api_key:
            raise QueryError("Missing application id or key")
        path = path.removeprefix("1/")
        if (app_id, api_key) == self.master:
            return self._master(method, path, body)
        app = next((a for a in self.apps.values() if a.app_id == app_id), None)
        if app is None:
            raise Forbidden("Forbidden")
        key = None if api_key == app.api_key else app.keys.get(api_key)
        if api_key != app.api_key and key is None:
            raise Forbidden("Forbidden")
        for m, pattern, permission, run in _COMPILED:
            found = pattern.match(path) if m == method else None
            if found:
                where = found.groupdict()
                if key is not None and (permission is None or not any(key.allows(p, where.get("i")) for p in permission.split("|"))):
                    raise Forbidden("Forbidden")
                answer = run(app, where, body)
                return {"success": True} if answer is None else answer
        raise Forbidden("Forbidden")

    def _master(self, method: str, path: str, body):
        name = path.removeprefix("applications/") if path.startswith("applications/") else None
        if (method, path) == ("GET", "version"):
            return {"version": __version__}
        if path == "applications":
            return self.list_apps() if method == "GET" else self.create_app(body.get("name")).info()
        if name and method == "GET":
            return self.get_app(name).info()
        if name and method == "DELETE":
            self.drop_app(name)
            return {"success": True}
        raise Forbidden("Forbidden")
