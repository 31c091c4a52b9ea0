"""Index management: create, update, drop, list; queries by index name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fathom.plans import query as q
from fathom.plans.definition import IndexDefinition
from fathom.plans.errors import need, only
from fathom.plans.index import SearchIndex


class IndexCatalog:
    """Indexes of collections, by name; `default` where a query names none."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], SearchIndex] = {}

    def create(self, collection: str, docs: DataFrame, definition: dict | IndexDefinition, name: str | None = None, **options) -> SearchIndex:
        made = SearchIndex(docs, definition, **options)
        name = name or made.definition.name
        need((collection, name) not in self.held, f"index {name} already exists")
        self.held[collection, name] = made
        return made

    def update(self, collection: str, name: str, definition: dict | IndexDefinition) -> SearchIndex:
        old = self.get(collection, name)
        self.held[collection, name] = SearchIndex(old.docs, definition, old.id_col, old.field_names_col, old.synonym_rows)
        return self.held[collection, name]

    def drop(self, collection: str, name: str) -> None:
        self.get(collection, name)
        del self.held[collection, name]

    def list(self, collection: str) -> list[dict]:
        return [{"name": n, "type": x.definition.type, "status": "READY", "queryable": True} for (c, n), x in sorted(self.held.items()) if c == collection]

    def get(self, collection: str, name: str = "default") -> SearchIndex:
        need((collection, name) in self.held, f"no index {name} of {collection}")
        return self.held[collection, name]

    def run(self, collection: str, command: dict) -> DataFrame:
        """A command {search | searchMeta | vectorSearch: body} on a collection."""
        only(command, "search searchMeta vectorSearch", "command")
        need(len(command) == 1, "one command at a time")
        kind, body = next(iter(command.items()))
        index = self.get(collection, body.get("index", "default"))
        return {"search": q.search, "searchMeta": q.search_meta, "vectorSearch": q.vector}[kind](index, body)

    def manage(self, collection: str, command: dict, docs: DataFrame | None = None) -> list[dict]:
        """createSearchIndexes, updateSearchIndex, dropSearchIndex, listSearchIndexes as documents."""
        kind, body = next(iter(command.items()))
        if kind == "createSearchIndexes":
            need(docs is not None, "createSearchIndexes needs the collection's rows")
            for d in body["indexes"]:
                self.create(collection, docs, d["definition"], d.get("name"))
        elif kind == "updateSearchIndex":
            self.update(collection, body["name"], body["definition"])
        elif kind == "dropSearchIndex":
            self.drop(collection, body["name"])
        else:
            need(kind == "listSearchIndexes", f"unknown command {kind}")
        return self.list(collection)
