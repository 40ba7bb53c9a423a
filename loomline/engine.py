"""The query surface: graph questions at any point in time, answered with DataFrames, and the request handlers that return plain dictionaries."""

from __future__ import annotations

import html
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.embed import base_properties, embed, node_text, token_sums, unit, vectors_of
from loomline.functions.text import intent
from loomline.model import Graph
from loomline.operators import diff, prompts, search, traversal
from loomline.session import ship
from loomline.sources.store import Store


class GraphSource(Protocol):
    """What the engine reads from; Store is one."""

    def graph(self, as_of: str | int | None = None) -> Graph: ...
    def table(self, name: str, as_of: str | int | None = None) -> DataFrame: ...
    def timeline(self) -> DataFrame: ...


@dataclass
class Traversal:
    root: DataFrame
    nodes: DataFrame
    edges: DataFrame
    depth_reached: int


@dataclass
class Diff:
    nodes: DataFrame
    edges: DataFrame


def node_vectors(nodes: DataFrame) -> DataFrame:
    """id, name, type, vector: token-hash embeddings of the nodes' texts. A node that has an embedding already keeps it."""
    text = node_text(F.col("type"), F.col("name"), F.col("description"), base_properties(F.col("type"), F.col("properties")))
    if "embedding" not in nodes.columns:
        return vectors_of(nodes)
    known = F.when(F.size("embedding") > 0, F.col("embedding").cast("array<double>"))
    both = nodes.select("id", "name", "type", known.alias("_known"), token_sums(F.when(known.isNull(), text)).alias("_s"))
    return both.select("id", "name", "type", F.coalesce("_known", unit(F.col("_s"))).alias("vector"))


class LineageEngine:
    """Questions to a versioned graph. Snapshots are immutable, so a resolved version could be cached by its number; nothing is cached unasked."""

    def __init__(self, source: GraphSource):
        self.source = source

    @classmethod
    def at(cls, spark: SparkSession, base: str) -> LineageEngine:
        ship(spark)
        return cls(Store(spark, base))

    def full_graph(self, as_of: str | int | None = None) -> Graph:
        return traversal.complete(self.source.graph(as_of))

    def timeline(self) -> DataFrame:
        return self.source.timeline()

    def _walk(self, start: str, depth: int, as_of: str | int | None, upstream: bool) -> Traversal:
        g = self.full_graph(as_of)
        roots = g.nodes.filter(F.col("id") == start).select(F.col("id").alias("root"))
        levels = traversal.walk(g, roots, depth, upstream)
        edges = traversal.walked_edges(g, levels, depth, upstream).drop("root")
        nodes = g.nodes.join(levels.select("id", "level"), "id")
        return Traversal(nodes.filter("level = 0"), nodes, edges, levels.agg(F.max("level")).first()[0] or 0)

    def blast_radius(self, start: str, depth: int = 5, as_of: str | int | None = None) -> Traversal:
        """Everything downstream of an id, itself included."""
        return self._walk(start, depth, as_of, False)

    def root_cause(self, start: str, depth: int = 5, as_of: str | int | None = None) -> Traversal:
        """Everything upstream of an id, itself included."""
        return self._walk(start, depth, as_of, True)

    def diff(self, t1: str | int, t2: str | int, scope: str | None = None) -> Diff:
        return Diff(*diff.graph_diff(self.full_graph(t1), self.full_graph(t2), scope))

    def search_terms(self, query: str, top_k: int = 5, as_of: str | int | None = None) -> DataFrame:
        return search.by_terms(self.full_graph(as_of).nodes, query, top_k)

    def search_vectors(self, vector: list[float], top_k: int = 5, max_distance: float = search.MAX_DISTANCE, as_of: str | int | None = None) -> DataFrame:
        return search.by_vector(self.source.table("vectors", as_of), vector, top_k, max_distance)

    def search(self, query: str, top_k: int = 5, as_of: str | int | None = None) -> DataFrame:
        """Vectors and terms together, with the datasets of found columns. The query is embedded at the length of the stored vectors."""
        vectors = self.source.table("vectors", as_of)
        one = vectors.filter("vector is not null").select(F.size("vector")).limit(1).collect()
        return search.hybrid(self.full_graph(as_of).nodes, vectors, query, embed(query, one[0][0]) if one else [], top_k)


class BadRequest(ValueError):
    """A request with a missing or impossible argument."""


def _number(body: dict[str, Any], key: str, default: int, low: int, high: int) -> int:
    v = body.get(key, default)
    if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
        raise BadRequest(f"{key} is a number from {low} to {high}")
    return v


def _text(body: dict[str, Any], key: str, former: str | None = None) -> str:
    """A required text; former: another name that is also taken."""
    v = body.get(key, body.get(former) if former else None)
    if not isinstance(v, str) or not v:
        raise BadRequest(f"{key} is required")
    return v


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.collect()]


class Api:
    """Request handlers by path. They return what a web server would send as JSON; the answer to one request comes to the driver, and only that."""

    def __init__(self, engine: LineageEngine):
        self.engine = engine

    def handle(self, path: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
        routes = {"/graph": self.graph, "/timeline": self.timeline, "/blast-radius": self.blast_radius, "/root-cause": self.root_cause, "/discovery": self.discovery, "/time-travel/diff": self.time_travel, "/chat": self.chat, "/config": self.config, "/healthz": self.health}
        path = path.removeprefix("/api/v1")
        if path not in routes:
            raise BadRequest(f"no such path: {path}")
        return routes[path](body or {})

    def health(self, body: dict[str, Any]) -> dict[str, Any]:
        return {"status": "ok"}

    def config(self, body: dict[str, Any]) -> dict[str, Any]:
        """What a client may ask for: bounds of the arguments and the paths."""
        return {"max_depth": {"default": 5, "min": 1, "max": 10}, "top_k": {"default": 5, "min": 1, "max": 50}, "llm": False}

    def graph(self, body: dict[str, Any]) -> dict[str, Any]:
        g = self.engine.full_graph(body.get("as_of"))
        return {"nodes": _rows(g.nodes), "edges": _rows(g.edges)}

    def timeline(self, body: dict[str, Any]) -> dict[str, Any]:
        return {"timeline": _rows(self.engine.timeline())}

    def _traversal(self, body: dict[str, Any], key: str, upstream: bool) -> dict[str, Any]:
        start, depth = _text(body, key, "start_node_id"), _number(body, "max_depth", 5, 1, 10)
        t = (self.engine.root_cause if upstream else self.engine.blast_radius)(start, depth, body.get("as_of"))
        nodes = _rows(t.nodes)
        prompt = (prompts.origin_prompt if upstream else prompts.impact_prompt)(start, t.nodes, t.edges).first()[0]
        return {"root": next((n for n in nodes if n["level"] == 0), None), "nodes": nodes, "count": len(nodes), "edges": _rows(t.edges), "depth_reached": t.depth_reached, "prompt": prompt}

    def blast_radius(self, body: dict[str, Any]) -> dict[str, Any]:
        return self._traversal(body, "node_id", False)

    def root_cause(self, body: dict[str, Any]) -> dict[str, Any]:
        return self._traversal(body, "node_id", True)

    def discovery(self, body: dict[str, Any]) -> dict[str, Any]:
        query, k = _text(body, "query"), _number(body, "top_k", 5, 1, 50)
        found = self.engine.search(query, k, body.get("as_of"))
        return {"nodes": (rows := _rows(found)), "count": len(rows), "prompt": prompts.discovery_prompt(query, found).first()[0]}

    def time_travel(self, body: dict[str, Any]) -> dict[str, Any]:
        scope = body.get("node_id", body.get("scope"))
        d = self.engine.diff(_text(body, "timestamp_t1", "t1"), _text(body, "timestamp_t2", "t2"), scope)
        nodes, edges = _rows(d.nodes), _rows(d.edges)
        counts = {s: sum(n["status"] == s for n in nodes) for s in ("added", "removed", "modified")}
        return {"nodes": nodes, "edges": edges, "counts": counts, "prompt": prompts.diff_prompt(scope, d.nodes, d.edges).first()[0]}

    def chat(self, body: dict[str, Any]) -> dict[str, Any]:
        """Routes a message by its words; impact and origin questions go to the node that it names, or the first one by id."""
        message = _text(body, "message")
        nodes = self.engine.full_graph(body.get("as_of")).nodes
        kind = nodes.sparkSession.range(1).select(intent(F.lit(message)).alias("i")).first()[0]
        low = F.lit(message.lower().strip())
        if kind != "search":
            named = (F.length("name") > 0) & low.contains(F.lower("name")) | low.contains(F.lower("id"))
            target = nodes.select("id", named.alias("hit")).orderBy(F.desc_nulls_last("hit"), "id").limit(1).collect()
            if target:
                call = self.blast_radius if kind == "downstream" else self.root_cause
                start = target[0]["id"]
                found = call({"node_id": start, "as_of": body.get("as_of")})
                return found | {"intent": kind, "target_node_id": start, "reply": self._told(kind, start, found)}
        found = self.discovery({"query": message, "as_of": body.get("as_of")})
        return found | {"intent": "search", "reply": self._told("search", message, found)}

    def _told(self, kind: str, subject: str, found: dict[str, Any]) -> str:
        """The answer in words, for where no language model is asked. The start itself is not among what it lists."""
        safe = lambda x: html.escape(x or "", quote=False)
        others = [n for n in found["nodes"] if n["id"] != subject]
        lead = {"downstream": "Downstream of", "upstream": "Upstream of", "search": "Matches for"}[kind]
        head = f"<p>{lead} <code>{safe(subject)}</code>: {len(others)} assets"
        head += f", {found['depth_reached']} hops deep.</p>" if "depth_reached" in found else ".</p>"
        items = "".join(f"<li><code>{safe(n['name'])}</code> ({safe(n['type'])})</li>" for n in others)
        return head + (f"<ul>{items}</ul>" if items else "<p>None.</p>")

    # what an agent calls: one text each
    def impact_context(self, node_id: str, max_depth: int = 5) -> str:
        return self.blast_radius({"node_id": node_id, "max_depth": max_depth})["prompt"]

    def catalog_context(self, query: str, top_k: int = 5) -> str:
        return self.discovery({"query": query, "top_k": top_k})["prompt"]

    def change_context(self, node_id: str, timestamp_t1: str, timestamp_t2: str) -> str:
        return self.time_travel({"node_id": node_id, "timestamp_t1": timestamp_t1, "timestamp_t2": timestamp_t2})["prompt"]
