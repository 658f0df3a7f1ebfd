"""Deeply nested records into related flat tables, by shared inlining.

A :class:`SchemaGraph` names the elements of a record type and which element holds which, how often, and in which
shapes. :meth:`SchemaGraph.relations` analyses the graph: an element becomes a relation of its own if it is the root,
can occur more than once below its parent, is held by several parents (shared), or can hold itself over any path
(recursive); every other descendant is inlined into the relation above it, its scalars becoming columns named by the
path. :func:`shred` reads JSON text as ``VARIANT`` and emits, in one pass over the input and without a shuffle, one row
per occurrence of every relation with its own key, its parent's key and relation, and the parent's natural key;
:func:`flat_tables` writes that stream once, by relation, and gives one DataFrame per relation.

A repeated element may come as a list, as null, as one bare object or as an object keyed by id. The records may lie in
lists, in other objects and in JSON strings, in one another to any depth.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import let
from ..session import checkpointed, written

ONE, MANY = "?", "*"


@dataclass(frozen=True)
class Element:
    """``scalars``: fields kept as columns. ``key``: the field that names an occurrence; where it is absent, the id
    under which a keyed parent holds it. ``needs``: a field without which an occurrence, and all below it, is none.
    ``marks``: fields of which a bare object has at least one, which tells it from an object keyed by id; empty where
    an object is always keyed by id."""

    name: str
    scalars: tuple[str, ...] = ()
    key: str | None = None
    needs: str | None = None
    marks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Edge:
    parent: str
    child: str
    path: str
    times: str = ONE


@dataclass
class Relation:
    """A table to be made: own scalars and those of inlined descendants, and the edges through which it is reached."""

    element: Element
    columns: dict[str, str] = field(default_factory=dict)
    children: list[tuple[str, str, str]] = field(default_factory=list)  # child element, path from here, times
    recursive: bool = False


class SchemaGraph:
    def __init__(self, root: str, elements: list[Element], edges: list[Edge]):
        self.root, self.edges = root, edges
        self.elements = {e.name: e for e in elements}
        for e in edges:
            if e.parent not in self.elements or e.child not in self.elements:
                raise ValueError(f"edge {e.parent} -> {e.child} names an unknown element")

    def _below(self, name: str) -> set[str]:
        seen: set[str] = set()
        todo = [name]
        while todo:
            at = todo.pop()
            for e in self.edges:
                if e.parent == at and e.child not in seen:
                    seen.add(e.child)
                    todo.append(e.child)
        return seen

    def root_fields(self) -> frozenset[str]:
        """Fields by which an object is known as a record: the root's scalars and the first steps to its children."""
        return frozenset(self.elements[self.root].scalars) | {e.path.split(".")[0] for e in self.edges if e.parent == self.root}

    def relations(self) -> dict[str, Relation]:
        """Shared inlining: which elements get a relation, and what each relation inlines."""
        reached = {self.root} | self._below(self.root)
        edges = [e for e in self.edges if e.parent in reached]
        degree = {n: sum(e.child == n for e in edges) for n in reached}
        repeated = {e.child for e in edges if e.times == MANY}
        cyclic = {n for n in reached if n in self._below(n)}
        own = {n for n in reached if n == self.root or n in repeated or degree[n] > 1 or n in cyclic}

        def inline(r: Relation, name: str, path: str, prefix: str) -> None:
            for s in self.elements[name].scalars:
                r.columns[prefix + s] = f"{path}.{s}"
            for e in edges:
                if e.parent == name:
                    if e.child in own:
                        r.children.append((e.child, f"{path}.{e.path}", e.times))
                    else:
                        inline(r, e.child, f"{path}.{e.path}", f"{prefix}{e.path.replace('.', '_')}_")

        out = {}
        for n in sorted(own):
            out[n] = Relation(self.elements[n], recursive=n in cyclic)
            inline(out[n], n, "$", "")
        return out


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _step(key: Column) -> Column:
    """A key as a step of a path: ``~`` and ``/`` are written ``~0`` and ``~1``."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _occurrences(v: Column, child: Element, times: str) -> Column:
    """``array<struct<k,p,n>>`` of the objects in ``v``: the id under which each is held (null in lists), its place (id or
    position in the list), and the object."""
    none = F.lit(None).cast("string")

    def bare(x: Column) -> Column:
        return F.array(F.struct(none.alias("k"), F.lit("0").alias("p"), x.alias("n")))

    def of_object(x: Column, keyed: Column) -> Column:
        if times == ONE:
            return F.when(keyed.isNotNull(), bare(x))
        entries = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("k"), _step(e["key"]).alias("p"), e["value"].alias("n")))
        if not child.marks:
            return entries
        return F.when(F.arrays_overlap(F.map_keys(keyed), F.array(*[F.lit(m) for m in child.marks])), bare(x)).otherwise(entries)

    def of_value(x: Column) -> Column:
        by_key = let(_get(x, "$", "map<string,variant>"), lambda m: of_object(x, m))
        if times == ONE:
            return by_key
        listed = F.transform(_get(x, "$", "array<variant>"), lambda n, i: F.struct(none.alias("k"), i.cast("string").alias("p"), n.alias("n")))
        return F.coalesce(listed, by_key)

    return F.filter(let(v, of_value), lambda x: _is_object(x["n"]))


def _parsed(text: Column) -> Column:
    """The one JSON value a text is, else null. Between brackets, what follows a complete value is an error too."""
    whole = _get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(whole, lambda a: F.when(F.size(a) == 1, a[0]))


def _strict(text: str):
    """A JSON value by the rules of the engine's own parser: no NaN, no key twice."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("a key stands twice")
        return out

    def constant(name: str):
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def opened(text: str, fields: frozenset[str]) -> list[tuple[str, str]]:
    """``(trail, JSON text)`` of the records in a text: objects that have one of ``fields``. Lists, other objects and strings
    that are JSON themselves are opened, however deep they lie in one another. The trail names the way: positions and keys,
    joined by full stops. What is no complete JSON, or nested deeper than a parser goes (1000), holds none."""
    out: list[tuple[str, str]] = []
    todo: list[tuple[str, object]] = [("", text)]
    while todo:
        trail, x = todo.pop()
        if isinstance(x, str):
            if x.lstrip()[:1] in ("{", "[", '"'):
                try:
                    todo.append((trail, _strict(x)))
                except (ValueError, RecursionError):
                    pass
        elif isinstance(x, dict) and not fields.isdisjoint(x):
            try:
                out.append((trail, json.dumps(x)))
            except RecursionError:
                pass
        elif isinstance(x, (dict, list)):
            steps = x.items() if isinstance(x, dict) else enumerate(x)
            held = [(str(k).replace("~", "~0").replace("/", "~1").replace(".", "~2"), v) for k, v in steps]
            todo += [(f"{trail}.{k}" if trail else k, v) for k, v in reversed(held)]
    return out


def records(df: DataFrame, body: str, fields: frozenset[str]) -> DataFrame:
    """``df`` with ``_records``, ``array<struct<trail,n>>``: the records in the JSON text ``body``.

    A text that is one record, as most are, never leaves the JVM. Only wrapped ones (lists, strings, other objects) go
    through Python, which opens them to any depth within the same pass.
    """

    @F.pandas_udf("array<struct<trail: string, text: string>>")
    def unwrapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else opened(t, fields))

    has = F.lit(False)
    for f in sorted(fields):
        has = has | _get(F.col("_whole"), f"$.{f}", "variant").isNotNull()
    df = df.withColumn("_whole", _parsed(F.col(body))).withColumn("_plain", has)
    df = df.withColumn("_open", unwrapped(F.when(F.col("_whole").isNotNull() & ~F.col("_plain"), F.col(body))))
    inner = F.transform(F.coalesce("_open", F.array().cast("array<struct<trail:string,text:string>>")), lambda o: F.struct(o["trail"].alias("trail"), F.try_parse_json(o["text"]).alias("n")))
    whole = F.array(F.struct(F.lit("").alias("trail"), F.col("_whole").alias("n")))
    return df.withColumn("_records", F.when(F.col("_plain"), whole).otherwise(inner)).drop("_whole", "_plain", "_open")


def shred(df: DataFrame, graph: SchemaGraph, body: str, keep: list[str]) -> DataFrame:
    """One row per occurrence of every relation in the JSON text ``body``; the columns ``keep`` are carried along.

    Result: ``keep``, then ``relation``, ``row_path`` (the key within the text: relation and place of every step),
    ``parent_relation``, ``parent_path`` (the foreign key; null for a root), ``parent_key`` (natural key of the parent),
    ``item`` (natural key), ``node`` (the object itself, ``VARIANT``). A record is an object with a field of the root,
    wrapped in whatever lists, objects and JSON strings. Null, empty, damaged or other text gives no row; an element
    without its needed field gives none for itself and what it holds. Other columns of ``df`` are left out, whatever
    their names.
    """
    rels = graph.relations()
    text = "string"

    def row(name: str, path: Column, up: str | None, up_path: Column, up_key: Column, item: Column, node: Column) -> Column:
        return F.struct(
            F.lit(name).alias("relation"), path.alias("row_path"), F.lit(up).cast(text).alias("parent_relation"), up_path.alias("parent_path"),
            up_key.alias("parent_key"), item.alias("item"), node.alias("node"), F.lit(up is not None and rels[name].recursive).alias("_open"),
        )

    def has(name: str) -> Callable[[Column], Column]:
        return lambda x: _get(x["n"], f"$.{name}").isNotNull()

    def occurrence(c: Relation, r: Relation, path: Column, item: Column) -> Callable[[Column], Column]:
        e = c.element

        def one(x: Column) -> Column:
            here = F.concat(path, F.lit(f"/{e.name}:"), x["p"])
            own = F.coalesce(_get(x["n"], f"$.{e.key}"), x["k"]) if e.key else x["k"]
            me = F.array(row(e.name, here, r.element.name, path, item, own, x["n"]))
            more = [] if c.recursive else below(c, here, x["n"], own)
            return F.concat(me, *more) if more else me

        return one

    def below(r: Relation, path: Column, node: Column, item: Column) -> list[Column]:
        parts = []
        for child, at, times in r.children:
            c = rels[child]
            e = c.element
            held = _occurrences(_get(node, at, "variant"), e, times)
            if e.needs:
                held = F.filter(held, has(e.needs))
            parts.append(F.coalesce(F.flatten(F.transform(held, occurrence(c, r, path, item))), F.array()))
        return parts

    root = rels[graph.root]
    none = F.lit(None).cast(text)

    def of_record(x: Column) -> Column:
        path = F.concat(F.lit(f"/{graph.root}:"), x["trail"])
        item = _get(x["n"], f"$.{root.element.key}") if root.element.key else none
        return F.concat(F.array(row(graph.root, path, None, none, none, item, x["n"])), *below(root, path, x["n"], item))

    held = records(df.where(F.col(body).isNotNull()).select(*keep, F.col(body).alias("_body")), "_body", graph.root_fields())
    rows = held.select(*keep, F.explode(F.flatten(F.transform("_records", of_record))).alias("_r")).select(*keep, "_r.*")
    loops = [r for r in rels.values() if r.recursive]
    parts = [rows]
    while loops:  # a level of recursion at a time, for as long as there is one
        level = checkpointed(parts[-1].where("_open"))
        if level.isEmpty():
            break
        nested = [F.when(F.col("relation") == r.element.name, F.concat(*below(r, F.col("row_path"), F.col("node"), F.col("item")))) for r in loops if r.children]
        parts.append(level.select(*keep, F.explode(F.coalesce(*nested)).alias("_r")).select(*keep, "_r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_open")


def _flat(df: DataFrame, graph: SchemaGraph, body: str, id_col: str, names: list[str]) -> DataFrame:
    """The rows of some relations with their keys; ``_f`` holds the values of the relation's columns. Rows with equal id
    and text are one record: what is told apart is the flat row, not the text, which never moves."""
    rows = shred(df.withColumn("_t", F.substring(F.sha2(body, 256), 1, 16)), graph, body, [id_col, "_t"]).where(F.col("relation").isin(*names))
    rels = graph.relations()
    values = F.lit(None).cast("array<string>")
    for n in names:
        values = F.when(F.col("relation") == n, F.array(*[_get(F.col("node"), p) for p in rels[n].columns.values()]).cast("array<string>")).otherwise(values)
    head = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("#"), F.col("_t"))
    keys = [F.concat(head, "row_path").alias("row_id"), F.concat(head, "parent_path").alias("parent_id"), "parent_relation", id_col, F.col("item").alias("natural_key")]
    return rows.select("relation", *keys, values.alias("_f")).distinct()


def _relation(rows: DataFrame, relation: Relation, id_col: str) -> DataFrame:
    cols = [F.col("_f")[i].alias(c) for i, c in enumerate(relation.columns)]
    return rows.where(F.col("relation") == relation.element.name).select("row_id", "parent_id", "parent_relation", id_col, "natural_key", *cols)


def flat_table(df: DataFrame, graph: SchemaGraph, body: str, id_col: str, name: str) -> DataFrame:
    """The one relation ``name`` of :func:`flat_tables`, without writing the others."""
    return _relation(_flat(df, graph, body, id_col, [name]), graph.relations()[name], id_col)


def flat_tables(df: DataFrame, graph: SchemaGraph, body: str, id_col: str) -> dict[str, DataFrame]:
    """One DataFrame per relation: ``row_id``, ``parent_id`` and ``parent_relation`` (foreign key; for a root null),
    ``<id_col>``, ``natural_key`` and the relation's columns as text. The texts are parsed once: the rows of all relations
    are written to the shared folder by relation, and each table reads its own part. Rows of ``df`` with equal id and text
    are one record. Equal ids with different texts are told apart by a hash of the text inside the key."""
    rels = graph.relations()
    rows = written(_flat(df, graph, body, id_col, sorted(rels)), "relation")
    return {n: _relation(rows, r, id_col) for n, r in rels.items()}


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """``(relation, rows, orphans)``: of every relation but the root, its rows and those whose parent is in no table."""
    keys = None
    for n, t in tables.items():
        part = t.select(F.lit(n).alias("relation"), "row_id", "parent_id", "parent_relation")
        keys = part if keys is None else keys.unionByName(part)
    up = keys.select(F.col("relation").alias("parent_relation"), F.col("row_id").alias("parent_id"), F.lit(1).alias("_up"))
    held = keys.where("parent_id is not null").join(up, ["parent_relation", "parent_id"], "left")
    return held.groupBy("relation").agg(F.count("*").alias("rows"), F.count_if(F.col("_up").isNull()).alias("orphans"))


#: The recorded replies: schema graph of their payloads.
REPLY = SchemaGraph(
    "reply",
    [
        Element("reply", ("success", "batchcomplete")),
        Element("query"),
        Element("searchinfo", ("totalhits",)),
        Element("page", ("pageid", "ns", "title", "missing", "length", "pagelanguage", "contentmodel"), key="title", needs="title", marks=("title", "ns", "pageid", "missing")),
        Element("pageprops", ("wikibase_item", "disambiguation", "defaultsort")),
        Element("search", ("ns", "title", "pageid", "size", "wordcount", "snippet", "timestamp"), key="title", needs="title", marks=("title", "pageid")),
        Element("normalized", ("from", "to", "fromencoded"), key="from", needs="from", marks=("from", "to")),
        Element("redirect", ("from", "to", "tofragment"), key="from", needs="from", marks=("from", "to")),
        Element("logevent", ("logid", "ns", "title", "type", "action", "timestamp"), key="logid", needs="title", marks=("logid", "title")),
        Element("params", ("target_ns", "target_title")),
        Element("langlink", ("lang", "title"), key="lang", needs="title", marks=("lang", "title")),
        Element("revision", ("timestamp", "size"), key="timestamp", needs="timestamp", marks=("timestamp", "size")),
        Element("entity", ("id", "type"), key="id", marks=("id", "sitelinks")),
        Element("label", ("language", "value"), key="language", marks=("language", "value")),
        Element("description", ("language", "value"), key="language", marks=("language", "value")),
        Element("sitelink", ("site", "title"), key="site", needs="title", marks=("site", "title")),
    ],
    [
        Edge("reply", "query", "query"),
        Edge("query", "searchinfo", "searchinfo"),
        Edge("query", "page", "pages", MANY),
        Edge("page", "pageprops", "pageprops"),
        Edge("page", "langlink", "langlinks", MANY),
        Edge("page", "revision", "revisions", MANY),
        Edge("query", "search", "search", MANY),
        Edge("query", "normalized", "normalized", MANY),
        Edge("query", "redirect", "redirects", MANY),
        Edge("query", "logevent", "logevents", MANY),
        Edge("logevent", "params", "params"),
        Edge("reply", "entity", "entities", MANY),
        Edge("entity", "label", "labels", MANY),
        Edge("entity", "description", "descriptions", MANY),
        Edge("entity", "sitelink", "sitelinks", MANY),
    ],
)

def item_names(tables: dict[str, DataFrame], lang: str = "en") -> DataFrame:
    """``(qid, label, description, editions)``: of every recorded item its name and description in a language, and the sites it links,
    in order. ``tables``: the flat tables of :data:`REPLY`. Of several records of an item the least of each holds."""
    own = lambda name: tables[name].where(F.col("language") == lang).select("parent_id", F.col("value").alias(name))
    sites = tables["sitelink"].groupBy("parent_id").agg(F.array_sort(F.collect_set("site")).alias("_s"))
    rows = tables["entity"].select(F.col("row_id").alias("parent_id"), F.col("natural_key").alias("qid")).where("qid is not null")
    rows = rows.join(own("label"), "parent_id", "left").join(own("description"), "parent_id", "left").join(sites, "parent_id", "left")
    return rows.groupBy("qid").agg(F.min("label").alias("label"), F.min("description").alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("editions"))


#: Relations whose rows are cases of nested elements, and those whose parent is named by its natural key.
CASES = ("page", "search", "normalized", "redirect", "logevent", "langlink", "revision", "sitelink")
LINKED = ("langlink", "revision", "sitelink")


def nested_elements(responses: DataFrame) -> DataFrame:
    """Distinct ``(response_id, kind, parent, item)`` of every nested element in ``responses.body``; ``parent`` is
    the natural key of the page or entity, ``''`` for elements of the reply itself."""
    rows = shred(responses, REPLY, "body", ["response_id"])
    return (
        rows.where(F.col("relation").isin(*CASES) & F.col("item").isNotNull())
        .select(
            "response_id", F.col("relation").alias("kind"),
            F.when(F.col("relation").isin(*LINKED), F.coalesce("parent_key", F.lit(""))).otherwise("").alias("parent"), "item",
        )
        .distinct()
    )
