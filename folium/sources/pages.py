"""Pages as a table of nodes: one row per node with its interval, so that path steps are joins and predicates.

``id`` numbers nodes in document order and ``last`` is the end of a node's subtree: d is below a where
a.id < d.id <= a.last. Sibling places are columns, so positional tests are plain filters.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import ascii_lower

#: Fixed values of the HTML standard: elements without content, and what closes an open element of its kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}

#: Elements that stand in the head; any other opens the body where the page leaves it out.
HEAD = frozenset("title meta link style script base noscript template".split())

NODE = "id int, parent int, last int, depth int, kind string, name string, value string, attrs map<string,string>, begin int, end int, nth int, nth_last int, nth_of_type int, nth_last_of_type int, n_children int"


#: Nodes that go to Spark at once: a task holds so many and its largest page's, however many pages it has.
NODES = 5_000

#: Entities that pages of escaped text are made of.
ESCAPES = ("lt", "gt", "amp")


class _Nodes(HTMLParser):
    """Collects node rows; unclosed and misnested elements close as their parents do, and html, head and body are there
    where the page leaves them out. ``begin`` and ``end`` are a node's places in the page's text."""

    def __init__(self, mark: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.mark = mark  # stands for an ampersand that begins no entity
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.seen: set[str] = set()
        self.chars = 0

    def imply(self, tag: str | None) -> None:
        """Open what must stand around an element, or around text for None."""
        if tag != "html" and "html" not in self.seen:
            self.start("html", [])
        if tag in HEAD and not self.seen & {"head", "body"}:
            self.start("head", [])
        elif tag not in HEAD and tag not in ("html", "head", "body") and "body" not in self.seen:
            if tag is None and self.open and self.rows[self.open[-1] - 1]["name"] in HEAD:
                return
            while self.open and self.rows[self.open[-1] - 1]["name"] != "html":
                self.shut(len(self.open) - 1)
            self.start("body", [])

    def start(self, tag: str, attrs: list) -> int:
        self.seen.add(tag)
        number = self.add("element", tag, None, attrs)
        if tag not in VOID:
            self.open.append(number)
        return number

    def add(self, kind: str, name: str | None, value: str | None, attrs: list[tuple[str, str | None]]) -> int:
        number = len(self.rows) + 1
        if self.mark:
            value = value and value.replace(self.mark, "&")
            attrs = [(k, v and v.replace(self.mark, "&")) for k, v in attrs]
        self.rows.append({"id": number, "parent": self.open[-1] if self.open else 0, "last": number, "depth": len(self.open) + 1, "kind": kind, "name": name, "value": value, "attrs": {k: v or "" for k, v in reversed(attrs)}, "begin": self.chars, "end": self.chars})
        return number

    def shut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.rows[self.open.pop() - 1] |= {"last": len(self.rows), "end": self.chars}

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, ())
        if self.open and self.rows[self.open[-1] - 1]["name"] in ends:
            self.shut(len(self.open) - 1)
        if tag == "body" and "body" not in self.seen:
            while self.open and self.rows[self.open[-1] - 1]["name"] != "html":
                self.shut(len(self.open) - 1)
        self.imply(tag)
        if tag not in self.seen or tag not in ("html", "head", "body"):
            self.start(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth] - 1]["name"] == tag:
                self.shut(depth)
                break

    def handle_data(self, data):
        if data.strip() or self.open:
            if data.strip():
                self.imply(None)
            self.add("text", None, data, [])
            self.chars += len(data)
            self.rows[-1]["end"] = self.chars


def page_rows(html: str | None, entities: tuple[str, ...] | None = None) -> list[dict]:
    """The nodes of one page in document order. ``entities`` are the names that are decoded where they end in a semicolon,
    all others stay as they are; None is for every entity of the HTML standard, with or without it."""
    html, mark = html or "", None
    if entities is not None:
        mark = next(c for c in map(chr, [*range(0xFDD0, 0xFDF0), *range(0xE000, 0xF900)]) if c not in html)
        html = re.sub(rf"&(?!(?:{'|'.join(entities)});)", mark, html)
    p = _Nodes(mark)
    p.feed(html)
    p.close()
    p.shut(0)
    children: dict[int, list[dict]] = {}
    for r in p.rows:
        r |= {"nth": None, "nth_last": None, "nth_of_type": None, "nth_last_of_type": None, "n_children": 0}
        if r["kind"] == "element":
            children.setdefault(r["parent"], []).append(r)
    for parent, mine in children.items():
        kinds: dict[str, int] = {}
        for k, r in enumerate(mine):
            kinds[r["name"]] = kinds.get(r["name"], 0) + 1
            r |= {"nth": k + 1, "nth_last": len(mine) - k, "nth_of_type": kinds[r["name"]]}
        for r in mine:
            r["nth_last_of_type"] = kinds[r["name"]] - r["nth_of_type"] + 1
        if parent:
            p.rows[parent - 1]["n_children"] = len(mine)
    return p.rows


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", entities: tuple[str, ...] | None = None) -> DataFrame:
    """``key`` and the NODE columns, one row per node of each page; ``entities`` as for :func:`page_rows`."""
    kinds = {"int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in NODE.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(owners: list, rows: list[dict]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows), NODES):
                some = rows[a : a + NODES]
                columns = [pa.array([list(r["attrs"].items()) for r in some] if name == "attrs" else [r[name] for r in some], kind) for name, kind in fields]
                yield pa.RecordBatch.from_arrays([pa.array(owners[a : a + NODES], batch.column(0).type), *columns], names=["_key", *[name for name, _ in fields]])

        for batch in batches:
            owners, rows = [], []
            for k, h in zip(batch.column(0), batch.column(1), strict=True):
                mine = page_rows(h.as_py(), entities)
                owners += [k.as_py()] * len(mine)
                rows += mine
                if len(rows) >= NODES:
                    yield from made(owners, rows)
                    owners, rows = [], []
            yield from made(owners, rows)

    kind_of_key = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("_key"), html).mapInArrow(task, f"_key {kind_of_key}, {NODE}").withColumnRenamed("_key", key)


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), name)


def nth_child(a: int, b: int, column: str = "nth") -> Column:
    """The an+b test on a sibling place: ``nth``, ``nth_last``, ``nth_of_type`` or ``nth_last_of_type``."""
    d = F.col(column) - b
    return (d == 0) if a == 0 else (d % a == 0) & (d / a >= 0)


def attr_test(name: str, op: str = "", value: str = "") -> Column:
    """An attribute selector: there, ``=``, ``^=``, ``$=``, ``*=``, or a part between blanks ``~=`` or dashes ``|=``; ASCII
    case is ignored."""
    own, text = ascii_lower(F.coalesce(attr(name), F.lit(""))), F.lit(value.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    tests = {"": F.lit(True), "=": own == text, "^=": F.startswith(own, text), "$=": F.endswith(own, text), "*=": F.contains(own, text), "~=": F.array_contains(F.split(own, " "), text), "|=": F.array_contains(F.split(own, "-"), text)}
    return attr(name).isNotNull() & tests[op]


def pseudo(name: str) -> Column:
    """A pseudo class that a node's own columns tell. ``empty`` is a node without any node below it, text included."""
    return {
        "root": F.col("parent") == 0,
        "first-child": F.col("nth") == 1,
        "last-child": F.col("nth_last") == 1,
        "only-child": (F.col("nth") == 1) & (F.col("nth_last") == 1),
        "first-of-type": F.col("nth_of_type") == 1,
        "last-of-type": F.col("nth_last_of_type") == 1,
        "only-of-type": (F.col("nth_of_type") == 1) & (F.col("nth_last_of_type") == 1),
        "empty": F.col("last") == F.col("id"),
        "link": (F.col("name") == "a") & attr("href").isNotNull(),
        "checked": attr("checked").isNotNull(),
    }[name]


def in_language(all_nodes: DataFrame, lang: str, key: str = "page_id") -> DataFrame:
    """Elements whose nearest ``lang``, their own or that of an element around them, is the one asked for.

    Only elements with the attribute are joined, by their interval within the page.
    """
    own = all_nodes.where((F.col("kind") == "element") & attr("lang").isNotNull()).select(F.col(key).alias("_k"), F.col("id").alias("_id"), F.col("last").alias("_last"), ascii_lower(attr("lang")).alias("_lang"))
    elements = all_nodes.where("kind = 'element'")
    near = elements.select(key, "id").join(own, (F.col(key) == F.col("_k")) & (F.col("id") >= F.col("_id")) & (F.col("id") <= F.col("_last")))
    told = near.groupBy(key, "id").agg(F.max_by("_lang", "_id").alias("_lang")).where(F.col("_lang") == lang.lower()).select(key, "id")
    return elements.join(told, [key, "id"], "left_semi")


def select(all_nodes: DataFrame, first: Column, *steps: tuple[str, Column], key: str = "page_id") -> DataFrame:
    """Elements by a selector: those that pass ``first``, then for each further ``(combinator, test)`` those that pass the
    test and stand below (blank), right below (``>``), right after (``+``) or after (``~``) one found so far, each once.

    ``>``, ``+`` and ``~`` are equality joins: by parent, by parent and place, and by parent with the first place that
    was found there. A test may be on any column, so groups are ``|`` of tests, and ``:not`` of a test is ``~``.
    """
    elements = all_nodes.where("kind = 'element'")
    found = elements.where(first)
    for combinator, test in steps:
        if combinator == " ":
            found = step(elements, found, "descendant", test, key)
        elif combinator == ">":
            found = step(elements, found, "child", test, key)
        elif combinator == "+":
            after = found.select(F.col(key).alias("_k"), F.col("parent").alias("_parent"), (F.col("nth") + 1).alias("_nth"))
            found = elements.where(test).join(after, (F.col(key) == F.col("_k")) & (F.col("parent") == F.col("_parent")) & (F.col("nth") == F.col("_nth")), "left_semi")
        elif combinator == "~":
            least = found.groupBy(F.col(key).alias("_k"), F.col("parent").alias("_parent")).agg(F.min("nth").alias("_nth"))
            found = elements.where(test).join(least, (F.col(key) == F.col("_k")) & (F.col("parent") == F.col("_parent")) & (F.col("nth") > F.col("_nth")), "left_semi")
        else:
            raise ValueError(f"no such combinator: {combinator}")
    return found


def without(found: DataFrame, others: DataFrame, key: str = "page_id") -> DataFrame:
    """``:not`` of a whole selector: the found nodes that it did not find."""
    return found.join(others.select(key, "id"), [key, "id"], "left_anti")


def step(all_nodes: DataFrame, context: DataFrame, axis: str, test: Column, key: str = "page_id") -> DataFrame:
    """Nodes on an axis of any context node for which ``test`` holds, each once.

    Axes by parent are equality joins. Axes by interval join on the page and test the interval there, so that a join
    never looks beyond one page.
    """
    c = context.select(F.col(key).alias("_k"), F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("last").alias("_last"))
    n = all_nodes.where(test)
    page = F.col(key) == F.col("_k")
    on = {
        "self": page & (F.col("id") == F.col("_id")),
        "child": page & (F.col("parent") == F.col("_id")),
        "parent": page & (F.col("id") == F.col("_parent")),
        "descendant": page & (F.col("id") > F.col("_id")) & (F.col("id") <= F.col("_last")),
        "descendant-or-self": page & (F.col("id") >= F.col("_id")) & (F.col("id") <= F.col("_last")),
        "ancestor": page & (F.col("id") < F.col("_id")) & (F.col("last") >= F.col("_last")) & (F.col("kind") == "element"),
        "ancestor-or-self": page & (F.col("id") <= F.col("_id")) & (F.col("last") >= F.col("_last")),
        "following": page & (F.col("id") > F.col("_last")),
        "preceding": page & (F.col("last") < F.col("_id")),
        "following-sibling": page & (F.col("parent") == F.col("_parent")) & (F.col("id") > F.col("_id")),
        "preceding-sibling": page & (F.col("parent") == F.col("_parent")) & (F.col("id") < F.col("_id")),
    }[axis]
    return n.join(c, on, "left_semi")


def path(all_nodes: DataFrame, *steps: tuple[str, Column], key: str = "page_id") -> DataFrame:
    """A path from the page's root: the first step's nodes, then each further axis and test."""
    axis, test = steps[0]
    if axis not in ("child", "descendant"):
        raise ValueError("a path starts at a child or descendant of the root")
    found = all_nodes.where(test & (F.col("parent") == 0)) if axis == "child" else all_nodes.where(test)
    for axis, test in steps[1:]:
        found = step(all_nodes, found, axis, test, key)
    return found


def strings(all_nodes: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, id, text``: each found node's text, its text nodes in order, trimmed.

    A page's text is put together once, and each node cuts its own part out of it.
    """
    pieces = all_nodes.where("kind = 'text'").groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("id", F.col("value").alias("v")))).alias("_p"))  # one page's
    page = pieces.select("_k", F.array_join(F.transform("_p", lambda x: x["v"]), "").alias("_text"))
    own = F.substr(F.coalesce("_text", F.lit("")), F.col("begin") + 1, F.col("end") - F.col("begin"))
    j = found.join(page, F.col(key) == F.col("_k"), "left")
    return j.select(key, "id", F.regexp_replace(own, r"^[\x00-\x20]+|[\x00-\x20]+$", "").alias("text"))


def links(all_nodes: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, id, href, text`` of found anchors."""
    return found.select(key, "id", attr("href").alias("href")).join(strings(all_nodes, found, key), [key, "id"])
