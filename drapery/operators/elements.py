"""HTML pages -> element arrays, and CSS-subset selection over them.

``html_elements`` is the only Python step of the catalog plans: an Arrow
function of the HTML column alone (the row's other columns stay in the JVM)
that tokenises each page and attaches its elements as an ``array<struct>``
column. All selection and per-page aggregation afterwards are higher-order
functions over that array, so they need no shuffle: a page's elements never
leave the row they came from. ``explode_elements`` gives the
one-row-per-element form.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # ship this module's code inside the task closures (no package install on workers)
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

ELEMENT_TYPE = T.StructType([
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("own_text", T.StringType()),
    T.StructField("t0", T.IntegerType()),
    T.StructField("t1", T.IntegerType()),
    T.StructField("last_id", T.IntegerType()),
])

PAGE_TYPE = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT_TYPE)), T.StructField("text_nodes", T.ArrayType(T.StringType())),
                          T.StructField("page_text", T.StringType())])

_PA_ELEMENT = pa.struct([
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
    ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
    ("own_text", pa.string()), ("t0", pa.int32()), ("t1", pa.int32()), ("last_id", pa.int32()),
])

# Fixed value: HTML void elements (never hold children).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
        "wbr", "keygen", "command"}
RAW_TEXT = {"script", "style", "template"}
# Implied end tags: a start tag closes open elements of these kinds, up to the
# nearest element that contains such a group.
_CELLS, _ROWS = {"td", "th"}, {"td", "th", "tr"}
_SECTIONS = _ROWS | {"thead", "tbody", "tfoot"}
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": (_CELLS, {"tr", "table"}), "th": (_CELLS, {"tr", "table"}), "tr": (_ROWS, {"table"}),
    "thead": (_SECTIONS, {"table"}), "tbody": (_SECTIONS, {"table"}), "tfoot": (_SECTIONS, {"table"}),
    "body": ({"head"}, set()),
} | dict.fromkeys(
    ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
     "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"), ({"p"}, {"button", "caption", "td", "th"}))
_WS = re.compile(r"^\s+|\s+$")


class _Tree(HTMLParser):
    """Lenient tree builder: records elements in document (pre-)order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = []        # dicts, index = node_id
        self.stack = []        # open node ids
        self.texts = []        # stripped non-empty text nodes, document order
        self.raw = []          # unstripped text nodes (``get_text()`` with no separator)
        self.raw_depth = 0

    def parse_marked_section(self, i, report=1):
        """``<![...`` outside CDATA is a comment up to the next '>'."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _close(self, pos):
        """Close the open elements from ``pos`` of the stack on."""
        for nid in self.stack[pos:]:
            self.nodes[nid]["t1"] = len(self.texts)
            self.nodes[nid]["last_id"] = len(self.nodes) - 1
            if self.nodes[nid]["tag"] in RAW_TEXT:
                self.raw_depth -= 1
        del self.stack[pos:]

    def _imply_end(self, tag):
        closes, within = IMPLIED_END[tag]
        outermost = None
        for pos in range(len(self.stack) - 1, -1, -1):
            name = self.nodes[self.stack[pos]]["tag"]
            if name in within:
                break
            if name in closes:
                outermost = pos
        if outermost is not None:
            self._close(outermost)

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED_END:
            self._imply_end(tag)
        parent = self.stack[-1] if self.stack else -1
        amap = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        nid = len(self.nodes)
        self.nodes.append({
            "node_id": nid, "parent_id": parent, "depth": len(self.stack), "tag": tag,
            "id": amap.get("id"), "classes": amap.get("class", "").split() if "class" in amap else [],
            "attrs": list(amap.items()), "own": [], "t0": len(self.texts), "t1": None,
            "last_id": nid,
        })
        if tag in VOID:
            self.nodes[nid]["t1"] = len(self.texts)
        else:
            self.stack.append(nid)
            if tag in RAW_TEXT:
                self.raw_depth += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for pos in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[pos]]["tag"] == tag:
                self._close(pos)
                return

    def handle_data(self, data):
        if self.raw_depth > 0 or not self.stack:
            return
        self.raw.append(data)
        s = _WS.sub("", data)
        if s:
            self.texts.append(s)
            self.nodes[self.stack[-1]]["own"].append(s)

    def finish(self):
        self.close()
        self._close(0)
        return [{k: n[k] for k in ("node_id", "parent_id", "depth", "tag", "id", "classes", "attrs", "t0", "t1", "last_id")}
                | {"own_text": " ".join(n["own"])} for n in self.nodes]


def parse_page(html: str | None):
    """``(elements, text_nodes, page_text)`` of one page; empty for null input."""
    if not html:
        return [], [], ""
    tree = _Tree()
    tree.feed(html)
    return tree.finish(), tree.texts, "".join(tree.raw)


def parse_elements(html: str | None) -> list:
    """Element dicts of one page (empty list for null / unparsable input)."""
    return parse_page(html)[0]


def html_elements(pages: DataFrame, html_col: str = "html", keep_html: bool = True) -> DataFrame:
    """Attach ``elements: array<element>``, ``text_nodes`` (the page's
    stripped text nodes, in order) and ``page_text`` (all text, no separator,
    scripts excluded) to every page row (one Arrow pass).

    Elements carry ``[t0, t1)`` ranges into ``text_nodes`` and the id of their
    last descendant instead of copies of text and ancestors, so the output is
    linear in the page size whatever the nesting; ``text_of`` rebuilds an
    element's text and ``is_inside`` tells descendants.
    """
    @F.arrow_udf(PAGE_TYPE)
    def parsed(html: pa.Array) -> pa.Array:
        found = [parse_page(h) for h in html.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([p[0] for p in found], type=pa.list_(_PA_ELEMENT)), pa.array([p[1] for p in found], type=pa.list_(pa.string())),
             pa.array([p[2] for p in found], type=pa.string())], names=["elements", "text_nodes", "page_text"])

    out = pages.withColumn("_page", parsed(F.col(html_col)))
    out = out.select(*pages.columns, "_page.elements", "_page.text_nodes", "_page.page_text")
    return out if keep_html else out.drop(html_col)


def select_one(elements, selector: str) -> Column:
    """First match of ``selector`` (null when none)."""
    return F.get(select(elements, selector), 0)


def first_of_selectors(elements, selectors: str, value, keep=None) -> Column:
    """The reference's loop over ``selectors.split(", ")``: per selector the
    first element, first non-empty ``value(e)`` wins."""
    from ..functions.text import let
    test = keep if keep is not None else (lambda v: F.coalesce(v, F.lit("")) != "")
    vals = F.array(*[let(select_one(elements, s), value) for s in selectors.split(", ")])
    return F.get(F.filter(vals, test), 0)


def text_of(e: Column, nodes: str = "text_nodes") -> Column:
    """``get_text(separator=' ', strip=True)`` of an element (null element -> null)."""
    return F.when(e.isNotNull(), F.array_join(F.slice(F.col(nodes), e["t0"] + 1, e["t1"] - e["t0"]), " "))


def explode_elements(df: DataFrame, key: str = "page_id") -> DataFrame:
    """Row form: one row per element (with its text)."""
    return (df.select(key, "text_nodes", F.explode("elements").alias("e"))
            .select(key, "e.*", text_of(F.col("e")).alias("text")))


# ---------------------------------------------------------------------------
# CSS subset -> element predicates
# ---------------------------------------------------------------------------
_SIMPLE = re.compile(r"""^(?P<tag>[a-zA-Z][a-zA-Z0-9-]*|\*)?(?P<rest>(?:\.[\w-]+|\[[^\]]+\]|#[\w-]+)*)$""")
_PART = re.compile(r"""\.([\w-]+)|\[\s*([\w-]+)\s*(?:(\*=|=|\^=|\$=)\s*['"]?([^'"\]]*)['"]?)?\s*\]|#([\w-]+)""")


def _simple_pred(sel: str, e: Column) -> Column:
    m = _SIMPLE.match(sel.strip())
    if not m:
        raise ValueError(f"unsupported selector: {sel!r}")
    conds = []
    if m.group("tag") and m.group("tag") != "*":
        conds.append(e["tag"] == m.group("tag").lower())
    for cls, attr, op, val, ident in _PART.findall(m.group("rest") or ""):
        if ident:
            conds.append(F.coalesce(e["id"] == ident, F.lit(False)))
        elif cls:
            conds.append(F.array_contains(e["classes"], cls))
        elif not op:
            conds.append(F.map_contains_key(e["attrs"], attr))
        else:
            v = F.element_at(e["attrs"], F.lit(attr))
            if op == "*=":
                conds.append(F.coalesce(F.instr(v, val) > 0, F.lit(False)))
            elif op == "^=":
                conds.append(F.coalesce(v.startswith(val), F.lit(False)))
            elif op == "$=":
                conds.append(F.coalesce(v.endswith(val), F.lit(False)))
            else:
                conds.append(F.coalesce(v == val, F.lit(False)))
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def is_inside(e: Column, outer: Column) -> Column:
    """``e`` is a descendant of ``outer``."""
    return (e["node_id"] > outer["node_id"]) & (e["node_id"] <= outer["last_id"])


def _select_steps(elements: Column, steps: list[str]) -> Column:
    """Descendant chain: each step's matches must lie inside one of the step before."""
    from ..functions.text import let
    if len(steps) == 1:
        return F.filter(elements, lambda e: _simple_pred(steps[0], e))
    return let(_select_steps(elements, steps[:-1]), lambda outer: F.filter(
        elements, lambda e: _simple_pred(steps[-1], e) & F.exists(outer, lambda o: is_inside(e, o))))


def select(elements, selector: str) -> Column:
    """Matching elements in document order (``soup.select``) for a CSS subset: tag,
    .cls, #id, [attr], [attr*=v], [attr^=v], [attr$=v], [attr=v], descendant
    combinator (space) and comma lists."""
    arr = F.col(elements) if isinstance(elements, str) else elements
    alternatives = [s.split() for s in selector.split(",") if s.strip()]
    if all(len(steps) == 1 for steps in alternatives):
        def any_of(e):
            out = F.lit(False)
            for steps in alternatives:
                out = out | _simple_pred(steps[0], e)
            return out
        return F.filter(arr, any_of)
    found = F.array_distinct(F.transform(F.concat(*[_select_steps(arr, steps) for steps in alternatives]), lambda e: e["node_id"]))
    return F.transform(F.array_sort(found), lambda i: F.get(arr, i))


def size_tokens_of(elements) -> Column:
    """Size tokens in the texts of size elements (class holds "size"; select or div)."""
    from ..functions.html import size_tokens
    texts = F.transform(class_contains(elements, "size", ["select", "div"]), lambda e: text_of(e))
    return size_tokens(F.array_join(texts, " "))


def first_selector_wins(elements, selectors, keep=None) -> Column:
    """Matches of the first selector that yields at least one element
    (after the optional ``keep`` element filter)."""
    arr = F.col(elements) if isinstance(elements, str) else elements
    results = []
    for sel in selectors:
        r = select(arr, sel)
        if keep is not None:
            r = F.filter(r, keep)
        results.append(r)
    return F.coalesce(F.get(F.filter(F.array(*results), lambda r: F.size(r) > 0), 0), F.slice(results[0], 1, 0))


def class_contains(elements, word: str, tags=None) -> Column:
    """Elements whose class attribute contains ``word`` (case-insensitive)."""
    arr = F.col(elements) if isinstance(elements, str) else elements

    def pred(e):
        c = F.coalesce(F.instr(F.lower(F.element_at(e["attrs"], F.lit("class"))), word.lower()) > 0, F.lit(False))
        return c & e["tag"].isin(list(tags)) if tags else c
    return F.filter(arr, pred)


def attr(e: Column, name: str) -> Column:
    return F.element_at(e["attrs"], F.lit(name))
