"""HTML extraction by wrapper induction.

The block elements of a page make a tree. Pages of a host are aligned with a reference page of that host by simple tree
matching: children keep their order, and the alignment with most matched nodes wins. A node whose text is the same on
nearly all pages of its host belongs to the template; slots that vary, and nodes that the reference lacks, hold
content. Elements that HTML or common names mark as menus, adverts, forms, comments and the like are never content.
"""

import re
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from turnlab.llm.common import cut, small_batches, with_columns

LEAST_PAGES = 5     # aligned pages from which a slot may be called constant
SHARE = 0.9         # of aligned pages that carry the reference's text in a constant slot
_WIDE = 2_000       # child pairs from which lists of children are aligned row by row in arrays, with the same weight

#: Fixed values of HTML: elements without an end, raw text, block elements, and what a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas", "object",
       "select", "audio", "video"}
BLOCKS = {"html", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details",
          "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "header", "hgroup", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
          "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "head"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"thead", "tbody"},
        "tfoot": {"tbody"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements, roles and parts of class or id names that mark no content.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "search", "head", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert",
         "menu", "menubar", "toolbar", "note"}
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored",
         "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
         "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "menu", "nav", "navbar", "navigation",
         "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "commentlist", "disqus", "reply",
         "replies", "respond", "related", "recommended", "recommendations", "share", "sharing", "social", "search",
         "pagination", "pager", "widget", "widgets", "toolbar", "skip", "legal", "copyright", "alert"}

#: What may stand beside such a part in a class name inside an article ("share-buttons", but not "share-price").
BESIDE = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "form", "group", "holder", "icons",
          "inline", "inner", "item", "items", "left", "link", "links", "list", "panel", "post", "posts", "right", "section",
          "slot", "text", "thread", "title", "top", "unit", "wrap", "wrapper"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element: label, child nodes and blocks of text in page order, and whether it may hold content."""

    __slots__ = ("tag", "label", "items", "kids", "size", "shape", "outside", "main", "holds", "inside")

    def __init__(self, tag, label, outside, main):
        self.tag, self.label, self.items, self.outside, self.main, self.inside = tag, label, [], outside, main, main

    def close(self):
        """Sizes and shapes, children first (no recursion: pages may nest deeply)."""
        order, todo = [], [self]
        while todo:
            node = todo.pop()
            node.kids = [x for x in node.items if isinstance(x, Node)]
            order.append(node)
            todo += node.kids
        for node in reversed(order):
            node.holds = node.main and not node.outside or any(k.holds for k in node.kids)
            node.size = 1 + sum(k.size for k in node.kids)
            node.shape = hash((node.label, *[k.shape for k in node.kids]))
        return self

    def text(self):
        return "\n".join(x for x in self.items if isinstance(x, str))


def _named(known, inside):
    """Whether class or id names mark no content: any part of one, or inside an article names that say nothing else."""
    for key in ("class", "id"):
        for token in known.get(key, "").split():
            parts = {p.lower() for p in _PART.findall(token)}
            if parts & NAMES and (not inside or parts <= NAMES | BESIDE):
                return True
    return False


def _node(tag, raw, inside=False):
    known = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip() else {}
    named = _named(known, inside)
    outside = (tag in OUTSIDE or named or known.get("role", "").lower() in ROLES or "hidden" in known
               or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "").lower())
    main = tag in ("article", "main") or known.get("role") == "main" or "articleBody" in known.get("itemprop", "")
    node = Node(tag, " ".join([tag, *sorted(known.get("class", "").split())]), outside and not (
        main and tag in ("article", "main") and not named), main)
    node.inside = inside or main
    return node


def parse(html):
    """The tree of block elements of a page; text is decoded, its white space single spaces, its blocks trimmed."""
    root = Node("html", "html", False, False)
    stack, parts, at = [root], [], 0
    hidden = None   # an inline element whose text is no content, and its depth

    def flush():
        block = " ".join("".join(parts).split())
        if block:
            stack[-1].items.append(block)
        parts.clear()

    n = len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        if not found:
            break
        if found.start() > at and not hidden:
            parts.append(unescape(html[at:found.start()]))
        at = found.end()
        if not found.group(2):
            continue
        end, tag = found.group(1), found.group(2).lower()
        if tag in RAW and not end:
            if not found.group(3).endswith("/") or tag in ("script", "style", "title", "textarea"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else n
            parts.append(" ")
        elif tag in BLOCKS:
            if tag in ("html", "body"):
                flush()
                continue
            flush()
            if end:
                hidden = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            else:
                hidden = None
                _end_implied(stack, tag)
                node = _node(tag, found.group(3), stack[-1].inside)
                stack[-1].items.append(node)
                stack.append(node)
        elif tag in ("br", "td", "th", "hr", "img", "option"):
            parts.append(" ")
        elif hidden:
            hidden = (tag, hidden[1] + (-1 if end else 1)) if tag == hidden[0] else hidden
            hidden = hidden if hidden[1] else None
        elif not end and tag not in VOID and found.group(3) and _node(tag, found.group(3), stack[-1].inside).outside:
            hidden = (tag, 1)
    else:
        at = n
    if at < n and not hidden:
        parts.append(unescape(html[at:]))
    flush()
    return root.close()


def _end_implied(stack, tag):
    """A block ends an open paragraph; a list item or row ends the one before it."""
    if tag not in ("head",) and stack[-1].tag == "p":
        stack.pop()
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in HOLDS.get(tag, ()):
            return
        if stack[i].tag in ENDS.get(tag, ()):
            del stack[i:]
            return
        if tag not in ENDS:
            return


def _most_matched(ours, theirs, weights):
    """For each first part of ``theirs`` the greatest weight of order-keeping pairs with all of ``ours``."""
    best = np.zeros(len(theirs) + 1, np.int64)
    for row in weights[:, theirs][ours] if len(ours) * len(theirs) < 100_000 else (weights[i, theirs] for i in ours):
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row))
    return best


def _paired(ours, theirs, weights):
    """The pairs (i, j) of a greatest weight, found by halves: memory grows with the lengths, not with their product."""
    out, todo = [], [(0, len(ours), 0, len(theirs))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            j = int(np.argmax(weights[ours[a], theirs[c:d]]))
            if weights[ours[a], theirs[c + j]]:
                out.append((a, c + j))
            continue
        half = (a + b) // 2
        first = _most_matched(ours[a:half], theirs[c:d], weights)
        rest = _most_matched(ours[half:b][::-1], theirs[c:d][::-1], weights)[::-1]
        at = c + int(np.argmax(first + rest))
        todo += [(a, half, c, at), (half, b, at, d)]
    return sorted(out)


def match_trees(a, b):
    """Pairs (node of a, node of b) of a simple tree matching: equal labels, order kept, most nodes matched."""
    if a.label != b.label:
        return []
    sizes = {}

    def known(x, y):
        """Most nodes that can be matched in two subtrees, None where it is not counted yet."""
        if x.label != y.label:
            return 0
        return x.size if x.shape == y.shape else sizes.get((x.shape, y.shape))

    def weight(x, y):
        """``known`` of the pair, its inner pairs counted first (no recursion: pages may nest deeply)."""
        todo = [(x, y)]
        while todo:
            s, t = todo[-1]
            if known(s, t) is None:
                head, p, q, tail = middle(s, t)
                missing = [(c, d) for c in unlike(p).values() for d in unlike(q).values() if known(c, d) is None]
                if missing:
                    todo += missing
                    continue
                if len(p) * len(q) > _WIDE:
                    ours, theirs, weights = weighed(p, q)
                    most = 1 + int(_most_matched(ours, theirs, weights)[-1]) + sum(w for *_, w in head + tail)
                else:
                    most = 1 + sum(w for *_, w in children(s, t))
                sizes[s.shape, t.shape] = most
            todo.pop()
        return known(x, y)

    def unlike(kids):
        return {k.shape: k for k in kids}

    def weighed(p, q):
        """Two lists of children as numbers of their shapes, and the weights of shapes with each other."""
        rows, columns = unlike(p), unlike(q)
        weights = np.array([[weight(c, d) for d in columns.values()] for c in rows.values()], np.int64)
        rows, columns = ({shape: i for i, shape in enumerate(x)} for x in (rows, columns))
        return np.array([rows[c.shape] for c in p]), np.array([columns[d.shape] for d in q]), weights

    def middle(x, y):
        """(pairs of equal first children, what lies between in either list, pairs of equal last children)."""
        p, q, head, tail = x.kids, y.kids, [], []
        low = 0
        while low < min(len(p), len(q)) and p[low].shape == q[low].shape:
            head.append((p[low], q[low], p[low].size))
            low += 1
        p, q = p[low:], q[low:]
        while p and q and p[-1].shape == q[-1].shape:
            tail.append((p[-1], q[-1], p[-1].size))
            p, q = p[:-1], q[:-1]
        return head, p, q, tail[::-1]

    def children(x, y):
        """The best order-keeping pairs (child, child, weight)."""
        found, p, q, tail = middle(x, y)
        if len(p) * len(q) > _WIDE:
            found += [(p[i], q[j], weight(p[i], q[j])) for i, j in _paired(*weighed(p, q))]
        elif p and q:
            best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            for i in range(len(p) - 1, -1, -1):
                for j in range(len(q) - 1, -1, -1):
                    best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + weight(p[i], q[j]))
            i = j = 0
            while i < len(p) and j < len(q):
                w = weight(p[i], q[j])
                if w and best[i][j] == best[i + 1][j + 1] + w:
                    found.append((p[i], q[j], w))
                    i, j = i + 1, j + 1
                elif best[i][j] == best[i + 1][j]:
                    i += 1
                else:
                    j += 1
        return found + tail

    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo += [(s, t) for s, t, w in children(x, y) if w]
    return pairs


def numbered(root):
    """Nodes in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids)
    return out


def skeleton(root):
    """A tree as text: a line for each node with depth, hash of its own text (empty if none) and label."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        own = node.text()
        out.append(f"{depth} {crc32(own.encode()) if own else ''} {node.label}")
        todo += [(k, depth + 1) for k in reversed(node.kids)]
    return "\n".join(out)


def from_skeleton(text):
    """(tree, hash of each node's own text or None) of a skeleton."""
    hashes, path, root = {}, [], None
    for line in text.split("\n"):
        depth, own, label = line.split(" ", 2)
        node = Node(label.split(" ")[0], label, False, False)
        hashes[id(node)] = int(own) if own else None
        del path[int(depth):]
        if path:
            path[-1].items.append(node)
        else:
            root = node
        path.append(node)
    return root.close(), hashes


class Wrapper:
    """A host's reference tree and the slots that are template."""

    def __init__(self, text, constant=()):
        self.root, self.hashes = from_skeleton(text)
        self.nodes = numbered(self.root)
        self.slots = {id(node): i for i, node in enumerate(self.nodes)}
        self.constant = set(constant)

    def aligned(self, page):
        """(node of the page, slot, whether both carry the same text) for matched nodes with text on either side."""
        for ours, theirs in match_trees(page, self.root):
            own, kept = ours.text(), self.hashes[id(theirs)]
            if own or kept is not None:
                yield ours, self.slots[id(theirs)], bool(own) and crc32(own.encode()) == kept


def content(root, template=()):
    """The blocks of content in page order; ``template`` are ids of nodes that are not.

    Where the page marks its article or main part, content lies there. A header belongs to content only inside it.
    Where all such parts lie within elements that names mark as no content, those names don't count.
    """
    strict = _has_main(root)
    marked = strict or root.holds
    out, todo = [], [(root, not marked)]
    while todo:
        item, inside = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if item.outside and (strict or not item.holds) or (item.tag == "header" and not (marked and inside)):
            continue
        inside = inside or item.main
        keep = inside and id(item) not in template
        todo += [(x, inside) for x in reversed(item.items) if isinstance(x, Node) or keep]
    return out


def _has_main(root):
    todo = [root]
    while todo:
        node = todo.pop()
        if node.main and not node.outside:
            return True
        todo += [k for k in node.kids if not k.outside]
    return False


def extract_text(html, wrapper=None):
    """The main text of a page by a host's wrapper (None: only what its own markup says).

    A page of which the wrapper would leave nothing, as on a host whose pages are all versions of one, keeps what its markup says.
    """
    root = parse(html)
    template = ()
    if wrapper and wrapper.constant:
        template = {id(node) for node, slot, same in wrapper.aligned(root) if same and slot in wrapper.constant}
    return "\n".join(content(root, template) or content(root))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def induce(pages, page_id="page_id", url="url", html="html"):
    """(host, skeleton, constant): the wrapper of every host.

    The reference is the host's page of smallest id (of equal ids that of least html). Every different page of the host
    is aligned with it (copies count once); slots are counted map-side, so a hot host is no hot task.
    """
    rows = pages.where(F.col(html) != "").select(
        _host(url).alias("host"), F.col(page_id).alias("id"), F.col(html).alias("html"))
    first = rows.groupBy("host").agg(F.min("id").alias("id"))
    chosen = rows.join(first, ["host", "id"], "left_semi").groupBy("host").agg(F.min("html").alias("html"))

    def outline(batches):
        for part in batches:
            yield pd.DataFrame({"host": part["host"], "skeleton": [skeleton(parse(x)) for x in part["html"]]})

    references = cut(chosen.mapInPandas(outline, "host string, skeleton string"), "references")

    def align(batches):
        known = {}
        for part in batches:
            counts = {}
            for host, page, text in zip(part["host"], part["html"], part["skeleton"]):
                if host not in known:
                    if len(known) > 256:
                        known.clear()
                    known[host] = Wrapper(text)
                for _, slot, same in known[host].aligned(parse(page)):
                    n = counts.setdefault((host, slot), [0, 0])
                    n[0] += 1
                    n[1] += same
            yield pd.DataFrame([(*k, *n) for k, n in counts.items()], columns=["host", "slot", "n", "same"])

    copy = F.xxhash64("html")
    once = rows.groupBy("host", copy.alias("copy")).agg(F.min("id").alias("id"))
    different = rows.withColumn("copy", copy).join(once, ["host", "copy", "id"], "left_semi")
    seen = (different.join(references, "host").select("host", "html", "skeleton")
            .mapInPandas(align, "host string, slot int, n long, same long")
            .groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum("same").alias("same")))
    constant = (seen.where((F.col("n") >= LEAST_PAGES) & (F.col("same") >= SHARE * F.col("n")))
                .groupBy("host").agg(F.array_sort(F.collect_list("slot")).alias("constant")))
    return references.join(constant, "host", "left").select(
        "host", "skeleton", F.coalesce("constant", F.array().cast("array<int>")).alias("constant"))


def extract(pages, page_id="page_id", url="url", html="html"):
    """One row per page: page_id, url, text (blocks joined by line ends; empty if none) and n_chars.

    A null or empty html has no text. Pages without a host share the empty one. A host with fewer than LEAST_PAGES
    pages has no constant slots, so markup alone decides. Repeated pages each get a row, an empty table gives none;
    other columns are not read.
    """
    small_batches(pages.sparkSession)
    wrappers = cut(induce(pages, page_id, url, html), "wrappers").select(
        F.col("host").alias("__host"), "skeleton", "constant")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    joined = rows.join(wrappers, _host("url") == F.col("__host"), "left").drop("__host")

    def run(pages, skeletons, constants):
        known, out = {}, []
        for page, text, slots in zip(pages, skeletons, constants):
            if text is not None and text not in known:
                known[text] = Wrapper(text, slots)
            out.append(extract_text(page, known.get(text)) if page else "")
        return [out]

    found = with_columns(joined, ["html", "skeleton", "constant"], run, "text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
