"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page's tokens are its block elements, named by tag and class, and its texts. They are aligned with
the wrapper of the pages seen so far on the same host. Equal elements are aligned with each other,
texts that differ become slots, neighbours that repeat an element or a short group of elements become
a repeated group, and what only one side has becomes optional. Wrappers align with each other like
pages, so tasks infer theirs apart, and those of a host are then aligned in two steps; all pages
take part and no task holds the pages of a host.

In a wrapper the content is where the variable text is: from the body down, an element is entered as
long as it is an article by name or holds nearly all the characters of the slots outside of menus,
forms and the like. All texts of an article by name count as slots there, as copies of one article on
many pages look like layout. A page's text is made of its blocks inside that element. Constant texts of the
wrapper are dropped unless they stand in an article by name. A page that lacks the element is
treated by its own wrapper.

Nulls and pages without text give an empty text; markup that is not closed ends where its parent
does, or with the page; an unknown or missing host is a host of its own; repeated rows give repeated
rows; an empty table gives no rows. Elements nested deeper than ``LEVELS`` form no levels of their own:
what they hold belongs to the element at that depth, nothing is lost. Only the three named columns are read.
"""

from __future__ import annotations

import html as entities
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.llm.words import slices
from gradus.session import checkpointed

#: Characters of all wrappers' decisions that may be broadcast; beyond, they are joined by host.
BROADCAST_CHARS = 16_000_000
#: Parts in which the wrappers of one host are aligned before the parts are.
PARTS = 64
#: Share of the slots' characters that an element must hold to be entered.
DOMINANT = 0.8
#: Levels of a page's tree; trees are walked by recursion.
LEVELS = 150
#: Pages on which a constant text must have been seen to count as part of the layout.
SUPPORT = 5

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr br input".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
EXCLUDED_TAGS = frozenset(
    "nav aside footer form script style noscript template iframe select button textarea svg dialog "
    "menu head title object canvas audio video map".split()
)
EXCLUDED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie "
    "cookies consent gdpr notice notices alert alerts popup modal overlay menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar side widget widgets related recommended share sharing social "
    "comment comments reply replies respond disqus newsletter subscribe subscription signup login "
    "footer header masthead pagination pager toolbar skip hidden".split()
)
EXCLUDED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert form menu menubar".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("articlebody article story post entry".split())
#: Elements that hold text themselves and are not entered.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre figure figcaption table address".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _name_words(value: str) -> list[str]:
    split = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    return re.findall(r"[a-z]+", split.lower())


def _element(name: str, rest: str) -> tuple[str, str]:
    """(signature, role) of an opening tag; role is "out", "article", "header" or "".

    Digits in class names are left out, so that numbered classes are one.
    """
    if not rest.strip():
        attributes = {}
    else:
        attributes = {
            k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)
        }
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = _name_words(named)
    role = attributes.get("role", "").lower()
    signature = ".".join([name, *sorted(set(words))])
    hidden = (
        "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or _HIDDEN.search(attributes.get("style", ""))
    )
    if name in ARTICLE_TAGS or role in ("main", "article"):
        return signature, "article"
    if name in EXCLUDED_TAGS or hidden or role in EXCLUDED_ROLES:
        return signature, "out"
    if name == "header":
        return signature, "header"
    if name not in ("html", "body") and EXCLUDED_WORDS.intersection(words):
        return signature, "out"
    if "articlebody" in attributes.get("itemprop", "").lower() or ARTICLE_WORDS.intersection(words):
        return signature, "article" if name in ("div", "section") else ""
    return signature, ""


class Node:
    """An element (or text) of a page or wrapper.

    ``const`` is a digest of a text that was the same on all pages, "" a slot; ``size`` the
    characters of texts, ``pages`` on how many pages; optional and repeated are the wrapper's ? and +.
    """

    __slots__ = ("tag", "role", "children", "const", "size", "pages", "optional", "repeated")

    def __init__(self, tag, role="", children=None, const="", size=0, pages=1, optional=False, repeated=False):
        self.tag, self.role, self.children = tag, role, children if children is not None else []
        self.const, self.size, self.pages = const, size, pages
        self.optional, self.repeated = optional, repeated

    def pack(self):
        return [
            self.tag, self.role, self.const, self.size, self.pages, int(self.optional),
            int(self.repeated), [c.pack() for c in self.children],
        ]

    @classmethod
    def unpack(cls, packed):
        tag, role, const, size, pages, optional, repeated, children = packed
        return cls(tag, role, [cls.unpack(c) for c in children], const, size, pages, bool(optional), bool(repeated))


TEXT = "#text"


def parse(page: str) -> tuple[Node, list[tuple[tuple[str, ...], bool, str]]]:
    """The page's elements and its blocks (path of signatures, inside an excluded element, text)."""
    import hashlib

    root = Node("#page")
    stack = [(root, "#page", False, False)]
    blocks, waiting = [], []

    def flush():
        if waiting:
            text = " ".join(entities.unescape("".join(waiting)).split())
            waiting.clear()
            if text:
                node, _, out, _ = stack[-1]
                digest = hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
                node.children.append(Node(TEXT, const=digest, size=len(text)))
                blocks.append((tuple(s[0].tag for s in stack[1 : LEVELS + 1]), out, text))

    def close(upto: int):
        flush()
        del stack[upto:]

    position, size = 0, len(page)
    while position < size:
        start = page.find("<", position)
        if start < 0:
            waiting.append(page[position:])
            break
        if start > position:
            waiting.append(page[position:start])
        token = _TOKEN.match(page, start)
        if token is None:
            waiting.append("<")
            position = start + 1
            continue
        position = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["close"]:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][1] == name:
                    close(at)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name == "br":
            waiting.append(" ")
            continue
        if name in RAW:
            flush()
            end = re.compile(f"</{name}(?=[\\s>/]|\\Z)", re.I).search(page, position)
            position = end.start() if end else size
            continue
        rest = token["rest"]
        signature, role = _element(name, rest)
        if name in INLINE and role != "out" or name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        if name not in INLINE:
            if stack[-1][1] == "p":
                close(len(stack) - 1)
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                peers = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
                         "tr": ("tr", "td", "th")}.get(name, (name,))
                while stack[-1][1] in peers:
                    close(len(stack) - 1)
        _, _, out, inside = stack[-1]
        if role == "header":
            role = "" if inside else "out"
        if len(stack) <= LEVELS:
            node = Node(signature, role)
            stack[-1][0].children.append(node)
        else:
            node = stack[-1][0]
        if not rest.rstrip().endswith("/") or name not in VOID:
            stack.append((node, name, out or role == "out", inside or role == "article"))
    flush()
    return root, blocks


def align(a: Node, b: Node) -> Node:
    """The least general node that both are instances of, by the operations above."""
    if a.tag == TEXT:
        const = a.const if a.const == b.const else ""
        return Node(TEXT, const=const, size=a.size + b.size, pages=a.pages + b.pages)
    children = _align_lists(a.children, b.children)
    return Node(
        a.tag, a.role, children, "", a.size + b.size, a.pages + b.pages,
        a.optional or b.optional, a.repeated or b.repeated,
    )


def _absent(node: Node) -> Node:
    node.optional = True
    return node


def _align_lists(a: list[Node], b: list[Node]) -> list[Node]:
    if [n.tag for n in a] == [n.tag for n in b]:
        return [align(x, y) for x, y in zip(a, b)]
    # Longest common subsequence of the names; lists are short, as repeats are folded.
    rows, columns = len(a), len(b)
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows - 1, -1, -1):
        for j in range(columns - 1, -1, -1):
            if a[i].tag == b[j].tag:
                best[i][j] = best[i + 1][j + 1] + 1
            else:
                best[i][j] = max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < rows and j < columns:
        if a[i].tag == b[j].tag:
            out.append(align(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_absent(a[i]))
            i += 1
        else:
            out.append(_absent(b[j]))
            j += 1
    out += [_absent(n) for n in a[i:]] + [_absent(n) for n in b[j:]]
    return fold(out)


def fold(nodes: list[Node]) -> list[Node]:
    """Neighbours that repeat one element, or a group of two or three, as one repeated node."""
    for width in (1, 2, 3):
        out: list[Node] = []
        for node in nodes:
            out.append(node)
            while len(out) >= 2 * width and all(
                out[k - width].tag == out[k].tag for k in range(-width, 0)
            ):
                second = out[-width:]
                del out[-width:]
                for k in range(width):
                    merged = align(out[k - width], second[k])
                    merged.pages = max(out[k - width].pages, second[k].pages)
                    merged.repeated = True
                    out[k - width] = merged
        nodes = out
    return nodes


def folded(node: Node) -> Node:
    node.children = fold([folded(c) for c in node.children])
    return node


def expression(node: Node) -> str:
    """The wrapper as a union-free regular expression."""
    if node.tag == TEXT:
        body = node.const or "#PCDATA"
    else:
        body = f"<{node.tag}>{''.join(expression(c) for c in node.children)}</{node.tag}>"
    if node.repeated and node.optional:
        return f"({body})*"
    return f"({body})+" if node.repeated else f"({body})?" if node.optional else body


def variable_size(node: Node) -> int:
    """Characters of the slots outside of excluded elements."""
    if node.role == "out":
        return 0
    if node.tag == TEXT:
        return 0 if node.const and node.pages > 1 else node.size
    return sum(map(variable_size, node.children))


def content_size(node: Node, named: bool = False) -> int:
    """``variable_size``, but of articles by name all characters."""
    if node.role == "out":
        return 0
    if node.tag == TEXT:
        return node.size if named else variable_size(node)
    return sum(content_size(c, named or node.role == "article") for c in node.children)


def content(wrapper: Node) -> tuple[list[str], bool]:
    """(path of the content element, whether it is an article by name)."""
    node, path = wrapper, []
    while True:
        inside = [(content_size(c), c) for c in node.children if c.tag != TEXT and c.role != "out"]
        total = sum(size for size, _ in inside) + sum(
            content_size(c) for c in node.children if c.tag == TEXT
        )
        named = [(s, c) for s, c in inside if c.role == "article" and s > 0]
        if named:
            size, child = max(named, key=lambda x: x[0])
            if size >= 0.5 * sum(s for s, _ in named):
                return [*path, child.tag], True
            return path, False
        inside = [(s, c) for s, c in inside if c.tag.split(".")[0] not in LEAVES]
        size, child = max(inside, key=lambda x: x[0], default=(0, None))
        if child is None or not total or size < DOMINANT * total:
            return path, False
        node, path = child, [*path, child.tag]


def constants(node: Node, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    found = []
    for child in node.children:
        if child.tag == TEXT:
            if child.const and child.pages >= SUPPORT:
                found.append((path, child.const))
        elif child.role != "article":
            found += constants(child, (*path, child.tag))
    return found


def decisions(wrapper: Node) -> dict:
    path, named = content(wrapper)
    # Were all pages alike, nothing would tell layout from content.
    varied = variable_size(wrapper) > 0 and wrapper.pages >= SUPPORT
    drop = [] if named or not varied else [[list(p), digest] for p, digest in constants(wrapper)]
    return {"path": path, "drop": drop}


def page_text(page: str, told: dict | None) -> str:
    import hashlib

    root, blocks = parse(page)

    def chosen(rules):
        path = tuple(rules["path"])
        drop = {(tuple(p), digest) for p, digest in rules["drop"]}
        within = [b for b in blocks if not b[1] and b[0][: len(path)] == path]
        return [
            text for place, _, text in within
            if not drop or (place, hashlib.blake2b(text.encode(), digest_size=8).hexdigest()) not in drop
        ]

    texts = chosen(told) if told else []
    if not texts:
        texts = chosen(decisions(folded(root)))
    return "\n".join(texts)


def _inferred(batches):
    """Wrapper of each host in a partition."""
    known: dict[str, Node] = {}
    for batch in batches:
        for part in slices(batch, 64):
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = folded(parse(page)[0])
                known[host] = align(known[host], own) if host in known else own
    packed = [json.dumps(w.pack(), separators=(",", ":")) for w in known.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(known), pa.string()), pa.array(packed, pa.string())], names=["host", "wrapper"]
    )


def _joined(group: pd.DataFrame) -> Node:
    wrapper = None
    for packed in sorted(group["wrapper"]):
        own = Node.unpack(json.loads(packed))
        wrapper = own if wrapper is None else align(wrapper, own)
    return wrapper


def _align_part(group: pd.DataFrame) -> pd.DataFrame:
    packed = json.dumps(_joined(group).pack(), separators=(",", ":"))
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [packed]})


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html) rows."""
    parts = pages.select("host", "html").mapInArrow(_inferred, "host string, wrapper string")
    dealt = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    halfway = dealt.groupBy("host", "part").applyInPandas(_align_part, "host string, wrapper string")
    return halfway.groupBy("host").applyInPandas(_align_part, "host string, wrapper string")


def _told(batches):
    for batch in batches:
        found = [
            json.dumps(decisions(Node.unpack(json.loads(w))), separators=(",", ":"))
            for w in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.string())], names=["host", "told"]
        )


def _extract(batches):
    rules: dict[str, dict] = {}
    for batch in batches:
        for part in slices(batch, 64):
            texts = []
            for page, told in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                if told is not None and told not in rules:
                    if len(rules) > 256:
                        rules.clear()
                    rules[told] = json.loads(told)
                texts.append(page_text(page, rules.get(told)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string())], names=["kept", "text"]
            )


def main_text(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(page_id, url, text) of each page."""
    pages = df.select(
        F.struct(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url")).alias("kept"),
        host_of(F.col(f"`{url_column}`")).alias("host"),
        F.coalesce(F.col(f"`{html_column}`"), F.lit("")).alias("html"),
    )
    rules = checkpointed(infer(pages).mapInArrow(_told, "host string, told string"))
    small = (rules.agg(F.sum(F.length("told"))).first()[0] or 0) <= BROADCAST_CHARS
    with_rules = pages.join(F.broadcast(rules) if small else rules, "host", "left")
    kept = pages.schema["kept"].dataType.simpleString()
    texts = with_rules.select("kept", "html", "told").mapInArrow(_extract, f"kept {kept}, text string")
    return texts.select("kept.page_id", "kept.url", "text")


@query("op6_main_text")
def op6_main_text(spark: SparkSession, base: str) -> DataFrame:
    return main_text(read(spark, base, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
