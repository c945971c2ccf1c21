"""HTML extraction (6): a site style tree.

The DOMs of all pages of a host are merged by element path (tag and class names from the root, words with a digit as one sign).
Pages of a host with the same main content (text below ``article`` or ``main``, else of the page) count once, so copies
and mirrors are no evidence. For every node of the merged tree, over the ``m`` pages that have it:

- presentation: entropy, to base m, of the sequences of child tags;
- content: entropy of the texts below the node. Where pages have an article or main element, a container that stands
  outside of it counts by its text against ``SHARE`` of the article's: small boxes beside an article say little even if
  they say something new on every page;
- evidence: ``(1 - GAMMA) * presentation + GAMMA * content``;
- what the node is for by HTML: its tag (nav, footer, aside, form, ... are furniture), role, hidden state, and the words
  of its class and id names, as a factor: 1, ``WEAK`` (inside an article, for names that articles use too) or ``STRONG``.

Importance is ``factor * (PRIOR + (m - 1) * evidence) / (PRIOR + m - 1)``: one page is no evidence, each further one
counts a little more, and no number of pages switches the rule. Nodes that hold an article or main element have importance
1, and so have nodes of factor 1 below one. Branches below ``LEAST`` are cut from every page of the host; nothing else
is ever cut, the parser itself only drops what is no text (scripts, styles, titles, form controls' options, comments).

What is left is read in page order, one line per block: references decoded, white space to single spaces, trimmed.
End tags that HTML lets out are implied. Pages are parsed map-side twice (for the tree, then for the text). Shuffled are
digests of nodes, deduplicated by (host, main content) and combined map-side, never texts. The cut nodes are joined to pages by
host: broadcast while their counted number is at most ``BROADCAST_NODES``, else by host and one of ``SALTS`` salts, so a
hot host's pages never meet in one task.

Null html: empty text. Null or odd urls share one host. Repeated rows count once as evidence and each give their row.
Unclosed elements end with their block or the page. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import small_batches, spool

GAMMA = 0.9
SHARE = 0.25
PRIOR = 1.0
WEAK = 0.5
STRONG = 0.2
LEAST = 0.25
BROADCAST_NODES = 200_000
SALTS = 64

_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:script|style|textarea)(?=[\s/>]){_ATTRS}>.*?(?:</(?:script|style|textarea)\s*>|\Z)"
    rf"|<(noscript|template|select|svg|math|iframe|title)(?=[\s/>]){_ATTRS}>.*?</\1\s*>"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS}|[^>]*)>|<[!?][^>]*>|</?[a-zA-Z][^<>]*\Z|[^<]+|<",
    re.S | re.I,
)
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_NAME = re.compile(rf"(?:^|\s)(class|id|role){_VALUE}", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_DIGITS = re.compile(r"[^\W\d_]*\d\w*")  # numbered and generated names
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOXES = frozenset("address aside center details dialog div dl figure fieldset footer form header menu nav ol section table ul".split())
_MAIN = frozenset(("article", "main"))
_ROOT = frozenset(("", "html", "body"))
#: What a start tag ends (the nearest of the first, if none of the second stands between).
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead"), ("table",)), "thead": (("tbody", "caption"), ("table",)),
}
_FURNITURE = frozenset("nav footer aside form button menu dialog object audio video canvas label fieldset".split())
_STRONG_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr popup sidebar "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer newsletter subscribe comment comments disqus complementary contentinfo".split()
)
_WEAK_NAMES = frozenset("notice notices alert modal overlay widget share sharing social related recommended signup login respond reply replies search skip masthead toolbar".split())
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


class Role(NamedTuple):
    """What a node is for: 0 neutral, 1 furniture by a name that articles use too, 2 furniture."""

    role: int
    classes: tuple[str, ...]


def role_of(tag: str, attrs: str, inside: bool) -> Role:
    role, classes = 2 if tag in _FURNITURE or (tag == "header" and not inside) else 0, ()
    if attrs:
        for m in _NAME.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "class" and tag not in _ROOT:
                classes = tuple(sorted({_DIGITS.sub("#", x) for x in value.split()}))
            if tag in _MAIN or tag in _ROOT:
                continue
            for name in value.split():
                words = [x.lower() for x in _SPLIT.split(name) if x]
                strong = sum(x in _STRONG_NAMES or (not inside and x == "header") for x in words)
                weak = sum(x in _WEAK_NAMES for x in words)
                if strong and 2 * (strong + weak) >= len(words):
                    role = 2
                elif weak and 2 * weak >= len(words):
                    role = max(role, 1)
        if role < 2 and tag not in _ROOT and _HIDDEN.search(attrs):
            role = 2
    return Role(role, classes)


class Node:
    """``id``: digest of the path; ``parent``: index of the node it stands in, -1 for the root; ``inside``: below article or main."""

    __slots__ = ("tag", "id", "parent", "role", "inside", "inline")

    def __init__(self, tag: str, path_id: int, parent: int, role: int, inside: bool, inline: bool):
        self.tag, self.id, self.parent, self.role, self.inside, self.inline = tag, path_id, parent, role, inside, inline


def path_id(parent: int, tag: str, role: Role) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\n".join((str(parent), tag, str(role.role), *role.classes)).encode("utf-8", "replace")) - (1 << 63)


def parse(page: str) -> tuple[list[Node], list[list[tuple[int, str]]]]:
    """Nodes in page order, and the blocks: lists of (index of its node, text). Inline elements are nodes if they have a role."""
    nodes = [Node("", 0, -1, 0, False, False)]
    stack = [0]  # indexes of open nodes; inline ones only at its end
    blocks: list[list[tuple[int, str]]] = []
    held: list[tuple[int, str]] = []

    def flush() -> None:
        if any(not t.isspace() for _, t in held):
            blocks.append(held.copy())
        held.clear()

    def push(tag: str, role: Role, inline: bool) -> None:
        top = nodes[stack[-1]]
        nodes.append(Node(tag, path_id(top.id, tag, role), stack[-1], role.role, top.inside or top.tag in _MAIN, inline))
        stack.append(len(nodes) - 1)

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                held.append((stack[-1], entities.unescape(token) if "&" in token else token))
            elif token[:2] != "<!" and token[:2] != "<?":
                held.append((stack[-1], " "))
            continue
        tag = tag.lower()
        if tag not in _BLOCK:
            if tag in _VOID:
                held.append((stack[-1], " "))
            elif m[2]:
                for depth in range(len(stack) - 1, 0, -1):
                    if not nodes[stack[depth]].inline:
                        break
                    if nodes[stack[depth]].tag == tag:
                        del stack[depth:]
                        break
            elif m[4] or tag in _FURNITURE:
                top = nodes[stack[-1]]
                role = role_of(tag, m[4], top.inside or top.tag in _MAIN)
                if role.role and m[4][-1:] != "/":
                    push(tag, role, True)
            continue
        flush()
        while nodes[stack[-1]].inline:
            stack.pop()
        if m[2]:
            for depth in range(len(stack) - 1, 0, -1):
                own = nodes[stack[depth]].tag
                if own == tag:
                    del stack[depth:]
                    break
                if (own in ("td", "th", "caption") and tag not in ("tr", "table", "tbody", "thead", "tfoot")) or (tag == "li" and own in ("ul", "ol", "menu")):
                    break
            continue
        if tag == "hr":
            continue
        if nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in _ENDS:
            ends, bounds = _ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                own = nodes[stack[depth]].tag
                if own in ends:
                    del stack[depth:]
                    break
                if own in bounds:
                    break
        top = nodes[stack[-1]]
        push(tag, role_of(tag, m[4], top.inside or top.tag in _MAIN), False)
    flush()
    return nodes, blocks


def _line(pieces: list[tuple[int, str]]) -> str:
    return " ".join("".join(t for _, t in pieces).split())


def main_text(page: str | None, cut: frozenset[int] = frozenset()) -> str:
    """Lines of the blocks of ``page`` but for the branches at the nodes ``cut``."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    gone = [False] * len(nodes)
    for i, node in enumerate(nodes):
        gone[i] = node.id in cut or (node.parent >= 0 and gone[node.parent])
    lines = (_line([x for x in pieces if not gone[x[0]]]) for pieces in blocks)
    return "\n".join(x for x in lines if x)


NODE = "id long, parent long, tag string, role int, inside boolean, holds int, shape long, content long, chars long, main_chars long"


def page_nodes(page: str) -> tuple[int, list[tuple]]:
    """Digest of the main content, and ``NODE`` rows of the distinct paths of a page. ``holds``: 2 an article or main, 1 a first heading."""
    import xxhash

    nodes, blocks = parse(page)
    digest = lambda x: xxhash.xxh3_64_intdigest("\n".join(x).encode("utf-8", "replace")) - (1 << 63)
    first: dict[int, int] = {}
    shape: dict[int, list[str]] = {}
    texts: dict[int, list[str]] = {}
    holds: dict[int, int] = {}
    for i, node in enumerate(nodes):
        first.setdefault(node.id, i)
        if node.parent >= 0:
            own = shape.setdefault(nodes[node.parent].id, [])
            if not own or own[-1] != node.tag:  # runs of one tag count as one
                own.append(node.tag)
        if (what := 2 if node.tag in _MAIN else 1 if node.tag == "h1" else 0):
            at = i
            while at >= 0 and holds.get(nodes[at].id, 0) < what:
                holds[nodes[at].id] = what
                at = nodes[at].parent
    whole, main = [], []
    for pieces in blocks:
        line = _line(pieces)
        whole.append(line)
        if nodes[pieces[0][0]].inside or nodes[pieces[0][0]].tag in _MAIN:
            main.append(line)
        own = pieces if any(nodes[i].inline for i, _ in pieces) else None
        seen: set[int] = set()
        for at in dict.fromkeys(i for i, _ in pieces):
            text = line if own is None or not nodes[at].inline else _line([x for x in pieces if x[0] == at])
            while at >= 0:
                if nodes[at].id in seen:
                    break
                seen.add(nodes[at].id)
                if text:
                    texts.setdefault(nodes[at].id, []).append(text)
                at = nodes[at].parent
                text = line if at >= 0 and not nodes[at].inline else text
    main_chars = sum(map(len, main))
    rows = []
    for key, i in first.items():
        if i:
            node, own = nodes[i], texts.get(key, [])
            rows.append((key, nodes[node.parent].id, node.tag, node.role, node.inside, holds.get(key, 0), digest(shape.get(key, [])), digest(own), sum(map(len, own)), main_chars))
    return digest(main or whole), rows


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, id, parent, tag, role, inside, holds, pages, presentation, content, share, evidence, importance of every node of every host."""
    kinds = pa.list_(pa.struct([
        ("id", pa.int64()), ("parent", pa.int64()), ("tag", pa.string()), ("role", pa.int32()), ("inside", pa.bool_()), ("holds", pa.int32()),
        ("shape", pa.int64()), ("content", pa.int64()), ("chars", pa.int64()), ("main_chars", pa.int64()),
    ]))
    names = [f.name for f in kinds.value_type]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *page_nodes(page)) for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if page]
            hosts, mains, nodes = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(mains, pa.int64()), pa.array([[dict(zip(names, x)) for x in own] for own in nodes], kinds)], names=["host", "main", "nodes"]
            )

    seen = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).mapInArrow(read, f"host string, main long, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")
    # Pages with one main content count once: the one that comes first by the digest of its nodes.
    once = seen.groupBy("host", "main").agg(F.min_by("nodes", F.xxhash64("nodes")).alias("nodes")).select("host", F.inline("nodes"))
    kind = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).alias("digest")) for i, c in enumerate(("shape", "content")))))
    keys = ["host", "id", "parent", "tag", "role", "inside"]
    n = F.col("n")
    counts = (
        once.select(*keys, "holds", "chars", "main_chars", kind.alias("x")).groupBy(*keys, "x.kind", "x.digest")
        .agg(F.count("*").alias("n"), F.max("holds").alias("holds"), F.sum("chars").alias("chars"), F.sum("main_chars").alias("main_chars"))
    )
    of = lambda k, f: F.sum(F.when(F.col("kind") == k, f))
    sums = counts.groupBy(*keys).agg(
        F.max("holds").alias("holds"), of(0, n).alias("pages"), of(0, n * F.log(n)).alias("s"), of(1, n * F.log(n)).alias("c"),
        of(0, F.col("chars")).alias("chars"), of(0, F.col("main_chars")).alias("main_chars"),
    )
    # Entropy to base m of counts n with sum m: 1 - sum(n * ln n) / (m * ln m).
    entropy = lambda x: F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col(x) / (F.col("pages") * F.log("pages")))).otherwise(1.0)
    beside = F.col("tag").isin(*sorted(_BOXES)) & ~F.col("inside") & (F.col("holds") == 0) & (F.col("main_chars") > 0)
    share = F.when(beside, F.least(F.lit(1.0), F.col("chars") / (SHARE * F.col("main_chars")))).otherwise(1.0)
    tree = sums.select(*keys, "holds", "pages", entropy("s").alias("presentation"), entropy("c").alias("content"), share.alias("share"))
    tree = tree.withColumn("evidence", (1 - GAMMA) * F.col("presentation") + GAMMA * F.col("content") * F.col("share"))
    factor = F.when(F.col("role") == 0, 1.0).when((F.col("role") == 1) & F.col("inside"), WEAK).otherwise(STRONG)
    smooth = factor * (PRIOR + (F.col("pages") - 1) * F.col("evidence")) / (PRIOR + F.col("pages") - 1)
    always = (F.col("holds") == 2) | F.col("tag").isin(*sorted(_MAIN | _ROOT)) | (F.col("inside") & (F.col("role") == 0))
    return tree.withColumn("importance", F.when(always, 1.0).otherwise(smooth))


def extract(pages: DataFrame, least: float = LEAST, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    cut = spool(style_tree(pages).where(F.col("importance") < least).select("host", "id"))
    low = cut.groupBy("host").agg(F.collect_list("id").alias("low"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"), host_of(F.col("url")).alias("host"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(page, frozenset(low or ())) for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    if cut.count() <= broadcast_nodes:
        joined = own.join(F.broadcast(low), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")
        copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", salt).join(copies.hint("merge"), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
