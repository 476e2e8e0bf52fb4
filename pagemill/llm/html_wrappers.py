"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A wrapper is a tree of items in page order; an item can be optional or part of a repeated group, and text stands in
slots. Pages are aligned with the wrapper of their host one after another: what the wrapper or a page lacks becomes
optional, what comes more than once becomes a repeated group, and a group or slot whose text differs between pages is one
that varies. Counts and codes of a wrapper add up, so partitions infer their own, the merge reads a wrapper for each
partition, not pages, and the result doesn't depend on how the pages were dealt.

The wrapper chooses the article: it lies in the least group that holds all text that varies and stands outside of links;
groups beside it say the same on every page. Names of elements decide only what the wrapper leaves open.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from pagemill.llm.common import bounded_batches, cut, table, unused

#: Bytes of wrappers that are broadcast; more are joined to the pages by host.
BROADCAST_BYTES = 16 << 20
#: Hosts whose wrappers a task holds before it sends them on, pages that must say the same before a group counts as
#: template (the least that can be compared), and levels of nesting beyond which elements stand side by side.
HELD_HOSTS, ALIKE, DEPTH = 2_000, 2, 120

#: A quoted value ends where its quote closes before a space, a slash or the end of the tag; a quote that doesn't is a sign
#: like any other, and an unclosed tag ends before the next one.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/<>]*+)(?P<rest>(?:[^<>"'=]++|=\s*+"[^"]*+"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|["'=])*+)(?:>|(?=<)|\Z)""",
    re.S,
)
#: One attribute whole, so that no word of a value and no part of a name is read as an attribute.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video select option textarea button form input label head title meta link map dialog".split())
RAW = frozenset("script style template noscript iframe textarea title svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr".split())
CHROME_TAGS = SILENT | frozenset("nav footer aside menu".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class and id that name what surrounds an article.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar sidenav widget widgets footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe"
    " subscription signup signin login paywall share sharing social related recommended recommendations trending comment comments commentlist reply replies respond"
    " disqus discussion pagination pager toolbar skip search copyright legal disclaimer hidden".split()
)
#: Those of them that an element keeps even around an article or main element: what readers wrote, and other articles.
HARD_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion related recommended recommendations trending".split())
#: Inside an article or main element a name drops a container if it has one of these words and otherwise only words of layout;
#: ids are often slugs of headings, so fewer words count there. Any other name takes a text that is mostly links.
CLEAR_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored promo nav navbar breadcrumb breadcrumbs sidebar sidenav widget widgets cookie newsletter"
    " subscribe signup share sharing comment comments commentlist disqus pagination pager toolbar popup paywall hidden".split()
)
CLEAR_IDS = frozenset("ad ads adsense sidebar newsletter comments commentlist disqus".split())
LAYOUT_WORDS = frozenset("area bar block body box buttons cell col column container content form group inner item items js left links list outer panel right row section slot top unit wrap wrapper".split())
CONTAINERS = frozenset("div section ul ol dl table".split())
PLACED = CONTAINERS | frozenset("article aside main header footer nav td th center fieldset".split())
#: Words that make an article element itself chrome; the whole page and its main element never are by their words.
SIDE_ARTICLES = frozenset("comment reply ad advert advertisement sponsored promo teaser related widget".split())
#: A start tag of the key ends open elements of the set, up to the nearest of the stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    """An element of a page: tag, signature, whether it is chrome by itself, and children that are nodes or texts."""

    __slots__ = ("tag", "classes", "chrome", "soft", "named", "clear", "role", "words", "kids")

    def __init__(self, tag: str, rest: str = ""):
        self.tag, self.kids, self.role, names, classes, hidden, self.clear = tag, [], "", "", "", False, False
        if rest:
            for m in ATTRIBUTE.finditer(rest):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "role":
                    self.role = value.lower()
                elif name in ("class", "id"):
                    names += " " + value
                    classes += " " + value if name == "class" else ""
                    self.clear |= tag in CONTAINERS and _clear(value, CLEAR_IDS if name == "id" else CLEAR_CLASSES)
                elif name in ("hidden", "aria-hidden", "style"):
                    hidden |= name == "hidden" or value.lower() == "true" or "display:none" in value.lower().replace(" ", "")
        self.words = _words(names)
        self.classes = ".".join(sorted(_words(classes)))
        named = self.words & (frozenset() if tag in ("html", "body", "main") else SIDE_ARTICLES if tag == "article" else CHROME_WORDS)
        hard = tag in CHROME_TAGS or hidden or self.role in CHROME_ROLES or bool(named & HARD_WORDS) or (tag == "article" and bool(named))
        self.chrome, self.soft = hard or bool(named), bool(named) and not hard
        self.named = bool(named) and tag != "article" and not (tag in CHROME_TAGS or hidden or self.role in CHROME_ROLES)


    @property
    def sig(self) -> str:
        """Tag and class words, led by `!` for chrome by element, role or state and by `~` for chrome by name only."""
        return f"{('~' if self.soft else '!') if self.chrome else ''}{self.tag}{'.' if self.classes else ''}{self.classes}"


def _words(names: str) -> frozenset:
    return frozenset(w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()) if w) if names else frozenset()


def _clear(names: str, words: frozenset) -> bool:
    return any(w & words and w <= words | LAYOUT_WORDS for w in map(_words, names.split()))


def _article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("article", "main")


def _spare(root: Node) -> None:
    """Inside article and main elements, words alone make nothing chrome: names must be clear, or the text mostly links."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if inside and node.named and not node.clear:
            node.chrome = node.soft = _linked(node)
        inside = inside or (_article(node) and not node.chrome)
        todo.extend((kid, inside) for kid in node.kids if isinstance(kid, Node) and not node.chrome)


def _linked(node: Node) -> bool:
    """Whether at least half of the text of an element stands in links."""
    todo, chars = [(node, False)], [0, 0]
    while todo:
        at, link = todo.pop()
        link = link or at.tag == "a"
        for kid in at.kids:
            if isinstance(kid, str):
                chars[link] += len("".join(kid.split()))
            else:
                todo.append((kid, link))
    return chars[1] > 0 and chars[1] >= chars[0]


def parse(page: str | None) -> Node:
    """The tree of a page. Comments and what scripts and the like hold are left out; unclosed and stray tags are borne.

    Elements nested deeper than DEPTH hang side by side on the element at that level, with all their text in its order.
    """
    root = Node("#root")
    stack, at, page, opened = [root], 0, page or "", Counter()

    def close(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        if depth > DEPTH and any(n.tag not in INLINE for n in stack[depth:]):
            stack[DEPTH].kids.append(Node("div"))  # what comes next is another block
        del stack[depth:]

    while (m := TOKEN.search(page, at)) is not None:
        holder = stack[min(len(stack) - 1, DEPTH)]
        if m.start() > at:
            holder.kids.append(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if opened[tag] > 0:
                close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].tag == tag))
            continue
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            if any(opened[x] > 0 for x in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in stops:
                        break
                    if stack[depth].tag in closes:
                        close(depth)
        elif tag not in INLINE and opened["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag not in INLINE:
                    break
        node = Node(tag, m["rest"])
        stack[min(len(stack) - 1, DEPTH)].kids.append(node)
        if tag in ("article", "main") and not node.chrome:
            for around in stack[: DEPTH + 1]:  # a wrapper named after its sidebar, and the like
                around.chrome &= not around.soft
        if tag not in VOID and not m["rest"].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(page):
        stack[min(len(stack) - 1, DEPTH)].kids.append(page[at:])
    _spare(root)
    return root


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*+>", re.I)


class Text(str):
    """A run of text, with the number of its characters that stand in links."""

    linked = 0


def blocks(node: Node) -> list:
    """The children of a node as blocks: nodes of block elements, and texts of what stands between them."""
    out: list = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        words = html.unescape("".join(text)).split()
        if words:
            out.append(Text(" ".join(words)))
            out[-1].linked = min(linked, len(out[-1]))
        text.clear()
        linked = 0

    def walk(n: Node, link: bool) -> None:
        nonlocal linked
        for kid in n.kids:
            if isinstance(kid, str):
                text.append(kid)
                linked += len(kid.strip()) if link else 0
            elif kid.tag == "br":
                text.append(" ")
            elif kid.tag in INLINE and not kid.chrome:
                walk(kid, link or kid.tag == "a")
            else:
                flush()
                if kid.tag not in SILENT:
                    out.append(kid)

    walk(node, node.tag == "a")
    flush()
    return out


#: Containers of one signature side by side that a wrapper tells apart by their place; those that follow repeat the last.
PLACES = 6


def signed(node: Node) -> list[tuple[str, object]]:
    """The blocks of a node with their signatures: `#` for text, and the place among its like for containers."""
    out, met = [], Counter()
    for kid in blocks(node):
        if isinstance(kid, str):
            out.append(("#", kid))
            continue
        sig = kid.sig
        if kid.tag in PLACED:
            met[sig] += 1
            sig = sig if met[sig] == 1 else f"{sig}:{min(met[sig], PLACES)}"
        out.append((sig, kid))
    return out


# A wrapper is [sig, count, seen, text, chars, linked, items]: how often it stands on pages, in how many of its parents, the
# code of its text in each of them (0 if it varies), and the characters of a slot and those in links. Slots have the
# signature "#". It is plain lists so that it can travel as JSON.
SIG, COUNT, SEEN, TEXT, CHARS, LINKED, ITEMS = range(7)


def new_wrapper(sig: str = "#root") -> list:
    return [sig, 0, 0, None, 0, 0, []]


def _insert(items: list, row: list[str], known: dict[str, list]) -> None:
    """Puts items that are new, in the order of a row of signatures, behind those that they follow."""
    behind: dict[str | None, list] = {}
    old, met, last = {i[SIG] for i in items}, set(), None
    for sig in row:
        if sig in old:
            last = sig
        elif sig not in met:
            met.add(sig)
            behind.setdefault(last, []).append(known[sig])
    if behind:
        ordered = behind.get(None, [])
        for item in items:
            ordered += [item, *behind.get(item[SIG], ())]
        items[:] = ordered


def _agree(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None or a == b else 0


def add_page(wrapper: list, node: Node) -> int:
    """Aligns an element of a page with its wrapper; returns the code of the element's text."""
    known = {i[SIG]: i for i in wrapper[ITEMS]}
    row, codes = [], {}
    whole = xxhash.xxh3_64()
    for sig, kid in signed(node):
        item = known.get(sig)
        if item is None:
            item = known[sig] = new_wrapper(sig)
        if isinstance(kid, str):
            code = xxhash.xxh3_64_intdigest(kid)
            item[COUNT] += 1
            item[CHARS] += len(kid)
            item[LINKED] += kid.linked
        else:
            code = add_page(item, kid)
        row.append(sig)
        codes.setdefault(sig, xxhash.xxh3_64()).update(code.to_bytes(8))
        whole.update(code.to_bytes(8))
    wrapper[COUNT] += 1
    for sig, code in codes.items():
        known[sig][SEEN] += 1
        known[sig][TEXT] = _agree(known[sig][TEXT], code.intdigest() | 1)
    _insert(wrapper[ITEMS], row, known)
    return whole.intdigest() if row else 0


def merge(wrapper: list, other: list) -> None:
    """Aligns a wrapper with another of the same host."""
    for at in (COUNT, SEEN, CHARS, LINKED):
        wrapper[at] += other[at]
    wrapper[TEXT] = _agree(wrapper[TEXT], other[TEXT])
    known = {i[SIG]: i for i in wrapper[ITEMS]}
    for item in other[ITEMS]:
        merge(known.setdefault(item[SIG], new_wrapper(item[SIG])), item)
    _insert(wrapper[ITEMS], [i[SIG] for i in other[ITEMS]], known)


def expression(wrapper: list) -> str:
    """The wrapper as a union-free regular expression: `?` marks what is optional, `+` what is repeated, and a slot is `#`
    where its text varies and `=` where it is the same on every page."""
    parts = []
    for item in wrapper[ITEMS]:
        shown = ("#" if item[TEXT] == 0 else "=") if item[SIG] == "#" else f"<{item[SIG]}>({expression(item)})"
        repeated, optional = item[COUNT] > item[SEEN], item[SEEN] < wrapper[COUNT]
        parts.append(shown + ("*" if repeated and optional else "+" if repeated else "?" if optional else ""))
    return " ".join(parts)


class Group:
    """What a wrapper says of an element: whether its text is the same on all pages that hold it, on how many pages the text
    was compared, how many characters vary outside of links, and the groups in it by signature."""

    __slots__ = ("sig", "same", "single", "weight", "groups")

    def __init__(self, item: list):
        self.sig, self.groups = item[SIG], {i[SIG]: Group(i) for i in item[ITEMS]}
        self.same = bool(item[TEXT]) and item[SEEN] >= ALIKE
        self.single = item[COUNT] == item[SEEN]
        own = item[CHARS] - item[LINKED] if item[SIG] == "#" and item[TEXT] == 0 else 0
        self.weight = 0 if self.same or self.sig[0] == "!" else own + sum(g.weight for g in self.groups.values())

    def article(self) -> bool:
        return self.tag() in ("article", "main")

    def tag(self) -> str:
        return re.split("[.:]", self.sig.lstrip("~!"))[0]

    def template(self) -> bool:
        """Whether this is a whole container that says the same on every page."""
        return self.same and self.tag() in CONTAINERS | {"header", "article", "td", "center"}

    def holds(self, sig: str) -> bool:
        """Whether the group of this signature holds more than half of what varies here, whatever it is named."""
        return sig in self.groups and 2 * self.groups[sig].weight > self.weight

    def path(self) -> list[str]:
        """The way down to the least group that holds all that varies, but not into an article or main element."""
        at, out = self, []
        while at.weight and not at.article():
            heavy = [g for g in at.groups.values() if g.weight and (g.sig[0] != "~" or at.holds(g.sig))]
            if len(heavy) != 1 or heavy[0].sig == "#" or not heavy[0].single:
                break
            at = heavy[0]
            out.append(at.sig)
        return out


def _mains(node: Node, group: Group | None) -> Iterator[tuple[Node, Group | None]]:
    """The outermost elements that say they hold an article, none of them inside chrome or the same on every page."""
    for sig, kid in signed(node):
        if isinstance(kid, Node) and not _dropped(kid, sig, group):
            below = group.groups.get(sig) if group else None
            if kid.tag == "article" or kid.role in ("article", "main"):
                if not (below and below.template() and group.weight > 0):
                    yield kid, below
            else:
                yield from _mains(kid, below)


def _dropped(kid: Node, sig: str, group: Group | None) -> bool:
    """Chrome, unless it is that by name only and the wrapper finds most of what varies in it."""
    return kid.chrome and not (kid.soft and group is not None and group.holds(sig))


def _size(node: Node) -> int:
    return sum(len(b) if isinstance(b, str) else 0 if b.chrome else _size(b) for b in blocks(node))


def main_text(page: str | None, wrapper: Group | None) -> str:
    """The text of a page's article, one line per block; the wrapper of its host tells what is template."""
    root = parse(page)
    found = list(_mains(root, wrapper))
    if not found:
        mains = list(_outermost(root, "main"))
        if mains and 2 * sum(map(_size, mains)) >= _size(root):
            found = [(n, None) for n in mains]
        else:
            found = [_followed(root, wrapper)]
    out: list[str] = []

    def walk(node: Node, group: Group | None, article: bool) -> None:
        article = article or node.tag in ("article", "main")
        for sig, kid in signed(node):
            if isinstance(kid, str):
                out.append(str(kid))
                continue
            below = group.groups.get(sig) if group else None
            header = not article and (kid.tag == "header" or "header" in kid.words) and not (group and group.holds(sig))
            template = not article and below is not None and below.template() and group.weight > 0
            if not (header or template or _dropped(kid, sig, group)):
                walk(kid, below, article)

    for node, group in found:
        walk(node, group, _article(node))
    return "\n".join(out)


def _followed(root: Node, wrapper: Group | None) -> tuple[Node, Group | None]:
    """The element of a page to which the wrapper's path leads, as far as the page follows it."""
    node, group = root, wrapper
    for sig in wrapper.path() if wrapper else ():
        here = [kid for s, kid in signed(node) if s == sig]
        if len(here) != 1:
            break
        node, group = here[0], group.groups[sig]
    return node, group


def _outermost(node: Node, tag: str) -> Iterator[Node]:
    for kid in node.kids:
        if isinstance(kid, Node) and not kid.chrome:
            if kid.tag == tag:
                yield kid
            else:
                yield from _outermost(kid, tag)


WRAPPERS = "host string, salt long, wrapper string"


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    sent = 0

    def send() -> pd.DataFrame:
        rows = [(host, sent % 64, json.dumps(w, separators=(",", ":"))) for host, w in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["host", "salt", "wrapper"])

    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            add_page(held.setdefault(host, new_wrapper()), parse(page))
            if len(held) > HELD_HOSTS:
                sent += 1
                yield send()
    if held:
        yield send()


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = new_wrapper()
    for text in sorted(pdf["wrapper"]):
        merge(whole, json.loads(text))
    return pd.DataFrame([(pdf["host"].iloc[0], int(pdf["salt"].iloc[0]), json.dumps(whole, separators=(",", ":")))], columns=["host", "salt", "wrapper"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host of the pages (host, html): its wrapper as JSON. All pages are aligned, each in its own partition."""
    partial = pages.mapInPandas(_infer, WRAPPERS).withColumn("salt", F.spark_partition_id().cast("long") % 64)
    half = partial.groupBy("host", "salt").applyInPandas(_merged, WRAPPERS)
    return cut(half.groupBy("host").applyInPandas(_merged, WRAPPERS).select("host", "wrapper"))


def extract(pages: DataFrame, html_column: str = "html", url: str = "url") -> DataFrame:
    """The pages with the column `text`, the article's text, one line per block.

    Wrappers are inferred for each host (the lower-cased host of the url; pages without one share the empty host). The
    article is what article elements hold, or else the least group of the wrapper with all that varies outside of links,
    or the body where a host gives nothing to compare. Of it leaves what is chrome by element, role or state, what is chrome
    by name unless it holds most of what varies, and outside of article and main elements every container that says the
    same on all pages that have it, two at least. Null and empty pages give an empty text. Repeated rows, as all ties, are
    extracted one by one and alike; equal pages alone show no template. Other columns stay, whatever their names, and one
    named text is replaced. An empty table gives an empty table. Pages are read whole, however long or deep. Wrappers are
    broadcast while they are small; beyond BROADCAST_BYTES they are joined to the pages by host.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    host = F.coalesce(F.lower(F.try_parse_url(F.col(f"`{url}`"), F.lit("HOST"))), F.lit(""))
    wrappers = infer_wrappers(pages.select(host.alias("host"), F.col(f"`{html_column}`").alias("html")))
    if (wrappers.agg(F.sum(F.octet_length("wrapper") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        made: dict[str, Group] = {}

        @pandas_udf("string")
        def text_of(hosts: pd.Series, bodies: pd.Series) -> pd.Series:
            for h in set(hosts) - made.keys():
                made[h] = Group(json.loads(shared.value[h])) if h in shared.value else None
            return pd.Series([main_text(b, made[h]) for h, b in zip(hosts, bodies, strict=True)], dtype=object)

        return pages.withColumn("text", text_of(host, F.col(f"`{html_column}`")))

    @pandas_udf("string")
    def text_with(texts: pd.Series, bodies: pd.Series) -> pd.Series:
        known: dict[str, Group | None] = {}
        out = []
        for w, b in zip(texts, bodies, strict=True):
            if w not in known:
                known.clear()
                known[w] = Group(json.loads(w)) if w else None
            out.append(main_text(b, known[w]))
        return pd.Series(out, dtype=object)

    at, of = unused(pages, "host"), unused(pages, "wrapper")
    joined = pages.withColumn(at, host).join(wrappers.select(F.col("host").alias(at), F.col("wrapper").alias(of)), at, "left")
    return joined.withColumn("text", text_with(F.col(of), F.col(f"`{html_column}`"))).drop(at, of)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(
    string_split(regexp_replace(regexp_replace(body, '</?(p|h1|div|ul|li)(\s[^>]*)?>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a
), c AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""

QUERIES = {"op10_html_extraction": op10_html_extraction}
SQL = {"op10_html_extraction": ORACLE}
