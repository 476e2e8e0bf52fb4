"""Features, page type and candidate extractions of a document tree. No Spark in here."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pagemill.functions.dom import Node, body_of, flat, remove_all

# Selectors of what is no content, keyword patterns and signals of page types.
DEFAULT_UNWANTED = "script,style,noscript,template,iframe,object,embed,nav,header,footer,.ad,.sidebar,.menu,.social,.share,.comments"
NOISE = ".advertisement,.ads,.banner,.cookie,.cookie-banner,.newsletter,.popup,.modal,.breadcrumb,.breadcrumbs,.pagination,.related,.widget,.promo,aside,form,[role=navigation],[role=banner],[role=contentinfo],[role=complementary],[aria-hidden=true],[hidden]"
POSITIVE = re.compile("content|article|body|main|story|product|detail|overview|spec|datasheet", re.I)
NEGATIVE = re.compile("nav|menu|header|footer|sidebar|breadcrumb|comment|ad|promo|widget|popup|newsletter|cookie|modal|social[-_ ]?(share|icons?|links?|buttons?)|share[-_ ]?(button|icons?|links?)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0*)?(?:;|$)", re.I)
TAG_POINTS = {"main": 20, "article": 20, "section": 10, "div": 5, "nav": -50, "header": -50, "footer": -50, "aside": -50}
GENERIC = "article,main,[role=main],[role=article],.post-content,.entry-content,.article-body,.article-content,.story-body,.content,#content,#main,.post,.main,section"
SEMANTIC = "article,main,section,[role=main],[role=article]"
FEED = "[class*=feed],[class*=list],[class*=posts],[class*=stream],[class*=results],ul,ol"
TEMPORAL = "time,[datetime],[itemprop*=date],[class*=date],[class*=time]"
BYLINE = "[rel=author],[itemprop*=author],.byline,[class*=author]"
COMMENTS = ".comment,.reply,.post,[id^=comment-],[class*=comment],[id*=comment],[class*=thread],[id*=thread],[class*=reply],[id*=reply],[class*=discussion],[id*=discussion]"
LANDING = ("[id*=hero],[class*=hero]", "[id*=about],[class*=about]", "[id*=skill],[class*=skill]", "[id*=project],[class*=project],[class*=work]", "[id*=blog],[class*=blog],[class*=post]", "[id*=contact],[class*=contact]", "[id*=portfolio],[class*=portfolio]")
PROFILES = ("article", "documentation", "forum", "product", "landing-page", "code-heavy")


def link_density(node: Node) -> float:
    """Share of the text that stands in links; 1 without text."""
    whole = len(flat(node.text()))
    return sum(len(flat(a.text())) for a in node.select("a")) / whole if whole else 1.0


def headings(node: Node) -> list[str]:
    """Distinct normalised headings of the first four levels with ten characters or more, in order."""
    found = (re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", flat(h.text()).lower())).strip() for h in node.select("h1,h2,h3,h4"))
    return list(dict.fromkeys(h for h in found if len(h) >= 10))


def repeated_items(node: Node, most: int = 40) -> int:
    n = 0
    for item in node.select("article,li,[class*=card],[class*=item],[class*=post],[class*=entry]"):
        if 40 <= len(flat(item.text())) <= 1600 and item.first("a") is not None:
            n += 1
            if n >= most:
                break
    return n


def form_blocks(node: Node) -> int:
    return len(node.select("form,input,select,textarea,[role=search],.search,.search-form"))


def sections(node: Node) -> int:
    """Direct children that are substantial parts of the page."""
    n = 0
    for box in node.children():
        if box.tag not in ("section", "article", "main", "div"):
            continue
        length = len(flat(box.text()))
        if length < 80 and not (length >= 40 and box.first("h1,h2,h3")):
            continue
        if re.search("nav|menu|header|footer|sidebar|breadcrumb|ad|promo|cookie|subscribe|widget|modal", box.names()):
            continue
        density = link_density(box)
        n += density <= 0.5 or (density <= 0.85 and repeated_items(box) >= 3)
    return n


def gate_features(node: Node) -> dict:
    """What the quality gate looks at."""
    text = node.text()
    chars, paragraphs = len(text), node.select("p")
    links = sum(len(a.text()) for a in node.select("a"))
    semantic = int(node.tag != "#document" and node.matches(SEMANTIC)) + len(node.select(SEMANTIC))
    heads = len(node.select("h1,h2,h3,h4,h5,h6"))
    lower = text.lower()
    times = min(3, len(re.findall(r"\b(?:\d{1,2}:\d{2}\s?(?:am|pm)?|\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2})\b", lower)))
    by = int(bool(re.search(r"\bby\s+[a-z][a-z\s.'-]{2,60}\b", lower)))
    numbered = min(3, len(re.findall(r"(?m)^\s*\d{1,2}[.)]\s+\S", text)))
    cue = 20 * len(node.select(TEMPORAL)) + 18 * len(node.select(BYLINE)) + 12 * len(node.select("ol")) + 8 * (times + by + numbered)
    markup = len(node.html())
    return {
        "chars": chars,
        "paragraphs": len(paragraphs),
        "link_density": links / chars if chars else 0.0,
        "mean_paragraph": sum(len(p.text()) for p in paragraphs) / len(paragraphs) if paragraphs else 0.0,
        "headings": heads,
        "signal": chars / markup if markup else 0.0,
        "structure": float(min(100, 20 * semantic + 5 * heads)),
        "cue": float(min(100, cue)),
    }


def node_score(node: Node) -> float:
    """How much an element looks like main content."""
    if HIDDEN.search(node.get("style")):
        return 0.0
    names = node.names()
    score = -50.0 * bool(NEGATIVE.search(names)) + 25 * bool(POSITIVE.search(names)) + TAG_POINTS.get(node.tag, 0)
    text = node.text().strip()
    if len(text) < 50:
        return min(score, 0.0)
    density = sum(len(a.text()) for a in node.select("a")) / max(1, len(text))
    if density > 0.3:
        score -= density**2 * len(text) * 0.5
    score += len(text) // 100 + (30 if node.first("table") else 0) + 2 * len(node.select("p"))
    return score + min(10, 3 * len(node.select("h1,h2,h3")))


def best_node(root: Node) -> tuple[Node, float]:
    """The container with the highest score; of equal ones the first."""
    return max(((n, node_score(n)) for n in [root, *root.select("article,main,section,div")]), key=lambda x: x[1])


def prune(node: Node) -> Node:
    """A copy without children of negative score, all the way down."""
    out = node.copy()
    stack = [out]
    while stack:
        for kid in stack.pop().children():
            if node_score(kid) < 0:
                kid.remove()
            else:
                stack.append(kid)
    return out


def page_type(root: Node, url: str | None) -> tuple[str, float, list[str]]:
    """Profile, confidence and signals of a page."""
    address = (url or "").lower()
    try:
        parts = urlsplit(address)
        host, path = parts.hostname or address, parts.path
    except ValueError:
        host, path = address, address
    points, signals = dict.fromkeys(PROFILES, 0), []

    def signal(holds: object, name: str, **more: int) -> None:
        if holds:
            signals.append(name)
            for profile, n in more.items():
                points[profile.replace("_", "-")] += n

    has = lambda *words: any(w in address for w in words)
    signal(has("/docs", "/documentation", "/guide", "/reference", "/api") or host.startswith(("docs.", "api.")), "url:docs", documentation=3)
    signal(host.endswith(("reddit.com", "redd.it", "news.ycombinator.com")) or has("/topic/", "/thread/") or any(w in host for w in ("forum", "community", "discuss")), "url:forum", forum=3)
    signal(host.startswith("blog.") or host.endswith(("medium.com", "substack.com")) or has("/blog/"), "url:blog", article=2)
    signal(host.endswith("wikipedia.org") or has("/wiki/"), "url:wiki", documentation=2)
    signal(host.endswith(".edu") or has("/abs/", "/pdf/"), "url:academic", documentation=2)
    signal((address and path in ("", "/")) or has("/portfolio", "/resume", "/work"), "url:landing", landing_page=2)
    signal(root.first("article"), "dom:article_tag", article=2)
    signal(root.first('[itemtype*=Article],[itemprop=articleBody],meta[property="article:published_time"]'), "dom:article_metadata", article=3)
    code = len(root.select("pre,code"))
    signal(code >= 3, "dom:codeBlocks>=3", code_heavy=3, documentation=1)
    signal(code >= 10, "dom:codeBlocks>=10", code_heavy=3, documentation=1)
    signal(len(root.select("h1,h2,h3,h4,h5,h6")) >= 5, "dom:headings>=5", documentation=1)
    signal(len(root.select("section")) >= 4 and len(root.select(",".join(LANDING))) >= 3, "dom:landing_sections>=3", landing_page=4)
    signal(root.first("form") and root.first("[id*=contact],[class*=contact]"), "dom:contact_form", landing_page=2)
    signal(root.first("footer a") or root.first("[class*=social] a"), "dom:footer_or_social_links", landing_page=1)
    signal(root.first(".chip,.tag,.badge,.skill,[data-chip]"), "dom:chips", landing_page=1)
    signal(len(root.select(COMMENTS)) >= 3, "dom:comments>=3", forum=3)
    signal(root.first("[itemtype*=Product]") or root.first(".price,[itemprop=price]") or root.first("button[class*=cart],button[id*=cart],button[class*=checkout],button[id*=checkout]"), "dom:product_signals", product=4)
    signal(sum(len(p.text().strip()) > 200 for p in root.select("p")) >= 3, "dom:long_paragraphs>=3", article=2)
    best = max(PROFILES, key=points.__getitem__)
    return ("generic", 0.3, signals) if points[best] < 3 else (best, min(1.0, points[best] / 8), signals)


def clean(root: Node, base: str | None = None, selectors: str = NOISE, defaults: bool = True) -> Node:
    """The tree without chrome, hidden and empty elements, with addresses made absolute. The tree given is changed."""
    from urllib.parse import urljoin

    remove_all(root.select(f"{DEFAULT_UNWANTED},{selectors}" if defaults else f"script,style,noscript,template,{selectors}"))
    remove_all([n for n in root.walk() if HIDDEN.search(n.get("style"))])
    gone: dict[int, Node] = {}
    for node in reversed(root.select("p,div,span,section,li,ul,ol")):
        if all(not k.strip() if isinstance(k, str) else id(k) in gone for k in node.kids):
            gone[id(node)] = node
    remove_all(list(gone.values()))
    if base:
        for node in root.walk():
            for name in ("href", "src"):
                value = node.attrs.get(name)
                if value and not value.startswith(("#", "data:", "mailto:", "javascript:")):
                    try:
                        node.attrs[name] = urljoin(base, value)
                    except ValueError:
                        pass
    return root


@dataclass
class Candidate:
    """An extraction of a page with what its score is made from."""

    source: str
    node: Node
    confidence: float = 0.0
    features: dict = field(default_factory=dict)


def _features(node: Node, source_heads: list[str], lead: str) -> dict:
    text = flat(node.text())
    heads = headings(node)
    covered = sum(any(h == x or (len(h) >= 20 and h in x) or (len(x) >= 20 and x in h) for x in heads) for h in source_heads)
    return {
        "text_length": len(text),
        "heading_coverage": covered / len(source_heads) if source_heads else 1.0,
        "section_count": sections(node),
        "noise": bool(re.search(r"accept all .*cookie|cookie settings|tracking cookies?|popup ad|manage preferences|allow all cookies", text, re.I)),
        "lead": not lead or lead in heads,
        "anchors": len(node.select("a")),
        "repeated": repeated_items(node),
        "forms": form_blocks(node),
        "vector": bool(node.first("svg,path")),
        "density": link_density(node),
        "paragraphs": len(node.select("p")),
        "code": sum(len(flat(c.text())) for c in node.select("pre,code")),
        "tables": len(node.select("table")),
        "lists": len(node.select("ul,ol")),
    }


def candidates(root: Node, first: list[Candidate] | tuple = ()) -> list[Candidate]:
    """Extractions of a cleaned page in pool order: those given, readable, semantic, generic, heuristic, feed and the whole body."""
    body = body_of(root)
    heads = headings(body)
    lead = heads[0] if heads else ""
    pool: list[Candidate] = [*first]
    if (node := readable(body)) is not None:
        pool.append(Candidate("readability", node, 0.8))
    for selector in ("article", "main", "[role=main]", "[role=article]"):
        if (node := body.first(selector)) is not None and len(flat(node.text())) >= 120:
            pool.append(Candidate("semantic", node, 0.6))
            break
    taken: set[int] = set()
    for node in body.select(GENERIC):
        if any(id(a) in taken for a in _ancestors(node)):
            continue
        length, paragraphs = len(flat(node.text())), len(node.select("p"))
        if length >= 140:
            taken.add(id(node))
            confidence = min(1.0, 0.2 + min(0.4, length / 4000) + min(0.3, paragraphs * 0.05) - min(0.3, link_density(node) * 0.3))
            pool.append(Candidate(f"generic:{node.tag}", node, max(0.0, confidence)))
    best, _ = best_node(body)
    pool.append(Candidate("heuristic", prune(best), 0.5))
    for node in body.select(FEED):
        if len(flat(node.text())) >= 350 and len(node.select("a")) >= 8 and repeated_items(node) >= 4:
            pool.append(Candidate("feed", node, 0.4))
            break
    pool.append(Candidate("body", body, 0.1))
    seen, out = set(), []
    for c in pool:
        key = c.node.html()
        if key not in seen:
            seen.add(key)
            c.features = _features(c.node, heads, lead)
            out.append(c)
    return out


def _ancestors(node: Node) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def readable(body: Node, char_threshold: int = 500, top: int = 5) -> Node | None:
    """The published arc90 scoring: paragraphs give points to their parents and grandparents, link density takes them off,
    and siblings of the best container join it. A second try is more generous."""
    for threshold, retry in ((char_threshold, False), (max(200, char_threshold // 2), True)):
        points: dict[int, list] = {}
        for p in body.select("p,pre,td,blockquote" if not retry else "p,pre,td,blockquote,li,div"):
            text = flat(p.text())
            if len(text) < 25:
                continue
            gain = 1 + text.count(",") + min(3, len(text) // 100)
            node, share = p.parent, 1.0
            for depth in range(3):
                if node is None or node.tag == "#document":
                    break
                entry = points.setdefault(id(node), [node, float(25 * bool(POSITIVE.search(node.names())) - 25 * bool(NEGATIVE.search(node.names())) + {"div": 5, "article": 8, "pre": 3, "td": 3, "blockquote": 3}.get(node.tag, 0))])
                entry[1] += gain * share
                node, share = node.parent, 0.5 if depth == 0 else 1 / 6
        ranked = sorted(((n, s * (1 - link_density(n))) for n, s in points.values()), key=lambda x: -x[1])[:top]
        if not ranked:
            continue
        best, score = ranked[0]
        out = Node("div")
        siblings = best.parent.children() if best.parent is not None else [best]
        for sibling in siblings:
            own = next((s for n, s in ranked if n is sibling), -math.inf)
            text = flat(sibling.text())
            joins = sibling is best or own >= max(10.0, score * 0.2) or (sibling.tag == "p" and len(text) > 80 and link_density(sibling) < 0.25) or sibling.tag in ("h1", "h2")
            if joins:
                out.append(sibling.copy())
        if len(out.html()) > threshold:
            return out
    return None
