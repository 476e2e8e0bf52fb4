"""Operators on page trees beside the main path: captures, noise, threads on pages, stages and rule tables. No Spark in here.

Operators that take elements out change the tree they are given and return it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pagemill.functions import features
from pagemill.functions.dom import Node, body_of, flat, parse

# Tables of selectors, words and patterns.
BASE_METADATA = 'meta[property],meta[name],meta[itemprop],script[type="application/ld+json"],link[rel=canonical],title'
AD_LABELS = frozenset(("advertisement", "sponsored", "sponsored content"))
KEYWORDS = ("cookie|consent|privacy|tracking", "subscribe|newsletter|sign up|join waitlist", "popup|modal|overlay|sponsored|advert", "accept all|manage preferences|allow all|continue")
KEYWORD_NAMES = "cookie|consent|subscribe|newsletter|popup|modal|promo|advert|ad"
COVERAGE_ROOTS = "main,article,[role=main],#content,.content,.main-content,.post-content,.article-body,.article-content"
SEMANTIC_FIRST = ("article", "main", "[role=main]", ".post-content", ".entry-content", ".article-content", "#content", ".content")
THREAD_BODIES = ("[data-testid=post-container]", ".thread", "#thread", "[class*=thread]")
THREAD_NOISE = (
    r"\b\d+\s*(?:up|down)votes?\b", r"\b\d+\s*comments?\b", r"\b\d+\s*(?:points?|karma)\b", r"posted by u/\w+", r"\b\d+\s*(?:hours?|days?|months?|years?)\s*ago\b", r"\bgive\s+award\b", r"\bsort by:?\s*\w+",
    r"\b(?:share|report|save|awards?|reply|permalink|edit|delete|hide|collapse|vote)\s*$",
)
SOCIAL_HOSTS = "github.com|linkedin.com|twitter.com|x.com|facebook.com|instagram.com|youtube.com|mastodon"


# Captures.


def ensure_base(root: Node, url: str) -> Node:
    """A base element in the head unless there is one."""
    if root.first("base") is None:
        head = root.first("head") or root.first("html") or root
        base = Node("base", {"href": url})
        base.parent = head
        head.kids.insert(0, base)
    return root


def mark_hidden(root: Node) -> Node:
    """Elements hidden by their own style or attributes, marked as such."""
    for node in root.walk():
        if features.HIDDEN.search(node.get("style")) or "hidden" in node.attrs or node.get("aria-hidden") == "true":
            node.attrs["data-hidden"] = "true"
    return root


def flatten_shadow(root: Node) -> Node:
    """Declared shadow roots in the place of their template: slots hold the children of the host that name them."""
    for template in [t for t in root.walk() if t.tag == "template" and ("shadowrootmode" in t.attrs or "shadowroot" in t.attrs)]:
        host = template.parent
        if host is None:
            continue
        light = [k for k in host.kids if k is not template]
        for slot in [n for n in template.walk() if n.tag == "slot"]:
            name = slot.get("name")
            fits = [k for k in light if (k.get("slot") if isinstance(k, Node) else "") == name]
            if fits:
                slot.kids = []
                for k in fits:
                    slot.append(k)
        host.kids = []
        host.attrs["data-shadow-pierced"] = "true"
        for k in template.kids:
            host.append(k)
    return root


def metadata_markup(root: Node, most: int = 30) -> str:
    """The parts of a page that say when and by whom, as markup."""
    parts = root.select(BASE_METADATA) + root.select("time,[datetime],.byline,[rel=author]")[:most]
    return "".join(n.html() for n in parts)


# Noise.


def remove_sponsored(root: Node) -> Node:
    """Strips of sponsored links outside of the content: next to no text, no heading, images or nothing but such links."""
    counts: Counter = Counter()
    boxes: dict[int, Node] = {}
    for link in root.select("a[rel*=sponsored]"):
        node = link.parent
        for _ in range(6):
            if node is None or node.tag in ("body", "html", "#document"):
                break
            if node.tag in ("div", "section", "aside", "header", "nav"):
                counts[id(node)] += 1
                boxes[id(node)] = node
            node = node.parent
    for key, n in counts.items():
        box = boxes[key]
        if box.parent is None or box.closest("article,main") is not None:
            continue
        images, links = len(box.select("img")), len(box.select("a"))
        bare = not box.select("h1,h2,h3,h4") and len(flat(box.text())) < 260
        if bare and (n >= 2 or images >= 3) and (images >= 2 or links <= n + 2):
            box.remove()
    return root


def remove_keyword_blocks(root: Node) -> Node:
    """Short blocks that at least two signs say are consent, sign-up or overlay chrome."""
    for node in root.select("div,section,aside,dialog,form,p,li,span"):
        if node.parent is None or node.first("article,main,pre,code,table,section h1,section h2"):
            continue
        text = flat(node.text()).lower()
        if not 30 <= len(text) <= 320:
            continue
        hits = sum(bool(re.search(p, text)) for p in KEYWORDS) + bool(re.search(KEYWORD_NAMES, node.names()))
        controls, heads = len(node.select("a,button")), len(node.select("h1,h2,h3,h4"))
        if hits >= 3 or (hits == 2 and not heads and controls):
            node.remove()
    return root


def remove_ad_labels(root: Node) -> Node:
    for node in root.select("div,section,aside,p,span"):
        if flat(node.text()).lower() in AD_LABELS and not node.first("a,button,img,iframe"):
            node.remove()
    return root


def remove_banners(root: Node) -> Node:
    """Rows of linked images among the first parts of a page."""
    for node in root.children()[:12]:
        if node.tag in ("main", "article") or node.first("article,main,h1,h2"):
            continue
        images, links, length = len(node.select("img")), len(node.select("a")), len(flat(node.text()))
        if (images >= 3 and length < 80 and links >= images) or (images >= 5 and length < 140):
            node.remove()
    return root


def remove_hidden(root: Node) -> Node:
    for node in list(root.walk()):
        if (features.HIDDEN.search(node.get("style")) or "hidden" in node.attrs or node.get("aria-hidden") == "true") and node.closest("pre,code,.highlight") is None:
            node.remove()
    return root


def remove_visual(root: Node) -> Node:
    """Vector parts and images whose data stand in the page, outside of code."""
    for node in root.select("svg,path,symbol,defs,mask,canvas,img,source"):
        inline = node.get("src").lower().startswith("data:image/") or node.get("srcset").lower().startswith("data:image/")
        if (node.tag not in ("img", "source") or inline) and node.closest("pre,code") is None:
            node.remove()
    return root


def remove_empty(root: Node) -> Node:
    for node in reversed(root.select("p,div,span,section,article,aside")):
        if not node.children() and not node.text(True).strip():
            node.remove()
    return root


def inline_spacing(root: Node) -> Node:
    """A space between neighbours in a heading, paragraph or item that would run together, unless letters are styled one by one."""
    for node in root.select("h1,h2,h3,h4,h5,h6,p,li"):
        if node.closest("pre,code,kbd,samp") is not None:
            continue
        inner = node.children()
        if len(inner) >= 10 and sum(len(flat(k.text())) == 1 for k in inner) >= 0.6 * len(inner):
            continue
        out: list = []
        for kid in node.kids:
            left, right = (x.text() if isinstance(x, Node) else x for x in (out[-1] if out else "", kid))
            if left and right and left[-1].isalnum() and right[0].isalnum() and left[-1].isascii() and right[0].isascii() and (len(left.strip()) > 1 or len(right.strip()) > 1):
                out.append(" ")
            out.append(kid)
        node.kids = out
    return root


def isolate_examples(root: Node, most: int = 3) -> Node:
    """Escaped markup that follows a label of raw input, as a code block."""
    for node in root.select("p,div"):
        if re.match("raw (?:input|source|html)", flat(node.text()).lower()) and node.parent is not None and len(flat(node.text())) < 40:
            kids = node.parent.kids
            at = next(i for i, k in enumerate(kids) if k is node) + 1
            run = [k for k in kids[at:] if isinstance(k, Node) or k.strip()][:most]
            taken = [k for k in run if isinstance(k, str) or k.tag not in ("pre", "h1", "h2", "h3")]
            if taken and len(taken) == len(run):
                code = Node("pre")
                code.append("".join(k if isinstance(k, str) else k.html() for k in taken))
                code.parent = node.parent
                node.parent.kids = [k for k in kids if not any(k is t for t in taken)]
                node.parent.kids.insert(at, code)
    return root


def prepare(root: Node, url: str | None = None) -> Node:
    """All of the cleaning before extraction, in order."""
    body = body_of(root)
    for step in (remove_sponsored, remove_hidden, remove_visual, remove_keyword_blocks, remove_ad_labels, remove_banners, inline_spacing):
        step(body)
    return remove_empty(features.clean(root, url))


# Measures and choices.


def coverage_root(root: Node) -> Node:
    """The container that a page's content is measured by; of equal ones the first, else the body."""
    body = body_of(root)
    whole = len(flat(body.text())) or 1
    best, most = body, float("-inf")
    for node in root.select(COVERAGE_ROOTS):
        length = len(flat(node.text()))
        primary = node.tag in ("main", "article") or node.get("role").lower() == "main"
        side = bool(re.search(r"sidebar|^side$|\bside\b|search|filter|menu|nav|footer|header|widget|promo", node.names().strip()))
        if length < 80 or (side and not primary and length < whole * 0.7):
            continue
        score = min(1800, length) + 520 * primary + 140 * features.repeated_items(node) - 360 * features.link_density(node) - 220 * features.form_blocks(node) - 600 * (length < whole * 0.08) - 380 * side
        if score > most:
            best, most = node, score
    return best


def coverage_low(extracted: Node, source: Node) -> bool:
    """Whether an extraction lost so much text, headings or lists of its page that another should be tried."""
    mine, whole = len(flat(extracted.text())), len(flat(body_of(source).text()))
    if whole < 80:
        return False
    if mine < 0.45 * whole:
        return True
    root = coverage_root(source)
    heads, have = features.headings(root), features.headings(extracted)
    parts = features.sections(root)
    if 2 <= parts <= 8 and 2 <= len(heads) <= 10 and (sum(h in have for h in heads) < 0.6 * len(heads) or heads[0] not in have):
        return True
    n, m = len(root.select("h1,h2,h3,h4")), len(extracted.select("h1,h2,h3,h4"))
    items, kept = len(root.select("li")), len(extracted.select("li"))
    return (n >= 4 and m < max(2, int(n * 0.4))) or (items >= 8 and kept < int(items * 0.25))


def usable(node: Node) -> bool:
    """Whether an adapter's extraction holds enough to go on with."""
    length = len(flat(node.text()))
    blocks = sum(len(flat(p.text())) >= 20 for p in node.select("p,li,blockquote"))
    code = sum(len(c.text(True)) for c in node.select("pre,code"))
    return length >= 40 and (length >= 120 or blocks >= 1 or code >= 80)


def expand(node: Node, most_density: float = 0.5, growth: float = 3.0) -> Node:
    """The outermost ancestor that stays a piece of content: few links, and no more than so many times the text."""
    length = len(flat(node.text()))
    while node.parent is not None and node.parent.tag not in ("body", "html", "#document"):
        up = node.parent
        if features.link_density(up) > most_density or len(flat(up.text())) > growth * max(1, length):
            break
        node = up
    return node


def semantic(root: Node, least: int = 500) -> Node | None:
    return next((n for s in SEMANTIC_FIRST if (n := root.first(s)) is not None and len(flat(n.text())) >= least), None)


def feeds(root: Node) -> list[Node]:
    """Containers of repeated linked items, one for each structural key."""
    out: dict[tuple, Node] = {}
    for node in root.select(features.FEED):
        key = (node.tag, node.get("id"), node.get("class"), len(node.children()))
        if key not in out and len(flat(node.text())) >= 350 and len(node.select("a")) >= 8:
            out[key] = node
    return list(out.values())


def landing(root: Node) -> Node:
    """A landing page as an article: chips as a list, form controls as paragraphs, links to profiles as a section."""
    out = Node("article")
    body = body_of(root).copy()
    for node in body.select("script,style,noscript,nav"):
        node.remove()
    chips = [flat(n.text()) for n in body.select(".chip,.tag,.badge,.skill,[data-chip]")]
    for node in body.select(".chip,.tag,.badge,.skill,[data-chip]"):
        node.remove()
    for node in body.select("input,select,textarea"):
        label = body.first(f'label[for="{node.get("id")}"]') if node.get("id") else None
        node.tag, node.attrs, node.kids = "p", {}, [flat(label.text()) if label is not None else ""]
    for kid in list(body.kids):
        out.append(kid)
    if chips:
        listed = Node("ul")
        for chip in dict.fromkeys(filter(None, chips)):
            item = Node("li")
            item.append(chip)
            listed.append(item)
        out.append(listed)
    profiles = [a for a in root.select("footer a,[class*=social] a") if re.search(SOCIAL_HOSTS, a.get("href"))]
    if profiles:
        section, head = Node("section"), Node("h2")
        head.append("Links")
        section.append(head)
        for a in profiles:
            section.append(a.copy())
        out.append(section)
    return out


def label_of(root: Node) -> list[tuple[str, str]]:
    """Labels joined to the controls that they name."""
    controls = {n.get("id"): n.tag for n in root.select("input,select,textarea") if n.get("id")}
    return [(flat(label.text()), controls[label.get("for")]) for label in root.select("label[for]") if label.get("for") in controls]


# Threads on pages.


def thread_body(root: Node) -> Node | None:
    return next((n for s in THREAD_BODIES if (n := root.first(s)) is not None and len(flat(n.text())) >= 80), None)


def thread_lines(text: str) -> str:
    """The lines of a thread without counters and buttons; a short line that repeats the one kept before it goes."""
    for pattern in THREAD_NOISE:
        text = re.sub(pattern, "", text, flags=re.I | re.M)
    out: list[str] = []
    for line in map(str.strip, text.split("\n")):
        if (len(line) > 5 or re.match(r"#+\s", line)) and not (out and out[-1] == line and len(line) <= 50):
            out.append(line)
    return "\n\n".join(out)


def thread_quality(cleaned: str, raw: str) -> int:
    lost = 1 - len(cleaned) / len(raw) if raw else 0.0
    words = len(re.split(r"\s+", cleaned))
    return max(0, 100 - 20 * (lost > 0.8) - 20 * (lost < 0.3) - 30 * (words < 50) - 10 * (len(cleaned) / words < 4))


def is_shell(root: Node, url: str) -> bool:
    """Whether a thread page came without its thread."""
    return bool(re.search(r"reddit\.com/r/[^/]+/comments/", url or "")) and (thread_body(root) is None or len(flat(body_of(root).text())) < 200)


# Adapters, stages and rules.


@dataclass(frozen=True)
class Adapter:
    """A site's own extraction: whether it fits a page, and what it extracts."""

    name: str
    fits: Callable[[Node, str], bool]
    extract: Callable[[Node], Node | None]


ADAPTERS: list[Adapter] = [Adapter("thread", lambda root, url: thread_body(root) is not None, thread_body)]


def adapted(root: Node, url: str, adapters: list[Adapter] | None = None) -> list[tuple[str, Node | None, str]]:
    """Of every adapter that fits: its name, its extraction, and what happened: used, null or the error's name."""
    out = []
    for a in ADAPTERS if adapters is None else adapters:
        if a.fits(root, url):
            try:
                node = a.extract(root)
                out.append((a.name, node, "used" if node is not None and usable(node) else "null"))
            except (ValueError, KeyError, AttributeError, TypeError, IndexError) as error:
                out.append((a.name, None, type(error).__name__))
    return out


def pool(root: Node, url: str, profile: str, adapters: list[Adapter] | None = None) -> list[features.Candidate]:
    """All candidates of a page as it was captured, which is cleaned here: a landing page rewritten as an article, the outermost
    posts of a forum, what the site adapters extract, and those of every page. The tree given is changed."""
    first: list[features.Candidate] = []
    if profile == "landing-page" and len(flat((node := remove_empty(remove_visual(landing(root)))).text())) >= 120:
        first.append(features.Candidate("landing", node, 0.9))
    features.clean(root, url)
    if profile == "forum":
        taken: set[int] = set()
        for node in body_of(root).select(".post,[class*=post],[slot=text-body],article,main"):
            inside = node.parent is not None and any(id(a) in taken for a in features._ancestors(node.parent))
            if not inside and not re.search("comment|reply", node.names(), re.I) and len(flat(node.text())) >= 50:
                taken.add(id(node))
                first.append(features.Candidate("generic:forum-main", node, 0.65))
    first += [features.Candidate(f"adapter:{name}", node, 0.95) for name, node, event in adapted(root, url, adapters) if event == "used"]
    return features.candidates(root, first)


def stages(root: Node, url: str = "") -> list[tuple[str, Node, dict]]:
    """The stages of the degrading chain that give something, with what the gate measures: thread, semantic, readability, heuristic."""
    body, out = body_of(root), []
    if (node := thread_body(root)) is not None:
        out.append(("thread", node, features.gate_features(node)))
    for selector in ("article", "main", "[role=main]", "[role=article]"):
        if (node := body.first(selector)) is not None:
            out.append(("semantic", node, features.gate_features(node)))
            break
    if (node := features.readable(body)) is not None:
        out.append(("readability", node, features.gate_features(node)))
    best, _ = features.best_node(body)
    out.append(("heuristic", features.prune(best), features.gate_features(best)))
    return [(s, n, g) for s, n, g in out if len(flat(n.text())) >= 80 or n.first("h1,h2,h3,p,ul,ol,table,pre,blockquote")]


@dataclass(frozen=True)
class Rule:
    """What to do with the elements that a selector finds: remove them, or unwrap them and keep what is inside."""

    name: str
    selector: str
    remove: bool


# The rule table of the boilerplate filter, in the order in which rules apply.
RULES = (
    Rule("navigation", "nav,[role=navigation],.navigation,.nav,.navbar,.menu,.main-menu", False),
    Rule("headers", "header,[role=banner],.header,.page-header,.site-header", False),
    Rule("footers", "footer,[role=contentinfo],.footer,.page-footer,.site-footer", False),
    Rule("sidebars", "aside,[role=complementary],.sidebar,.side-bar,.secondary", False),
    Rule("advertisements", ".ad,.ads,.advertisement,.advert,.sponsored,.promo,.adsbygoogle", True),
    Rule("social", ".social,.share,.sharing,.social-share,.social-media,.follow-us", False),
    Rule("embeds", ".twitter-tweet,.fb-post,.instagram-embed", True),
    Rule("consent", ".cookie,.consent,.privacy-notice,[id*=cookie],[class*=cookie],.gdpr", True),
    Rule("comments", ".comments,.comment-section,#comments,.disqus,.livefyre", True),
    Rule("related", ".related,.suggestions,.recommended,.more-articles,.you-might-like", False),
    Rule("sign-up", ".newsletter,.signup,.subscribe,.email-signup,.cta,.call-to-action", False),
    Rule("search", ".search,.filter,.search-form,.search-box,[role=search]", False),
    Rule("popups", ".popup,.modal,.overlay,.lightbox,[aria-hidden=true]", True),
    Rule("breadcrumbs", ".breadcrumb,.breadcrumbs,[aria-label=breadcrumb]", False),
    Rule("skip links", ".skip-link,.skip-nav,.screen-reader-text,.sr-only,.visually-hidden", False),
)


def preserved(node: Node) -> bool:
    """Whether an element is technical content that no rule may touch."""
    if any(name.startswith(("data-spec", "data-api")) for name in node.attrs) or node.first("pre,code,table[class*=spec]"):
        return True
    heads = node.select("h1,h2,h3,h4")
    return any(re.search("specification|api reference|parameters|data ?sheet|technical", h.text(), re.I) for h in heads)


def apply_rules(root: Node, rules: tuple[Rule, ...] = RULES) -> Node:
    for rule in rules:
        for node in root.select(rule.selector):
            if node.parent is None or preserved(node):
                continue
            if not rule.remove:
                up = node.parent
                at = next(i for i, k in enumerate(up.kids) if k is node)
                for k in node.kids:
                    if isinstance(k, Node):
                        k.parent = up
                up.kids[at : at + 1] = node.kids
                node.parent = None
            else:
                node.remove()
    return root


def readability_check(content: str, original_length: int) -> tuple[int, list[str]]:
    """Score and issues of an extraction's markup."""
    share = len(content) / original_length if original_length else 1.0
    issues = {
        "Content too short": (len(content) < 500, 30),
        "Excessive content reduction": (share < 0.1, 20),
        "Minimal content filtering": (share > 0.8, 10),
        "Cookie banner detected": ("cookie" in content and "accept" in content, 15),
        "Newsletter signup detected": ("subscribe" in content and "newsletter" in content, 10),
        "Poor content structure": (len(re.findall(r"<p[^>]*>", content)) < 2, 15),
    }
    found = [name for name, (holds, _) in issues.items() if holds]
    return max(0, 100 - sum(points for holds, points in issues.values() if holds)), found


def recover(steps: list[tuple[str, Callable[[], str]]]) -> tuple[str, str | None, list[str]]:
    """The result of the first step that works, its name, and the errors of those before it."""
    errors = []
    for name, step in steps:
        try:
            return step(), name, errors
        except (ValueError, KeyError, AttributeError, TypeError, IndexError, RecursionError) as error:
            errors.append(f"{name}: {type(error).__name__}")
    return "", None, errors


def cyrb53(text: str) -> str:
    """A hash of 53 bits of the UTF-16 units in base 36, for identities that were made with it."""
    raw = text.encode("utf-16-le", "surrogatepass")
    units = [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]
    mask = 0xFFFFFFFF
    a, b = 0xDEADBEEF ^ len(units), 0x41C6CE57 ^ len(units)
    for unit in units:
        a, b = (a ^ unit) * 2654435761 & mask, (b ^ unit) * 1597334677 & mask
    a = (a ^ a >> 16) * 2246822507 & mask ^ (b ^ b >> 13) * 3266489909 & mask
    b = (b ^ b >> 16) * 2246822507 & mask ^ (a ^ a >> 13) * 3266489909 & mask
    number, out = 4294967296 * (2097151 & b) + a, ""
    while number:
        number, digit = divmod(number, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + out
    return out or "0"


def tree(html: str | None) -> Node:
    return parse(html)
