"""Publication dates and bylines of a page. No Spark in here."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pagemill.functions.dom import Node, flat

# Where pages say when they were published, when changed, and by whom.
PUBLISHED = ('meta[property="article:published_time"]', 'meta[property="og:published_time"]', 'meta[name="article:published_time"]', 'meta[name="publishdate"]', 'meta[name="pubdate"]', 'meta[name="date"]', 'meta[itemprop="datePublished"]')
UPDATED = ('meta[property="article:modified_time"]', 'meta[property="og:updated_time"]', 'meta[name="lastmod"]', 'meta[itemprop="dateModified"]')
AUTHORS = ('meta[name="author"]', 'meta[property="article:author"]', 'meta[itemprop="author"]')
TIMES = "time,[datetime],[itemprop=datePublished],[itemprop=dateModified],.dateline,.byline,[class*=timestamp],[class*=publish],[class*=update],[class*=date],[class*=time],[id*=date],[id*=time]"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
ZONES = "utc|gmt|ist|pst|pdt|est|edt|cet|cest|bst"
FORMATS = ("%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b %d %Y", "%d %B %Y %H:%M", "%d %b %Y %H:%M", "%B %d, %Y %H:%M", "%b %d, %Y %H:%M", "%a, %d %b %Y %H:%M:%S")
FRAGMENTS = (
    r"(?:^|[^0-9])(\d{1,2}:\d{2}(?:\s+(?:\([A-Z]{2,6}\)|[A-Z]{2,6}))?\s+[A-Za-z]{3,9}\s+\d{1,2}(?:,\s*\d{2,4})?)",
    r"(?:^|[^0-9])([A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}\s+\d{1,2}:\d{2}(?:\s*[AP]M)?(?:\s*[A-Z]{2,6})?)",
    r"(?:^|[^0-9])(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}\s+\d{1,2}:\d{2}(?:\s*[AP]M)?(?:\s*[A-Z]{2,6})?)",
    r"(?:^|[^0-9])(\d{1,2}:\d{2}(?:\s*[AP]M)?(?:\s+[A-Z]{2,6})?)",
)


def looks_like_timestamp(text: str) -> bool:
    if not 4 <= len(text) <= 80:
        return False
    return bool(re.search(r"\d{4}-\d{2}-\d{2}|\b\d{1,2}:\d{2}\b|\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}\b", text) or re.fullmatch(r"\d{10}|\d{13}", text) or (re.search(rf"\b(?:{MONTHS})[a-z]*\b", text, re.I) and re.search(r"\d", text)))


def fragments(text: str) -> list[str]:
    found = (flat(m[1]) for p in FRAGMENTS for m in re.finditer(p, flat(text), re.I))
    return list(dict.fromkeys(f for f in found if looks_like_timestamp(f)))[:4]


def parse_time(text: str) -> datetime | None:
    """The moment that a text names; without a zone it is taken as UTC."""
    if re.fullmatch(r"\d{10}|\d{13}", text):
        return datetime.fromtimestamp(int(text) / (1000 if len(text) == 13 else 1), timezone.utc)
    try:
        parsed = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        bare = re.sub(rf"\s*\b(?:{ZONES})\b\s*$", "", text, flags=re.I)
        for form in FORMATS:
            try:
                parsed = datetime.strptime(bare, form)
                break
            except ValueError:
                continue
        else:
            return None
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def iso(moment: datetime) -> str:
    return moment.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def score_time(text: str, moment: datetime | None, year: int) -> int:
    """How telling a timestamp is, seen from the given year."""
    lower = text.lower()
    tests = ((r"\b\d{1,2}:\d{2}\b", 30), (rf"[+-]\d{{2}}:?\d{{2}}\b|\b(?:{ZONES})\b", 12), (rf"\b(?:{MONTHS})[a-z]*\b", 10), (r"\b\d{4}\b", 8), (r"\b(?:updated|modified|published|posted)\b", 6))
    score = sum(points for pattern, points in tests if re.search(pattern, lower)) + 4 * (8 <= len(lower) <= 48)
    if moment is not None:
        y = moment.astimezone(timezone.utc).year
        score += 10 + (14 if year - 2 <= y <= year + 1 else -18 if y < year - 10 else 0) - 20 * (y < 1970 or y > year + 2)
    return score


def pick_time(candidates: list[str], year: int) -> tuple[str, str | None] | None:
    """Text and ISO form of the most telling candidate; of equal ones the later."""
    best = None
    for text in dict.fromkeys(flat(c) for c in candidates):
        if text and looks_like_timestamp(text):
            moment = parse_time(text)
            key = (score_time(text, moment, year), moment is not None, moment.timestamp() if moment else len(text))
            if best is None or key > best[0]:
                best = (key, text, iso(moment) if moment else None)
    return best and (best[1], best[2])


def pick_byline(candidates: list[str]) -> str | None:
    for name in dict.fromkeys(flat(c) for c in candidates):
        if 2 <= len(name) <= 80 and not re.fullmatch("staff|news|editorial", name, re.I):
            return re.sub(r"^by\s+", "", name, flags=re.I)
    return None


def _linked_data(root: Node) -> tuple[list[str], list[str], list[str]]:
    published, updated, authors = [], [], []

    def visit(value: object) -> None:
        if isinstance(value, list):
            for v in value:
                visit(v)
        elif isinstance(value, dict):
            for key, v in value.items():
                if key == "datePublished" and isinstance(v, str):
                    published.append(v)
                elif key == "dateModified" and isinstance(v, str):
                    updated.append(v)
                elif key == "author":
                    for a in v if isinstance(v, list) else [v]:
                        name = a if isinstance(a, str) else a.get("name") if isinstance(a, dict) else None
                        if isinstance(name, str):
                            authors.append(name)
                elif isinstance(v, (list, dict)):
                    visit(v)

    for node in root.select('script[type="application/ld+json"]'):
        try:
            visit(json.loads(node.text(True)))
        except ValueError:
            continue  # a page's own broken data says nothing
    return published, updated, authors


def metadata(root: Node, year: int) -> dict[str, str | None]:
    """published, updated (ISO or text) and byline of a page."""
    content = lambda selectors: [flat(n.get("content")) for s in selectors if (n := root.first(s)) is not None and n.get("content")]
    published, updated, authors = content(PUBLISHED), content(UPDATED), content(AUTHORS)
    for node in root.select(TIMES):
        bucket = updated if re.search("modified|updated|update", f"{node.get('itemprop')} {node.get('class')}", re.I) else published
        if node.get("datetime"):
            bucket.append(node.get("datetime"))
        text = flat(node.text())
        bucket += fragments(text) or ([text] if looks_like_timestamp(text) else [])
        if re.search("byline|author", node.get("class"), re.I) and 2 < len(text) <= 80:
            authors.append(re.sub(r"^by\s+", "", text, flags=re.I))
    more = _linked_data(root)
    best = [pick_time([x for x in a + b if len(x) <= 120], year) for a, b in ((published, more[0]), (updated, more[1]))]
    return {"published": best[0] and (best[0][1] or best[0][0]), "updated": best[1] and (best[1][1] or best[1][0]), "byline": pick_byline([x for x in authors + more[2] if len(x) <= 120])}
