"""Discussion threads in JSON listings: flattened to rows, rendered to markup. No Spark in here."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from html import escape

#: Comments that a thread keeps, and the deepest reply that it keeps.
MOST, DEEPEST = 80, 8


def tidy(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text.replace("\r", "\n")))
    return re.sub(r"[ \t]{2,}", " ", text).strip()


def _children(listing: object) -> list:
    data = listing.get("data") if isinstance(listing, dict) else None
    found = data.get("children") if isinstance(data, dict) else None
    return found if isinstance(found, list) else []


def _body(data: dict, plain: str, markup: str) -> str:
    if isinstance(data.get(plain), str):
        return tidy(data[plain])
    return tidy(re.sub(r"<[^>]+>", " ", data[markup])) if isinstance(data.get(markup), str) else ""


def _line(data: dict) -> tuple[str | None, int | None, str | None]:
    score, at = data.get("score"), data.get("created_utc")
    number = isinstance(score, (int, float)) and not isinstance(score, bool)
    moment = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z") if isinstance(at, (int, float)) and not isinstance(at, bool) else None
    return data.get("author") if isinstance(data.get("author"), str) else None, int(score) if number else None, moment


def flatten(payload: str | None) -> tuple[dict | None, list[dict], int]:
    """The post, its comments in reading order with depth, path and parent, and the number of comments left out."""
    try:
        loaded = json.loads(payload or "null")
    except ValueError:
        return None, [], 0
    post: dict | None = None
    rows: list[dict] = []
    omitted = 0

    def count(child: object) -> int:
        if not (isinstance(child, dict) and child.get("kind") == "t1" and isinstance(child.get("data"), dict)):
            return 0
        return 1 + sum(map(count, _children(child["data"].get("replies"))))

    def visit(child: object, depth: int, path: list[int], parent: str | None) -> None:
        nonlocal omitted
        if len(rows) >= MOST or depth > DEEPEST:
            omitted += count(child)
            return
        if not (isinstance(child, dict) and child.get("kind") == "t1" and isinstance(child.get("data"), dict)):
            return
        data = child["data"]
        if not (body := _body(data, "body", "body_html")):
            return
        author, score, at = _line(data)
        name = data.get("id") if isinstance(data.get("id"), str) else None
        rows.append({"comment_id": name, "parent_id": parent, "depth": depth, "path": path, "author": author, "score": score, "created_at": at, "body": body, "is_auto_summary": "tl;dr of the discussion generated automatically" in body.lower(), "is_bot_like": bool(author and re.search("bot$", author, re.I))})
        for i, reply in enumerate(_children(data.get("replies"))):
            visit(reply, depth + 1, [*path, i], name)

    top = 0
    for listing in loaded if isinstance(loaded, list) else [loaded]:
        for child in _children(listing):
            data = child.get("data") if isinstance(child, dict) else None
            if not isinstance(data, dict):
                continue
            if child.get("kind") == "t3" or (not child.get("kind") and isinstance(data.get("selftext"), str)):
                url = data.get("url_overridden_by_dest") or data.get("url")
                author, score, at = _line(data)
                post = {"id": data.get("id"), "title": str(data.get("title") or ""), "author": author, "score": score, "created_at": at, "url": url if isinstance(url, str) and url.startswith(("http://", "https://")) else None, "body": _body(data, "selftext", "selftext_html")}
            elif child.get("kind") == "t1" and post is not None:
                visit(child, 0, [top], None)
                top += 1
    return post, rows if post else [], omitted


def _inline(text: str) -> str:
    parts = re.split(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", text)
    return "".join(escape(p) if i % 3 == 0 else f'<a href="{escape(parts[i + 1])}">{escape(p)}</a>' for i, p in enumerate(parts) if i % 3 != 2)


def _paragraphs(text: str) -> Iterator[str]:
    for block in filter(None, map(tidy, re.split(r"\n{2,}", text))):
        items = re.split(r"(?:^|\s)(\d+)\.\s+", block)
        if len(items) >= 5 and items[1] == "1":
            if items[0].strip():
                yield f"<p>{_inline(items[0].strip())}</p>"
            yield "<ol>" + "".join(f"<li>{_inline(x.strip())}</li>" for x in items[2::2] if x.strip()) + "</ol>"
        else:
            yield f"<p>{_inline(block)}</p>"


def render(post: dict, rows: list[dict]) -> str:
    """A thread as markup: headings by depth, quotes from the fifth level on."""
    out = ["<article>"]
    if post["title"].strip():
        out.append(f"<h1>{escape(post['title'].strip())}</h1>")
    out += _paragraphs(post["body"])
    if post["url"]:
        out.append(f'<p><a href="{escape(post["url"])}">{escape(post["url"])}</a></p>')
    if rows:
        out.append("<section><h2>Comments</h2>")
    for row in rows:
        name = f"u/{row['author']}" if row["author"] else "Unknown redditor"
        points = None if row["score"] is None else f"{row['score']} {'point' if row['score'] == 1 else 'points'}"
        head = "Reddit summary · generated automatically" if row["is_auto_summary"] else " · ".join(filter(None, [f"Reply from {name}" if row["depth"] else name, points, row["created_at"]]))
        body = "\n".join(_paragraphs(row["body"]))
        out.append(f"<blockquote><p><strong>{escape(head)}</strong></p>{body}</blockquote>" if row["depth"] >= 4 else f"<h{3 + row['depth']}>{escape(head)}</h{3 + row['depth']}>{body}")
    return "\n".join([*out, "</section></article>" if rows else "</article>"])
