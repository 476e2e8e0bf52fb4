"""Markup to Markdown, by preset. No Spark in here."""

from __future__ import annotations

import json
import re

from pagemill.functions.dom import Node, flat

# Names that a platform has for languages.
GITHUB_LANGUAGES = {"js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "sh": "bash", "shell": "bash", "yml": "yaml", "md": "markdown"}
PRESETS = ("standard", "github", "obsidian", "notion", "academic", "minimal")
_SKIP = frozenset("script style noscript template head title".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table ul".split())


def to_markdown(node: Node, preset: str = "standard") -> str:
    """The Markdown of an element and all below."""
    if preset not in PRESETS:
        raise ValueError(f"no such preset: {preset}; there are {', '.join(PRESETS)}")
    text = _blocks(node, preset, 0)
    text = re.sub(r"\n{3,}", "\n\n", text)
    if preset in ("standard", "notion", "academic"):
        text = re.sub(r"(?m)[ \t]+$", "", text)
    if preset == "github":
        text = re.sub(r"(?m)^([ \t]*)-[ \t]*(?=\S)(?!--)", r"\1- ", text)
    if preset == "minimal":
        text = re.sub(r"[*_]{3,}", "**", text)
    return text.strip()


def _blocks(node: Node, preset: str, depth: int) -> str:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = re.sub(r"[ \t\n]+", " ", "".join(line)).strip().replace("\x00", "  \n")
        if text:
            out.append(text)
        line.clear()

    def visit(kid: Node | str) -> None:
        if isinstance(kid, str):
            line.append(kid)
        elif kid.tag in _SKIP:
            pass
        elif kid.tag not in _BLOCK and any(n.tag in _BLOCK for n in kid.walk()):
            for inner in kid.kids:  # an inline element around blocks, as unclosed tags make them
                visit(inner)
        elif kid.tag in _BLOCK:
            flush()
            if text := _block(kid, preset, depth):
                out.append(text)
        else:
            line.append(_inline(kid, preset))

    for kid in node.kids:
        visit(kid)
    flush()
    return "\n\n".join(out)


def _block(node: Node, preset: str, depth: int) -> str:
    tag = node.tag
    if re.fullmatch("h[1-6]", tag):
        text = flat("".join(_inline(k, preset) if isinstance(k, Node) else k for k in node.kids))
        return f"{'#' * int(tag[1])} {text}" if text else ""
    if tag == "hr":
        return "---"
    if tag == "pre":
        return _code(node, preset)
    if tag == "table":
        return _table(node, preset)
    if tag in ("ul", "ol"):
        return _list(node, preset, depth)
    inner = _blocks(node, preset, depth)
    if not inner:
        return ""
    if preset == "github" and (kind := re.search("alert|warning|note|tip", node.get("class"))):
        return f"> [!{kind[0].upper()}]\n" + _quoted(inner)
    if preset == "obsidian" and "highlight" in node.get("class").split():
        return f"=={inner}=="
    return _quoted(inner) if tag == "blockquote" else inner


def _quoted(text: str) -> str:
    return "\n".join(f"> {line}".rstrip() for line in text.split("\n"))


def _code(node: Node, preset: str) -> str:
    text = node.text(True).strip("\n")
    code = node.first("code")
    found = re.search(r"(?:language-|lang-)([\w+#-]+)", f"{code.get('class') if code else ''} {node.get('class')}")
    language = found[1] if found else ""
    if preset == "minimal":
        return "\n".join("    " + line for line in text.split("\n"))
    if preset == "github":
        language = GITHUB_LANGUAGES.get(language.lower(), language)
    fence = "````" if "```" in text else "```"
    return f"{fence}{language}\n{text}\n{fence}"


def _table(node: Node, preset: str) -> str:
    rows = [[flat(c.text()) for c in r.children() if c.tag in ("td", "th")] for r in node.select("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    if any("rowspan" in c.attrs or "colspan" in c.attrs for c in node.select("td,th")):
        return "```json\n" + json.dumps({"headers": rows[0], "rows": rows[1:]}, indent=2, ensure_ascii=False) + "\n```"
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def _list(node: Node, preset: str, depth: int) -> str:
    out, number = [], int(node.get("start")) if node.get("start").isdigit() else 1
    for item in node.children():
        if item.tag in _SKIP:
            continue
        mark = f"{number}." if node.tag == "ol" else "-"
        text = _blocks(item, preset, depth + 1) if item.tag not in ("ul", "ol") else _list(item, preset, depth + 1)
        if text:
            pad = " " * (len(mark) + 1)
            out.append(f"{mark} " + re.sub(r"\n\n(?=[ \t]*(?:-|\d+\.) )", "\n", text).replace("\n", "\n" + pad).replace("\n" + pad + "\n", "\n\n"))
            number += 1
    return "\n".join(out)


def _inline(node: Node, preset: str) -> str:
    tag = node.tag
    if tag == "br":
        return "\x00"
    if tag == "img":
        src, alt = node.get("src"), node.get("alt")
        if not src or src.lower().startswith("data:"):
            return ""
        if preset == "obsidian":
            return f"![[{src}|{alt}]]"
        title = f' "{node.get("title")}"' if node.get("title") else ""
        return f"![{alt}]({src}{title})"
    if tag in _SKIP:
        return ""
    if tag in ("code", "kbd", "samp"):
        text = node.text(True)
        return f"`{text}`" if text.strip() else text
    text = "".join(k if isinstance(k, str) else _inline(k, preset) for k in node.kids)
    bare = text.strip(" \t\r\n\x00")
    if not bare:
        return text
    around = lambda mark: text.replace(bare, f"{mark}{bare}{mark}", 1)
    if tag in ("b", "strong"):
        return around("**")
    if tag in ("i", "em"):
        return around("_")
    if tag in ("del", "s", "strike") and preset != "minimal":
        return around("~~")
    if tag == "mark" and preset == "obsidian":
        return around("==")
    if tag == "a" and node.get("href"):
        href = node.get("href")
        if preset == "obsidian" and href.startswith(("#", "/")):
            return f"[[{bare}]]"
        return f"[{flat(bare)}]({href})"
    return text


def simple_markdown(node: Node) -> str:
    """The least converter: three levels of headings, paragraphs, code and flat lists."""
    out = []
    for n in node.select("h1,h2,h3,p,pre,li"):
        text = n.text(True).strip("\n") if n.tag == "pre" else flat(n.text())
        if text:
            out.append({"h1": f"# {text}", "h2": f"## {text}", "h3": f"### {text}", "pre": f"```\n{text}\n```", "li": f"- {text}"}.get(n.tag, text))
    return "\n\n".join(out)
