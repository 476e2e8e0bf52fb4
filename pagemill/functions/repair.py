"""Markdown passes that carry state from line to line. No Spark in here."""

from __future__ import annotations

import re
from collections.abc import Callable

from pagemill.functions import markdown as M
from pagemill.functions.text import ENTITIES, WIDE_SPACES, ZERO_WIDTH

_FENCE = re.compile(r"^\s*```")
# Commands that begin a line of shell, and words that name interface chrome in a code block.
COMMANDS = frozenset("apt apt-get bash brew bundle cargo cat cd chmod composer conda cp curl deno docker echo export gh git go gradle helm java kubectl ls make mkdir mv mvn node npm npx pip pip3 pnpm poetry python python3 rm ruby rustup sh ssh sudo tar terraform touch uv vim wget yarn".split())
UI_BLOCK = ("donate|create account|log in|privacy policy|about wikipedia", "cookie settings|accept all .*cookies?|tracking cookies?", "subscribe|newsletter|join waitlist|related links", "front page of the internet|limit my search|advanced search", r"raw copy|copy-paste|raw input|selecting main content|contents\s*\[hide]|from wikipedia")
PROGRAM = (r"\b(import|export|function|const|let|var|class|interface|type)\b", r"\b(fetch|curl|npm|pnpm|yarn|pip|python|node|typescript|javascript)\b", r"\b(insert\s+into|delete\s+from|create\s+table)\b", r"[{}`$]|=>")


def _segments(md: str) -> list[tuple[bool, list[str]]]:
    """Lines in stretches of prose (False) and code with its fence lines (True)."""
    out: list[tuple[bool, list[str]]] = [(False, [])]
    for line in md.split("\n"):
        if _FENCE.match(line):
            if out[-1][0]:
                out[-1][1].append(line)
                out.append((False, []))
            else:
                out.append((True, [line]))
        else:
            out[-1][1].append(line)
    return [(code, lines) for code, lines in out if lines]


def on_prose(md: str, change: Callable[[list[str]], list[str]]) -> str:
    return "\n".join(line for code, lines in _segments(md) for line in (lines if code else change(lines)))


def _pattern(java: str) -> re.Pattern:
    """A pattern of the column functions as they read it: classes are of ASCII, and the end may have a line end behind it."""
    return re.compile(java.replace("$", r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"), re.A)


_START_SHORT, _START_STRONG, _START_EXACT, _START_TRIMMED = (_pattern(M.at_start(p)) for p in (M.UI_SHORT, M.UI_STRONG, M.UI_EXACT, M.UI_TRIMMED))
_ANY_SHORT, _ANY_STRONG, _CHIP = _pattern(M.anywhere(M.UI_SHORT)), _pattern(M.anywhere(M.UI_STRONG)), _pattern(M.UI_CHIP)
_LISTED, _TITLE, _BULLET, _NUMBER = (re.compile(p, re.A) for p in (r"(?:[-*+]|\d+\.)\s", r"#{1,6}\s", r"[-*+]\s+", r"\d+\.\s+"))
_UNEVEN = re.compile(r"\s\s|[\t\n\x0b\f\r]", re.A)
_SPACES = str.maketrans(dict.fromkeys(ZERO_WIDTH, "") | dict.fromkeys(WIDE_SPACES, " "))


def normal_line(line: str) -> str:
    """A line for comparison: no comments, no CDATA, one kind of space."""
    if "<!" in line or "-->" in line:
        line = re.sub(r"(?is)<!\[cdata\[.*?\]\]>", " ", re.sub(r"(?s)<!--.*?-->", " ", line)).replace("-->", " ")
    if not line.isascii():
        line = line.translate(_SPACES)
    return re.sub(r"\s+", " ", line, flags=re.A).strip(" ") if _UNEVEN.search(line) else line.strip(" ")


def is_ui_noise(line: str) -> bool:
    """The same as the column function of this name, for use inside an Arrow pass."""
    trimmed = line.strip(" ")
    plain = normal_line(line).lower()
    if not plain or _TITLE.match(trimmed):
        return False
    brief = len(plain) <= 200
    if _START_STRONG.match(plain) or "data:image/" in plain or (brief and _START_SHORT.match(plain)):
        return True
    if any(w in plain for w in M.UI_WORDS) and ((brief and _ANY_SHORT.search(plain)) or _ANY_STRONG.search(plain)):
        return True
    if _START_EXACT.match(trimmed) or _START_TRIMMED.match(trimmed) or _CHIP.match(trimmed) or any(w in trimmed.lower() for w in M.VECTOR_WORDS):
        return True
    if not _LISTED.match(trimmed):
        return False
    bare = _NUMBER.sub("", _BULLET.sub("", trimmed, count=1), count=1) if _BULLET.match(trimmed) else _NUMBER.sub("", trimmed, count=1)
    return bool(_START_EXACT.match(bare.strip(" ")) or _CHIP.match(bare.strip(" ")))


def strip_ui_noise(md: str) -> str:
    """The text without interface chrome between its code fences."""
    parts, fences = re.split(M.FENCE, md), re.findall(M.FENCE, md)
    kept = ["\n".join(x for x in part.split("\n") if not is_ui_noise(x)) if i % 2 == 0 else part for i, part in enumerate(parts)]
    return "".join(part + fence for part, fence in zip(kept, [*fences, ""], strict=True))


def normalize_headings(md: str) -> str:
    """Broken headings joined, no level skipped, early second titles one level down, blank lines around."""
    state = {"titled": False, "locked": False, "level": 0}

    def change(lines: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(lines):
            m = re.match(r"^(#{1,6})\s*(\S.*)$", lines[i].strip())
            if not m:
                out.append(lines[i])
                i += 1
                continue
            level, text, step = len(m[1]), m[2].strip(), 1
            after = i + 2 if i + 2 < len(lines) and not lines[i + 1].strip() else i + 1
            tail = lines[after].strip() if after < len(lines) else ""
            plain = tail and len(tail) <= 48 and not re.match(r"^(?:#{1,6}\s*\S|(?:>|-|\*|\d+\.)\s)", tail)
            if plain and (re.search("[,:—–-]$", text) or tail.startswith(("&", "and "))):
                text, step = f"{text} {tail}", after - i + 1
            if level == 1 and state["titled"] and not state["locked"]:
                level = 2
            elif level == 1:
                state["titled"] = True
            elif state["titled"]:
                state["locked"] = True
            if state["level"]:
                level = min(level, state["level"] + 1)
            state["level"] = level
            if out and out[-1].strip():
                out.append("")
            out.append(f"{'#' * level} {text}")
            i += step
            if i < len(lines) and lines[i].strip():
                out.append("")
        return out

    return on_prose(md, change)


def _is_item(line: str) -> bool:
    t = line.strip()
    return 6 <= len(t) <= 64 and 2 <= len(t.split()) <= 10 and not re.match(r"^(?:>|#{1,6}\s|[-*+]\s|\d+\.\s)", t) and t[-1] not in ".!?;:"


def bulletize(md: str) -> str:
    """Three or more short lines with blank lines between them as a list."""

    def change(lines: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(lines):
            items, at = [], i
            while at < len(lines) and _is_item(lines[at]):
                items.append(lines[at].strip())
                blank = at + 1
                while blank < len(lines) and not lines[blank].strip():
                    blank += 1
                if blank == at + 1:
                    at = blank
                    break
                at = blank
            if len(items) >= 3:
                if out and out[-1].strip():
                    out.append("")
                out += [f"- {x}" for x in items] + [""]
                i = at
            else:
                out.append(lines[i])
                i += 1
        return out

    return on_prose(md, change)


def decode(text: str) -> str:
    for escaped, plain in ENTITIES:
        text = text.replace(escaped, plain)
    return text


def fence_escaped_html(md: str, reach: int = 60) -> str:
    """Escaped markup that opens and closes on lines of its own, decoded and in a fence."""

    def change(lines: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(lines):
            m = re.match(r"^&lt;([a-z0-9]+)(?:\s[^&]*)?&gt;$", lines[i].strip(), re.I)
            end = next((j for j in range(i + 1, min(len(lines), i + reach)) if lines[j].strip().lower() == f"&lt;/{m[1].lower()}&gt;"), None) if m else None
            if end is None:
                out.append(lines[i])
                i += 1
            else:
                out += ["```html", *"\n".join(decode(x).replace("\xa0", " ") for x in lines[i : end + 1]).strip("\n").split("\n"), "```"]
                i = end + 1
        return out

    return on_prose(md, change)


def repair_fences(md: str) -> str:
    """Fences on lines of their own, glued ones split, markup samples closed before prose, and no fence left open."""
    out: list[str] = []
    queue = md.split("\n")[::-1]
    language: str | None = None
    closed_tag = False
    while queue:
        line = queue.pop()
        bare = line.strip()
        if bare.startswith("```"):
            glued = re.match(r"^```\s*(<.*)$", bare)
            if language is None and glued:
                out.append("```html")
                language, closed_tag = "html", False
                queue.append(glued[1])
                continue
            language = bare[3:].strip().lower() if language is None else None
            closed_tag = False
            out.append(line)
            continue
        if language is not None and "```" in line:
            before, _, after = line.partition("```")
            out += [before, "```"]
            language = None
            if after.strip():
                queue.append(after.lstrip())
            continue
        if language == "html" and closed_tag and re.match(r"^(?:#{1,6}\s|>|[-*+]\s|\d+\.\s)", bare):
            out += ["```", ""]
            language = None
        closed_tag = bool(re.match(r"^</[a-z0-9:-]+>\s*$", bare, re.I)) or (closed_tag and not bare)
        out.append(line)
    if language is not None:
        out.append("```")
    return "\n".join(out)


def strip_ui_code(md: str) -> str:
    """The text without code blocks that hold interface chrome and no program."""
    parts: list[str] = []
    for code, lines in _segments(md):
        body = " ".join(lines[1:-1] if code else lines).lower()
        signals = sum(bool(re.search(p, body)) for p in UI_BLOCK)
        programs = sum(bool(re.search(p, body)) for p in PROGRAM)
        label = next((x for x in reversed(parts) if x.strip()), "").strip().lower()
        labelled = bool(re.match("raw (?:input|copy|source)", label))
        if code and len(body) >= 20 and not programs and (signals >= 2 or (signals and labelled)):
            continue
        parts += lines
    return "\n".join(parts)


def skip_prelude(md: str, title: str) -> str:
    """The text without skip links that lead to its own title."""
    plain = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", s.lower())).strip()
    out: list[str] = []
    above, dropped = "", False
    for line in md.split("\n"):
        bare = line.strip()
        if dropped and (not bare or re.fullmatch("-{3,}", bare)):
            dropped = not bare
            continue
        dropped = False
        if bare.lower().startswith("[skip to main content]("):
            rest = plain(bare.partition(")")[2])
            if not rest or rest in (plain(title), plain(above)):
                dropped = True
                continue
        if bare.startswith("# "):
            above = bare[2:]
        out.append(line)
    return "\n".join(out)


def looks_like_command(token: str) -> bool:
    return token in COMMANDS or bool(re.fullmatch(r"\./[\w./-]+", token))


def brace_balance(line: str) -> int:
    """Open less closed braces and brackets outside of strings."""
    bare = re.sub(r'"(?:\\.|[^"\\])*"', "", line)
    return sum(bare.count(c) for c in "{[") - sum(bare.count(c) for c in "}]")


def technical_blocks(md: str) -> str:
    """Shell lines, JSON objects and TOML tables that stand bare in prose, in fences."""

    def change(lines: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(lines):
            bare = lines[i].strip()
            end, language = i, ""
            words = re.sub(r"^\$ ", "", bare).split()
            if bare.startswith("$ ") and words or (len(words) >= 2 and looks_like_command(words[0]) and re.match(r"^[a-z@./-][\w@./:=-]*$", words[1]) and not bare.endswith((".", ":")) and len(words) <= 12):
                language = "bash"
                while end < len(lines) and (x := lines[end].strip()) and (x.startswith("$ ") or looks_like_command(x.split()[0])):
                    end += 1
            elif bare in ("{", "[") or re.match(r'^\{\s*"', bare):
                depth = 0
                for j in range(i, min(len(lines), i + 200)):
                    depth += brace_balance(lines[j])
                    if depth <= 0:
                        end, language = j + 1, "json"
                        break
            elif re.fullmatch(r"\[\[?[\w.-]+\]?\]", bare) and i + 1 < len(lines) and re.match(r"^[\w.-]+\s*=", lines[i + 1].strip()):
                language, end = "toml", i + 1
                while end < len(lines) and re.match(r"^(?:[\w.-]+\s*=|\[\[?[\w.-]+\]?\]$)", lines[end].strip()):
                    end += 1
            if language and end > i:
                out += [f"```{language}", *(re.sub(r"^\$ ", "", x.strip()) if language == "bash" else x for x in lines[i:end]), "```"]
                i = end
            else:
                out.append(lines[i])
                i += 1
        return out

    return on_prose(md, change)


def code_tables(md: str) -> str:
    """Pipe tables whose first cells are line numbers or prompts, as code."""

    def change(lines: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(lines):
            end = i
            while end < len(lines) and lines[end].strip().startswith("|"):
                end += 1
            cells = [[c.strip() for c in x.strip().strip("|").split("|", 1)] for x in lines[i:end]]
            cells = [c for c in cells if not re.fullmatch(r":?-{3,}:?", c[0]) and any(c)]
            if len(cells) >= 1 and all(len(c) == 2 and re.fullmatch(r"\d+|\$", c[0]) for c in cells):
                out += ["```", *(re.sub(r"^`|`$", "", c[1]) for c in cells), "```"]
                i = end
            else:
                out += lines[i : max(end, i + 1)]
                i = max(end, i + 1)
        return out

    return on_prose(md, change)


def dedupe_code(md: str) -> str:
    """The text without code blocks that repeat the code block before them, nothing but blank lines between."""
    out: list[str] = []
    last, gap = None, True
    for code, lines in _segments(md):
        if code:
            key = [x.strip() for x in lines[1:-1] if x.strip()]
            if key and key == last and gap:
                continue
            last, gap = key, True
        else:
            gap = gap and not any(x.strip() for x in lines)
        out += lines
    return "\n".join(out)


def misfenced_headings(md: str) -> str:
    """Fences around nothing but a heading, taken off."""
    out: list[str] = []
    for code, lines in _segments(md):
        body = [x for x in lines[1:-1] if x.strip()]
        out += body if code and len(body) == 1 and re.match(r"^#{1,6}\s+\S", body[0].strip()) and not lines[0].strip()[3:] else lines
    return "\n".join(out)


def chrome_lines(md: str) -> str:
    """The text without controls of interactive demos and listings."""
    drop = re.compile(r"^\s*(?:[-*]\s+)?(?:copy|copied!?|run|reset|try it|open in (?:playground|editor|codesandbox)|expand|collapse|permalink|embed|reply|give award|\d+ comments?|sort by:.*)\s*$", re.I)
    return on_prose(md, lambda lines: [x for x in lines if not drop.match(x)])


def tighten(md: str) -> str:
    """The passes that bring code back into shape, in their order."""
    for one in (code_tables, dedupe_code, misfenced_headings, chrome_lines):
        md = one(md)
    return re.sub(r"(?m)\b([A-Za-z_]\w*) \(\)", r"\1()", md)
