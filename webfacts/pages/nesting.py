"""Nested sections of one page: one pass over its container tags with a stack, linear in the page."""

from __future__ import annotations

import re

from webfacts.rules.section_rules import CONTAINERS, LANDMARKS, SECTION_CLASSES, SECTION_DATA, SECTION_IDS, SECTION_ROLES

_TAG = re.compile(rf"<(/?)({'|'.join([*LANDMARKS, *CONTAINERS])}|[a-z]+-[\w-]*)(?=[\s/>])[^>]*>", re.I)
_MARK = re.compile(r"""\s(role|class|id)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
_DATA = re.compile(rf"\s(?:{'|'.join(SECTION_DATA)})\b", re.I)
_CLASS, _ID = re.compile("|".join(SECTION_CLASSES)), re.compile("|".join(SECTION_IDS))
_SHOWS = re.compile(r"<(?:img|video|svg|canvas|input|iframe|button)\b", re.I)
_ANY_TAG = re.compile(r"<[^>]*>")


def marked(opening: str) -> bool:
    """True for an opening tag whose attributes make it a section."""
    for name, double, single in _MARK.findall(opening):
        name, value = name.lower(), (double or single).lower()
        if (name == "role" and value in SECTION_ROLES) or (name == "class" and _CLASS.search(value)) or (name == "id" and _ID.search(value)):
            return True
    return bool(_DATA.search(opening))


class _Open:
    """An open element; ``parts`` collects the pieces of the section it is (strings, or parts of elements that were never closed)."""

    def __init__(self, tag: str, opening: str, section: bool, owner: _Open | None):
        self.tag, self.opening, self.section, self.up = tag, opening, section, owner
        self.parts: list = []
        self.closed = False


def _flat(parts: list) -> str:
    out, stack = [], [iter(parts)]
    while stack:
        for p in stack[-1]:
            if isinstance(p, list):
                stack.append(iter(p))
                break
            out.append(p)
        else:
            stack.pop()
    return "".join(out)


def nested_sections(html: str) -> list[tuple[str, str, str]]:
    """``(tag, opening tag, snippet)`` of each section in page order.

    A section's snippet is its own markup; what lies in a section inside it belongs to that one. A closing tag closes the
    innermost open element of its name; what is still open inside that one was never closed, is no section, and
    leaves its pieces to the section around it. Sections that show nothing are left out.
    """
    page = _Open("", "", True, None)
    stack: list[_Open] = []
    depths: dict[str, list[int]] = {}
    found: list[_Open] = []
    at = 0

    def owner() -> _Open:
        return stack[-1] if stack and stack[-1].section else stack[-1].up if stack else page

    for m in _TAG.finditer(html):
        ends, tag = m.group(1), m.group(2).lower()
        owner().parts.append(html[at : m.start()])
        at = m.end()
        if not ends:
            opened = _Open(tag, m.group(0), tag in LANDMARKS or marked(m.group(0)), owner())
            if opened.section:
                found.append(opened)
            depths.setdefault(tag, []).append(len(stack))
            stack.append(opened)
            owner().parts.append(m.group(0))
        elif depths.get(tag):
            depth = depths[tag][-1]
            while len(stack) > depth + 1:
                left = stack.pop()
                depths[left.tag].pop()
                if left.section:
                    left.up.parts.append(left.parts)
            owner().parts.append(m.group(0))
            depths[tag].pop()
            stack.pop().closed = True
        else:
            owner().parts.append(m.group(0))
    out = []
    for s in found:
        if s.closed:
            snippet = _flat(s.parts)
            if _SHOWS.search(snippet) or _ANY_TAG.sub("", snippet).strip():
                out.append((s.tag, s.opening, snippet))
    return out
