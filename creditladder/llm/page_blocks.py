"""DOM leaf blocks of a page: the runs of text between block-level tags, each with its ancestors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

# Element names of HTML by what they do to the text around them.
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre
    section select summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object audio video math xmp noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())  # the end of one ends any
CLOSES_P = BLOCK - frozenset("body button caption html iframe option optgroup select td th tr tbody thead tfoot".split())
#: Opening one of the keys ends an open element of its values, looked for up to a limit.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
}

COMMENT = re.compile(r"<!--(?:.*?-->|.*\Z)", re.DOTALL)
TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


class Path:
    """An open element with those around it; blocks share the paths of their common ancestors. As a sequence: the (tag,
    class and id and role) of all of them from the root."""

    __slots__ = ("tag", "marks", "parent", "traits")

    def __init__(self, tag: str, marks: str, parent: Path | None):
        self.tag, self.marks, self.parent, self.traits = tag, marks, parent, None

    def __iter__(self) -> Iterator[tuple[str, str]]:
        above, node = [], self
        while node is not None:
            above.append((node.tag, node.marks))
            node = node.parent
        return reversed(above)

    def __getitem__(self, i):
        return tuple(self)[i]


class Stack:
    """The open elements, with the places of each tag, so that the innermost of some tags is found without a walk."""

    def __init__(self):
        self.paths: list[Path] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, marks: str) -> None:
        place = len(self.paths)
        self.at.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks.append(place)
        self.paths.append(Path(tag, marks, self.paths[-1] if self.paths else None))

    def cut(self, i: int) -> bool:
        """Closes the elements from place i on; was one of them a block?"""
        for path in reversed(self.paths[i:]):
            self.at[path.tag].pop()
        del self.paths[i:]
        held = bool(self.blocks) and self.blocks[-1] >= i
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()
        return held

    def innermost(self, names: Iterable[str]) -> int:
        return max((own[-1] for t in names if (own := self.at.get(t))), default=-1)

    def last(self, names: Iterable[str], limit: Iterable[str] | None = ()) -> int:
        """Place of the innermost element of ``names`` that no element of ``limit`` (None: any block) lies inside of, or -1."""
        i = self.innermost(names)
        border = (self.blocks[-1] if self.blocks else -1) if limit is None else self.innermost(limit)
        return i if i >= border else -1


class Tags:
    """Tags, comments and declarations of a page. A tag ends at the first > outside quotes. One that never ends is
    text; what was read in vain is remembered, so that no part of a page is read again for every < before it."""

    def __init__(self, page: str):
        self.page = page
        self.vain: set[int] = set()
        self.last_end = page.rfind(">")

    def _end(self, at: int) -> int:
        """Place after the > that ends attributes beginning at ``at``, or -1."""
        tried = []
        while at <= self.last_end and at not in self.vain:
            tried.append(at)
            m = QUOTE_OR_END.search(self.page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            closing = self.page.find(m[0], m.end())
            if closing < 0:
                break
            at = closing + 1
        self.vain.update(tried)
        return -1

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag; the name of a comment or declaration is empty."""
        while (at := self.page.find("<", at)) >= 0:
            if self.page.startswith("<!--", at):
                return at, COMMENT.match(self.page, at).end(), "", False, ""
            if self.page.startswith(("<!", "<?"), at):
                if at < self.last_end:
                    return at, self.page.index(">", at) + 1, "", False, ""
            elif m := TAG.match(self.page, at):
                # A quote in a name may also begin the attributes.
                starts = [m.end(), *[i for i in range(m.end() - 1, m.start("name"), -1) if self.page[i] in "\"'"]]
                for k in starts:
                    end = self._end(k)
                    if end >= 0:
                        return at, end, self.page[m.start("name") : k], bool(m["close"]), self.page[k : end - 1]
            at += 1
        return None


def leaf_blocks(page: str) -> list[tuple[str, Path | None, int]]:
    """(text, path of the innermost open element, characters inside links) of every non-empty block in page order.
    Character references are decoded and white space is one blank; comments, scripts, styles and the like are no
    text. Broken markup never fails: unknown closing tags are passed over, unclosed elements end with their parents,
    a tag that never ends is text. Time and memory are in proportion to the page, however deep it nests."""
    blocks: list[tuple[str, Path | None, int]] = []
    stack, tags = Stack(), Tags(page)
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            value = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if value:
                blocks.append((value, stack.paths[-1] if stack.paths else None, linked))
            linked = 0

    def pop_to(i: int) -> None:
        if stack.blocks and stack.blocks[-1] >= i:
            flush()
        stack.cut(i)

    ends: dict[str, re.Pattern] = {}
    endless: set[str] = set()
    at, size = 0, len(page)
    while at < size:
        tag = tags.after(at)
        piece = page[at : tag[0] if tag else size]
        if piece:
            text.append(piece)
            if stack.at.get("a"):
                linked += len(piece)
        if not tag:
            break
        _, at, name, closes, attributes = tag
        if not name:
            continue
        name = name.lower()
        if closes:
            i = stack.last(HEADINGS if name in HEADINGS else (name,), () if name in BLOCK else None)
            if i >= 0:
                pop_to(i)
            continue
        if name in RAW:
            if not attributes.endswith("/") or name in ("script", "style", "textarea", "title"):
                pattern = ends.setdefault(name, re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE))
                end = None if name in endless else pattern.search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else (size if name in ("script", "style", "textarea", "title") else at)
            continue
        if name == "br":
            text.append("\n")
        if name in CLOSES_P and (i := stack.last(("p",), ("button", "td", "th", "caption"))) >= 0:
            pop_to(i)
        if name in IMPLIED and (i := stack.last(*IMPLIED[name])) >= 0:
            pop_to(i)
        if name in BLOCK:
            flush()
        if name not in VOID:
            marks = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)) if attributes else ""
            stack.push(name, marks)
    flush()
    return blocks
