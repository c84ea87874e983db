"""Trees of damaged XML: what can be read is kept, and what is left open is closed."""

from __future__ import annotations

import re
from collections import Counter
from xml.etree import ElementTree

#: A tag that is whole, in one of its three forms; values of attributes may lack their quotes.
TAG = re.compile(r"<(/?)([A-Za-z_][\w.:-]*)((?:\s+[\w.:-]+(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>/]+))?)*)\s*(/?)>")
CUT_OFF = re.compile(r"</?[A-Za-z_][^<>]*\Z")
ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)'|([^\s\"'<>/]+))")
REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]*));")
#: The five entities of XML, and signs that it does not allow.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
#: Parts that are no elements: how they begin, how they end, and whether what is inside is text.
ASIDES = (("<!--", "-->", False), ("<![CDATA[", "]]>", True), ("<?", "?>", False), ("<!", ">", False))


def plain(text: str) -> str:
    """Text with its references replaced. One that means nothing is left out, and a lone `&` stays."""

    def sign(m: re.Match) -> str:
        decimal, hexadecimal, name = m.groups()
        if name:
            return ENTITIES.get(name, "")
        code = int(decimal) if decimal else int(hexadecimal, 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else ""

    return FORBIDDEN.sub("", REFERENCE.sub(sign, text))


class Tree:
    """Elements that are open, and the tree that grows from them."""

    def __init__(self) -> None:
        self.builder, self.open, self.names, self.begun = ElementTree.TreeBuilder(), [], Counter(), False

    def say(self, text: str) -> None:
        if self.open and text:
            self.builder.data(text)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if self.open or not self.begun:  # what follows the root belongs to no tree
            self.builder.start(name, attributes)
            self.open.append(name)
            self.names[name] += 1
            self.begun = True

    def _close(self) -> str:
        name = self.open.pop()
        self.names[name] -= 1
        self.builder.end(name)
        return name

    def end(self, name: str) -> None:
        """Closes the nearest open element of that name with all that are open in it; an end that nothing began is passed over."""
        if self.names[name]:
            while self._close() != name:
                pass

    def root(self) -> ElementTree.Element | None:
        while self.open:
            self._close()
        return self.builder.close() if self.begun else None


def recovered(xml: str) -> ElementTree.Element | None:
    """The tree of an XML text, however damaged; None without any element. Time is linear in the text.

    Elements left open are closed where the element around them ends, or at the end; ends without a
    beginning are passed over; a `<` that begins no tag is text; a tag or comment that is cut off at the end of the text is dropped.
    Names keep their prefixes.
    """
    tree, at = Tree(), 0
    while at < len(xml):
        mark = xml.find("<", at)
        tree.say(plain(xml[at : mark if mark >= 0 else len(xml)]))
        if mark < 0:
            break
        aside = next((a for a in ASIDES if xml.startswith(a[0], mark)), None)
        if aside:
            begin, end, is_text = aside
            stop = xml.find(end, mark + len(begin))
            if is_text:
                tree.say(FORBIDDEN.sub("", xml[mark + len(begin) : stop if stop >= 0 else len(xml)]))
            if stop < 0:
                break
            at = stop + len(end)
            continue
        tag = TAG.match(xml, mark)
        if tag is None:
            if CUT_OFF.match(xml, mark):
                break
            tree.say("<")
            at = mark + 1
            continue
        closing, name, rest, single = tag.groups()
        if closing:
            tree.end(name)
        else:
            tree.start(name, {k: plain(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(rest)})
            if single:
                tree.end(name)
        at = tag.end()
    return tree.root()
