"""A tolerant reader of web pages: block elements as a tree, and the stretches of text inside them."""

from __future__ import annotations

import html
import re

#: Fixed by HTML: elements that are blocks or parts of forms; all others are inline and leave the tree alone.
BLOCKS = (
    "html head title body header footer nav main article aside section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu table caption thead tbody tfoot tr td th "
    "blockquote pre address figure figcaption details summary dialog fieldset legend form label button select option center hgroup"
).split()
#: Elements whose content is no text of the page: code, styles, form fields, drawings and what stands in for media.
_DROPPED = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in "script style noscript template textarea svg iframe canvas audio video".split()}
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag up to its end; nothing is tried twice.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile("[a-z]+")
_TAG = {t: i for i, t in enumerate(BLOCKS)}
#: An opening tag ends open elements of these names, up to a boundary.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "body": ({"head", "title"}, set())}
_NO_PARAGRAPH = set(BLOCKS) - {"label", "button", "select", "option"}
MARK = re.compile(r"\sdata-content=\"([01])\"")


def tokens(source: str):
    """(start, end, closing, name, attributes) of each tag and of each stretch that is no text (name None), in one pass.

    A tag whose quotes don't close ends at the next ">", and from there on quotes aren't looked at. A "<" without a name or a ">" after it is text."""
    at, size, quoted = 0, len(source), True
    while 0 <= (start := source.find("<", at)) < size:
        at = start + 1
        if source.startswith("!--", at):
            end = source.find("-->", at + 3)
            at = size if end < 0 else end + 3
            yield start, at, "", None, ""
            continue
        if at < size and source[at] in "!?":
            if (end := source.find(">", at)) < 0:
                return
            at = end + 1
            yield start, at, "", None, ""
            continue
        if not (tag := _TAG_NAME.match(source, at)):
            continue
        end = rest.end() if quoted and (rest := _REST.match(source, tag.end())) else source.find(">", tag.end()) + 1
        if not end:
            return
        quoted = quoted and rest is not None
        name, attributes = tag[2].lower(), source[tag.end() : end - 1]
        at = end
        if name in _DROPPED and not tag[1]:
            if not (name == "svg" and attributes.endswith("/")):  # alone of these it is empty where its tag ends in "/>"
                close = _DROPPED[name].search(source, end)
                end = close.end() if close else size
                at = size if not close else (source.find(">", end) + 1 or size)
            yield start, at, "", None, ""
            continue
        yield start, at, tag[1], name, attributes


class Page:
    """Nodes in page order (parents first): parent, depth, tag, words of class, id and role, own text and link characters; and the texts as (node, text)."""

    __slots__ = ("depth", "links", "parent", "tag", "texts", "words", "marks")

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.words, self.links, self.marks = [-1], [0], [0], [()], [0], [None]
        self.texts: list[tuple[int, str]] = []
        stack, names, link, run, at = [0], ["html"], 0, [], 0
        unescape = html.unescape

        def flush() -> None:
            if run:
                text = "".join(run)
                run.clear()
                if "&" in text:
                    text = unescape(text)
                if text := " ".join(text.split()):
                    self.texts.append((stack[-1], text))

        for start, end, closing, name, rest in tokens(source):
            if start > at:
                run.append(source[at:start])
                if link:
                    self.links[stack[-1]] += start - at
            at = end
            if name is None:
                continue
            if name not in _TAG:
                if name == "a":
                    link = not closing
                elif name in ("br", "hr", "img", "input", "wbr"):
                    run.append(" " if name != "wbr" else "")
                continue
            flush()
            link = 0
            if closing:
                if name in names:
                    while names.pop() != name:
                        stack.pop()
                    stack.pop()
                    if not stack:
                        stack, names = [0], ["html"]
                continue
            if name == "html":
                self.marks[0] = int(m[1]) if (m := MARK.search(rest)) else self.marks[0]
                continue
            if name in _NO_PARAGRAPH and "p" in names:
                place = len(names) - 1 - names[::-1].index("p")
                del names[place:], stack[place:]
            if name in _ENDS:
                ends, stops = _ENDS[name]
                for place in range(len(names) - 1, 0, -1):
                    if names[place] in stops:
                        break
                    if names[place] in ends:
                        del names[place:], stack[place:]
                        break
            node = len(self.parent)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tag.append(_TAG[name])
            self.words.append(tuple(w for m in _NAMES.finditer(rest) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())) if rest and "=" in rest else ())
            self.links.append(0)
            self.marks.append(int(m[1]) if rest and (m := MARK.search(rest)) else None)
            stack.append(node)
            names.append(name)
        if at < len(source):
            run.append(source[at:])
        flush()
