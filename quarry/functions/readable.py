"""Main-content selection: paragraphs score their ancestors, and the best one's neighbourhood is the article."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

from quarry.functions.dom import SCRIPTS, Node, Page, parse
from quarry.functions.text import NEGATIVE, POSITIVE
from quarry.schema import NO_AUTHOR, NO_TITLE

# Fixed values.
UNLIKELY = re.compile("combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter", re.I)
MAYBE = re.compile("and|article|body|column|main|shadow", re.I)
VIDEO = re.compile(r"https?://(www\.)?(youtube|vimeo)\.com", re.I)
BLOCK_PREFIXES = ("a", "blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul")
PAUSES = re.compile(r"[,.，。；;：:！!？?、]")
NOISE = re.compile(r"(?i)^(width|height|style|[-a-z]*color|background[-a-z]*|on.*)$")
PRIORS = {"div": 5, "article": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form aside".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th header footer nav".split(), -5)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BOXES = ("table", "ul", "div", "aside", "header", "footer", "section")
MIN_TEXT, RETRY = 25, 250
#: Ids and classes of elements that may hold a page's short title.
TITLE_IDS = ("title", "head", "heading")
TITLE_CLASSES = ("pageTitle", "news_title", "title", "head", "heading", "contentheading", "small_header_red")
DELIMITERS = (" | ", " - ", " :: ", " / ")
TITLE_SIGNS = (("—", "-"), ("–", "-"), ("&mdash;", "-"), ("&ndash;", "-"), ("\xa0", " "), ("«", '"'), ("»", '"'), ("&quot;", '"'))
#: Attributes with addresses.
ADDRESSES = ("href", "src", "cite", "longdesc", "usemap", "background", "action", "data", "poster")

_POSITIVE, _NEGATIVE = re.compile(POSITIVE, re.I), re.compile(NEGATIVE, re.I)


def keywords(words: str | tuple[str, ...] | re.Pattern | None) -> re.Pattern | None:
    """A pattern that is given, or one of words as they stand: a tuple's, or those between a string's commas."""
    if not words or isinstance(words, re.Pattern):
        return words or None
    return re.compile("|".join(re.escape(w.strip()) for w in (words.split(",") if isinstance(words, str) else words)))


@dataclass(frozen=True)
class Readability:
    """How the main content is chosen: names that speak for or against an element, its least text, and the length under which a second, milder try is made."""

    positive: str | tuple[str, ...] | None = None
    negative: str | tuple[str, ...] | None = None
    min_text: int = MIN_TEXT
    retry: int = RETRY
    #: Addresses become absolute against it, else against the page's own base.
    url: str | None = None


class _Weigher:
    def __init__(self, how: Readability):
        self.how = how
        self.for_, self.against = keywords(how.positive), keywords(how.negative)

    def __call__(self, n: Node) -> int:
        weight = 0
        if not (n.attrs or self.for_ or self.against):
            return weight
        for v in (n.attrs.get("class"), n.attrs.get("id")):
            if v:
                weight += sum(25 * bool(p.search(v)) for p in (_POSITIVE, self.for_) if p) - sum(25 * bool(p.search(v)) for p in (_NEGATIVE, self.against) if p)
        named = "tag-" + n.tag
        return weight + 25 * bool(self.for_ and self.for_.match(named)) - 25 * bool(self.against and self.against.match(named))


def _size(s: str) -> int:
    return len(" ".join(s.split()))


def link_density(n: Node) -> float:
    links = sum(_size(a.text()) for a in n.all("a"))
    return links / max(_size(n.text()), 1) if links else 0.0


def _prune_unlikely(root: Node) -> bool:
    """Whether there were some."""
    found = False
    for n in root.all():
        if not n.attrs or n.tag == "body":
            continue
        named = n.attrs.get("class", "") + " " + n.attrs.get("id", "")
        if len(named) > 1 and UNLIKELY.search(named) and not MAYBE.search(named):
            n.drop()
            found = True
    return found


def _paragraphs_from_divs(root: Page) -> None:
    divs = root.all("div")
    if divs:
        root.tags.add("p")
    for div in divs:
        if not any(n.tag.startswith(BLOCK_PREFIXES) for n in div.all()):
            div.tag = "p"
            continue
        kids = []
        for k in div.kids:
            if isinstance(k, str) and k.strip():
                k = Node("p", kids=[k])
            if not (isinstance(k, Node) and k.tag == "br"):
                kids.append(k)
        div.kids = []
        for k in kids:
            div.add(k)


def _scores(root: Node, class_weight: _Weigher) -> dict[Node, float]:
    found: dict[Node, float] = {}
    for n in root.all("p", "pre", "td"):
        inner = " ".join(n.text().split())
        if len(inner) < class_weight.how.min_text:
            continue
        points = len(PAUSES.split(inner)) + min(len(inner) / 100, 3)
        up, share = n, 1
        while up is not None:
            if up not in found:
                found[up] = class_weight(up) + PRIORS.get(up.tag, 0)
            found[up] += points / share
            up, share = up.parent, share + 1
    linked: set[Node] = set()
    for n in root.all("a"):
        while (n := n.parent) is not None and n not in linked:
            linked.add(n)
    return {n: s * (1 - link_density(n)) if n in linked else s for n, s in found.items()}


def _article(scores: dict[Node, float]) -> Node:
    best = max(scores, key=scores.get)
    up = best.parent
    for wider in ((up.parent if up is not None else None), up):
        if wider is not None and wider in scores:
            best = wider
            break
    out, least = Node("div"), 0.2 * scores[best]
    if best.parent is None:
        out.add(best)
        return out
    taking = False
    for k in list(best.parent.kids):
        if isinstance(k, Node):
            taking = k is best or scores.get(k, least - 1) >= least or (k.tag == "p" and _good_paragraph(k))
        if taking:
            out.add(k)
    return out


def _good_paragraph(p: Node) -> bool:
    start, links = p.first_text(), link_density(p)
    if len(start) > 80:
        return links < 0.25
    return links == 0 and bool(re.search(r"\.( |$)", start))


def _worth_keeping(n: Node, scores: dict[Node, float], class_weight: _Weigher) -> bool:
    weight = class_weight(n)
    if weight + scores.get(n, 0) < 0:
        return False
    text = n.text()
    if text.count(",") >= 10:
        return True
    count = dict.fromkeys(("p", "img", "li", "a", "embed", "input"), 0)
    for d in n.all(*count):
        count[d.tag] += not (d.tag == "input" and d.attrs.get("type") == "hidden")
    size, links = _size(text), link_density(n)
    crowded = (count["p"] and count["img"] > 1 + 1.3 * count["p"]) or (count["li"] - 100 > count["p"] and n.tag != "ul") or count["input"] > count["p"] / 3
    short = size < class_weight.how.min_text and not 1 <= count["img"] <= 2
    linked = links > (0.5 if weight >= 25 else 0.2)
    embeds = (count["embed"] == 1 and size < 75) or count["embed"] > 1
    if crowded or short or linked or embeds:
        return False
    return size > 0 or _between_long_texts(n)


def _between_long_texts(n: Node) -> bool:
    around = n.parent.nodes() if n.parent is not None else [n]
    at = next(i for i, k in enumerate(around) if k is n)
    near = (next((s for k in side if (s := _size(k.text()))), 0) for side in (around[at + 1 :], around[:at][::-1]))
    return sum(near) > 1000


def _sanitize(article: Node, scores: dict[Node, float], class_weight: _Weigher) -> None:
    found = article.all(*HEADINGS, "form", "textarea", "iframe", *BOXES)
    if any(n.tag not in BOXES for n in found):
        for h in article.all(*HEADINGS):
            if class_weight(h) < 0 or link_density(h) > 0.33:
                h.drop()
        for n in article.all("form", "textarea"):
            n.drop()
        for n in article.all("iframe"):
            if VIDEO.search(n.attrs.get("src", "")):
                n.kids = ["VIDEO"]
            else:
                n.drop()
        found = article.all(*BOXES)
    allowed: set[Node] = set()
    for n in reversed(found):
        if n in allowed:
            continue
        if not _worth_keeping(n, scores, class_weight):
            n.drop()
        elif not n.text().strip():
            allowed.update(n.all("table", "ul", "div", "section"))


def _clean(n: Node) -> Node:
    for x in [n, *n.all()]:
        if x.attrs:
            x.attrs = {k: v for k, v in x.attrs.items() if not NOISE.match(k)}
    return n


def absolute(root: Node, url: str | None = None) -> Node:
    """The tree with its addresses resolved against the URL and the page's base element, which goes; an address that can't be is left out."""
    found = next((n for n in root.all("base") if n.attrs.get("href")), None)
    base = _joined(url or "", found.attrs["href"].strip()) if found is not None else url
    if found is not None:
        found.drop()
    if base:
        for n in root.all():
            for k in ADDRESSES:
                if k in n.attrs:
                    to = _joined(base, n.attrs[k].strip())
                    if to is None:
                        del n.attrs[k]
                    else:
                        n.attrs[k] = to
    return root


def _joined(base: str, to: str) -> str | None:
    try:
        return urljoin(base, to)
    except ValueError:
        return None


def read(html: str | Node | None, how: Readability) -> Page:
    """The tree that content is chosen from, of a page or of a tree's markup: without scripts and styles, with absolute addresses."""
    return absolute(parse(html, SCRIPTS), how.url)


def summary(html: str | Node | None, how: Readability | None = None) -> Node:
    """The article of a page, which stays as it is if it is a tree: first without nodes of unlikely names, and with them if that leaves too little; without scored paragraphs the body."""
    weigh = _Weigher(how or Readability())
    for ruthless in (True, False):
        root = read(html, weigh.how)
        body = next(iter(root.all("body")), root)
        if body is not root:
            body.attrs["id"] = "readabilityBody"
        # without any the second try would be this one again
        ruthless = ruthless and _prune_unlikely(root)
        _paragraphs_from_divs(root)
        scores = _scores(root, weigh)
        if not scores and ruthless:
            continue
        article = _article(scores) if scores else body
        _sanitize(article, scores, weigh)
        _clean(article)
        if not ruthless or sum(map(len, article.strings())) >= weigh.how.retry or len(article.html()) >= weigh.how.retry:
            return article
    return article


def normal_title(text: str) -> str:
    text = " ".join(text.split())
    for sign, plain in TITLE_SIGNS:
        text = text.replace(sign, plain)
    return text


def title(root: Node) -> str:
    """The text of the title element before any element in it, spaces and signs made plain."""
    found = next(iter(root.all("title")), None)
    text = found.first_text() if found is not None else ""
    return normal_title(text) if text else NO_TITLE


def author(root: Node) -> str:
    found = next((n for n in root.all("meta") if n.attrs.get("name") == "author"), None)
    return (found.attrs.get("content") if found is not None else "") or NO_AUTHOR


def short_title(root: Node) -> str:
    """The longest heading of at least two words and 15 characters that stands in the title; else what stands before or behind a delimiter, if it has four words; the whole title where that has not 16 to 149 characters."""
    whole = title(root)
    if whole == NO_TITLE:
        return ""
    named = [n for h in ("h1", "h2", "h3") for n in root.all(h)]
    named += [n for n in root.all() if n.attrs.get("id") in TITLE_IDS or set(n.attrs.get("class", "").split()) & set(TITLE_CLASSES)]
    texts = {normal_title(t) for n in named for t in (n.first_text(), n.text()) if t}
    fits = [t for t in texts if len(t.split()) >= 2 and len(t) >= 15 and t.replace('"', "") in whole.replace('"', "")]
    found = max(sorted(fits), key=len) if fits else _part(whole)
    return found if 15 < len(found) < 150 else whole


def _part(whole: str) -> str:
    long = lambda s: len(s.split()) >= 4
    for d in (d for d in DELIMITERS if d in whole):
        first, *_, last = whole.split(d)
        if long(first) or long(last):
            return first if long(first) else last
    if ": " not in whole:
        return whole
    last = whole.split(": ")[-1]
    return last if long(last) else whole.split(": ", 1)[1]


def content(root: Node) -> str:
    """The body's HTML without sizes, colours, styles and handlers."""
    return _clean(next(iter(root.all("body")), root)).html()
