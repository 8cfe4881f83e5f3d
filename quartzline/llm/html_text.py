"""HTML extraction: paragraphs pass points to their ancestors, link density discounts them, the best container and its siblings are kept.

Each page is scored on its own, in one pass without a shuffle. The tree is a few parallel lists: an element is an index, and a child's is
greater than its parent's. Every step is linear in the page: elements count their open kind, so that no end tag searches in vain.

Names of class, id and role discount the points of what stands in an element. Where the best container lies elsewhere, an element is left out by a name that
is a hint as a whole or, outside an article, holds one; in an article, by a name that holds one only if it has many links as well. Headings are never
marked, and ids of sections, paragraphs and lists, which come from titles, mark nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.llm.arrow import map_rows

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed xmp".split())
DROPPED = set("head nav footer aside button select option label fieldset dialog menu svg canvas object audio video".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = set("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary".split())
#: What an opening tag ends: open elements of the first set, as far up as the first of the second.
ENDED = (
    (BLOCKS, {"p"}, {"table", "td", "th", "caption", "article", "section"} | DROPPED),
    ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"tr"}, {"tr", "td", "th"}, {"table"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
)
# Words of class, id and role. The first are never of an article, the second may be part of its wrapper's name.
NEVER = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay comment comments disqus replies respond menu nav navbar navigation breadcrumb breadcrumbs footer share sharing newsletter subscribe subscription signup login pagination pager".split())
SELDOM = set("notice notices sidebar social related recommended toolbar widget contentinfo complementary search dialog alert header masthead banner topbar".split())
#: In an article these are its own.
HEADS = {"header", "masthead", "banner", "topbar"}
#: A hint behind one of these says what an element has, not what it is.
ABOUT = set("has have no not with without is hide hides show shows enable disable".split())
#: Of inline elements only these names drop their text.
INLINE = set("ad ads advert advertisement sponsored share sharing breadcrumb breadcrumbs".split())
#: What the points in an element so marked count: a word of NEVER, a name that is of SELDOM, and one that only holds it.
DISCOUNT = (0.02, 0.05, 0.25)
#: Headings are never marked. Ids of these come from their titles and mark nothing, and in an article only a class that is a word of NEVER does.
HEADINGS, TITLED = set("h1 h2 h3 h4 h5 h6".split()), PARAGRAPHS | {"section", "figure", "table", "ul", "ol", "dl"}
#: A sibling is kept under this link density; beside an article, and further up, from this share of the best container's points on.
DENSITY, SHARE = 0.25, 0.2
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*(=)\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL, SPLIT = re.compile(r"(?<=[a-z0-9])(?=[A-Z])"), re.compile(r"[^a-z0-9]+")


def discount(tag: str, classes: str, ident: str, in_article: bool) -> tuple[float, bool]:
    """(the least discount that the names of an element give, 1 where none is a hint; whether the name alone leaves the element out).

    A name that only holds a hint, and an id in an article, need many links as well to leave an element out.
    """
    if tag in HEADINGS:
        return 1.0, False
    least, alone, titled = 1.0, False, tag in TITLED
    for name, is_id in [(x, False) for x in classes.split()] + [(x, True) for x in ident.split() if not titled]:
        low, words = name.lower(), SPLIT.split(CAMEL.sub("-", name).lower())
        if low in NEVER:
            least, alone = min(least, DISCOUNT[0]), alone or not (in_article and is_id)
            continue
        if in_article and titled:
            continue
        if low in SELDOM and not (in_article and low in HEADS):
            least, alone = min(least, DISCOUNT[1]), alone or not (in_article and is_id)
        for word in words:
            if word in ABOUT:
                break
            if word in NEVER:
                least, alone = min(least, DISCOUNT[2 if in_article else 0]), alone or not in_article
            elif word in SELDOM and not (in_article and word in HEADS):
                least = min(least, DISCOUNT[2])
    return least, alone


class Page:
    """The elements of a page (parent, tag, mark and what applies in them) and its blocks: (element, text, characters, characters in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.mark, self.alone = [-1], ["#root"], [1.0], [False]
        self.junk, self.core, self.block = [False], [False], [0]  # dropped; in an article or main; nearest block element
        self.blocks: list[tuple[int, str, int, int]] = []
        self.stack, self.open_bits, self.inline, self.count = [0], [0], [Counter()], Counter()
        self.pieces: list[str] = []
        self.linked, self.in_link = 0, 0
        self.last_quote = {q: source.rfind(q) for q in "\"'"}
        at = 0
        while (lt := source.find("<", at)) >= 0:
            self.say(source[at:lt])
            at = self.markup(source, lt)
        self.say(source[at:])
        self.flush()

    def say(self, raw: str) -> None:
        if raw and not self.junk[self.stack[-1]]:
            text = html.unescape(raw)
            self.pieces.append(text)
            if self.in_link:
                self.linked += sum(map(len, text.split()))

    def flush(self) -> None:
        if self.pieces:
            words = "".join(self.pieces).split()
            if words:
                self.blocks.append((self.block[self.stack[-1]], " ".join(words), sum(map(len, words)), self.linked))
            self.pieces, self.linked = [], 0

    def markup(self, source: str, lt: int) -> int:
        """Takes what begins at <; the position behind it."""
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 2)
            return len(source) if end < 0 else end + 3
        m = NAME.match(source, lt + 1)
        if m is None:
            if source[lt + 1 : lt + 2] not in ("!", "?", "/"):
                self.say("<")
                return lt + 1
            end = source.find(">", lt)
            return len(source) if end < 0 else end + 1
        name = m[1].lower()
        attributes, end = self.attributes(source, m.end())
        if end < 0:
            return len(source)
        if source[lt + 1] == "/":
            self.close(name)
        elif name in RAW:
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, end)
            return len(source) if not shut else shut.end()
        elif name == "br":
            self.say(" ")
        elif name in VOID:
            if name in BLOCKS:
                self.flush()
        else:
            self.open(name, attributes)
        return end

    def attributes(self, source: str, at: int) -> tuple[dict[str, str], int]:
        """The attributes from at on, the first of a name counting, and the position behind the tag, -1 where it doesn't end."""
        found: dict[str, str] = {}
        while True:
            m = ATTRIBUTE.match(source, at)
            if m is None:
                end = source.find(">", at)  # white space and slashes alone are left before it
                return found, end + 1 if end >= 0 else -1
            at, value = m.end(), ""
            if m[2]:
                quote = source[at : at + 1]
                if quote in ("'", '"') and self.last_quote[quote] > at:
                    end = source.find(quote, at + 1)
                    value, at = source[at + 1 : end], end + 1
                else:
                    u = UNQUOTED.match(source, at)
                    value, at = u[0], u.end()
            found.setdefault(m[1].lower(), value)

    def open(self, name: str, attributes: dict[str, str]) -> None:
        if name in BLOCKS:
            self.flush()
        for bit, (tags, _, _) in enumerate(ENDED):
            if name in tags:
                self.end_implied(bit)
        top = self.stack[-1]
        core = name in ("article", "main") or attributes.get("role", "").lower() == "main"
        names = " ".join(attributes[a] for a in ("class", "role") if a in attributes)
        ident = attributes.get("id", "")
        shown = "hidden" not in attributes and attributes.get("aria-hidden", "").lower() != "true" and not UNSHOWN.search(attributes.get("style", ""))
        junk = self.junk[top] or not shown or name in DROPPED or name == "header" and not self.core[top]
        mark, alone = 1.0, False
        if name == "form":
            mark, alone = DISCOUNT[0], True
        elif (names or ident) and name in BLOCKS and not core and name not in ("html", "body"):
            mark, alone = discount(name, html.unescape(names), html.unescape(ident), self.core[top])
        elif (names or ident) and name not in BLOCKS:
            junk = junk or not INLINE.isdisjoint(f"{names} {ident}".lower().split())
        self.parent.append(top)
        self.tag.append(name)
        self.mark.append(mark)
        self.alone.append(alone)
        self.core.append(self.core[top] or core)
        self.junk.append(junk)
        at = len(self.tag) - 1
        self.block.append(at if name in BLOCKS else self.block[top])
        bits = self.open_bits[-1]
        for bit, (_, ended, fence) in enumerate(ENDED):
            bits = bits | 1 << bit if name in ended else bits & ~(1 << bit) if name in fence else bits
        self.stack.append(at)
        self.open_bits.append(bits)
        self.count[name] += 1
        if name in BLOCKS:
            self.inline.append(Counter())
        else:
            self.inline[-1][name] += 1
        self.in_link += name == "a"

    def end_implied(self, bit: int) -> None:
        """Ends the outermost open element of a kind before its fence; the bits say whether one is left."""
        while self.open_bits[-1] >> bit & 1:
            k = len(self.stack) - 1
            while self.tag[self.stack[k]] not in ENDED[bit][1]:
                k -= 1
            self.pop_to(k)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            name = self.tag[self.stack.pop()]
            self.open_bits.pop()
            self.count[name] -= 1
            if name in BLOCKS:
                self.inline.pop()
            else:
                self.inline[-1][name] -= 1
            self.in_link -= name == "a"

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if not self.count[name] or name not in BLOCKS and not self.inline[-1][name]:  # a stray inline end tag ends no block
            return
        k = len(self.stack) - 1
        while self.tag[self.stack[k]] != name:
            k -= 1
        self.pop_to(k)


def score(page: Page, at: int, text: str) -> float:
    """A block's points: one for being a paragraph or long, one a comma, and up to three by length."""
    return (page.tag[at] in PARAGRAPHS or len(text) > 80) + text.count(",") + min(len(text) / 100, 3.0)


def best_container(page: Page, length: list[int], density: list[float], total: list[float], paragraphs: list[int]) -> int:
    """The element of the most points, -1 for none. Points go in full to a paragraph's parent and by half to the next, but leave no marked element."""
    n, parent = len(page.tag), page.parent
    weight, points, filled = page.mark[:], [0.0] * n, page.core[:]
    for i in range(1, n):
        weight[i] *= weight[parent[i]]
    for i in range(n - 1, 0, -1):
        filled[parent[i]] |= filled[i] and length[i] > 0
    for at, text, _, _ in page.blocks:
        owner = parent[at] if page.tag[at] in PARAGRAPHS and parent[at] >= 0 and page.mark[at] == 1 else at
        worth = score(page, at, text) * weight[at]
        points[owner] += worth
        if parent[owner] >= 0 and page.mark[owner] == 1:
            points[parent[owner]] += worth / 2
    best, most = -1, -1.0
    for i in range(n):
        may = weight[i] == 1 or filled[i] or paragraphs[i] > 0
        if length[i] and may and points[i] * (1 - density[i]) > most:
            best, most = i, points[i] * (1 - density[i])
    return best


def main_text(source: str | None) -> str:
    """The main text of one page; empty for null, empty or textless html."""
    page = Page(source or "")
    n, parent, tag = len(page.tag), page.parent, page.tag
    length, linked, total, paragraphs = [0] * n, [0] * n, [0.0] * n, [0] * n
    for at, text, size, inside in page.blocks:
        length[at] += size
        linked[at] += inside
        total[at] += score(page, at, text)
        paragraphs[at] += tag[at] in PARAGRAPHS or len(text) > 80
    for i in range(n - 1, 0, -1):
        for sums in (length, linked, total, paragraphs):
            sums[parent[i]] += sums[i]
    density = [k / m if m else 0.0 for k, m in zip(linked, length, strict=True)]
    best = best_container(page, length, density, total, paragraphs)
    if best < 0:
        return ""
    holds, up = [False] * n, best  # the elements around the best container, which their marks don't drop
    while up >= 0:
        holds[up], up = True, parent[up]
    out, within = [False] * n, [False] * n
    for i in range(1, n):
        within[i] = within[parent[i]] or i == best
        outside = not within[i] and not page.core[i]
        out[i] = out[parent[i]] or page.mark[i] < 1 and not holds[i] and (page.alone[i] or outside or density[i] >= DENSITY)
    up = best
    while page.core[best] and up > 0:  # an article's parts belong together
        if tag[up] in ("article", "main") or not page.core[parent[up]]:
            best = up
            break
        up = parent[up]
    kept = [False] * n
    kept[best] = True
    level: dict[int, int] = {}  # parents of the best container and of those around it, up to the page's body, and their distance
    up = best
    while up > 0 and tag[up] not in ("body", "html"):
        level[parent[up]] = len(level)
        up = parent[up]
        if page.core[best]:
            break
    for i in range(1, n):
        d = level.get(parent[i], -1)
        if d < 0 or holds[i] or not length[i]:
            continue
        least = max(1.0, SHARE * total[best]) if d or page.core[best] else 1.0
        heading = tag[i] in ("h1", "h2") and density[i] == 0
        prose = not d and tag[i] in PARAGRAPHS and density[i] < DENSITY and (length[i] > 80 or density[i] == 0)
        kept[i] = heading or prose or paragraphs[i] > 0 and density[i] < DENSITY and total[i] * (1 - density[i]) >= least
    for i in range(1, n):
        kept[i] = (kept[i] or kept[parent[i]]) and not out[i]
    return "\n\n".join(text for at, text, _, _ in page.blocks if kept[at])


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the main text of every page; empty for null or empty html and for pages without text.

    Repeated rows repeat; other columns are ignored; an empty table gives an empty result. Broken markup is read as far as it goes: an open
    comment, tag or script hides what follows it. Pages of any length are read whole, in time linear in the page.
    """

    def one(ident, address, raw):
        text = main_text(raw)
        yield ident, address, text, len(text)

    return map_rows(pages.select(F.col(key).cast("long"), url, source), one, f"{key} long, url string, text string, n_chars long")
